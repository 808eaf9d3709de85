"""Full-text search: analyzers, postings, boolean and phrase queries, BM25, and a structured search language.

Postings are a frame (pk, term, tf, positions), derived in built-in functions for the
analyzers without a stemmer.  Queries are semi joins and aggregations on postings;
statistics are global.  The stemmer is a batched UDF over the distinct terms of a text.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

K1, B = 1.2, 0.75
ANALYZERS = {"english": "en_stem", "en": "en_stem", "english_stem": "en_stem", "simple": "default", "standard": "default", "default": "default", "whitespace": "whitespace", "ws": "whitespace", "raw": "raw", "keyword": "raw", "exact": "raw"}
MAX_PAGE = 10_000


def stem(word: str) -> str:
    """Plurals and the commonest English suffixes, by rule."""
    w = word
    if len(w) <= 2:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy].", w[:-2] + "."):
        w = w[:-1]
    for suffix in ("eedly", "eed", "ingly", "edly", "ing", "ed"):
        if w.endswith(suffix):
            base = w[: -len(suffix)]
            if suffix.startswith("ee"):
                w = base + "ee" if re.search("[aeiouy][^aeiouy]", base) else w
            elif re.search("[aeiouy]", base):
                w = base + "e" if base.endswith(("at", "bl", "iz")) else base[:-1] if len(base) > 1 and base[-1] == base[-2] and base[-1] in "bdfgmnprt" else base
            break
    if len(w) > 2 and w[-1] == "y" and w[-2] not in "aeiou":
        w = w[:-1] + "i"
    for suffix, to in (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al")):
        if w.endswith(suffix) and re.search("[aeiouy][^aeiouy]", w[: -len(suffix)]):
            return w[: -len(suffix)] + to
    return w


def analyze(text: str, analyzer: str) -> list[str]:
    """Terms of a query text, as the columns are analyzed."""
    kind = ANALYZERS.get(analyzer, "default")
    if kind == "raw":
        return [text]
    if kind == "whitespace":
        return text.lower().split()
    terms = [t.lower() for t in re.findall(r"[^\W_]+", text) if len(t.encode()) <= 40]
    return [stem(t) for t in terms] if kind == "en_stem" else terms


@F.pandas_udf(ArrayType(StringType()))
def _stems(terms: pd.Series) -> pd.Series:
    memo: dict[str, str] = {}
    return pd.Series([[memo.setdefault(t, stem(t)) for t in x] if x is not None else None for x in terms], dtype=object)


def terms(text: Column, analyzer: str) -> Column:
    """array<string> of a text column's terms, in order; null gives none."""
    kind = ANALYZERS.get(analyzer, "default")
    if kind == "raw":
        return F.when(text.isNull(), F.array().cast("array<string>")).otherwise(F.array(text))
    cut = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+" if kind == "whitespace" else r"[^\p{L}\p{N}]+")
    kept = F.filter(cut, lambda t: (t != "") & ((F.octet_length(t) <= 40) if kind != "whitespace" else F.lit(True)))
    return _stems(kept) if kind == "en_stem" else kept


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, if it is read in fewer tasks than there are: so no more is moved than that many tasks read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def postings(df: DataFrame, pk: str, text: str, analyzer: str = "default") -> DataFrame:
    """(pk, term, tf, positions)"""
    each = spread(df.select(pk, text)).select(F.col(pk).alias("pk"), F.posexplode(terms(F.col(text), analyzer)).alias("pos", "term"))
    return each.groupBy("pk", "term").agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def merge_live(durable: DataFrame, live: DataFrame, touched: DataFrame) -> DataFrame:
    """Durable postings without the keys that live ones touch, and the live postings."""
    return durable.join(touched.select("pk").distinct(), "pk", "left_anti").unionByName(live)


def bm25(posts: DataFrame, wanted: list[str]) -> DataFrame:
    """(pk, score) of keys with any of the terms; idf = ln(1 + (N - df + 0.5) / (df + 0.5))."""
    sizes = posts.groupBy("pk").agg(F.sum("tf").alias("len"))
    n, mean = sizes.agg(F.count(F.lit(1)), F.avg("len")).first()
    hits = posts.where(F.col("term").isin(wanted))
    dfs = {r["term"]: r["df"] for r in hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}  # one row a query term
    idf = F.create_map(*[x for t in dfs for x in (F.lit(t), F.log(F.lit(1 + (n - dfs[t] + 0.5) / (dfs[t] + 0.5))))]) if dfs else F.create_map(F.lit(""), F.lit(0.0))
    tf = F.col("tf").cast("double")
    part = F.element_at(idf, F.col("term")) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean)))
    return hits.join(sizes, "pk").groupBy("pk").agg(F.sum(part).alias("score"))


def bm25_scan(df: DataFrame, pk: str, text: str, wanted: list[str], analyzer: str = "default") -> DataFrame:
    """What bm25() gives for the postings of df, from two scans of the texts: counts of the wanted terms alone, nothing shuffled but one row a task."""
    words = sorted(set(wanted))
    # generated, so that the optimiser doesn't copy what makes the terms, or counts them, into each use
    each = spread(df.select(pk, text)).select(F.col(pk).alias("pk"), F.explode(F.array(terms(F.col(text), analyzer))).alias("terms"))
    tfs = F.array(*[F.size("terms") - F.size(F.array_remove("terms", F.lit(w))) for w in words])
    each = each.select("pk", F.inline(F.array(F.struct(F.size("terms").alias("len"), tfs.alias("tf"))))).where("len > 0")
    n, mean, *dfs = each.agg(F.count(F.lit(1)), F.avg("len"), *[F.sum((F.get("tf", F.lit(k)) > 0).cast("int")) for k in range(len(words))]).first()
    parts = []
    for k, seen in enumerate(dfs):
        tf = F.get("tf", F.lit(k)).cast("double")
        parts.append(F.lit(math.log(1 + (n - (seen or 0) + 0.5) / ((seen or 0) + 0.5))) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(mean or 1.0))))
    return each.where(F.exists("tf", lambda x: x > 0)).select("pk", sum(parts, F.lit(0.0)).alias("score"))


# -- queries: trees of ("term", t) ("phrase", [..]) ("and", [..]) ("or", [..]) ("not", x) ("all",) ("none",)


def plain(text: str, analyzer: str) -> tuple:
    return ("and", [("term", t) for t in analyze(re.sub(r"[^\w\s]", " ", text).lower(), analyzer)]) if text.strip() else ("none",)


def tsquery(text: str, analyzer: str) -> tuple:
    """& is and, | is or, ! is not; weights and prefixes are stripped."""
    parts = re.findall(r"[&|!()]|[^\s&|!()]+", re.sub(r":[*A-Da-d]*", "", text))
    pos = 0

    def either():
        nonlocal pos
        found = [both()]
        while pos < len(parts) and parts[pos] == "|":
            pos += 1
            found.append(both())
        return found[0] if len(found) == 1 else ("or", found)

    def both():
        nonlocal pos
        found = [one()]
        while pos < len(parts) and parts[pos] not in "|)":
            if parts[pos] == "&":
                pos += 1
            found.append(one())
        return found[0] if len(found) == 1 else ("and", found)

    def one():
        nonlocal pos
        t = parts[pos]
        pos += 1
        if t == "!":
            return ("not", one())
        if t == "(":
            x = either()
            pos += 1
            return x
        own = analyze(t, analyzer)
        return ("term", own[0]) if len(own) == 1 else ("and", [("term", x) for x in own])

    return either() if parts else ("none",)


def websearch(text: str, analyzer: str) -> tuple:
    """Words are and-ed; "phrases", -excluded, and or between."""
    groups, current = [], []
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            groups.append(current)
            current = []
            continue
        own = analyze(phrase or word, analyzer)
        if own:
            node = ("term", own[0]) if len(own) == 1 else ("phrase", own)
            current.append(("not", node) if minus else node)
    groups.append(current)
    groups = [("and", g) for g in groups if g]
    return ("none",) if not groups else groups[0] if len(groups) == 1 else ("or", groups)


def matches(posts: DataFrame, query: tuple, keys: DataFrame | None = None) -> DataFrame:
    """(pk) of what the query holds for.  keys (pk): all documents, those without a term included; else those that have one."""
    everything = posts.select("pk").distinct() if keys is None else keys
    kind = query[0]
    if kind == "all":
        return everything
    if kind == "none":
        return everything.limit(0)
    if kind == "term":
        return posts.where(F.col("term") == query[1]).select("pk").distinct()
    if kind == "phrase":
        words = query[1]
        own = posts.where(F.col("term").isin(words))

        def places(i: int, word: str) -> Column:
            """Where the phrase would begin if this is its i-th word."""
            found = F.transform("positions", lambda p: F.struct((p - i).alias("at"), F.lit(i).alias("i")))
            return F.when(F.col("term") == word, found).otherwise(F.array().cast("array<struct<at:int,i:int>>"))

        begin = F.explode(F.filter(F.flatten(F.array(*[places(i, w) for i, w in enumerate(words)])), lambda x: x["at"] >= 0))
        return own.select("pk", begin.alias("x")).groupBy("pk", "x.at").agg(F.count_distinct("x.i").alias("n")).where(F.col("n") == len(words)).select("pk").distinct()
    if kind == "not":
        return everything.join(matches(posts, query[1], keys), "pk", "left_anti")
    parts = query[1]
    if kind == "or":
        out = matches(posts, parts[0], keys)
        for p in parts[1:]:
            out = out.union(matches(posts, p, keys))
        return out.distinct()
    # and: all plain terms in one aggregation
    plain_terms = sorted({p[1] for p in parts if p[0] == "term"})
    rest = [p for p in parts if p[0] != "term"]
    out = everything
    if plain_terms:
        out = posts.where(F.col("term").isin(plain_terms)).groupBy("pk").agg(F.count_distinct("term").alias("n")).where(F.col("n") == len(plain_terms)).select("pk")
    for p in rest:
        out = out.join(matches(posts, p[1], keys), "pk", "left_anti") if p[0] == "not" else out.join(matches(posts, p, keys), "pk", "left_semi")
    return out


def positive_terms(query: tuple) -> list[str]:
    kind = query[0]
    if kind == "term":
        return [query[1]]
    if kind == "phrase":
        return list(query[1])
    return sorted({t for p in query[1] for t in positive_terms(p)}) if kind in ("and", "or") else []


def ranked(posts: DataFrame, query: tuple) -> DataFrame:
    """(pk, score) of matching keys, best first; ties by key."""
    return bm25(posts, positive_terms(query)).join(matches(posts, query), "pk", "left_semi").orderBy(F.col("score").desc(), "pk")


def highlight(text: Column, wanted: list[str]) -> Column:
    """<em> around runs of letters and digits that begin with a term, whatever their case."""
    if not wanted:
        return text
    any_of = "|".join(re.escape(t) for t in sorted(wanted, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])((?:{any_of})[\p{{L}}\p{{N}}]*)", "<em>$1</em>")


# -- the structured language


@dataclass
class Index:
    """A mapping {field: {"type": text|keyword|integer|long, "analyzer": ...}} over a frame with a key ``_id``."""

    df: DataFrame
    mapping: dict

    def __post_init__(self):
        if "_id" in self.mapping:
            raise ValueError("_id is reserved")
        for f, m in self.mapping.items():
            if m["type"] not in ("text", "keyword", "integer", "long"):
                raise ValueError(f"{f}: type {m['type']!r}")
        self._posts: dict[str, DataFrame] = {}

    def posts(self, field: str) -> DataFrame:
        m = self.mapping[field]
        if field not in self._posts:
            self._posts[field] = postings(self.df, "_id", field, m.get("analyzer", "standard") if m["type"] == "text" else "raw")
        return self._posts[field]

    def field(self, name: str) -> dict:
        if name not in self.mapping:
            raise ValueError(f"no field {name!r} in the mapping")
        return self.mapping[name]

    def _tree(self, field: str, text: str, operator: str) -> tuple:
        m = self.field(field)
        own = analyze(str(text), m.get("analyzer", "standard") if m["type"] == "text" else "raw")
        return (operator, [("term", t) for t in own]) if own else ("none",)

    def ids(self, query: dict) -> DataFrame:
        """(_id) of the documents that match."""
        (kind, body), = query.items() if query else [("match_all", {})]
        everything = self.df.select("_id")
        if kind == "match_all":
            return everything
        if kind in ("match", "match_phrase"):
            (field, spec), = body.items()
            text, op = (spec["query"], spec.get("operator", "or").lower()) if isinstance(spec, dict) else (spec, "or")
            tree = self._tree(field, text, op)
            if kind == "match_phrase" and tree[0] != "none":
                tree = ("phrase", [t[1] for t in tree[1]]) if len(tree[1]) > 1 else tree[1][0]
            return matches(self.posts(field), tree).select(F.col("pk").alias("_id"))
        if kind == "term":
            (field, value), = body.items()
            value = value["value"] if isinstance(value, dict) else value
            if self.field(field)["type"] == "text":
                return matches(self.posts(field), ("term", str(value))).select(F.col("pk").alias("_id"))
            return self.df.where(F.col(field) == F.lit(value)).select("_id")
        if kind == "range":
            (field, spec), = body.items()
            if self.field(field)["type"] == "text":
                raise ValueError("range needs an integer or keyword field")
            cond = F.lit(True)
            for op, v in spec.items():
                cond = cond & {"gt": F.col(field) > v, "gte": F.col(field) >= v, "lt": F.col(field) < v, "lte": F.col(field) <= v}[op]
            return self.df.where(cond).select("_id")
        if kind == "exists":
            field = body["field"]
            if self.field(field)["type"] == "text":
                return self.posts(field).select(F.col("pk").alias("_id")).distinct()
            return self.df.where(F.col(field).isNotNull()).select("_id")
        if kind == "bool":
            as_list = lambda k: body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]]
            must, should, never = as_list("must") + as_list("filter"), as_list("should"), as_list("must_not")
            if not must and not should and not never:
                raise ValueError("an empty bool query")
            out = everything
            for q in must:
                out = out.join(self.ids(q), "_id", "left_semi")
            if should and not must:
                any_of = self.ids(should[0])
                for q in should[1:]:
                    any_of = any_of.union(self.ids(q))
                out = out.join(any_of, "_id", "left_semi")
            for q in never:
                out = out.join(self.ids(q), "_id", "left_anti")
            return out
        raise ValueError(f"unsupported query {kind!r}")

    def scoring(self, query: dict) -> list[tuple[str, list[str]]]:
        """(field, terms) that score and are highlighted."""
        (kind, body), = query.items() if query else [("match_all", {})]
        if kind in ("match", "match_phrase"):
            (field, spec), = body.items()
            return [(field, positive_terms(self._tree(field, spec["query"] if isinstance(spec, dict) else spec, "or")))]
        if kind == "bool":
            return [x for k in ("must", "filter", "should") for q in (body.get(k, []) if isinstance(body.get(k, []), list) else [body[k]]) for x in self.scoring(q)]
        return []

    def hits(self, request: dict) -> DataFrame:
        """(_id, _score, columns of the source, and highlight_<field>) of one page, best first."""
        query = request.get("query", {"match_all": {}})
        first, size = request.get("from", 0), request.get("size", 10)
        if first + size > MAX_PAGE:
            raise ValueError(f"from + size is {MAX_PAGE} at most")
        found = self.df.join(self.ids(query), "_id", "left_semi").withColumn("_score", F.lit(0.0))
        scoring = self.scoring(query)
        for field, wanted in scoring:
            s = bm25(self.posts(field), wanted).select(F.col("pk").alias("_id"), F.col("score").alias("_s"))
            found = found.join(s, "_id", "left").withColumn("_score", F.col("_score") + F.coalesce("_s", F.lit(0.0))).drop("_s")
        if not scoring:
            found = found.withColumn("_score", F.lit(1.0))
        sort = (request.get("sort") or [{"_score": "desc"}])[0]
        name, way = next(iter(sort.items())) if isinstance(sort, dict) else (sort, "desc" if sort == "_score" else "asc")
        way = way["order"] if isinstance(way, dict) else way
        if name != "_score" and self.field(name)["type"] not in ("integer", "long"):
            raise ValueError("sort by _score or an integer field")
        key = F.col(name).desc_nulls_last() if way == "desc" else F.col(name).asc_nulls_last()
        page = found.orderBy(key, "_id").offset(first).limit(size)
        for field in request.get("highlight", {}).get("fields", {}):
            page = page.withColumn(f"highlight_{field}", highlight(F.col(field), sorted({t for f, ts in scoring if f == field for t in ts})))
        source = request.get("_source")
        return page.select("_id", "_score", *source, *[c for c in page.columns if c.startswith("highlight_")]) if source else page

    def envelope(self, request: dict) -> dict:
        query = request.get("query", {"match_all": {}})
        rows = [r.asDict() for r in self.hits(request).collect()]  # one page
        return {"total": {"value": self.ids(query).distinct().count(), "relation": "eq"}, "max_score": rows[0]["_score"] if rows else None, "hits": [{"_id": r.pop("_id"), "_score": r.pop("_score"), "_source": json.loads(json.dumps(r, default=str))} for r in rows]}
