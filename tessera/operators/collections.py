"""Document collections: frames (_id, doc) with doc as JSON text, filtered, updated and piped as a document database does.

Everything but the update of a document is built of Catalyst expressions over the JSON
text; an update needs the whole document and is an Arrow-batched UDF.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COMPARE = {"$eq": "__eq__", "$gt": "__gt__", "$gte": "__ge__", "$lt": "__lt__", "$lte": "__le__", "$ne": "__ne__"}


class Unsupported(ValueError):
    pass


def path_of(field: str, nested: bool) -> str:
    """JSON path of a field: dots nest in find, and are part of the key in a pipeline."""
    parts = field.split(".") if nested else [field]
    if any("'" in p for p in parts):
        raise Unsupported(f"field {field!r}")
    return "$" + "".join(f"['{p}']" for p in parts)


class Fields:
    """Fields of the document text, or of columns that earlier stages made."""

    def __init__(self, made: set[str] | None = None, nested: bool = False, doc: str = "doc"):
        self.made, self.nested, self.doc = made or set(), nested, doc

    def __call__(self, field: str) -> Column:
        if field in self.made or field == "_id":
            return F.col(f"`{field}`")
        return F.get_json_object(F.col(self.doc), path_of(field, self.nested))


def _literal(value) -> Column:
    if isinstance(value, bool):
        return F.lit("true" if value else "false")
    if isinstance(value, (dict, list)):
        return F.lit(json.dumps(value, separators=(",", ":")))
    return F.lit(value)


def _number(value) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def condition(query: dict, fields: Fields, missing_matches: bool) -> Column:
    """A filter document.  missing_matches: $ne and $nin are true of absent fields (find), or not (pipelines)."""
    out = F.lit(True)
    for field, want in query.items():
        if field in ("$and", "$or"):
            parts = [condition(q, fields, missing_matches) for q in want]
            if not parts:
                raise Unsupported(f"empty {field}")
            one = parts[0]
            for p in parts[1:]:
                one = one & p if field == "$and" else one | p
        elif field == "$not":
            one = ~condition(want, fields, missing_matches)
        elif field.startswith("$"):
            raise Unsupported(field)
        else:
            one = _field(fields, field, want, missing_matches)
        out = out & one
    return out


def _field(fields: Fields, field: str, want, missing_matches: bool) -> Column:
    if not (isinstance(want, dict) and want and all(k.startswith("$") for k in want)):
        want = {"$eq": want}
    value, out = fields(field), F.lit(True)
    for op, x in want.items():
        if op in _COMPARE:
            if x is None and op in ("$eq", "$ne"):
                one = value.isNull() if op == "$eq" else value.isNotNull()
            else:
                have = value.try_cast("double") if _number(x) else value.cast("string")
                one = getattr(have, _COMPARE[op])(F.lit(float(x)) if _number(x) else _literal(x))
                if op == "$ne" and missing_matches:
                    one = one | value.isNull()
        elif op in ("$in", "$nin"):
            numbers = all(_number(v) for v in x)
            have = value.try_cast("double") if numbers else value.cast("string")
            one = have.isin([float(v) if numbers else v if isinstance(v, str) else json.dumps(v) for v in x]) if x else F.lit(False)
            if op == "$nin":
                one = ~one | value.isNull() if missing_matches else ~one
        elif op == "$exists":
            one = value.isNotNull() if x else value.isNull()
        elif op == "$regex" and missing_matches:
            one = value.rlike(x)
        elif op == "$not":
            one = ~_field(fields, field, x, missing_matches)
        else:
            raise Unsupported(op)
        out = out & one
    return out


def find(coll: DataFrame, query: dict | None = None, projection: dict | None = None, sort: dict | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """(_id, doc) of matching documents.  Sorting compares fields as text, nulls last."""
    fields = Fields(nested=True)
    df = coll.where(condition(query or {}, fields, True))
    if sort:
        df = df.orderBy(*[(fields(f).asc_nulls_last() if d > 0 else fields(f).desc_nulls_last()) for f, d in sort.items()])
    if skip:
        df = df.offset(skip)
    if limit is not None:
        df = df.limit(limit)
    return project_documents(df, projection) if projection else df


def count(coll: DataFrame, query: dict | None = None) -> int:
    return coll.where(condition(query or {}, Fields(nested=True), True)).count()


def project_documents(df: DataFrame, projection: dict) -> DataFrame:
    """Top-level inclusion (keeps _id unless it is 0) or exclusion; mixed is inclusion."""
    ins = [k for k, v in projection.items() if v and k != "_id"]
    outs = [k for k, v in projection.items() if not v]
    keep = ins or None

    def run(docs: pd.Series, ids: pd.Series) -> pd.Series:
        made = []
        for text in docs:
            try:
                d = json.loads(text) if text is not None else {}
            except ValueError:
                d = {}
            d = {k: v for k, v in d.items() if (k in keep if keep is not None else k not in outs)} if isinstance(d, dict) else {}
            made.append(json.dumps(d, ensure_ascii=False, separators=(",", ":")))
        return pd.Series(made, dtype=object)

    out = df.withColumn("doc", F.pandas_udf(run, "string")("doc", "_id"))
    return out.drop("_id") if "_id" in outs else out


def pipeline(coll: DataFrame, stages: list[dict], collections: dict[str, DataFrame] | None = None) -> DataFrame:
    """An aggregation pipeline, one lazy frame throughout."""
    df, made = coll, set()
    for stage in stages:
        if len(stage) != 1:
            raise Unsupported("a stage has one key")
        (name, spec), fields = next(iter(stage.items())), Fields(made)
        if name == "$match":
            df = df.where(condition(spec, fields, False))
        elif name == "$sort":
            df = df.orderBy(*[(fields(f).asc_nulls_last() if d > 0 else fields(f).desc_nulls_last()) for f, d in spec.items()])
        elif name == "$limit":
            df = df.limit(int(spec))
        elif name == "$skip":
            df = df.offset(int(spec))
        elif name == "$count":
            df, made = df.agg(F.count(F.lit(1)).alias(spec)), {spec}
        elif name == "$group":
            df, made = _group(df, spec, fields)
        elif name == "$project":
            df, made = _project(df, spec, fields)
        elif name in ("$addFields", "$set"):
            df = df.withColumns({f: fields(v[1:]) if isinstance(v, str) and v.startswith("$") else _literal(v) for f, v in spec.items()})
            made = made | set(spec)
        elif name == "$lookup":
            df, made = _lookup(df, spec, fields, collections or {}), made | {spec["as"]}
        elif name == "$unwind":
            df, made = _unwind(df, spec if isinstance(spec, str) else spec["path"], fields)[0], made | {(spec if isinstance(spec, str) else spec["path"])[1:]}
        else:
            raise Unsupported(name)
    return df


def _group(df: DataFrame, spec: dict, fields: Fields) -> tuple[DataFrame, set]:
    by, aggs = spec["_id"], []
    for name, acc in spec.items():
        if name == "_id":
            continue
        (op, arg), = acc.items()
        value = fields(arg[1:]).try_cast("double") if isinstance(arg, str) and arg.startswith("$") else None
        if op == "$count" or op == "$sum" and _number(arg):
            aggs.append(F.count(F.lit(1)).alias(name))
        elif op in ("$sum", "$avg", "$min", "$max") and value is not None:
            aggs.append(getattr(F, op[1:])(value).alias(name))
        else:
            raise Unsupported(f"{op} of {arg!r}")
    if by is not None and not (isinstance(by, str) and by.startswith("$")):
        raise Unsupported(f"_id {by!r}")
    key = F.lit(None).cast("string") if by is None else fields(by[1:])
    out = df.groupBy(key.alias("_id")).agg(*aggs)
    return out, {n for n in spec}


def _project(df: DataFrame, spec: dict, fields: Fields) -> tuple[DataFrame, set]:
    cols = {}
    for name, x in spec.items():
        if isinstance(x, str) and x.startswith("$"):
            cols[name] = fields(x[1:])
        elif x:
            cols[name] = fields(name)
    return df.select(*[c.alias(n) for n, c in cols.items()]), set(cols)


def _lookup(df: DataFrame, spec: dict, fields: Fields, collections: dict[str, DataFrame]) -> DataFrame:
    """The right side is gathered by its key before the join, so the left is never regrouped."""
    if "." in spec["localField"] or "." in spec["foreignField"]:
        raise Unsupported("dotted keys")
    right = collections[spec["from"]].select(Fields()(spec["foreignField"]).alias("_fk"), "doc").where("_fk is not null")
    many = right.groupBy("_fk").agg(F.sort_array(F.collect_list("doc")).alias("_many"))
    joined = df.withColumn("_lk", fields(spec["localField"])).join(many, F.col("_lk") == F.col("_fk"), "left")
    return joined.withColumn(spec["as"], F.coalesce("_many", F.array().cast("array<string>"))).drop("_lk", "_fk", "_many")


def _unwind(df: DataFrame, path: str, fields: Fields) -> tuple[DataFrame, str]:
    name = path[1:]
    kind = dict(df.dtypes).get(name, "")
    if kind.startswith("array"):
        items = F.col(f"`{name}`")
    else:
        text = fields(name)
        items = F.when(text.startswith("["), F.from_json(text, "array<string>")).when(text.isNotNull(), F.array(text))
    return df.withColumn(name, F.explode(items)), name


def updated(doc: dict, change: dict) -> dict:
    """A document after an update document; a replacement keeps _id."""
    if not any(k.startswith("$") for k in change):
        return ({"_id": doc["_id"]} if "_id" in doc else {}) | change
    doc = dict(doc)
    for op, fields in change.items():
        for f, x in fields.items():
            if op == "$set":
                doc[f] = x
            elif op == "$unset":
                doc.pop(f, None)
            elif op == "$inc":
                doc[f] = int(total) if (total := doc.get(f, 0) + x) == int(total) else total
            elif op == "$push":
                if not isinstance(doc.get(f, []), list):
                    raise ValueError(f"$push needs an array in {f!r}")
                doc[f] = [*doc.get(f, []), x]
            elif op == "$pull":
                if isinstance(doc.get(f), list):
                    doc[f] = [v for v in doc[f] if v != x]
            else:
                raise Unsupported(op)
    return doc


def update(coll: DataFrame, query: dict, change: dict, multi: bool = False) -> DataFrame:
    """The changed documents (_id, doc): what a change log takes.  Without multi, the one with the least _id."""
    hit = coll.where(condition(query, Fields(nested=True), True))
    hit = hit if multi else hit.orderBy("_id").limit(1)

    def run(docs: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(updated(json.loads(d), change), ensure_ascii=False, separators=(",", ":")) for d in docs], dtype=object)

    return hit.withColumn("doc", F.pandas_udf(run, "string")("doc"))


def expired(coll: DataFrame, field: str, seconds: int, now: float) -> DataFrame:
    """(_id, doc) whose time (epoch seconds, RFC 3339 or a date) is ``seconds`` old; others never expire."""
    text = Fields(nested=True)(field)
    at = F.coalesce(text.try_cast("double"), F.unix_micros(F.try_to_timestamp(text)) / 1e6)
    return coll.where(at + F.lit(float(seconds)) <= F.lit(float(now)))


def new_id() -> Column:
    """24 hexadecimal digits: seconds, then random ones."""
    return F.concat(F.lpad(F.lower(F.hex(F.unix_timestamp())), 8, "0"), F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16))
