"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` with literal tokens (runs of
a-z and 0-9) that any match must contain whole.  A rule is filed under that token of
its own which the fewest URLs have.  The tokens of a URL fetch candidate rules, and
only those run their expression.  Everything is one projection over the URL column
of built-in functions, after one counting pass for the rarity; nothing is shuffled
but the counts of the rules' own tokens.

Cases: a null URL, or one without ``://``, has an empty host and path and no tokens,
so only rules without literals can match it; empty tables give empty results;
repeated rows are judged each; other columns, whatever their names, pass through
``judge_urls`` untouched unless they bear an output name, which replaces them.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules are literals of the plan; more than this belong in several passes.
MAX_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """name is reported; pattern is matched (as ``rlike``) against host + path; tokens are the whole literals it needs."""

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]


def prefix_rule(name: str, verdict: str) -> Rule:
    """A rule like ``example.net/en/``: its host and all subdomains, paths that begin with its path."""
    host, slash, path = name.partition("/")
    path = slash + path
    quoted = "".join(c if c.isascii() and c.isalnum() or c in "/_" or not c.isascii() else "\\" + c for c in host + path)
    whole = re.findall(r"[a-z0-9]+", host.lower())
    inner = path.lower()
    whole += [m.group() for m in re.finditer(r"[a-z0-9]+", inner) if m.end() < len(inner)]  # the last run may go on in the URL
    return Rule(name, verdict, rf"^(?:[^/]*\.)?{quoted}", tuple(dict.fromkeys(whole)))


def word_rule(word: str, verdict: str = "block") -> Rule:
    """A rule for hosts that have a word as a token of their own."""
    return Rule(word, verdict, rf"^(?:[^/]*[^a-z0-9/])?{word}(?:[^a-z0-9]|$)", (word,))


#: Words of hosts that the method itself refuses.
HOST_WORDS = ("adult", "bet", "casino", "escort", "gambling", "hentai", "nude", "phishing", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
METHOD_RULES = tuple(word_rule(w) for w in HOST_WORDS)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def tokens_of(target: Column) -> Column:
    return F.array_distinct(F.split(F.translate(target, _UPPER, _LOWER), "[^a-z0-9]+"))


def token_counts(df: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the given tokens is; as many rows reach the driver as tokens are given."""
    if not tokens:
        return {}
    target = F.concat(host_of(F.col(url)), path_of(F.col(url)))
    own = F.array_intersect(tokens_of(target), F.array(*[F.lit(t) for t in tokens]))
    rows = df.select(F.explode(own).alias("token")).groupBy("token").count().collect()
    return {r["token"]: r["count"] for r in rows}


def judge_urls(df: DataFrame, url: str = "url", rules: tuple[Rule, ...] = (), method: tuple[Rule, ...] = METHOD_RULES, default: str = "allow") -> DataFrame:
    """df with host, path, rule, method_rule and verdict.

    Of the ``rules`` that fit, the longest name wins (then the smaller one); where
    none fits, the first fitting ``method`` rule decides, else ``default``.
    """
    every = [*sorted(rules, key=lambda r: (-len(r.name), r.name)), *method]
    if len(every) > MAX_RULES:
        raise ValueError(f"{len(every)} rules; {MAX_RULES} fit in one pass")
    seen = token_counts(df, url, sorted({t for r in every for t in r.tokens}))
    buckets: list[list[int]] = [[] for _ in range(max(1, 1 << (2 * len(every)).bit_length()))]
    always = [k for k, r in enumerate(every) if not r.tokens]
    for k, r in enumerate(every):
        if r.tokens:
            rarest = min(r.tokens, key=lambda t: (seen.get(t, 0), t))
            buckets[zlib.crc32(rarest.encode()) % len(buckets)].append(k)
    ints = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<int>")
    strings = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<string>")
    index = F.array(*[ints(b) for b in buckets])
    fetched = F.flatten(F.transform(tokens_of(F.col("__u_target")), lambda t: F.get(index, F.pmod(F.crc32(t.cast("binary")), F.lit(len(buckets))).cast("int"))))
    fits = F.filter(F.array_distinct(F.concat(ints(always), fetched)), lambda k: F.rlike(F.col("__u_target"), F.get(strings([r.pattern for r in every]), k)))
    best = F.col("__u_best")
    out = {"host", "path", "rule", "method_rule", "verdict"}
    passed = [F.col(f"`{c}`") for c in df.columns if c.lower() not in out]
    judged = df.select(*passed, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")).withColumn("__u_target", F.concat("host", "path"))
    judged = judged.withColumn("__u_best", F.array_min(fits))
    names, verdicts = strings([r.name for r in every]), strings([r.verdict for r in every])
    return judged.select(
        *passed,
        "host",
        "path",
        F.when(best < len(rules), F.get(names, best)).alias("rule"),
        F.when(best >= len(rules), F.get(names, best)).alias("method_rule"),
        F.coalesce(F.get(verdicts, best), F.lit(default)).alias("verdict"),
    )


#: The list that the registered query judges by.
LISTED = (prefix_rule("net/", "block"), prefix_rule("example.net/en/", "allow"), prefix_rule("example.com/de/", "block"), prefix_rule("org/fr/", "allow"))

ORACLE = f"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
  END AS rule,
  nullif(regexp_extract(host, '(?:^|[^a-z0-9])({"|".join(HOST_WORDS)})(?:[^a-z0-9]|$)', 1), '') AS word
  FROM u
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IS NULL THEN word END AS method_rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN word IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
