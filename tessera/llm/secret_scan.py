"""Secret scans: candidates by pattern, false positives removed by a random forest.

All in built-in functions and Spark's own forest.  A text is cut at its candidates by
one expression, so each candidate's place and the words beside it are known.  The
forest looks at the candidate's length, the transitions between kinds of characters,
the share of it that dictionary words cover, whether it stands in a path or address,
and the neighbouring words.  It is trained from labelled findings: (left words,
candidate, right words, label); ``labelled_findings()`` makes a set of public formats
and of look-alikes (numbers, addresses, hashes of commits, identifiers, placeholders,
long words), and others may be given.

Cases: null and empty texts have no findings; a text of any length is scanned whole;
repeated rows are scanned each; an empty table gives no rows; extra columns, whatever
their names, pass through ``redact``.
"""

from __future__ import annotations

import random
from functools import lru_cache

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import positional

KEYWORDS = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|apikey|access[_-]?key|private[_-]?key|credential|auth"
#: Between a key word and its value: closing quotes or brackets, an assignment, an opening quote; white space in runs of up to 32.
ASSIGNED = r"[\\\"'`\])}]{0,4}\s{0,32}(?:={1,3}>?|:=?)\s{0,32}\\?[\"'`]?"
#: After a key word and ASSIGNED, any value (the short look-behind spares most places the long one); passwords of addresses (up to 128 characters, user up to 64); known beginnings; and long runs with a digit.
CANDIDATE = (
    r"(?<=[\s=:>\"'`])(?=[^\s\"'<>,;=`][^\s\"'<>,;]{7})"
    rf"(?<=(?i:password|passwd|pwd|passphrase|secret|token|api_key|api-key|apikey|access_key|private_key|credential|auth){ASSIGNED})[^\s\"'<>,;]{{8,}}"
    r"|(?<=:)(?=[^\s/@\"'<>]{4,128}@[A-Za-z0-9\[])(?<=[A-Za-z0-9]://[^\s/:@\"'<>]{0,64}:)[^\s/@\"'<>]{4,}"
    r"|(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|ghs_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ)[A-Za-z0-9_.\-]{10,}"
    r"|(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]{0,40}[0-9])[A-Za-z0-9_+/\-]{16,}={0,2}"
)
#: Words whose letters count as covered by the dictionary.
DICTIONARY = ("example", "sample", "test", "dummy", "your", "change", "change", "insert", "here", "placeholder", "secret", "password", "token", "key", "value", "user", "name", "admin", "document", "report", "version", "image", "index", "page", "file", "data", "the", "and", "ing", "tion", "ent", "for", "her", "ver", "ion", "que", "ment", "der", "ung", "ich", "est", "xxx", "000", "123", "abc")
THRESHOLD = 0.5
FEATURES = ("length", "digits", "uppers", "lowers", "moves", "covered", "hexed", "path", "keyed", "login", "known", "tame", "spread")


def with_features(df: DataFrame) -> DataFrame:
    """df (lhs, value, rhs) with the columns of FEATURES."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    move = F.regexp_count(v, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])"))
    return df.withColumns({
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "moves": move / n,
        "covered": 1 - F.length(F.regexp_replace(F.lower(v), "|".join(dict.fromkeys(DICTIONARY)), "")) / n,
        "hexed": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "path": (F.col("lhs").rlike(r"(?:[/\\@.]|://\S*)$") | F.col("rhs").rlike(r"^[/\\@.][A-Za-z0-9]")).cast("double") + F.regexp_count(v, F.lit("/")) / n,
        "keyed": F.col("lhs").rlike(rf"(?i)(?:{KEYWORDS})(?:\W{{0,4}}|{ASSIGNED})$").cast("double"),
        "login": (F.col("lhs").rlike(r"://[^\s/:@]*:$") & F.col("rhs").startswith("@")).cast("double"),
        "known": v.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{12,}$|^(?:ghp_|gho_|ghs_|glpat-|sk-|sk_live_|xox[abprs]-|AIza|eyJ)").cast("double"),
        "tame": F.col("lhs").rlike(r"(?i)(?:commit|sha\d*|md5|digest|uuid|guid|isbn|order|invoice|phone|card|iban|id|tel|no\.?|example|sample)\W{0,4}$").cast("double"),
        "spread": F.size(F.array_distinct(F.split(v, ""))) / n,
    })


def labelled_findings(n: int = 1500, seed: int = 3) -> list[tuple[str, str, str, int]]:
    """(left, value, right, label) of n findings, half of them secrets."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    of = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    syllables = ("the", "tion", "er", "ing", "que", "ment", "de", "ver", "ich", "on", "an", "re", "st", "le")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    text = lambda: " ".join(word() for _ in range(3))
    key = lambda: rng.choice(("password", "token", "secret", "api_key", "pwd", "access_key", "passwd", "auth")) + rng.choice(("=", " = ", ": ", ' = "', '="', ":"))
    quoted = lambda: rng.choice(("{\"", "'", ":", "[\"")) + rng.choice(("password", "api_key", "token", "secret", "auth")) + rng.choice(("\": \"", "\":\"", "' => '", " => '", "\"] = \"", "  =  ", "':  '", " := \""))
    login = lambda: rng.choice(("postgres", "https", "redis", "amqp", "ftp")) + "://" + rng.choice((word(), "admin", "")) + ":"
    case = lambda s: s.upper() if rng.random() < 0.15 else s
    secrets = (
        lambda: (text() + " ", rng.choice(("AKIA", "ASIA")) + of(upper + digit, 16)),
        lambda: (text() + " " + case(key()), case(of("0123456789abcdef", rng.choice((16, 18, 20, 24, 32, 40, 64))))),
        lambda: (text() + " " + key(), of(lower + upper + digit, rng.randint(10, 44))),
        lambda: (text() + " " + key(), of(lower + upper + digit + "!$%&*+-_", rng.randint(10, 24))),
        lambda: (text() + " ", rng.choice(("ghp_", "gho_", "glpat-", "sk-", "sk_live_", "xoxb-", "AIza")) + of(lower + upper + digit, rng.randint(20, 40))),
        lambda: (text() + " ", of(lower + upper + digit + "+/", rng.randint(36, 44))),
        lambda: (text() + " " + quoted(), of(lower + upper + digit + rng.choice(("", "!$%&*+-_")), rng.randint(8, 24))),
        lambda: (text() + " " + login(), of(lower + upper + digit + rng.choice(("", "!$%&*+-_")), rng.randint(6, 20)), "@" + word() + ".com"),
        lambda: (text() + " ", "eyJ" + of(lower + upper + digit, 30) + "." + of(lower + upper + digit + "_-", 40)),
    )
    harmless = (
        lambda: (text() + " ", of(digit, rng.randint(16, 20))),
        lambda: (text() + rng.choice((" commit ", " sha1 ", " md5: ", " digest=")), of("0123456789abcdef", rng.choice((32, 40, 64)))),
        lambda: (text() + " uuid ", "-".join(of("0123456789abcdef", k) for k in (8, 4, 4, 4, 12))),
        lambda: (text() + " https://" + word() + ".com/", word() + "-" + of(digit, 4) + "-" + word() + "/" + word()),
        lambda: (text() + " ", word() + word() + word() + of(digit, 2) + word()),
        lambda: (text() + " ", "-".join((of(digit, 3), of(digit, 3), of(digit, 4), of(digit, 4)))),
        lambda: (text() + " " + key(), rng.choice(("your_password_here", "changeme_example", "xxxxxxxxxxxx", "********", "placeholder", "example_token_value", "insert_token_here"))),
        lambda: (text() + " " + key(), word() + word() + word()),
        lambda: (text() + " " + quoted(), rng.choice(("your_password_here", "changeme_example", "xxxxxxxxxxxx", "********", "placeholder", "example_token_value", word() + word() + word()))),
        lambda: (text() + " " + login(), rng.choice(("password", "secret", "placeholder", "xxxxxxxx", "********", "changeme")), "@" + word() + ".com"),
        lambda: (text() + " /" + word() + "/", word() + "_v" + of(digit, 2) + "_" + word() + word()),
        lambda: (text() + " ", of(digit, 4) + "-" + of(digit, 2) + "-" + of(digit, 2) + "T" + of(digit, 6)),
        lambda: (text() + " ", "=" * rng.randint(14, 30) + of(digit, 2)),
    )
    out = []
    for k in range(n):
        left, value, *right = rng.choice(secrets if k % 2 else harmless)()
        out.append((left[-60:], value, "".join(right) + " " + text(), k % 2))
    return out


@lru_cache(maxsize=2)
def _model(spark: SparkSession, trees: int, depth: int):
    return fit(spark, labelled_findings(), trees, depth)


def fit(spark: SparkSession, findings: list[tuple[str, str, str, int]], trees: int = 20, depth: int = 8):
    rows = with_features(spark.createDataFrame(findings, "lhs string, value string, rhs string, label int").coalesce(1)).withColumn("label", F.col("label").cast("double"))
    forest = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=17)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def _cut(df: DataFrame, text: str) -> DataFrame:
    """df with __s_found, the candidates of the text, and __s_between, what stands around them: one more."""
    found = df.withColumn("__s_found", F.coalesce(F.regexp_extract_all(F.col(text), F.lit(CANDIDATE), F.lit(0)), F.array().cast("array<string>")))
    return found.withColumn("__s_between", F.when(F.size("__s_found") > 0, F.split(F.col(text), CANDIDATE, -1)))


def findings(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, model=None) -> DataFrame:
    """(key, start, length, value, score, is_secret, th): one row for each candidate; start counts characters from 0."""
    model = model or _model(docs.sparkSession, 20, 8)
    cut = _cut(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), "t").where(F.size("__s_found") > 0)
    # where each candidate begins: all that is before it
    ahead = F.expr("transform(__s_found, (x, i) -> length(__s_between[i]) + if(i > 0, length(__s_found[i - 1]), 0))")
    cut = cut.select("k", F.xxhash64("t").alias("th"), "__s_found", "__s_between", ahead.alias("__s_ahead"))
    starts = F.expr("aggregate(__s_ahead, cast(array() as array<int>), (s, x) -> array_append(s, coalesce(get(s, size(s) - 1), 0) + x))")
    one = cut.select("k", "th", "__s_found", "__s_between", starts.alias("__s_starts")).select("k", "th", "__s_between", "__s_starts", F.posexplode("__s_found").alias("i", "value"))
    one = one.select("k", "th", "value", F.get("__s_starts", F.col("i")).alias("start"), F.expr("right(__s_between[i], 60)").alias("lhs"), F.expr("left(__s_between[i + 1], 30)").alias("rhs"))
    scored = model.transform(with_features(one)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return scored.select(F.col("k").alias(key), "start", F.length("value").alias("length"), "value", "score", (F.col("score") >= threshold).alias("is_secret"), "th")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", mark: str = "[SECRET]", threshold: float = THRESHOLD, model=None) -> DataFrame:
    """docs, the secrets in their texts replaced by ``mark``; all rows stay.  A key may be null or repeated.

    A value that is a secret at one place of a text is replaced wherever it is a candidate in it.
    """
    d, names = positional(docs), docs.columns
    k, t = F.col(f"_{names.index(key)}"), F.col(f"_{names.index(text)}")
    secrets = findings(docs, key, text, threshold, model).where("is_secret").groupBy(F.col("th").alias("__s_hash"), F.col(key).alias("__s_key")).agg(F.collect_set("value").alias("__s_values"))
    joined = d.withColumn("__s_th", F.xxhash64(t)).join(secrets, (F.col("__s_th") == F.col("__s_hash")) & k.eqNullSafe(F.col("__s_key")), "left")
    has = F.col("__s_values").isNotNull()
    cut = joined.withColumn("__s_found", F.when(has, F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0)))).withColumn("__s_between", F.when(has, F.split(t, CANDIDATE, -1)))
    clean = F.expr(f"array_join(transform(__s_between, (b, i) -> concat(b, if(i >= size(__s_found), '', if(array_contains(__s_values, __s_found[i]), '{mark}', __s_found[i])))), '')")
    return cut.select(*[F.when(has, clean).otherwise(t).alias(c) if c == text else F.col(f"_{i}").alias(c) for i, c in enumerate(names)])


def scan_digests(docs: DataFrame) -> DataFrame:
    """The registered query: every candidate of every document, its secret replaced by a hash."""
    got = findings(docs)
    return got.select("doc_id", F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"), F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")
