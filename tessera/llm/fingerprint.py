"""Document fingerprints by one-permutation MinHash, in built-in functions only.

The distinct shingles of ``width`` words are hashed once; the top bits of a hash name
its bin and each bin keeps its least hash.  An empty bin takes the value of the first
filled bin in a pseudo-random order of its own (optimal densification: any filled bin
is equally likely).  ``BITS`` low-order bits of each bin are packed, 16 bins to an
integer.  Two fingerprints agree by chance in 1 of 2**BITS bins, so likeness is the
share of equal bins with that bias taken out.

Sorting a document's hashes brings each bin's least to the front of its run, so a
fingerprint costs one sort of an array within the row; nothing is exploded.

Cases: null and empty texts, and texts of white space, have the fingerprint ''
(likeness 1 to each other, 0 to others); with fewer words than a shingle has, the
whole sequence is the one shingle; a text of any length is fingerprinted whole; repeated
rows get a fingerprint each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, save

BINS = 256
BITS = 4
_SHIFT = 64 - (BINS.bit_length() - 1)
#: Places that an empty bin tries before all filled bins are ranked for it.
_TRIES = 8
#: What follows the bits of the bin in a hash; all ones stands for an empty bin.
_REST = (1 << _SHIFT) - 1


def with_fingerprint(df: DataFrame, text: str, out: str, width: int = 5) -> DataFrame:
    """df and a column ``out`` of array<bigint>: the packed bins, empty without words.

    Each step is a column that the next refers to more than once, so that the
    optimiser evaluates it once a row instead of copying it into a lambda.
    """
    given = [c for c in df.columns if c != out]
    e, passed = F.expr, [f"`{c}`" for c in given]
    word = r"[ \\t-\\r]+"
    step = df.select(*passed, e(f"trim(both ' \\t\\n\\u000B\\u000C\\r' from lower(`{text}`))").alias("_t"))
    step = step.select(*passed, e(f"if(length(_t) > 0, split(_t, '{word}'), cast(array() as array<string>))").alias("_w"))
    step = step.select(*passed, e("transform(_w, w -> xxhash64(w))").alias("_h"), e("size(_w)").alias("_n"))
    shingle = ", ".join(f"_h[i + {k}]" if k else "_h[i]" for k in range(width))
    step = step.select(*passed, e(f"case when _n >= {width} then transform(sequence(0, _n - {width}), i -> xxhash64({shingle})) when _n > 0 then array(xxhash64(_h)) else cast(array() as array<bigint>) end").alias("_s"), "_n")
    # one mark for each bin, above all its hashes: then every bin has a first, in the order of signed integers
    marks = f"transform(sequence(0L, {BINS - 1}L), b -> shiftleft(b, {_SHIFT}) | {_REST}L)"
    step = step.select(*passed, "_n", e(f"sort_array(concat(_s, {marks}))").alias("_s"))
    bin_of = f"shiftrightunsigned({{}}, {_SHIFT})"
    step = step.select(*passed, "_n", e(f"filter(_s, (x, i) -> i = 0 or {bin_of.format('_s[i - 1]')} <> {bin_of.format('x')})").alias("_m"))
    step = step.select(*passed, "_n", e(f"transform(_m, x -> if((x & {_REST}L) = {_REST}L, null, x))").alias("_d"), e(f"filter(_m, x -> (x & {_REST}L) <> {_REST}L)").alias("_f"))
    tries = ", ".join(f"_d[pmod(xxhash64(b, {k}), {BINS}L)]" for k in range(_TRIES))
    ranked = f"array_min(transform(_f, x -> struct(xxhash64(b, {bin_of.format('x')}) as h, x as x))).x"
    step = step.select(*passed, e(f"if(_n > 0, transform(sequence(0, {BINS - 1}), b -> coalesce(_d[b], {tries}, {ranked})), cast(null as array<bigint>))").alias("_d"), "_n")
    packed = f"transform(sequence(0, {BINS // 16 - 1}), g -> aggregate(slice(_d, g * 16 + 1, 16), 0L, (a, v) -> shiftleft(a, {BITS}) | (v & {2**BITS - 1}L)))"
    return step.select(*passed, e(f"if(_n > 0 and size(_d) > 0, {packed}, cast(array() as array<bigint>))").alias(out))


def as_text(packed: Column) -> Column:
    """The packed bins as lowercase hexadecimal digits, ``BINS * BITS / 4`` of them, or ''."""
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two columns of packed bins, the bias of short codes taken out."""
    low = 0x1111111111111111
    differ = f"bit_count((x | shiftrightunsigned(x, 1) | shiftrightunsigned(x, 2) | shiftrightunsigned(x, 3)) & {low}L)"
    share = f"(1 - aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (s, x) -> s + {differ}) / {float(BINS)}D)"
    chance = 1 / 2**BITS
    raw = f"greatest(0D, ({share} - {chance}D) / {1 - chance}D)"
    return F.expr(f"cast(case when size({a}) < 1 and size({b}) < 1 then 1D when size({a}) < 1 or size({b}) < 1 then 0D else {raw} end as double)")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """(key, fingerprint) of every row."""
    return with_fingerprint(docs.select(key, text), text, "_packed", width).select(key, as_text(F.col("_packed")).alias("fingerprint"))


def edited_likeness(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5) -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness to each other and to the next document's.

    The edited text: the last floor(n/4) of n code points give way to as many first
    ones (or all) of the next document by ascending key, after the last the first.

    The order comes from keys and lengths alone.  Texts are shuffled by key once: the
    join that takes heads from them and the join that brings heads to them read the same
    exchange.  Rows that share a key have the same next document, and the one with the
    least text hash stands for them as another's next.  A row without a key has no next:
    its edited text is cut and its near_next is 0.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    keyed, keyless = docs.where("k is not null"), docs.where("k is null")
    made = save(with_fingerprint(docs.select("k", F.length("t").cast("long").alias("n"), F.xxhash64("t").alias("th"), F.col("t")), "t", "packed", width).drop("t"), "fingerprints")
    ids = made.where("k is not null").groupBy("k").agg(F.max("n").alias("most"), F.min(F.struct("th", "packed")).alias("own"), F.count(F.lit(1)).alias("c"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    ranged = ids.repartitionByRange(parts, "k").sortWithinPartitions("k").withColumn("at", at)
    ranged = save(ranged.select("k", "most", "own", "c", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("at")), "order")
    # one row for each task of the sort
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    total, most_rows = ranged.agg(F.count(F.lit(1)), F.max("c")).first()
    repeated = (most_rows or 0) > 1 or made.where("k is null").limit(1).count()
    ranked = ranged.join(F.broadcast(before), "part").select("k", "most", "own", (F.col("before") + F.col("at")).alias("rank"))
    ahead = ranked.select(F.col("k").alias("prev"), "most", F.col("own").alias("prev_own"), F.pmod(F.col("rank") + 1, F.lit(max(total, 1))).alias("rank"))
    pairs = ranked.select("k", "own", "rank").join(ahead, "rank")
    pairs = save(pairs.select("k", F.col("own.th").alias("th"), F.col("own.packed").alias("next_packed"), "prev", (F.col("most") / 4).cast("long").alias("need"), F.col("prev_own.th").alias("prev_th"), F.col("prev_own.packed").alias("prev_packed")), "pairs")
    discard(made, ranged)
    # written so that the hash is no join key: the exchange is by k alone, as in the other join
    heads = keyed.join(pairs, "k").where(F.xxhash64("t").bitwiseXOR(F.col("th")) == 0)
    heads = heads.select(F.col("prev").alias("k"), F.expr("left(t, int(need))").alias("piece"), "next_packed", "prev_th", "prev_packed")
    given = ("piece", "next_packed", "prev_th", "prev_packed")
    if (most_rows or 0) > 1:  # equal rows that share a key
        heads = heads.groupBy("k").agg(*[F.first(c).alias(c) for c in given])
    none = [F.lit(None).cast(heads.schema[c].dataType).alias(c) for c in given]
    both = keyed.join(heads, "k", "left").unionByName(keyless.select("*", *none)).withColumn("n", F.length("t"))
    own_known = F.xxhash64("t") == F.col("prev_th")
    edited = F.expr("concat(left(t, n - n div 4), left(coalesce(piece, ''), int(n div 4)))")
    both = both.select("k", F.col("n").cast("long").alias("n"), edited.alias("edited"), "next_packed", F.when(own_known, F.col("prev_packed")).alias("known"), F.when(own_known, F.lit(None)).otherwise(F.col("t")).alias("other"))
    both = both.select("k", "n", "edited", F.sha2(F.col("edited").cast("binary"), 256).alias("sha"), "next_packed", "known", "other")
    both = with_fingerprint(both, "edited", "edited_packed", width).drop("edited")
    if repeated:  # only such rows' own fingerprints are not known yet
        both = with_fingerprint(both, "other", "other_packed", width).withColumn("packed", F.coalesce("known", "other_packed"))
    else:
        both = both.withColumnRenamed("known", "packed")
    return both.select(
        F.col("k").alias(key),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("packed")).alias("fingerprint"),
        as_text(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness("packed", "edited_packed").alias("near_edited"),
        F.when(F.col("next_packed").isNull(), 0.0).otherwise(likeness("packed", "next_packed")).alias("near_next"),
    )
