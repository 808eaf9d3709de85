"""Append-only chains: leaf hashes, Merkle roots, inclusion and consistency proofs (RFC 6962 trees).

Hashing is in built-in functions.  A chain's root is folded level by level: nodes pair
by seq div 2 and an odd last one moves up, which equals splitting at the largest power
of two.  All chains are folded together.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EMPTY_ROOT = hashlib.sha256(b"").hexdigest()


def _framed(data: Column) -> Column:
    size = F.octet_length(data).cast("long")
    return F.concat(F.unhex(F.lpad(F.hex(size), 16, "0")), data)


def leaf_hash(kind: Column, payload: Column, at: Column) -> Column:
    """SHA-256 of 0x00 and the framed fields, of an entry without edges, as a hexadecimal string."""
    fields = [_framed(F.coalesce(c.cast("binary"), F.lit(b""))) for c in (kind, payload, at)]
    return F.sha2(F.concat(F.unhex(F.lit("00")), *fields, F.unhex(F.lit("0" * 16))), 256)


def append(chain: DataFrame, entries: DataFrame, order: list[str]) -> DataFrame:
    """entries numbered after each chain's last, in the given order: dense sequences from 0."""
    heads = chain.groupBy("chain").agg(F.max("seq").alias("_head"))
    w = Window.partitionBy("chain").orderBy(*order)
    new = entries.withColumn("_n", F.row_number().over(w)).join(heads, "chain", "left")
    new = new.withColumn("seq", F.coalesce("_head", F.lit(-1)) + F.col("_n")).drop("_n", "_head")
    return chain.unionByName(new.withColumn("leaf_hash", leaf_hash(F.col("type"), F.col("payload"), F.col("at"))).withColumn("redacted", F.lit(False)).select(*chain.columns))


def redact(chain: DataFrame, name: str, seq: int) -> DataFrame:
    """The entry's payload goes, its leaf hash stays, and so does the root."""
    hit = (F.col("chain") == name) & (F.col("seq") == seq)
    return chain.withColumn("payload", F.when(~hit, F.col("payload"))).withColumn("redacted", F.col("redacted") | hit)


def page(chain: DataFrame, name: str, begin: int, limit: int = 1000) -> DataFrame:
    return chain.where((F.col("chain") == name) & (F.col("seq") >= begin)).orderBy("seq").limit(min(limit, 1000))


def roots(leaves: DataFrame, key: str = "chain") -> DataFrame:
    """leaves (key, seq from 0, leaf_hash) -> (key, size, root)."""
    sizes = leaves.groupBy(key).agg(F.count(F.lit(1)).alias("size"))
    level = leaves.select(key, F.col("seq").cast("long").alias("i"), F.col("leaf_hash").alias("h"))
    most = sizes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        two = level.groupBy(key, (F.floor(F.col("i") / 2)).alias("i")).agg(F.max(F.when(F.col("i") % 2 == 0, F.col("h"))).alias("l"), F.max(F.when(F.col("i") % 2 == 1, F.col("h"))).alias("r"))
        node = F.sha2(F.concat(F.unhex(F.lit("01")), F.unhex("l"), F.unhex("r")), 256)
        level = two.select(key, "i", F.when(F.col("r").isNull(), F.col("l")).otherwise(node).alias("h"))
        most = (most + 1) // 2
    return level.join(sizes, key).select(key, "size", F.col("h").alias("root"))


# -- proofs, over one chain's leaf hashes in order


def node(left: bytes, right: bytes) -> bytes:
    return hashlib.sha256(b"\x01" + left + right).digest()


def _half(n: int) -> int:
    return 1 << (n - 1).bit_length() - 1


def root(leaves: list[bytes]) -> bytes:
    if len(leaves) < 2:
        return leaves[0] if leaves else hashlib.sha256(b"").digest()
    k = _half(len(leaves))
    return node(root(leaves[:k]), root(leaves[k:]))


def inclusion_proof(leaves: list[bytes], at: int) -> list[bytes]:
    if len(leaves) < 2:
        return []
    k = _half(len(leaves))
    return [*inclusion_proof(leaves[:k], at), root(leaves[k:])] if at < k else [*inclusion_proof(leaves[k:], at - k), root(leaves[:k])]


def verify_inclusion(leaf: bytes, at: int, size: int, proof: list[bytes], expected: bytes) -> bool:
    sides = []
    while size > 1:
        k = _half(size)
        sides.append(at < k)
        at, size = (at, k) if at < k else (at - k, size - k)
    if len(sides) != len(proof):
        return False
    for left, sibling in zip(reversed(sides), proof, strict=True):
        leaf = node(leaf, sibling) if left else node(sibling, leaf)
    return leaf == expected


def consistency_proof(leaves: list[bytes], old: int, whole: bool = True) -> list[bytes]:
    n = len(leaves)
    if old == n:
        return [] if whole else [root(leaves)]
    k = _half(n)
    if old <= k:
        return [*consistency_proof(leaves[:k], old, whole), root(leaves[k:])]
    return [*consistency_proof(leaves[k:], old - k, False), root(leaves[:k])]


def verify_consistency(old: int, new: int, old_root: bytes, new_root: bytes, proof: list[bytes]) -> bool:
    if old == new:
        return not proof and old_root == new_root
    if old == 0:
        return not proof
    rest = list(proof)
    fn, sn = old - 1, new - 1
    while fn & 1:
        fn, sn = fn >> 1, sn >> 1
    first = rest.pop(0) if fn or not rest == [] and fn else old_root
    a = b = first
    for c in rest:
        if sn == 0:
            return False
        if fn & 1 or fn == sn:
            a, b = node(c, a), node(c, b)
            while fn and not fn & 1:
                fn, sn = fn >> 1, sn >> 1
        else:
            b = node(b, c)
        fn, sn = fn >> 1, sn >> 1
    return a == old_root and b == new_root and sn == 0
