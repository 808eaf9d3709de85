"""Token ids in a binary store with a shared zstandard dictionary and an offset index.

A store is two tables in the shared folder, written and read by Spark, so that any
file system will do.  ``blocks``: (block, part, dict_sha256, data, rows), data being
the separately compressed frames of consecutive documents, about ``block_bytes`` each,
and rows their (key, offset, length, n_tokens, ids before it in the part).
``index``: (key, block, offset, length, n_tokens, start), one row for each document.
``dictionary`` holds the one dictionary under its hash.  A short document is read by
its index row alone: slice the block, check the hash, inflate one frame.

Frames hold ids as unsigned 16-bit integers if the vocabulary allows, else 32-bit,
little-endian.  Blocks follow ascending key.

The dictionary is trained on a bounded sample of whole documents (``sample`` of them,
the first in the order of a hash, until they hold ``sample_bytes``); it only serves
compression, so every document is written whole whatever the sample held.

Cases: null and empty texts hold the end id alone; a text of any length is one frame;
repeated rows are stored each; rows that share a key, or have none, are stored in the
order of a hash of their frames (null first); an empty table gives empty tables and an
empty dictionary; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tessera.llm.common import TwoGenerations, discard, encode_by_pieces, lean, save, solely, text_slices

SAMPLE = 1000
SAMPLE_BYTES = 32_000_000
DICT_BYTES = 112_640
BLOCK_BYTES = 4_000_000
LEVEL = 3
#: Pieces that a worker remembers (twice: a new and an old generation), and bytes of text that it encodes at once.
MEMO = 350_000
ENCODE_BYTES = 4_000_000


class LibraryEncoder:
    """The tokenizers library over distinct pieces between spaces, remembered; ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo = TwoGenerations(self.direct, MEMO)
        split = self.tokenizer.pre_tokenizer
        self.by_spaces = self.tokenizer.normalizer is None and "ByteLevel" in repr(split) and "add_prefix_space=False" in repr(split)
        vocabulary = self.tokenizer.get_vocab()
        self.width = "<u2" if len(vocabulary) <= 65_536 else "<u4"
        #: bytes that each id stands for: a byte-level token has a character for each byte
        self.bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, k in vocabulary.items():
            self.bytes[k] = len(token)

    def direct(self, text: str) -> bytes:
        return self.each([text])[0]

    def each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, new: list[str]) -> list[bytes]:
        """Encodes pieces that begin with a space and have no other white space at an end in a row, others alone.

        In a row each piece is cut from the next, so its ids are those that its bytes
        use up; where lengths don't show the cuts, the pieces are encoded alone.
        """
        out: dict[str, bytes] = {}
        row = [p for p in new if len(p) > 1 and p[0] == " " and p[1:].strip() == p[1:]]
        for at in range(0, len(row), 2000):
            part = row[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, "<u4")
            reach, want = np.cumsum(self.bytes[ids]), np.cumsum([len(p.encode()) for p in part])
            ends = np.searchsorted(reach, want)
            if not len(ids) or ends[-1] != len(ids) - 1 or (reach[ends] != want).any():
                continue
            data, cuts = ids.tobytes(), [0, *(4 * (ends + 1)).tolist()]
            out.update(zip(part, (data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), strict=True))
        alone = [p for p in new if p not in out]
        out.update(zip(alone, self.each(alone), strict=True))
        return [out[p] for p in new]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of all texts."""
        if self.by_spaces:
            return encode_by_pieces(texts, self.memo, self.pieces, self.direct)
        each = [np.frombuffer(x, "<u4") for x in self.each([t or "" for t in texts.to_pylist()])]
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each])


def encoder(path: str) -> LibraryEncoder:
    """One for each worker; kept between tasks of this operator."""
    return solely(f"token_store {path}", lambda: LibraryEncoder(path))


def default_vocabulary() -> str:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json")


def serialized(texts: pa.Array, path: str, end: int) -> list[bytes]:
    """Each text's ids and the end id, in the width of the store."""
    own = encoder(path)
    ids, ends = own.encode(texts)
    data, tail, size = ids.astype(own.width).tobytes(), np.array([end], own.width).tobytes(), np.dtype(own.width).itemsize
    cuts = [0, *(size * ends).tolist()]
    return [data[a:b] + tail for a, b in zip(cuts, cuts[1:], strict=False)]


def train_dictionary(docs: DataFrame, key: str, text: str, path: str, end: int, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, size: int = DICT_BYTES) -> bytes:
    """A dictionary from the ids of at most ``sample`` whole documents, and no more of them once they pass ``sample_bytes``; empty where they are too few to train one."""

    def ids(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t", ENCODE_BYTES):
            yield pa.RecordBatch.from_arrays([pa.array(serialized(b.column("t"), path, end), pa.binary())], names=["ids"])

    marked = docs.select(F.xxhash64(F.lit("dictionary"), key, text).alias("h"), F.col(text).alias("t"))
    last = marked.select("h").orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes alone are sorted
    chosen = marked.where(F.col("h") <= F.lit(last)).limit(sample)  # equal rows share a hash
    rows, held = [], 0
    for r in chosen.select("t").mapInArrow(ids, "ids binary").toLocalIterator():
        rows.append(bytes(r["ids"]))
        held += len(rows[-1])
        if held > sample_bytes:
            break
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


class TokenStore:
    """What write_store() left: blocks, index, and the dictionary."""

    def __init__(self, blocks: DataFrame, index: DataFrame, before: DataFrame, dictionary: bytes, width: str):
        self.blocks, self.index, self.before, self.dictionary, self.width = blocks, index, before, dictionary, width

    def read(self, visit, schema: str) -> DataFrame:
        """visit(key, start, ids) -> row, for each document; ids is a numpy array, the row a tuple in schema's order."""
        dictionary, width = self.dictionary, self.width
        names = to_arrow_schema(StructType.fromDDL(schema))
        sha = hashlib.sha256(dictionary).hexdigest()

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            for b in batches:
                for k in range(b.num_rows):
                    if b.column("dict_sha256")[k].as_py() != sha:
                        raise ValueError("the block was written with another dictionary")
                    data = memoryview(b.column("data")[k].as_buffer())
                    at = b.column("rows").offsets[k].as_py(), b.column("rows").offsets[k + 1].as_py()
                    rows = b.column("rows").values.slice(at[0], at[1] - at[0])
                    first = b.column("before")[k].as_py()
                    made = [visit(key, first + base, np.frombuffer(inflate.decompress(data[o : o + n]), width)) for key, o, n, base in zip(*(rows.field(x).to_pylist() for x in ("key", "offset", "length", "base")), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), names, strict=True)], schema=names)

        # blocks are read where they lie: their own rows say all but how many ids other tasks wrote before
        return self.blocks.join(F.broadcast(self.before), "part").select("dict_sha256", "data", "rows", "before").mapInArrow(run, schema)


def write_store(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES, level: int = LEVEL) -> TokenStore:
    """Encodes and compresses where the texts are read; only frames are sorted by key and written."""
    lean(docs.sparkSession)
    path = path or default_vocabulary()
    dictionary = train_dictionary(docs, key, text, path, end, sample)
    sha, width = hashlib.sha256(dictionary).hexdigest(), encoder(path).width
    kind = docs.schema[key].dataType.simpleString()

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deflate = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in text_slices(batches, "text", ENCODE_BYTES):
            ids = serialized(b.column("text"), path, end)
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(x) // np.dtype(width).itemsize for x in ids], pa.int64()), pa.array([deflate.compress(x) for x in ids], pa.binary())], names=["key", "n_tokens", "frame"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one sorted task as blocks; base: ids before a document within the task."""
        from pyspark import TaskContext

        part, block, ids, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def flush():
            keys, n, data, base = (list(x) for x in zip(*held, strict=True))
            length = [len(x) for x in data]
            offset = [0, *np.cumsum(length[:-1]).tolist()]
            rows = pa.StructArray.from_arrays([pa.array(keys, key_type), *(pa.array(x, pa.int64()) for x in (offset, length, n, base))], names=["key", "offset", "length", "n_tokens", "base"])
            rows = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) | block], pa.int64()), pa.array([part], pa.int64()), pa.array([sha]), pa.array([b"".join(data)], pa.binary()), rows], names=["block", "part", "dict_sha256", "data", "rows"])

        for b in batches:
            key_type = b.schema.field("key").type
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "n_tokens", "frame")), strict=True):
                held.append((*row, ids))
                ids += row[1]
                size += len(row[2])
                if size >= block_bytes:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(frames, f"key {kind}, n_tokens long, frame binary")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    made = save(made, "frames")  # so that the sort's sampling doesn't encode everything twice
    order = ["key", F.xxhash64("frame")]  # many rows may share a key
    stored = save(made.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(blocks, f"block long, part long, dict_sha256 string, data binary, rows array<struct<key:{kind},offset:bigint,length:bigint,n_tokens:bigint,base:bigint>>"), "blocks")
    discard(made)
    # one row for each task of the sort: the ids before it
    ids = F.aggregate("rows", F.lit(0).cast("long"), lambda n, r: n + r["n_tokens"])
    before = stored.groupBy("part").agg(F.sum(ids).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    before = save(before, "before")
    index = stored.select("block", "part", F.explode("rows").alias("r")).join(F.broadcast(before), "part").select("r.key", "block", "r.offset", "r.length", "r.n_tokens", (F.col("before") + F.col("r.base")).alias("start"))
    return TokenStore(stored, save(index, "index"), before, dictionary, width)


def store_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 0) -> DataFrame:
    """Writes a store and reads it back: (key, start, n_tokens, ids_crc32)."""
    store = write_store(docs, key, text, path, end)
    kind = docs.schema[key].dataType.simpleString()
    return store.read(lambda k, start, ids: (k, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())), f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")
