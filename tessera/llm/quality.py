"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Word vectors.  Words, as they are spelled, are hashed to ``rows`` rows of a fixed
matrix.  Each row has a sparse ternary index vector; a word's context vector is the sum
of the index vectors of its neighbours at up to ``window`` places, over all documents.
Each task sums its own matrix, and the rows are added up by one aggregation; the matrix
has the same size whatever the corpus, so it may be broadcast (rows x dims x 4 bytes).

Pooling.  A document is the mean and the spread of its words' context vectors, and the
mean of the products of neighbouring words' vectors, component by component: repeated
words have vectors that are alike.  Nothing but these vectors goes in.

Network.  Standardised pooled vectors, one hidden layer of tanh units, a logistic
output, trained in numpy on the driver with a bounded sample of labelled documents
(``sample`` ids, the first in the order of a hash of the id, one text for each); a part
of the sample is kept back to fit the temperature by which logits are divided.

Cases: a null or empty text pools to zeros and gets a score as well; a text of any
length is pooled whole, in stretches; rows with a null label are not learned from; of
rows that share an id the one with the least text hash is learned from; without labels
of two kinds, the score is the share of label 1 (0.5 without any label); repeated rows
are scored each; an empty table gives no rows; extra columns pass through ``scored``
and are ignored by ``judged``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tessera.llm.common import lean, solely, text_slices

ROWS = 32_768
DIMS = 32
NONZERO = 4
WINDOW = 2
SAMPLE = 8000
HIDDEN = 24
THRESHOLD = 0.3
#: Bytes of text whose word pairs are summed at once, and words whose vectors are pooled at once; they bound a worker's memory.
SUM_BYTES = 4_000_000
STRETCH = 50_000


def index_vectors(rows: int, dims: int, nonzero: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero components of each row's index vector."""
    rng = np.random.default_rng(seed)
    places = np.argsort(rng.random((rows, dims)), axis=1)[:, :nonzero]
    return places, rng.choice([-1.0, 1.0], (rows, nonzero)).astype("f4")


class Tokens:
    """The words of a batch of texts, one after another: row of the matrix, and document of each."""

    def __init__(self, texts: pa.Array, rows: int):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words, owner = lists.flatten(), pc.list_parent_indices(lists)
        full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty word
        coded = words.filter(full).dictionary_encode()
        kinds = [zlib.crc32(w) % rows for w in pc.cast(coded.dictionary, pa.binary()).to_numpy(zero_copy_only=False).tolist()]
        self.row = np.array(kinds, np.int64)[coded.indices.to_numpy()] if kinds else np.zeros(0, np.int64)
        self.doc = owner.filter(full).to_numpy(zero_copy_only=False).astype(np.int64)
        self.texts = len(texts)


def context_vectors(docs: DataFrame, text: str = "text", rows: int = ROWS, dims: int = DIMS, window: int = WINDOW) -> np.ndarray:
    """The matrix of context vectors, each of length 1 (or 0 for rows that no word has)."""

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solely(None)
        places, signs = index_vectors(rows, dims, NONZERO)
        total = np.zeros(rows * dims)
        for b in text_slices(batches, text, SUM_BYTES):
            t = Tokens(b.column(text), rows)
            for d in range(1, window + 1):
                same = np.flatnonzero(t.doc[d:] == t.doc[:-d]) if len(t.doc) > d else np.zeros(0, np.int64)
                for here, there in ((t.row[same], t.row[same + d]), (t.row[same + d], t.row[same])):
                    for k in range(NONZERO):
                        total += np.bincount(here * dims + places[there, k], signs[there, k], rows * dims)
        table = total.reshape(rows, dims)
        own = np.flatnonzero(np.abs(table).any(1))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.FixedSizeListArray.from_arrays(pa.array(table[own].astype("f4").ravel()), dims).cast(pa.list_(pa.float32()))], names=["row", "v"])

    made = docs.select(text).mapInArrow(sums, "row long, v array<float>")
    summed = made.groupBy("row").agg(*[F.sum(F.get("v", F.lit(k)).cast("double")).alias(f"v{k}") for k in range(dims)])
    out = np.zeros((rows, dims), np.float32)
    for r in summed.toLocalIterator():  # at most ``rows`` rows
        out[r["row"]] = r[1:]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row for each text: mean and spread of its words' vectors, and mean product of neighbours."""
    rows, dims = vectors.shape
    t = Tokens(texts, rows)
    sums = np.zeros((t.texts, 3 * dims))
    count = np.bincount(t.doc, minlength=t.texts)
    for at in range(0, len(t.row), STRETCH):
        doc, w = t.doc[at : at + STRETCH], vectors[t.row[at : at + STRETCH]]
        before = np.arange(at - 1, at - 1 + len(doc))
        product = w * vectors[t.row[before]]  # of the very first word: with the last, struck out below
        product[t.doc[before] != doc] = 0
        if at == 0:
            product[0] = 0
        first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        for k, x in enumerate((w, w * w, product)):
            sums[doc[first], k * dims : (k + 1) * dims] += np.add.reduceat(x, first, axis=0)
    out = sums / np.maximum(count, 1)[:, None]
    out[:, dims : 2 * dims] = np.sqrt(np.maximum(0, out[:, dims : 2 * dims] - out[:, :dims] ** 2))
    return out.astype("f4")


class Network:
    """tanh hidden layer and logistic output over standardised inputs; temperature-calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, seed: int = 11, rounds: int = 60, rate: float = 0.01, decay: float = 1e-4):
        self.constant = None
        if len(y) == 0 or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        rng = np.random.default_rng(seed)
        x, y = x.astype("f8"), y.astype("f8")
        keep = rng.random(len(y)) < 0.8
        if keep.all() or y[keep].min() == y[keep].max():
            keep[:] = True
        self.mean, self.scale = x[keep].mean(0), x[keep].std(0) + 1e-3
        z, back = self.standard(x[keep]), self.standard(x[~keep])
        w = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        m, v, step, t = [np.zeros_like(p) for p in w], [np.zeros_like(p) for p in w], 0, y[keep]
        for _ in range(rounds):
            order = rng.permutation(len(t))
            for at in range(0, len(t), 128):
                i = order[at : at + 128]
                h = np.tanh(z[i] @ w[0] + w[1])
                g = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -40, 40))) - t[i]) / len(i)
                gh = np.outer(g, w[2]) * (1 - h * h)
                step += 1
                for k, grad in enumerate((z[i].T @ gh + decay * w[0], gh.sum(0), h.T @ g + decay * w[2], g.sum(keepdims=True))):  # Adam
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad * grad
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.w, self.temperature = w, 1.0
        if len(back):
            logits, t = self.logits(back), y[~keep]
            loss = lambda temp: np.mean(np.logaddexp(0, logits / temp) - t * logits / temp)
            self.temperature = float(min(np.geomspace(0.5, 10, 61), key=loss))

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.standard(x.astype("f8"))) / self.temperature, -40, 40)))


def held_out(key):
    """Whether crc32 of the id as text leaves 0 when divided by 5: such rows are never learned from."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, vectors: np.ndarray | None = None) -> tuple[np.ndarray, Network]:
    """Word vectors from all docs, and a network from at most ``sample`` labelled ones."""
    spark = docs.sparkSession
    lean(spark)
    vectors = context_vectors(docs, text) if vectors is None else vectors
    chosen = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k is not null and y is not null").where(~held_out(F.col("k"))).groupBy("k").agg(F.max("y").alias("y"))
    chosen = chosen.orderBy(F.xxhash64(F.lit("sample"), "k"), "k").limit(sample)  # at most ``sample`` small rows: fit to broadcast
    shared = spark.sparkContext.broadcast(vectors)

    def pool(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches, "t"):
            x = pooled(b.column("t"), shared.value)
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("y"), b.column("h"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], names=["k", "y", "h", "x"])

    own = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "y", F.xxhash64("t").alias("h"), "t")
    made = own.mapInArrow(pool, f"k {docs.schema[key].dataType.simpleString()}, y int, h long, x array<float>")
    rows = made.groupBy("k").agg(F.min(F.struct("h", "x", "y")).alias("r")).select("k", "r.x", "r.y").toArrow()  # at most ``sample`` rows
    order = np.argsort(np.array(rows["k"].to_pylist()), kind="stable") if rows.num_rows else []
    flat = rows["x"].combine_chunks().flatten().to_numpy() if rows.num_rows else np.zeros(0, "f4")
    x = flat.reshape(rows.num_rows, -1)[order] if rows.num_rows else np.zeros((0, 1), "f4")
    return vectors, Network(x, rows["y"].to_numpy()[order] if rows.num_rows else np.zeros(0))


def score_of(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE):
    """A column: the calibrated probability of label 1 of each row's text.  Only the text goes to Python, and one number comes back."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, key, text, label, sample))

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        solely(None)
        vectors, network = shared.value
        for texts in batches:
            b = pa.RecordBatch.from_arrays([texts], names=["t"])
            yield pa.array(np.concatenate([np.zeros(0), *(network.score(pooled(x.column("t"), vectors)) for x in text_slices([b], "t"))]))

    return F.arrow_udf(scores, DoubleType())(F.col(text))


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, out: str = "score") -> DataFrame:
    """docs and a column ``out``, which replaces one of that name: the calibrated probability of label 1."""
    return docs.withColumn(out, score_of(docs, labels, key, text, label, sample))


def judged(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The digest of the registered query: (doc_id, held_out, score, predicted)."""
    got = scored(docs.select("doc_id", "text"), labels)
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
