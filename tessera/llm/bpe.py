"""Byte-level BPE encoding and decoding through a lazily determinised transducer.

The merge list is compiled into a nondeterministic transducer that guesses where
tokens end; a guess survives only while it is a prefix of a token and every pair
of neighbouring tokens is one that the merges themselves would produce.  Such a
chain of locally valid pairs is the BPE encoding, and for each prefix of the input
there is exactly one, so the subset construction stays small: one thread for each
place where the current token may have begun.  States are built on first use and
kept in a bounded table, which turns over when it is full.  A token is emitted as soon
as all threads agree on it, which is after at most one token length of lookahead.

Decoding is incremental: an UTF-8 state machine finds how much of a chunk is
complete, so characters may straddle chunks.

Cases: null and empty texts have no ids; a text of any length is encoded whole; ids are
0-based ranks; no special tokens exist, and their strings in a text are ordinary text;
repeated rows are encoded each; an empty table gives no rows; extra columns pass through
``encode_documents`` and ``decode_documents``, but for one named like the output, which
is replaced, and are ignored by ``encoded_digests``.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import TwoGenerations, encode_by_pieces, gather, lean, solely, text_slices

#: Bounds of what one Python worker keeps (pre-tokens, pieces and states twice: a new and an old generation), and bytes of text that it encodes at once.
MAX_WORDS = 250_000
MAX_STATES = 40_000
TURN = 100_000  # inputs that leave a full state table, until it turns over
ENCODE_BYTES = 4_000_000
MAX_PAIRS = 400_000
START = -1
#: The split pattern for which texts may be cut at spaces first (fixed value: that of the public vocabulary).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merge list as rank tables: which two tokens each token is made of."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.parts: list[tuple[int, int] | None] = [None] * len(self.token)
        self.pairs: dict[tuple[int, int], int] = {}
        for t, r in sorted(ranks.items(), key=lambda x: x[1]):
            if len(t) > 1:
                two = self.merged(t, r)
                if len(two) == 2:
                    self.parts[r] = two[0], two[1]
                    self.pairs[two[0], two[1]] = r

    def merged(self, text: bytes, below: int) -> list[int]:
        """The tokens of text when only merges ranked lower than ``below`` exist."""
        ranks = self.ranks
        parts = [text[i : i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = below, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens apart when they are neighbours.

        Unwinds both tokens along the edge where they touch, latest merge first; a
        merge across the edge that comes before the one just unwound would have won.
        """
        limit, parts, pairs = len(self.token), self.parts, self.pairs
        while True:
            if pairs.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                split = parts[left]
                if split is None:
                    limit, split = right + 1, parts[right]
                    if split is None:
                        return True
                    right = split[0]
                else:
                    left = split[1]
            else:
                limit = right + 1
                split = parts[right]
                if split is None:
                    limit, split = left, parts[left]
                    if split is None:
                        return True
                    left = split[1]
                else:
                    right = split[0]


class State:
    """threads: what the input so far may mean; old: the same state in the generation of the table before this one."""

    __slots__ = ("threads", "tail", "moves", "old")

    def __init__(self, threads: tuple, old: State | None = None):
        self.threads, self.old = threads, old
        self.tail = old.tail if old else None  # what an end of input here emits, once that is known
        self.moves: dict[int, tuple[State, bytes]] = {}


class Transducer:
    """Bytes in, token ids (little-endian unsigned 32-bit) out.

    States are determinised on first use.  An input that leaves a full table is finished
    by following its threads as they are, at the same result and without new states.
    After ``turn`` such inputs the table turns over: a new generation begins, into which
    states and moves that come again are taken from the old one as they are; the rest
    goes with the turn after.  So the table holds what the input of late has needed.
    """

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, turn: int = TURN):
        self.merges, self.max_states, self.turn, self.left = Merges(ranks), max_states, turn, 0
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.ends: list[int] = [-1]
        inner = set()
        for t, r in ranks.items():
            node = 0
            for b in t:
                inner.add(node)
                at = node << 8 | b
                if (to := self.child.get(at)) is None:
                    to = self.child[at] = len(self.ends)
                    self.ends.append(-1)
                node = to
            self.ends[node] = r
        self.inner = inner
        self.start = State((((START,), 0),))
        self.states = {self.start.threads: self.start}
        self.fit_memo: dict[int, bool] = {}

    def fits(self, left: int, right: int) -> bool:
        at = left << 32 | right
        if (got := self.fit_memo.get(at)) is None:
            if len(self.fit_memo) >= MAX_PAIRS:
                self.fit_memo.clear()
            got = self.fit_memo[at] = self.merges.fits(left, right)
        return got

    def state_of(self, threads: tuple, old: State | None = None) -> State | None:
        """The state of the threads; None where a full table lacks it."""
        if (state := self.states.get(threads)) is None and len(self.states) < self.max_states:
            state = self.states[threads] = State(threads, old)
        return state

    def turn_over(self) -> None:
        for x in self.states.values():
            x.old = None  # the generation before goes
        self.start = State(self.start.threads, self.start)
        self.states, self.left = {self.start.threads: self.start}, 0

    def move(self, state: State, b: int) -> tuple[State, bytes] | None:
        """The next state and what the move emits; None where a full table lacks it."""
        if state.old and (known := state.old.moves.get(b)):
            if (to := self.state_of(known[0].threads, known[0])) is None:
                return None
            made = state.moves[b] = to, known[1]
            return made
        if len(self.states) >= self.max_states:  # most likely a new one
            return None
        out, new, child, ends, inner = [], None, self.child.get, self.ends, self.inner
        for chain, node in state.threads:
            if (node := child(node << 8 | b)) is None:
                continue
            if new is None and (t := ends[node]) >= 0 and ((u := chain[-1]) == START or self.fits(u, t)):
                new = (*chain, t)
            if node in inner:  # the rest can't go on
                out.append((chain, node))
        if new is None:
            raise ValueError("the vocabulary lacks single bytes")
        out.append((new, 0))
        first, agreed = out[0][0], min([len(c) for c, _ in out])
        n = 1
        while n < agreed and all([c[n] == first[n] for c, _ in out]):
            n += 1
        threads = tuple(out if n == 1 else [(c[n - 1 :], node) for c, node in out])
        if (to := self.state_of(threads)) is None:
            return None
        made = state.moves[b] = to, self.coded(first[1:n])
        return made

    def follow(self, text: bytes) -> bytes:
        """All of text nondeterministically; token and where[i]: the last token of the first i bytes, and its beginning."""
        child, ends, memo = self.child.get, self.ends, self.fit_memo.get
        token, where, threads = [START], [0], []
        for at, b in enumerate(text):
            threads.append((at, 0))
            alive, found = [], -1
            for begin, node in threads:
                if (node := child(node << 8 | b)) is None:
                    continue
                alive.append((begin, node))
                if found < 0 and (t := ends[node]) >= 0:
                    u = token[begin]
                    if u < 0 or ((fit := memo(u << 32 | t)) or fit is None and self.fits(u, t)):
                        found = t
                        where.append(begin)
            if found < 0:
                raise ValueError("the vocabulary lacks single bytes")
            token.append(found)
            threads = alive
        out, at = [], len(text)
        while at:
            out.append(token[at])
            at = where[at]
        return self.coded(out[::-1])

    @staticmethod
    def coded(tokens: Iterable[int]) -> bytes:
        return b"".join([t.to_bytes(4, "little") for t in tokens])

    def encode(self, text: bytes) -> bytes:
        state, out = self.start, []
        for b in text:
            if (got := state.moves.get(b) or self.move(state, b)) is None:
                self.left += 1
                if self.left >= self.turn:
                    self.turn_over()
                return self.follow(text)
            state = got[0]
            if got[1]:
                out.append(got[1])
        if state.tail is None:
            state.tail = self.coded(state.threads[-1][0][1:])
        out.append(state.tail)
        return b"".join(out)


#: Bytes that may follow a lead byte of UTF-8, as (least, most) of the first one after it.
_SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


class Utf8Machine:
    """Decodes bytes that come in pieces; ``pending`` holds an unfinished character.

    Ill-formed bytes become U+FFFD, as in Python's "replace".
    """

    def __init__(self):
        self.pending = b""

    @staticmethod
    def unfinished(data: bytes) -> int:
        """How many bytes at the end are the beginning of a character that may still become whole."""
        for back in range(1, min(3, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0
            if need <= back:
                return 0
            if back > 1:
                least, most = _SECOND.get(lead, (0x80, 0xBF))
                if not least <= data[1 - back] <= most:
                    return 0
            return back
        return 0

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = len(data) - self.unfinished(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")


class Codec:
    """Encoder and decoder of one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.split = regex.compile(pattern).finditer
        self.by_spaces = pattern == SPLIT
        self.transducer = Transducer(read_ranks(path))
        self.token = np.frombuffer(b"".join(self.transducer.merges.token), np.uint8)
        self.size = np.fromiter(map(len, self.transducer.merges.token), np.int64)
        self.words = TwoGenerations(lambda w: self.transducer.encode(w.encode("utf-8", "surrogatepass")), MAX_WORDS)
        self.memo = TwoGenerations(self.encode_piece, MAX_WORDS)

    def encode_piece(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        get = self.words.__getitem__
        return b"".join([get(m.group()) for m in self.split(text)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of all texts one after another, and where each text's end."""
        if self.by_spaces:
            return encode_by_pieces(texts, self.memo, lambda new: [self.encode_piece(p) for p in new], self.encode_piece)
        each = [np.frombuffer(self.encode_piece(t or ""), "<u4") for t in texts.to_pylist()]
        return np.concatenate([np.zeros(0, "<u4"), *each]), np.cumsum([len(x) for x in each])

    def decode(self, ids: np.ndarray, chunk: int = 65_536) -> Iterator[str]:
        """The text of the ids in pieces: tokens may end within a character, pieces don't."""
        machine = Utf8Machine()
        for i in range(0, len(ids), chunk):
            yield machine.feed(gather(self.token, self.size, ids[i : i + chunk])[0].tobytes())
        yield machine.close()


def codec(path: str, pattern: str) -> Codec:
    """One for each worker; kept between tasks of this operator."""
    return solely(f"bpe {path} {pattern}", lambda: Codec(path, pattern))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def encode_documents(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df and a column ``out`` of array<int>; null and empty texts have no ids."""
    lean(df.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` array<int>"
    names = [f.name for f in df.schema if f.name != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in text_slices(batches, text, ENCODE_BYTES):
            ids, ends = own.encode(b.column(text))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype("i4")), pa.array(ids.astype("i4")))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists], names=[*names, out])

    return df.mapInArrow(run, schema)


def decode_documents(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """df and the text of its ids; null ids decode as empty."""
    lean(df.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out) + f", `{out}` string"
    names = [f.name for f in df.schema if f.name != out]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            texts = ["".join(own.decode(np.array(x or [], "<u4"))) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

    return df.mapInArrow(run, schema)


def encoded_digests(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Encodes and decodes each text where it is read; only digests leave the task."""
    lean(df.sparkSession)
    given = default_vocabulary()
    path, pattern = path or given[0], pattern or given[1]
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in text_slices(batches, text, ENCODE_BYTES):
            ids, ends = own.encode(b.column(text))
            n, ids_sha, back_sha = np.diff(ends, prepend=0), [], []
            for x in np.split(ids, ends[:-1]):
                back = hashlib.sha256()
                for piece in own.decode(x):
                    back.update(piece.encode())
                ids_sha.append(hashlib.sha256(x.tobytes()).hexdigest())
                back_sha.append(back.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(back_sha, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
