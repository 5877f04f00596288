"""Byte-level BPE by ranks: whole texts to ids and ids back to bytes, in numpy.

A text is cut by the vocabulary's pattern. Pieces that are tokens have their
rank; each distinct other piece becomes a row of byte tokens in a padded matrix
of its length bucket. Every round each row merges its leftmost pair of least
rank: the pair's rank, which is the id of what it makes, replaces the left
token, the rest moves one place left, and only the two pairs beside it are
looked up again. Rows without a pair leave, so a matrix loses a column a round
and its finished rows. Pairs are found in an open-addressing table of hashes.

A row of k bytes takes up to k rounds of k columns. Pieces of more than ``WIDEST``
bytes, which prose has not, are merged in the same order by a heap, in k log k.
Decoding gathers the tokens' bytes by tables of starts and lengths.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import mix, slices
from .tokens import _Table, resolve

U64 = np.uint64
RANKS = "byte_bpe_multi_50k.tiktoken"
#: Upper lengths of the buckets, and how many cells a matrix has at most.
BUCKETS, WIDEST, CELLS = (2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512), 512, 1 << 20
#: Pieces that a worker remembers, and their characters, before it starts afresh.
PIECES, PIECE_CHARS = 1 << 18, 1 << 22
#: A longer text is taken in portions of so many pieces; so many ids are decoded at once.
LONG_TEXT, PORTION, IDS = 1 << 21, 1 << 18, 1 << 20
#: The rank of a pair that makes no token.
NONE = np.int32(2**31 - 1)


class _Places(dict):
    """Numbers pieces in order of arrival and lists the new ones."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.fresh.append(piece)
        return n


class Vocabulary:
    """Ranks of byte strings, every single byte among them, and the pattern that cuts texts."""

    _made: dict[tuple[str, str | None], Vocabulary] = {}

    @classmethod
    def of(cls, path: str, pattern: str | None = None) -> Vocabulary:
        """One per worker process."""
        if (path, pattern) not in cls._made:
            with open(resolve(path), "rb") as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
            cls._made[path, pattern] = cls(ranks, pattern)
        return cls._made[path, pattern]

    def __init__(self, ranks: dict[bytes, int], pattern: str | None = None):
        import regex

        if pattern is None:
            import public_tokenizers

            pattern = public_tokenizers.PATTERN
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"{len(missing)} bytes have no rank, the first is {missing[0]}")
        if not all(ranks):
            raise ValueError("the empty string has a rank")
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        # every way to make a token of two
        made = [(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, rank = (np.array(x, np.int64) for x in zip(*made, strict=True)) if made else (np.zeros(0, np.int64),) * 3
        self.pairs = _Table(max(4, (2 * len(made)).bit_length()))
        self.pairs.put(self._keys(left, right), rank.astype(np.int32))
        # bytes of every id, one after the other; ids that no token has are of length -1
        size = np.full(max(ranks.values()) + 1, -1, np.int64)
        size[list(ranks.values())] = [len(t) for t in ranks]
        self.size, self.start = size, np.r_[0, np.cumsum(np.maximum(size, 0))][:-1]
        self.bytes = np.frombuffer(b"".join(sorted(ranks, key=ranks.__getitem__)), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.places, self.chars = _Places(), 0
        self.at, self.ids, self.used = np.zeros(1, np.int64), np.zeros(1 << 16, np.int32), 0

    @staticmethod
    def _keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """A bijection of pairs that never gives 0."""
        return mix((left.astype(U64) + U64(1)) << U64(32) | right.astype(U64))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        found = self.pairs.find(self._keys(left.ravel(), right.ravel())).reshape(left.shape)
        found[found < 0] = NONE
        return found

    # -- merging ---------------------------------------------------------------

    def merge(self, ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merges every row of a padded matrix; the ids left of all rows, one after the other, and how many of each."""
        n, width = ids.shape
        out, out_size, row = np.zeros_like(ids), size.copy(), np.arange(n)
        rank = self._rank(ids[:, :-1], ids[:, 1:])
        rank[np.arange(1, width)[None, :] >= size[:, None]] = NONE
        while True:
            width = ids.shape[1]
            here = np.arange(len(row))
            at = rank.argmin(1) if width > 1 else np.zeros(len(row), np.int64)
            best = rank[here, at] if width > 1 else np.full(len(row), NONE)
            stop = best == NONE
            if stop.any():
                out[row[stop], :width], out_size[row[stop]] = ids[stop], size[stop]
                go = ~stop
                if not go.any():
                    break
                ids, rank, size, row, at, best = ids[go], rank[go], size[go], row[go], at[go], best[go]
                here = np.arange(len(row))
            size = size - 1
            width = int(size.max())
            cols = np.arange(width)[None, :]
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[here, at] = best
            cols = cols[:, : width - 1]
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], ids[left, at[left]])
            right = np.flatnonzero(at + 1 < size)
            rank[right, at[right]] = self._rank(ids[right, at[right]], ids[right, at[right] + 1])
            last = np.flatnonzero((at + 1 >= size) & (at < width - 1))
            rank[last, at[last]] = NONE
        return out[np.arange(out.shape[1])[None, :] < out_size[:, None]], out_size

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same for one long piece, by a heap of (rank, place)."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        first = self._rank(ids[:-1], ids[1:])
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        known = np.r_[first, NONE].tolist()  # the rank of the pair that starts at a place
        ids, n = ids.tolist(), len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        pairs: dict[tuple[int, int], int] = {}

        def again(i: int) -> None:
            """Looks up the pair from place i on."""
            j, rank = after[i], int(NONE)
            if j >= 0:
                pair = ids[i], ids[j]
                rank = pairs.get(pair)
                if rank is None:
                    rank = pairs[pair] = int(self._rank(np.array(pair[:1]), np.array(pair[1:]))[0])
            known[i] = rank
            if rank != NONE:
                heapq.heappush(heap, (rank, i))

        while heap:
            rank, i = heapq.heappop(heap)
            if known[i] != rank or ids[i] < 0:
                continue  # the pair is no more
            j = after[i]
            ids[i], ids[j], known[j] = rank, -1, int(NONE)
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            again(i)
            if before[i] >= 0:
                again(before[i])
        left = np.array(ids, np.int32)
        return left[left >= 0]

    def encode_pieces(self, pieces: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after the other, and how many each has. An empty piece has none."""
        whole = np.array([self.ranks.get(p, -1) for p in pieces], np.int64)
        length = np.array([len(p) for p in pieces], np.int64)
        size = np.where(length > 0, 1, 0)
        found: list[tuple[np.ndarray, np.ndarray]] = [(known := np.flatnonzero(whole >= 0), whole[known].astype(np.int32))]
        low = 1
        for high in BUCKETS:
            bucket = np.flatnonzero((whole < 0) & (length > low) & (length <= high))
            low = high
            for part in (bucket[i : i + CELLS // high] for i in range(0, len(bucket), CELLS // high)):
                data = np.frombuffer(b"".join([pieces[i] for i in part.tolist()]), np.uint8)
                matrix = np.zeros((len(part), high), np.int32)
                matrix[np.arange(high)[None, :] < length[part][:, None]] = self.byte[data]
                ids, size[part] = self.merge(matrix, length[part])
                found.append((part, ids))
        for i in np.flatnonzero((whole < 0) & (length > WIDEST)).tolist():
            ids = self.merge_long(pieces[i])
            size[i] = len(ids)
            found.append((np.array([i]), ids))
        start = np.r_[0, np.cumsum(size)]
        out = np.zeros(start[-1], np.int32)
        for part, ids in found:
            span = size[part]
            out[np.repeat(start[part] - np.r_[0, np.cumsum(span)[:-1]], span) + np.arange(len(ids))] = ids
        return out, size

    # -- texts -----------------------------------------------------------------

    def _learn(self) -> None:
        """Ids of the pieces that are new."""
        fresh = self.places.fresh
        ids, size = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in fresh])
        self.chars += sum(map(len, fresh))
        self.places.fresh = []
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.at = np.r_[self.at, self.used + np.cumsum(size)]
        self.used += len(ids)

    def _joined(self, places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of known pieces in order, and where each begins."""
        rows = np.array(places, np.int64)
        size = self.at[rows + 1] - self.at[rows]
        before = np.r_[0, np.cumsum(size)]
        return self.ids[np.repeat(self.at[rows] - before[:-1], size) + np.arange(before[-1])].astype("<u4"), before

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids (little-endian, unsigned, 32 bits), one after the other, and each text's offsets among them; null is empty."""
        parts, size = [], np.zeros(len(texts), np.int64)
        places: list[int] = []
        ends: list[tuple[int, int]] = []  # of the texts at hand: number, pieces so far

        def flush() -> None:
            nonlocal places, ends
            if self.places.fresh:
                self._learn()
            ids, before = self._joined(places)
            parts.append(ids)
            at = 0
            for i, end in ends:
                size[i] += before[end] - before[at]
                at = end
            places, ends = [], []
            if len(self.places) > PIECES or self.chars > PIECE_CHARS:
                self._forget()

        for i, text in enumerate(texts):
            if not text:
                continue
            if len(text) <= LONG_TEXT:
                places.extend(map(self.places.__getitem__, self.pattern.findall(text)))
                ends.append((i, len(places)))
                if len(places) >= PORTION:
                    flush()
                continue
            found = (m.group() for m in self.pattern.finditer(text))
            while portion := list(islice(found, PORTION)):
                places.extend(map(self.places.__getitem__, portion))
                ends.append((i, len(places)))
                flush()
        flush()
        return np.concatenate(parts), np.r_[0, np.cumsum(size)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, by table lookup; an id that no token has is an error."""
        out = []
        for part in (ids[i : i + IDS] for i in range(0, len(ids), IDS)):
            if (part >= len(self.size)).any() or (self.size[part] < 0).any():
                raise ValueError("an id is not of the vocabulary")
            size = self.size[part]
            before = np.r_[0, np.cumsum(size)]
            out.append(self.bytes[np.repeat(self.start[part] - before[:-1], size) + np.arange(before[-1])].tobytes())
        return b"".join(out)


Arrow = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def _encode(path: str, pattern: str | None) -> Arrow:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        for batch in slices(batches, "t"):
            ids, off = vocabulary.encode(batch.column("t").to_pylist())
            data = pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(4 * off), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(np.diff(off)), data.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _decode(path: str, pattern: str | None) -> Arrow:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.of(path, pattern)
        for batch in slices(batches, "ids"):
            data = [None if ids is None else vocabulary.decode(np.frombuffer(ids, "<u4")) for ids in batch.column("ids").to_pylist()]
            keep = [c for c in batch.schema.names if c != "decoded"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(data, pa.binary())], names=[*keep, "decoded"])

    return run


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def encode(docs: DataFrame, ranks: str = RANKS, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary, little-endian unsigned 32-bit).

    ``ranks`` is a file of ranks or the name of a public one, ``pattern`` cuts texts
    (by default that of the public tokenizers). No text has special tokens; their
    strings are ordinary text. Null and empty texts have no ids. Rows are encoded
    one by one, so repeated or null doc_ids, of whatever type, are no matter; an
    empty table gives no rows; other columns are ignored. One pass, no shuffle; of
    a text of any length, pieces are held a portion at a time.
    """
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(_encode(ranks, pattern), f"doc_id {dict(rows.dtypes)['d']}, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str = RANKS, pattern: str | None = None) -> DataFrame:
    """The rows with ``decoded`` (binary) from ``ids``: for ids of a text its UTF-8 bytes. Null ids give null, an id without token is an error."""
    kept = encoded.drop("decoded")
    return kept.mapInArrow(_decode(ranks, pattern), f"{_schema(kept)}, decoded binary")
