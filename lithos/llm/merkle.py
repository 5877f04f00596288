"""Document fingerprints: a Merkle tree over sections and paragraphs, with the pieces that a paragraph has.

A section ends at a blank line and a paragraph at a line end. A paragraph's
digest covers its text, and every node above has the digest of its children's
digests in order: equal roots mean equal texts, and descending only where
digests differ locates an edit.

A paragraph's pieces are cut by content: behind a character where a hash of the
four that end there is small, wherever in the text that is. So a word put in or
taken out changes the pieces around it and no others, with full stops or
without, in any script. A piece has at least ``LEAST`` and at most ``MOST``
characters, but for a paragraph's last.

A fingerprint writes the tree down: the root's digest, and for each section and
paragraph a short digest, with the pieces' short digests and lengths. Two
fingerprints alone give the share of text that their documents have in common:
equal sections count as they are, the rest descends to paragraphs, and what
differs there to pieces.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranges as id_ranges
from .batches import mix, slices

#: Characters of a piece; one of ``OFTEN`` places can end one.
LEAST, MOST, OFTEN = 4, 255, 12
#: Characters that are hashed at once.
PORTION = 1 << 20
_sections = re.compile(r"[^\n]*(?:\n[^\n]+)*\n*")
_paragraphs = re.compile(r"[^\n]*\n+|[^\n]+")
#: Odd factors of the characters of a window, and of its hash.
_WINDOW, _FACTOR = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F), np.uint32(0x165667B1)


@dataclass
class Node:
    """A section, paragraph or piece, or the document: digest, character span, children."""

    kind: str
    start: int
    end: int
    digest: bytes
    children: list[Node] = field(default_factory=list)


def _layout(text: str) -> list[list[tuple[int, int]]]:
    """The paragraphs' spans, section by section."""
    out = []
    for s in _sections.finditer(text):
        if s[0]:
            out.append([(s.start() + m.start(), s.start() + m.end()) for m in _paragraphs.finditer(s[0])])
    return out


def _pieces(text: str, ends: list[int]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Ends and 64-bit hashes of the pieces, and how many there are up to each paragraph's end."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found = []
    for begin in range(0, len(codes), PORTION):
        seen = codes[max(0, begin - 3) : begin + PORTION]  # with what a window reaches back to
        h = seen * np.uint32(_WINDOW[0])
        for back, factor in enumerate(_WINDOW[1:], 1):
            h[back:] += seen[: len(seen) - back] * np.uint32(factor)
        h ^= h >> np.uint32(15)
        h *= _FACTOR
        h ^= h >> np.uint32(13)
        own = min(begin, 3)
        found.append(np.flatnonzero(h[own:] < np.uint32((1 << 32) // OFTEN)) + begin + 1)
    places = np.concatenate(found).tolist()
    cut: list[int] = []
    upto = []
    at = i = 0
    for end in ends:
        while i < len(places) and (c := places[i]) < end:
            i += 1
            if c - at >= LEAST:
                while c - at > MOST:
                    at += MOST
                    cut.append(at)
                cut.append(c)
                at = c
        while end - at > MOST:
            at += MOST
            cut.append(at)
        cut.append(end)
        at = end
        upto.append(len(cut))
    stop = np.array(cut, np.int64)
    start = np.r_[0, stop[:-1]]
    hashes = np.empty(len(stop), np.uint64)
    first = 0
    while first < len(stop):
        last = max(first + 1, int(np.searchsorted(stop, start[first] + PORTION, "right")))
        x, y, low = start[first:last], stop[first:last], start[first]
        inside = (np.arange(y[-1] - low) - np.repeat(x - low, y - x)).astype(np.uint64)
        hashes[first:last] = np.add.reduceat(mix(codes[low : y[-1]].astype(np.uint64) + (inside << np.uint64(32)) + np.uint64(1)), x - low)
        first = last
    return stop, hashes, upto


def pieces(text: str) -> list[str]:
    """The text cut into its pieces; joined they are the text."""
    ends = [b for section in _layout(text) for _, b in section]
    cut = [0, *_pieces(text, ends)[0].tolist()] if text else [0]
    return [text[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def _digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()


def _own(paragraph: str) -> bytes:
    return _digest(b"paragraph\0" + paragraph.encode("utf-8", "surrogatepass"))


def _parent(kind: str, children: list[Node], start: int) -> Node:
    return Node(kind, children[0].start if children else start, children[-1].end if children else start, _digest(kind.encode() + b"\0" + b"".join(c.digest for c in children)), children)


def tree(text: str | None) -> Node:
    """The whole tree; null is as the empty text, a document without sections."""
    text = text or ""
    layout = _layout(text)
    sections: list[Node] = []
    if layout:
        stop, hashes, upto = _pieces(text, [b for section in layout for _, b in section])
        ends, first, n = stop.tolist(), 0, 0
        for section in layout:
            paragraphs = []
            for a, b in section:
                spans = zip([a, *ends[first : upto[n] - 1]], ends[first : upto[n]], hashes[first : upto[n]], strict=True)
                paragraphs.append(Node("paragraph", a, b, _own(text[a:b]), [Node("piece", x, y, h.tobytes()) for x, y, h in spans]))
                first, n = upto[n], n + 1
            sections.append(_parent("section", paragraphs, 0))
    return _parent("document", sections, 0)


def differing(a: Node, b: Node) -> list[tuple[int, int]]:
    """Character spans of ``a`` that ``b`` lacks at that place, found by descending differing branches only."""
    if a.digest == b.digest:
        return []
    if not a.children or not b.children:
        return [(a.start, a.end)] if a.end > a.start else []
    # branches in common at either end keep their place; what lies between is compared in order
    x, y = a.children, b.children
    n = 0
    while n < min(len(x), len(y)) and x[n].digest == y[n].digest:
        n += 1
    m = 0
    while m < min(len(x), len(y)) - n and x[-1 - m].digest == y[-1 - m].digest:
        m += 1
    x, y = x[n : len(x) - m], y[n : len(y) - m]
    out = [span for i, j in zip(x, y, strict=False) for span in differing(i, j)]
    return out + [(i.start, i.end) for i in x[len(y) :]]


def fingerprint(text: str | None) -> str:
    """Root digest, a colon, and the sections with semicolons between them.

    A section is eight hex digits of its digest and its paragraphs, each after a
    comma; a paragraph is eight digits and for each piece six of its digest and
    two of its length. The root is that of ``tree``, made here without the nodes.
    """
    text = text or ""
    sha, out, sections = hashlib.sha256, [], []
    layout = _layout(text)
    if layout:
        stop, hashes, upto = _pieces(text, [b for section in layout for _, b in section])
        # 24 bits of the hash and 8 of the length, as eight hex digits
        size = np.diff(stop, prepend=0).astype(np.uint64)
        written = ((hashes >> np.uint64(40) << np.uint64(8)) | size).astype(">u4").tobytes().hex()
        first = n = 0
        for section in layout:
            digests, lines = [], []
            for a, b in section:
                own = _own(text[a:b])
                digests.append(own)
                lines.append(own[:4].hex() + written[8 * first : 8 * upto[n]])
                first, n = upto[n], n + 1
            digest = sha(b"section\0" + b"".join(digests)).digest()
            sections.append(digest)
            out.append(",".join([digest[:4].hex(), *lines]))
    return sha(b"document\0" + b"".join(sections)).hexdigest() + ":" + ";".join(out)


def _chars(paragraph: str) -> int:
    """Characters of a paragraph, from the lengths of its pieces."""
    return sum(bytes.fromhex(paragraph[8:])[3::4])


def likeness(a: str, b: str) -> float:
    """Twice the characters in branches that both have, over all characters of both; 1 for equal roots.

    Sections that both have count whole; of the others, paragraphs that both
    have; and of those that are left, pieces. What stands at another place
    counts too.
    """
    if a[:64] == b[:64]:
        return 1.0
    x, y = (Counter(s[65:].split(";")) for s in (a, b))
    size = lambda s: sum(map(_chars, s.split(",")[1:]))
    total = sum(size(s) * n for c in (x, y) for s, n in c.items())
    if not total:
        return 0.0
    same = x & y
    common = sum(size(s) * n for s, n in same.items())
    x, y = (Counter(p for s, n in (c - same).items() for p in s.split(",")[1:] for _ in range(n)) for c in (x, y))
    same = x & y
    common += sum(_chars(p) * n for p, n in same.items())
    x, y = (Counter(p[i : i + 8] for p, n in (c - same).items() for i in range(8, len(p), 8) for _ in range(n)) for c in (x, y))
    common += sum(int(p[6:], 16) * n for p, n in (x & y).items())
    return 2 * common / total


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter of code points replaced by the first as many, or all, of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


# -- over a table ------------------------------------------------------------


def _deal(edges: list[int], heads: dict[int, object], last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compressed texts with the range each goes to; a range's first row also goes to the range before it."""
    before: dict[object, list[int]] = {}
    order = sorted(heads)
    for i, bucket in enumerate(order):
        before.setdefault(heads[bucket], []).append(order[i - 1] if i else last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, "t"):
            ids, texts = batch.column("d").to_pylist(), batch.column("t").to_pylist()
            bucket, doc, after, data = [], [], [], []
            for d, t in zip(ids, texts, strict=True):
                packed = pack.compress((t or "").encode("utf-8", "surrogatepass"))
                bucket.append(id_ranges.of(d, edges))
                doc.append(d)
                after.append(False)
                data.append(packed)
                for other in before.get(d, ()):
                    bucket.append(other)
                    doc.append(d)
                    after.append(True)
                    data.append(packed)
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(doc, batch.column("d").type), pa.array(after), pa.array(data, pa.binary())], names=["bucket", "d", "after", "t"])

    return run


def _prints(last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        held: tuple | None = None  # the row that waits for the next one: bucket, id, text, fingerprint
        out: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal out, size
            rows, out, size = out, [], 0
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], names=["doc_id", "n_chars", "text", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        kind = None
        for batch in batches:
            kind = batch.column("d").type
            for bucket, d, after, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "d", "after", "t")), strict=True):
                text = unpack.decompress(raw).decode("utf-8", "surrogatepass")
                if held and held[0] != bucket:
                    held = None  # its next row came as the extra row of its own range
                if after and not held:
                    continue
                own = fingerprint(text)
                if held:
                    _, d0, t0, f0 = held
                    changed = edited(t0, text)
                    fe = fingerprint(changed)
                    out.append((d0, len(t0), t0, changed, f0, fe, likeness(f0, fe), likeness(f0, own)))
                    size += 2 * len(t0)
                    if size > 4 << 20:
                        yield flush()
                held = None if after else (bucket, d, text, own)
        if out:
            yield flush()

    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, and how like it is to its edited text's and to the next document's.

    The edited text is the document's with its last quarter replaced by the
    start of the next document, in ascending order of id; the last is
    followed by the first. Returns doc_id, n_chars (code points), text,
    edited_text, fingerprint, edited_fingerprint, near_edited, near_next.

    Texts move once, compressed, to ranges of ids whose bounds are quantiles; a
    range also gets the first row of the next. Driver and closures hold a bound
    and a first id for each range only.

    Null texts are empty; empty ones have the empty tree and are like only
    other empty ones. Null ids come first; rows that repeat an id follow each
    other in an order that only their texts decide. A single row follows itself. An empty table gives
    no rows; other columns are ignored. Ids must be numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(rows.dtypes)["d"]
    schema = f"doc_id {kind}, n_chars long, text string, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    edges = id_ranges.bounds(rows, "d", ranges)
    heads = id_ranges.heads(rows, "d", edges)
    if not heads:
        return spark.createDataFrame([], schema)
    dealt = rows.mapInArrow(_deal(edges, heads, max(heads)), f"bucket int, d {kind}, after boolean, t binary")
    dealt = dealt.repartitionById(ranges, F.col("bucket")).sortWithinPartitions("bucket", "after", F.col("d").asc_nulls_first(), "t")
    return dealt.mapInArrow(_prints(max(heads)), schema)
