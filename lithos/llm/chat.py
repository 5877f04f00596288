"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with character offsets, and the
mask is the intersection of the sorted spans of assistant texts with the
tokens' spans, found by binary search.

Template: ``<s>`` opens a conversation; a turn is ``[INST]``, its role,
``[/INST]``, its text and ``</s>``. The four marks are added tokens, so none can
merge with text. A mark inside a role or text is escaped by a backslash behind
its first character (``[\\INST]``); where backslashes stand there already, one
more is added, so taking one away gives the text again.

A conversation of turns 0 to ``SEGMENT_TURNS`` - 1 is one segment and so rendered
and encoded whole. Longer ones are dealt by ``turn // SEGMENT_TURNS`` too, so one
with a large part of all rows is the work of many tasks; marks are never merged
with their neighbours, hence the segments' ids joined are the ids of the whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import resolve

TOKENIZER = "byte_bpe_50k.json"
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
MARKS = (OPEN, ROLE, TEXT, CLOSE)
#: A segment of more turns, as ties or nulls in the turn numbers can make, comes in parts of so many.
SEGMENT_TURNS, PART_TURNS = 1024, 4096
#: Characters that a task renders before it encodes them.
FLUSH_CHARS = 1 << 20

_marks = re.compile(r"(<)(\\*)(/?s>)|(\[)(\\*)(/?INST\])")


def escape(text: str) -> str:
    return _marks.sub(lambda m: (m[1] or m[4]) + "\\" + (m[2] or m[5] or "") + (m[3] or m[6]), text)


def unescape(text: str) -> str:
    # only forms that ``escape`` makes for the bracket at hand
    return re.sub(r"<\\(\\*/?s>)|\[\\(\\*/?INST\])", lambda m: "<" + m[1] if m[1] is not None else "[" + m[2], text)


def render(turns: list[tuple[str, str]], first: bool = True) -> tuple[str, list[tuple[int, int, str]]]:
    """The formatted text of (role, text) turns, and the span of every turn's text in it with its role."""
    out, spans, at = [OPEN] if first else [], [], len(OPEN) if first else 0
    for role, text in turns:
        head, body = ROLE + escape(role) + TEXT, escape(text)
        spans.append((at + len(head), at + len(head) + len(body), role))
        out += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation or segment."""
    return [(unescape(r), unescape(t)) for r, t in re.findall(r"\[INST\](.*?)\[/INST\](.*?)</s>", formatted, re.S)]


def token_mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens lie in one of the sorted, disjoint spans; a token at ``offsets[i]`` covers [start, end)."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), bool)
    starts, ends = np.array(spans).T
    at = np.searchsorted(starts, offsets[:, 0], "right") - 1
    return (at >= 0) & (offsets[:, 1] <= ends[np.maximum(at, 0)]) & (offsets[:, 0] < ends[np.maximum(at, 0)])


_made: dict[str, object] = {}


def _tokenizer(path: str):
    if path not in _made:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import AddedToken, Tokenizer

        t = Tokenizer.from_file(resolve(path))
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
        _made[path] = t
    return _made[path]


_SCHEMA = "conv_id {kind}, segment long, part int, n_turns int, formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss_mask array<boolean>"


def _format(tokenizer: str, train: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _tokenizer(tokenizer)
        held: list[tuple] = []  # finished segments
        size, key, part, turns, kind = 0, None, 0, [], pa.int64()

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            done, held, size = held, [], 0
            made = [render(t, first) for _, _, first, t in done]
            encoded = model.encode_batch([m[0] for m in made], add_special_tokens=False)
            ids, starts, ends, masks = [], [], [], []
            for (_, spans), e in zip(made, encoded, strict=True):
                offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
                ids.append(e.ids)
                starts.append(offsets[:, 0])
                ends.append(offsets[:, 1])
                masks.append(token_mask(offsets, [(a, b) for a, b, role in spans if role == train]).tolist())
            cols = [pa.array([k[0] for k, _, _, _ in done], kind), pa.array([k[1] for k, _, _, _ in done], pa.int64()), pa.array([p for _, p, _, _ in done], pa.int32()), pa.array([len(t) for _, _, _, t in done], pa.int32()), pa.array([m[0] for m in made], pa.string())]
            cols += [pa.array(x, pa.list_(pa.int32())) for x in (ids, starts, ends)] + [pa.array(masks, pa.list_(pa.bool_()))]
            return pa.RecordBatch.from_arrays(cols, names=["conv_id", "segment", "part", "n_turns", "formatted", "token_ids", "token_starts", "token_ends", "loss_mask"])

        for batch in batches:
            kind = batch.column("c").type
            for c, s, first, role, text in zip(*(batch.column(n).to_pylist() for n in ("c", "s", "first", "r", "t")), strict=True):
                if turns and ((c, s) != key or len(turns) >= PART_TURNS):
                    held.append((key, part, opens, turns))
                    turns, part = [], part + 1
                    if size > FLUSH_CHARS:
                        yield flush()
                if (c, s) != key:
                    key, part = (c, s), 0
                opens = first and not part
                turns.append((role or "", text or ""))
                size += len(text or "")
        if turns:
            held.append((key, part, opens, turns))
        if held:
            yield flush()

    return run


def format_chat(turns: DataFrame, tokenizer: str = TOKENIZER, train: str = "assistant", conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows per segment of a conversation: conv_id, segment, part, n_turns, formatted, token_ids, token_starts, token_ends, loss_mask.

    A conversation's rows in ascending order of segment and part, joined, are the conversation;
    the first opens with ``<s>``. Offsets count characters within the segment.

    Null roles and texts are empty. Turns are ordered by turn number, nulls
    first, then role, then text, so ties and repeated rows have one order and
    all stay. Null conversation ids are one conversation. An empty table gives
    no rows; other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("c"), F.col(turn_col).cast("long").alias("n"), F.col(role_col).cast("string").alias("r"), F.col(text_col).cast("string").alias("t"))
    rows = rows.withColumn("s", F.coalesce(F.floor(F.col("n") / SEGMENT_TURNS), F.lit(-(1 << 62))))
    # only conversations of several segments need to be told where they begin
    several = rows.groupBy("c").agg(F.min("s").alias("low"), F.max("s").alias("high")).where("low < high").select(F.col("c").alias("lc"), "low")
    rows = rows.join(several, F.col("c").eqNullSafe(F.col("lc")), "left").withColumn("first", F.coalesce(F.col("s") == F.col("low"), F.lit(True)))
    rows = rows.select("c", "s", "first", "n", "r", "t").repartition("c", "s").sortWithinPartitions("c", "s", F.col("n").asc_nulls_first(), F.coalesce("r", F.lit("")), F.coalesce("t", F.lit("")))
    return rows.mapInArrow(_format(tokenizer, train), _SCHEMA.format(kind=dict(rows.dtypes)["c"]))


def masked_texts(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> list[str]:
    """The unescaped text under the mask, one entry for each run of masked tokens."""
    out, at, begin = [], None, None
    for a, b, m in zip(starts, ends, mask, strict=True):
        if m:
            begin = a if begin is None else begin
            at = b
        elif begin is not None:
            out.append(unescape(formatted[begin:at]))
            begin = None
    if begin is not None:
        out.append(unescape(formatted[begin:at]))
    return out
