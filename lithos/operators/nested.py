"""Nested sets of forests: every node's places of entry and exit on a walk, so that what lies below, above and nearest is a matter of ranges.

Nodes are (scope, stable_key, parent_key). The walk through a scope is a list of
entries and exits, each of which knows the next. Nodes are numbered in ranges of
scope and order; each task follows the walk through its own ranges, and only the
elements at which a walk enters a range from elsewhere are ranked over all. If
they are many, as in a forest whose order says nothing of its shape, they are
ranked by doubling, in rounds that follow the logarithm of the length. A scope
of any size and depth is spread over all tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.operators import ordered
from lithos.plans.lineage import cut

#: Lines of a bin by which spans meet points.
BIN = 4096
#: So many elements at most are ranked in one task, and broadcast.
FEW = 1 << 18
#: Bits of a node's number that count nodes of one range: those of a row in ``monotonically_increasing_id`` and one more.
_RANGE_BITS = 34


def nested_sets(nodes: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """(scope, stable_key, parent_key, enter_no, exit_no, depth): numbers from 0 within a scope, in the order of siblings.

    A node lies below another if its numbers lie between the other's. Keys are
    distinct within a scope and scopes not null; siblings are sorted by ``order`` and
    key. A parent that the scope lacks counts as a level, as it would if it
    were there, and takes two numbers; nodes on cycles, or below one, are left out.
    """
    own = nodes.select(*scope, "stable_key", "parent_key", F.struct(*order, "stable_key").alias("_o"))
    # numbers follow scope and order, so they tell the order of siblings
    dealt = own.repartitionByRange(*scope, "_o").sortWithinPartitions(*scope, "_o")
    ids = cut(dealt.select(*scope, "stable_key", "parent_key", (2 * F.monotonically_increasing_id() + 1).alias("_id")))
    linked = cut(ids.join(ids.select(*scope, F.col("stable_key").alias("parent_key"), F.col("_id").alias("_up")), [*scope, "parent_key"], "left"))
    rows = linked.select(*scope, "_id", "_up")
    lost = linked.where("parent_key is not null and _up is null")
    if not lost.isEmpty():
        # a missing parent stands where its first child does
        missing = cut(lost.groupBy(*scope, "parent_key").agg((F.min("_id") - 1).alias("_lost")))
        met = linked.join(missing, [*scope, "parent_key"], "left").select(*scope, "_id", F.coalesce("_up", "_lost").alias("_up"))
        rows = met.unionAll(missing.select(*scope, F.col("_lost").alias("_id"), F.lit(None).cast("long").alias("_up")))
    # siblings: the children of a node, or the roots of a scope
    near = ordered.neighbours(rows.withColumn("_p", F.coalesce("_up", F.lit(-1))), [*scope, "_p"], ["_id"], F.struct("_id"), following="_after")
    first = rows.where("_up is not null").groupBy(F.col("_up").alias("_id")).agg(F.min("_id").alias("_first"))
    walk = near.select(*scope, "_id", "_up", F.col("_after._id").alias("_after")).join(first, "_id", "left")
    placed = _ranked_nodes(walk.select(*scope, "_id", "_up", "_first", "_after"), scope)
    whole = placed.groupBy(*scope).agg(F.max("_in").alias("_all"))
    met = linked.drop("_up").join(placed.drop(*scope), "_id").join(whole, scope).withColumn("enter_no", F.col("_all") - F.col("_in")).withColumn("exit_no", F.col("_all") - F.col("_out"))
    # entries before the node, less the exits before it
    before = F.expr("_all div 2 - _entries")
    return met.select(*scope, "stable_key", "parent_key", "enter_no", "exit_no", (2 * before - F.col("enter_no")).cast("int").alias("depth"))


def _follow(e: np.ndarray, next_: np.ndarray, steps: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Follows each element to the first one that is not in ``e``, or the end (-1), in place; which of them get there, as rings never do."""
    order = np.argsort(e)
    found = np.minimum(np.searchsorted(e, next_, sorter=order), max(len(e) - 1, 0))
    at = np.where(e[order[found]] == next_, order[found], -1) if len(e) else found
    for _ in range(len(e).bit_length() + 1):
        going = np.flatnonzero(at >= 0)
        if not going.size:
            break
        to = at[going]
        for a in (steps, entries):
            a[going] += a[to]
        next_[going] = next_[to]
        at[going] = at[to]
    return at < 0


def _table(batches: Iterator[pa.RecordBatch], schema: list[str]) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).select(schema) if held else None


def _longs(column: pa.ChunkedArray, null: int = -1) -> np.ndarray:
    return np.array(column.fill_null(null).to_numpy(), dtype=np.int64)


def _to_column(values: np.ndarray) -> pa.Array:
    """Numbers, -1 as null."""
    return pa.array(values, pa.int64(), mask=values < 0)


def _ranked_nodes(walk: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, _id, _in, _out, _entries): of each node (scope, _id, _up, _first child, _after it), how many elements of its walk there are from its entry and its exit on, and entries from its entry on.

    An entry is element 2 * id, an exit 2 * id + 1. Nodes whose walk has no end are left out.
    """
    names = [*scope, "_id", "_up", "_first", "_after"]
    made = ["_in_next", "_in", "_entries", "_out_next", "_out", "_out_entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches, names)
        if rows is None:
            return
        id_, up, first, after = (_longs(rows.column(c)) for c in names[-4:])
        n = len(id_)
        next_ = np.concatenate([np.where(first >= 0, 2 * first, 2 * id_ + 1), np.where(after >= 0, 2 * after, np.where(up >= 0, 2 * up + 1, -1))])
        steps, entries = np.ones(2 * n, np.int64), np.repeat(np.array([1, 0], np.int64), n)
        ended = _follow(np.concatenate([2 * id_, 2 * id_ + 1]), next_, steps, entries)
        columns = [c for i in (slice(0, n), slice(n, None)) for c in (_to_column(next_[i]), pa.array(steps[i]), pa.array(entries[i]))]
        out = rows.select(names[: len(scope) + 1])
        for name, c in zip(made, columns, strict=True):
            out = out.append_column(name, c)
        yield from out.filter(pa.array(ended[:n] & ended[n:])).combine_chunks().to_batches(max_chunksize=1 << 16)

    types = dict(walk.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names[: len(scope) + 1]), *(f"{c} long" for c in made)])
    # the nodes of a range are one task's
    found = cut(walk.select(*names).repartition(F.shiftright("_id", _RANGE_BITS)).mapInArrow(run, schema))
    asked = cut(found.select(F.explode(F.array("_in_next", "_out_next")).alias("e")).where("e is not null").distinct())
    count = asked.count()
    if count:
        few = F.broadcast if count <= FEW else lambda df: df
        element = lambda i, *c: F.struct((F.col("_id") * 2 + i).alias("e"), *(F.col(x).alias(y) for x, y in zip(c, ("next", "steps", "entries"), strict=True)))
        all_ = found.select(F.inline(F.array(element(0, *made[:3]), element(1, *made[3:]))))
        ranks = cut(_ranked(all_.join(few(asked), "e", "left_semi"), count))
        for next_, *sums in (made[:3], made[3:]):
            rest = few(ranks.select(F.col("e").alias(next_), F.col("steps").alias("_s"), F.col("entries").alias("_e"), F.lit(True).alias("_known")))
            met = found.join(rest, next_, "left").where(f"{next_} is null or _known")
            found = met.withColumns({c: F.col(c) + F.coalesce(d, F.lit(0)) for c, d in zip(sums, ("_s", "_e"), strict=True)}).drop("_s", "_e", "_known")
    return found.select(*scope, "_id", "_in", "_out", "_entries")


def _ranked(steps: DataFrame, count: int) -> DataFrame:
    """Of each of ``count`` list elements (e, next, steps, entries), how many elements and entries there are from it to the end; elements of rings are left out."""
    names = ["e", "next", "steps", "entries"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _table(batches, names)
        if rows is not None:
            e, next_, s, n = (_longs(rows.column(c)) for c in names)
            ended = _follow(e, next_, s, n) & (next_ < 0)
            yield pa.RecordBatch.from_arrays([pa.array(a[ended]) for a in (e, s, n)], names=["e", "steps", "entries"])

    if count <= FEW:
        return steps.select(*names).repartition(1).mapInArrow(run, "e long, steps long, entries long")
    return _doubled(cut(steps.select(*names)))


def _doubled(steps: DataFrame) -> DataFrame:
    """``_ranked`` of a list of any length, each round twice as far."""
    most, reach = 2 * steps.count(), 1
    while reach < most:
        open_ = steps.where("next is not null")
        if open_.isEmpty():
            break
        far = steps.select(F.col("e").alias("next"), F.col("next").alias("_n"), F.col("steps").alias("_s"), F.col("entries").alias("_e"))
        more = open_.join(far, "next").select("e", F.col("_n").alias("next"), (F.col("steps") + F.col("_s")).alias("steps"), (F.col("entries") + F.col("_e")).alias("entries"))
        steps = cut(steps.where("next is null").unionAll(more))
        reach *= 2
    return steps.where("next is null").drop("next")


def outline_rows(index: DataFrame, items: DataFrame, scope: list[str]) -> DataFrame:
    """Items with their depth and their row, from 0, in the order of the walk: what an indented outline shows."""
    placed = items.join(index.select(*scope, "stable_key", "enter_no", "depth"), [*scope, "stable_key"])
    numbered = ordered.running_sum(placed.withColumn("_one", F.lit(1)), scope, ["enter_no"], "_one", "row_no")
    return numbered.withColumn("row_no", (F.col("row_no") - 1).cast("long")).drop("enter_no", "_one")


def _events(index: DataFrame, chosen: DataFrame, scope: list[str]) -> DataFrame:
    """Chosen nodes (scope, stable_key, value) as entries (d = 1) and exits (d = -1) at their places."""
    at = chosen.join(index.select(*scope, "stable_key", "enter_no", "exit_no"), [*scope, "stable_key"])
    go_in = at.select(*scope, F.col("enter_no").alias("place"), F.lit(1).alias("d"), "value")
    return go_in.unionAll(at.select(*scope, F.col("exit_no").alias("place"), F.lit(-1).alias("d"), "value"))


def below(index: DataFrame, scope: list[str], roots: DataFrame) -> DataFrame:
    """(scope, stable_key) of all nodes under any of ``roots`` (scope, stable_key), the roots themselves only if under another one."""
    events = _events(index, roots.select(*scope, "stable_key", F.lit(True).alias("value")).distinct(), scope)
    # at its own entry a node is asked before it counts as a root
    asked = index.select(*scope, F.col("enter_no").alias("place"), F.lit(0).alias("d"), F.lit(0).alias("turn"), "stable_key")
    all_ = events.select(*scope, "place", "d", F.lit(1).alias("turn"), F.lit(None).cast(dict(index.dtypes)["stable_key"]).alias("stable_key")).unionAll(asked)
    return ordered.running_sum(all_, scope, ["place", "turn"], "d", "open").where("turn = 0 and open > 0").select(*scope, "stable_key")


def inherited(index: DataFrame, scope: list[str], given: DataFrame, value: str) -> DataFrame:
    """(scope, stable_key, value): each node's own value in ``given`` (scope, stable_key, value), else that of its nearest ancestor with one, else null.

    Given keys are distinct and their values not null; keys that the index lacks count for nothing.
    """
    events = _events(index, given.select(*scope, "stable_key", F.col(value).alias("value")), scope)
    depth = ordered.running_sum(events, scope, ["place"], "d", "open")
    # an exit falls back to the value one level up: that of the last entry there
    at = depth.withColumn("level", F.col("open").cast("long")).withColumn("entered", F.when(F.col("d") == 1, F.col("value")))
    back = ordered.latest(at, [*scope, "level"], ["place"], "entered", "now").withColumn("now", F.when(F.col("level") > 0, F.col("now")))
    changes = back.select(*scope, "place", F.struct("now").alias("now"), F.lit(0).alias("turn"), F.lit(None).cast(dict(index.dtypes)["stable_key"]).alias("stable_key"))
    asked = index.select(*scope, F.col("enter_no").alias("place"), F.lit(None).cast(dict(changes.dtypes)["now"]).alias("now"), F.lit(1).alias("turn"), "stable_key")
    found = ordered.latest(changes.unionAll(asked), scope, ["place", "turn"], "now", "last").where("turn = 1")
    return found.select(*scope, "stable_key", F.col("last.now").alias(value))


def items_at(spans: DataFrame, points: DataFrame, key: list[str], first: str = "start_line", last: str = "end_line", line: str = "line_no") -> DataFrame:
    """(key, line, stable_key): the deepest of ``spans`` (key, stable_key, depth, first and last line) at each point (key, line); points in none are left out.

    Of spans of one depth the later start wins, then the larger key. Lines count
    from 0 and lie in bins of ``BIN``. A span is a row in the bins of its two ends,
    where a sweep meets the points; for the bins between, however many, only the best span of
    each two bins counts, which is dealt to blocks of 1, 2, 4 and so on bins.
    """
    bin_ = lambda c: F.expr(f"{c} div {BIN}")
    own = spans.select(*key, "stable_key", F.col("depth").cast("long").alias("depth"), F.col(first).cast("long").alias("_a"), F.col(last).cast("long").alias("_b"))
    own = own.where("_a <= _b").withColumn("_s", bin_("_a")).withColumn("_t", bin_("_b"))
    asked = cut(points.select(*key, F.col(line).cast("long").alias("_at")).distinct().withColumn("_bin", bin_("_at")))
    item = F.struct("depth", "_a", "stable_key").alias("_item")
    # whole bins between the ends
    pairs = own.where("_t - _s > 1").groupBy(*key, (F.col("_s") + 1).alias("_from"), F.col("_t").alias("_to")).agg(F.max(item).alias("_item"))
    blocks = pairs.select(*key, "_item", F.explode(_blocks(F.col("_from"), F.col("_to"))).alias("_b")).groupBy(*key, "_b.level", "_b.no").agg(F.max("_item").alias("_item"))
    levels = F.explode(F.expr("sequence(0, length(bin(_bin)) - 1)")).alias("level")
    bins = asked.where("_bin > 0").select(*key, "_bin").distinct().select(*key, "_bin", levels).withColumn("no", F.expr("shiftright(_bin, level)"))
    over = bins.join(blocks, [*key, "level", "no"]).groupBy(*key, "_bin").agg(F.max("_item").alias("_item"))
    # pieces at the ends, the best of the spans over the whole bin, and points
    start, end = F.col("_bin") * BIN, F.col("_bin") * BIN + (BIN - 1)
    near = own.select(*key, F.explode(F.array_distinct(F.array("_s", "_t"))).alias("_bin"), "_a", "_b", item)
    pieces = near.select(*key, "_bin", F.greatest("_a", start).alias("_at"), F.lit(0).alias("_turn"), F.least("_b", end).alias("_until"), "_item")
    whole = over.select(*key, "_bin", start.alias("_at"), F.lit(0).alias("_turn"), end.alias("_until"), "_item")
    nothing = F.lit(None).cast(dict(pieces.dtypes)["_item"])
    points_ = asked.select(*key, "_bin", "_at", F.lit(1).alias("_turn"), F.lit(None).cast("long").alias("_until"), nothing.alias("_item"))
    rows = pieces.unionAll(whole).unionAll(points_).select(*key, "_bin", "_at", "_turn", "_until", F.col("_item.depth").alias("depth"), F.col("_item._a").alias("_a"), F.col("_item.stable_key").alias("stable_key"))
    by = [*key, "_bin"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, heap, turn = None, [], 0
        for batch in batches:
            hits, found = [], []
            groups = zip(*(batch.column(c).to_pylist() for c in by), strict=True)
            for i, (g, at, is_point, until, depth, a, name) in enumerate(zip(groups, *(batch.column(c).to_pylist() for c in ("_at", "_turn", "_until", "depth", "_a", "stable_key")), strict=True)):
                if g != group:
                    group, heap = g, []
                if not is_point:
                    turn -= 1  # of equals the later row has the larger key
                    heapq.heappush(heap, (-depth, -a, turn, until, name))
                    continue
                while heap and heap[0][3] < at:
                    heapq.heappop(heap)
                if heap:
                    hits.append(i)
                    found.append(heap[0][4])
            if hits:
                own = batch.select([*key, "_at"]).take(pa.array(hits, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(found, batch.schema.field("stable_key").type)], names=[*key, "_at", "stable_key"])

    types = dict(rows.dtypes)
    dealt = rows.repartition(*by).sortWithinPartitions(*by, "_at", "_turn", "depth", "_a", "stable_key")
    made = dealt.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in [*key, "_at", "stable_key"]))
    return made.select(*key, F.col("_at").cast(dict(points.dtypes)[line]).alias(line), "stable_key")


def _blocks(first: Column, end: Column) -> Column:
    """[first, end) as an array of aligned blocks (level, no), each of 2 ** level numbers from no * 2 ** level on: two of a level at most."""

    def of(k: Column) -> Column:
        low, high = F.ceil(first / F.pow(F.lit(2.0), k)).cast("long"), F.floor(end / F.pow(F.lit(2.0), k)).cast("long")
        open_ = low < high
        left = F.when(open_ & (low % 2 == 1), F.struct(k.alias("level"), low.alias("no")))
        right = F.when(open_ & (high % 2 == 1), F.struct(k.alias("level"), (high - 1).alias("no")))
        return F.array_compact(F.array(left, right))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.length(F.bin(end - first)) - 1), of))
