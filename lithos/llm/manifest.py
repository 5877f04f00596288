"""Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Rows of a group are leaves in order. ``ARITY`` consecutive nodes of a level, or
what is left of them, have the digest of their digests' text as parent, until
one node remains.

The tree is made by events, as ``combineByKey`` would make it. An arriving
child's digest goes into its partial parent, the combiner of (group, level,
place); the group's size tells how many children that parent has, and with the
last of them its own digest is an event one level up. A task emits each complete
parent with its children's digests, a link, and in the end the parents that
still lack children. These frontiers are dealt again by their ancestor some
levels up, so that each round makes whole subtrees, until nothing is open.
Links are followed from the root back to the leaves for the proofs: a leaf's
siblings at every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

ARITY = 16
#: Levels of the tree that a round of frontiers completes.
ROUND = 3
_EVENTS = "kind string, g string, n long, level int, parent long, slots binary, digests binary"


def digest_of(fields: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its bytes in number, a colon and its text."""
    told = []
    for f in fields:
        s = f.cast("string")
        told.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*told), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


@dataclass
class Partials:
    """Partial parents of one task: children's digests by (group, level, parent) and place among their siblings."""

    open: dict[tuple[str, int, int], dict[int, bytes]] = field(default_factory=dict)
    sizes: dict[str, int] = field(default_factory=dict)
    done: list[tuple[str, str, int, int, int, bytes, bytes]] = field(default_factory=list)

    def arrive(self, g: str, n: int, level: int, place: int, digest: bytes) -> None:
        """A node's digest; it may complete its parent, that one's parent, and so on to the root."""
        while True:
            nodes = -(-n // ARITY**level)
            if nodes == 1:
                self.done.append(("root", g, n, level, 0, b"", digest))
                return
            parent, slot = divmod(place, ARITY)
            arity = min(ARITY, nodes - parent * ARITY)
            children = self.open.setdefault((g, level, parent), {})
            children[slot] = digest
            self.sizes[g] = n
            if len(children) < arity:
                return
            del self.open[g, level, parent]
            run = b"".join([children[i] for i in range(arity)])
            self.done.append(("link", g, n, level, parent, b"", run))
            level, place, digest = level + 1, parent, hashlib.sha256(run.hex().encode()).digest()

    def leave(self) -> None:
        """What is still open becomes frontier rows."""
        for (g, level, parent), children in self.open.items():
            self.done.append(("partial", g, self.sizes[g], level, parent, bytes(children), b"".join(children.values())))
        self.open.clear()
        self.sizes.clear()

    def rows(self) -> pa.RecordBatch:
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        columns = zip(*self.done, strict=True) if self.done else [()] * len(kinds)
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "g", "n", "level", "parent", "slots", "digests"])
        self.done.clear()
        return out


def _first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaves, sorted by group and place, arrive."""
    partials, last = Partials(), None
    for batch in batches:
        for g, n, place, digest in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "place", "digest")), strict=True):
            if g != last:
                partials.leave()
                last = g
            partials.arrive(g, n, 0, place, digest)
        yield partials.rows()
    partials.leave()
    yield partials.rows()


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Frontier rows, sorted by group and subtree, meet."""
    partials, last = Partials(), None
    for batch in batches:
        for g, cell, n, level, parent, slots, digests in zip(*(batch.column(c).to_pylist() for c in ("g", "cell", "n", "level", "parent", "slots", "digests")), strict=True):
            if (g, cell) != last:
                partials.leave()
                last = g, cell
            for i, slot in enumerate(slots):
                partials.arrive(g, n, level, parent * ARITY + slot, digests[32 * i : 32 * i + 32])
        yield partials.rows()
    partials.leave()
    yield partials.rows()


@dataclass
class Forest:
    """``leaves``: g, place, n and all columns given. ``links``: g, level (of the children), parent, digests. ``roots``: g, n, root."""

    leaves: DataFrame
    links: DataFrame
    roots: DataFrame


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with n, their group's size, and place, from 0 in order.

    Ranges of (group, order) are sorted by themselves and begin where the
    ranges before them in the group end, so a group of any size is spread.
    """
    ranged = materialize(rows.repartitionByRange("g", *order).withColumn("range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("g", "range").agg(F.count(F.lit(1)).alias("c"))
    group = Window.partitionBy("g")
    before = counts.select(
        "g", "range", (F.sum("c").over(group.orderBy("range")) - F.col("c")).alias("before"), F.sum("c").over(group).alias("n"),
    )
    own = F.row_number().over(Window.partitionBy("g", "range").orderBy(*order)) - 1
    return ranged.withColumn("own", own).join(before, ["g", "range"]).withColumn("place", (F.col("before") + F.col("own")).cast("long")).drop("range", "own", "before")


def forest(rows: DataFrame, order: list[str]) -> Forest:
    """The trees of all groups: ``rows`` have g (string, never null), digest (binary, 32 bytes), the columns of ``order``, and others, which leaves keep.

    ``order`` must tell rows apart unless they are wholly equal. Nothing passes
    one task whole: a group is spread over ranges, of each range at most two
    partial parents a level are left open, and a round brings at most
    16**(ROUND + 1) nodes of one subtree together. Groups of one row have that
    row's digest as root. An empty table gives no trees.
    """
    leaves = materialize(_placed(rows, order).sortWithinPartitions("g", "place"), "leaves")
    events = [materialize(leaves.select("g", "n", "place", "digest").mapInArrow(_first, _EVENTS), "events")]
    top = ROUND
    while not (frontier := events[-1].where("kind = 'partial'")).isEmpty():
        # parents stand at level + 1; their ancestor at the round's top level names the subtree
        cell = F.expr(f"shiftright(parent, 4 * greatest({top} - level - 1, 0))")
        dealt = frontier.withColumn("cell", cell).repartition("g", "cell").sortWithinPartitions("g", "cell", "level", "parent")
        events.append(materialize(dealt.select("g", "cell", "n", "level", "parent", "slots", "digests").mapInArrow(_again, _EVENTS), "events"))
        top += ROUND
    made = events[0]
    for more in events[1:]:
        made = made.unionAll(more)
    links = made.where("kind = 'link'").select("g", "level", "parent", "digests")
    return Forest(leaves, links, made.where("kind = 'root'").select("g", "n", F.col("digests").alias("root")))


def _siblings(run: Column, slot: Column) -> Column:
    """Digests before and after a node in its run."""
    at = (slot * 32).cast("int")
    return F.struct(F.substring(run, F.lit(1), at).alias("before"), F.substring(run, at + 33, F.length(run)).alias("after"))


def with_paths(trees: Forest, above: DataFrame) -> DataFrame:
    """Leaves with ``path``: (before, after), the siblings' digests at every level from the leaf's own up, and then those of ``above``.

    ``above`` has, for every group, g, path (what lies above its root) and other
    columns, which are kept. Links are joined level by level from the roots
    down, a sixteenth of the leaves at the most, and leaves once.
    """
    deepest = trees.roots.agg(F.max("n")).first()[0] or 0
    levels = 0
    while ARITY**levels < deepest:
        levels += 1
    extra = [c for c in above.columns if c not in ("g", "path")]
    tops = trees.roots.select("g", "n").join(above, "g").withColumn("place", F.lit(0).cast("long"))
    # parents whose children are at the level in hand, each with its path
    parents = tops.where("false").select("g", "place", "path", *extra)
    for level in range(levels - 1, -1, -1):
        own = tops.where(f"n > {ARITY**level} and n <= {ARITY ** (level + 1)}").select("g", "place", "path", *extra)
        runs = trees.links.where(f"level = {level}").select("g", F.col("parent").alias("place"), "digests")
        parents = parents.unionAll(own).join(runs, ["g", "place"])
        if level:
            child = parents.select("g", F.posexplode(F.sequence(F.lit(0), F.expr("length(digests) div 32 - 1"))).alias("slot", "_s"), F.col("place").alias("parent"), "digests", "path", *extra)
            path = F.concat(F.array(_siblings(F.col("digests"), F.col("slot"))), F.col("path"))
            # a sixteenth of the nodes below at the most; written, as plans would grow with every level
            parents = materialize(child.select("g", (F.col("parent") * ARITY + F.col("slot")).cast("long").alias("place"), path.alias("path"), *extra), "paths")
    none = F.lit(None).cast("binary").alias("digests")
    runs = parents.select("g", "place", "digests", "path", *extra) if levels else parents.select("g", "place", none, "path", *extra)
    runs = runs.unionAll(tops.where("n = 1").select("g", "place", none, "path", *extra)).withColumnRenamed("place", "parent")
    met = trees.leaves.withColumn("parent", F.expr(f"place div {ARITY}")).join(runs, ["g", "parent"])
    path = F.when(F.col("digests").isNull(), F.col("path")).otherwise(F.concat(F.array(_siblings(F.col("digests"), F.col("place") % ARITY)), F.col("path")))
    return met.withColumn("path", path).drop("parent", "digests")


def _hex(data: Column) -> Column:
    return F.lower(F.hex(data))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings of a path, in order."""
    return F.sha2(F.array_join(F.transform(path, lambda p: F.concat(_hex(p["before"]), _hex(p["after"]))), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf's digest (hex) and its siblings lead to."""
    return F.aggregate(path, leaf, lambda node, p: F.sha2(F.concat(_hex(p["before"]), node, _hex(p["after"])), 256))


def manifest(docs: DataFrame, fields: list[str], group: str = "source", order: str = "doc_id", changed: Column | None = None) -> DataFrame:
    """Every row with its proof: order column, leaf, subroot, root (hex), path, changed_leaf (hex, null unless ``changed`` gives one).

    A row's leaf covers ``fields``, in that order, nulls told apart from empty
    texts. Rows of one ``group`` are ordered by ``order`` (null first), equal ones
    by leaf; wholly equal rows are leaves of their own. Null is a group, the
    first; groups follow by their bytes. ``changed`` is a digest of other content
    whose proof is to be checked. Empty tables give no rows; other columns are
    ignored. Rows are digested once and written as digests; what moves is no
    text.
    """
    leaf = digest_of([F.col(c) for c in fields])
    rows = docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col(group).cast("string")), F.lit("")).alias("g"), F.col(order).alias("key"), F.unhex(leaf).alias("digest"),
        F.unhex(F.lit(None).cast("string") if changed is None else changed).alias("other"), F.monotonically_increasing_id().alias("row"),
    )
    trees = forest(materialize(rows, "digests"), ["key", "digest", "row"])
    over = forest(trees.roots.select(F.lit("").alias("g"), F.col("g").alias("group"), F.col("root").alias("digest")), ["group"])
    whole = over.roots.first()
    if whole is None:
        root = F.lit(None).cast("string")
    else:
        root = F.lit(whole["root"].hex())
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    above = with_paths(over, over.roots.select("g", nothing.alias("path"))).select(F.col("group").alias("g"), "path", _hex("digest").alias("subroot"))
    found = with_paths(trees, above)
    return found.select(F.col("key").alias(order), _hex("digest").alias("leaf"), "subroot", root.alias("root"), "path", _hex("other").alias("changed_leaf"))


def verify(rows: DataFrame) -> DataFrame:
    """Adds proof_sha256, folded_root (from changed_leaf where there is one, else leaf) and verified: whether it is the root."""
    found = rows.withColumn("proof_sha256", proof_digest(F.col("path"))).withColumn("folded_root", fold(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
