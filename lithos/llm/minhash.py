"""Near duplicates by b-bit MinHash.

1. One pass over the texts makes each document's set of word shingles, a digest
   of the set, ``rows * bands`` minima, the band hashes, and a packed signature
   of the low 8 bits of every minimum. Only these small rows are kept.
2. Documents with equal sets become one class, represented by the smallest id.
3. Representatives that share a band hash form a bucket. The bucket's smallest
   id is its pivot, and each member is a candidate partner of the pivot.
4. A candidate pair goes on if its sizes allow the threshold and if the bits its
   signatures share, corrected for chance agreement, do not rule it out.
5. What is left is confirmed on the full sets; links make components.
6. A bucket whose members are then in several components has a main one, that
   of most members; its strays, the members of others, are compared with all
   members: in one task for each pair of a block of strays and a block of
   members, which carry packed signatures and full sets. Sizes, components, the
   first band that two members share and signatures leave few pairs for the
   exact comparison; the task merges what it links at once, so it returns at
   most one link for two components and never a pair in doubt.

So a group of m near copies costs m candidate pairs for each band and rows in
proportion to m, not m**2, and no link between different texts is lost except
where all bands miss it: (1 - s**rows)**bands, below 1e-8 at the threshold if
minima were independent; a test measures it on pairs near the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import distinct, mix, shingles, slices, trim
from .shared import materialize

U64 = np.uint64
BITS = 8
#: Shingles in one block of a bucket's members, 8 MB; a block of strays and a block of members meet in one task.
BLOCK_SHINGLES = 1 << 20
#: Bits of the filter by which a scan leaves out texts that no pair needs, where these are at most an eighth as many; else a join does.
FILTER_BITS = 1 << 23


def layout(percent: int, miss: float = 1e-8) -> tuple[int, int]:
    """Rows of a band and the number of bands: about 250 minima, missing a pair at the threshold less often than ``miss``."""
    s = percent / 100
    for rows in range(12, 0, -1):
        bands = math.ceil(math.log(miss) / math.log1p(-(s**rows)))
        if rows * bands <= 256:
            return rows, bands
    raise ValueError("the threshold is too low for this signature")


def lowest_estimate(percent: int, minima: int) -> float:
    """Six standard deviations below the threshold: nothing above the threshold falls below this."""
    s = percent / 100
    return s - 6 * math.sqrt(s * (1 - s) / minima)


def _multipliers(n: int) -> np.ndarray:
    """Two odd numbers for each of ``n`` hash functions."""
    return ((mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32) | np.uint32(1)).reshape(n, 2)


def _hashed(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit values that is not linear, one for each pair of multipliers."""
    z = x * by[0]
    z ^= z >> np.uint32(15)
    z *= by[1]
    return z


def _signatures(k: int, rows: int, bands: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = _multipliers(rows * bands)
        for batch in slices(batches, "t"):
            with np.errstate(over="ignore"):
                sets, off = distinct(*shingles(batch.column("t"), k))
                n = np.diff(off)
                some = np.flatnonzero(n)
                high, low = np.zeros(len(n), U64), np.zeros(len(n), U64)
                signature: list[bytes | None] = [None] * len(n)
                hashes: list[np.ndarray | None] = [None] * len(n)
                if len(some):
                    at = off[:-1][some]
                    high[some] = mix(np.add.reduceat(mix(sets), at) + n[some].astype(U64))
                    low[some] = mix(np.add.reduceat(mix(sets ^ U64(0x5851F42D4C957F2D)), at))
                    x = (sets >> U64(32)).astype(np.uint32)
                    minima = np.stack([np.minimum.reduceat(_hashed(x, a), at) for a in by])
                    packed = np.ascontiguousarray(((minima * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.uint8).T)
                    keys = np.zeros((bands, len(some)), U64)
                    for j in range(rows):
                        keys = mix(keys + minima[j::rows].astype(U64) + U64(j + 1))
                    keys = np.ascontiguousarray(keys.T).astype(np.int64)
                    for row, i in enumerate(some.tolist()):
                        signature[i], hashes[i] = packed[row].tobytes(), keys[row]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), pa.array(n, pa.int64()), pa.array(high.astype(np.int64)), pa.array(low.astype(np.int64)), pa.array(signature, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "high", "low", "signature", "bands"],
            )

    return run


def _similar(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures by counting equal bytes, corrected for those equal by chance."""
    c = 1 / (1 << BITS)
    return ((a == b).mean(-1) - c) / (1 - c)


def _prune(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sa", "sb"))
            keep = _similar(a, b) >= lowest_estimate(percent, a.shape[1])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _sets(k: int, wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted shingle sets of the texts whose id may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            some = whole
            if wanted is not None:
                place = whole.column("place").to_numpy()
                some = whole.filter(pa.array((wanted[place >> 6] >> (place & 63).astype(U64) & U64(1)).astype(bool)))
            for batch in slices([some], "t"):
                sets, off = distinct(*shingles(batch.column("t"), k))
                data = [sets[x:y].tobytes() for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(data, pa.binary())], names=["doc_id", "shingles"])

    return run


def _gather(texts: DataFrame, needed: DataFrame, k: int, kind: str, name: str) -> DataFrame:
    """(doc_id, shingles) of the ids in ``needed`` (d), which are distinct.

    Few ids go to the scan as a filter of fixed size, so that other texts are
    neither shingled nor moved; many meet their texts in a join.
    """
    place = F.pmod(F.xxhash64("d"), F.lit(FILTER_BITS))
    if needed.count() * 8 > FILTER_BITS:
        met = texts.join(needed, "d", "left_semi")
        return materialize(met.select("d", "t").mapInArrow(_sets(k, None), f"doc_id {kind}, shingles binary"), name)
    bits = needed.select(place.alias("p")).groupBy((F.col("p") / 64).cast("long").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect()  # at most FILTER_BITS / 64 rows
    wanted = np.zeros(FILTER_BITS // 64, np.int64)
    for r in bits:
        wanted[r.w] = r.bits
    made = texts.withColumn("place", place).mapInArrow(_sets(k, wanted.view(U64)), f"doc_id {kind}, shingles binary")
    return materialize(made.join(needed.withColumnRenamed("d", "doc_id"), "doc_id", "left_semi"), name)


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links of different components, from rows sorted by bucket and pair of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "value", "x", "y")), strict=True))
            cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for p, q in zip(cut[:-1], cut[1:], strict=True):
                if p == q:
                    continue
                if key is not None and keys[p] != key:
                    yield _compare(key, parts, percent)
                    parts = []
                key = keys[p]
                parts.append(batch.slice(p, q - p))
        if parts:
            yield _compare(key, parts, percent)
        trim()

    return run


def _compare(key: tuple, parts: list[pa.RecordBatch], percent: int) -> pa.RecordBatch:
    """At most one link for two components, of a block's strays with a block's members, on their full sets."""
    t = pa.Table.from_batches(parts)
    ids, n, mine, theirs = (np.array(t.column(c).to_pylist()) for c in ("rep", "n", "as_stray", "as_member"))
    stray = np.array(t.column("stray").to_pylist())
    comp = np.unique(np.array(t.column("comp").to_pylist()), return_inverse=True)[1]
    sig = np.frombuffer(b"".join(t.column("signature").to_pylist()), np.uint8).reshape(len(ids), -1)
    bands = np.array(t.column("bands").combine_chunks().flatten()).reshape(len(ids), -1)
    members, least = np.flatnonzero(theirs), lowest_estimate(percent, sig.shape[1])
    code: np.ndarray | None = None
    off = mark = np.zeros(0, np.int64)
    a, b = [], []
    for i in np.flatnonzero(mine).tolist():
        # two strays meet twice, and members of several buckets in each; one of these places counts
        j = members[(comp[members] != comp[i]) & (~stray[members] | (ids[members] > ids[i]))]
        j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
        j = j[(bands[j] == bands[i]).argmax(1) == key[0]] if len(j) else j
        j = j[_similar(sig[j], sig[i]) >= least] if len(j) else j
        if not len(j):
            continue
        if code is None:  # shingles as small numbers, so that a set is a mark at each of its own
            sets = [np.frombuffer(x, U64) for x in t.column("shingles").to_pylist()]
            off = np.r_[0, np.cumsum([len(x) for x in sets])]
            known, code = np.unique(np.concatenate(sets), return_inverse=True)
            mark = np.zeros(len(known), bool)
        mark[code[off[i] : off[i + 1]]] = True
        at = np.concatenate([code[off[x] : off[x + 1]] for x in j.tolist()])
        common = np.add.reduceat(mark[at].astype(np.int64), np.r_[0, np.cumsum(n[j])[:-1]])
        mark[code[off[i] : off[i + 1]]] = False
        for x in j[100 * common >= percent * (n[j] + n[i] - common)].tolist():
            if comp[x] != comp[i]:
                a.append(min(ids[i], ids[x]))
                b.append(max(ids[i], ids[x]))
                comp[comp == comp[x]] = comp[i]
    return pa.RecordBatch.from_arrays([pa.array(a, t.schema.field("rep").type), pa.array(b, t.schema.field("rep").type)], names=["a", "b"])


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for every node of the undirected links (a, b); comp is the smallest node that can be reached.

    Each round ties every node to the smallest of its neighbours and its
    neighbours to that one, then lets each node point to its pointer's pointer;
    the number of rounds grows with the logarithm of the longest path. Rounds
    are written to the shared folder.
    """
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), name)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: neighbours above a node, and it, hang on the smallest of all
        star = both.where("v > u").join(low, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionAll(low.select(F.col("m").alias("a"), F.col("u").alias("b")))
        star = materialize(star.where("a <> b").distinct(), name)
        # small-star: neighbours below a node, and it, hang on the smallest of those
        below = star.groupBy("b").agg(F.min("a").alias("m"))
        small = star.join(below, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).unionAll(below.select(F.col("m").alias("x"), F.col("b").alias("y")))
        new = materialize(small.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct(), name)
        # done when no node hangs on two, and nothing hangs on one that hangs
        roots = new.groupBy("b").agg(F.count(F.lit(1)).alias("k"))
        open_ = roots.where("k > 1").limit(1).count() or new.select(F.col("a").alias("b")).join(roots, "b", "left_semi").limit(1).count()
        edges = new
        if not open_:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionAll(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def near_duplicates(docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's class among those linked by at least ``percent`` percent of shared ``k``-word shingles.

    Returns doc_id, n_shingles, component_id (smallest id that links reach, its
    own included) and kept (doc_id = component_id). A link stands when 100 *
    intersection >= percent * union of the sets of distinct shingles.

    Null, empty and blank texts have no shingles and are linked with nothing.
    Repeated texts are one class. Rows that repeat an id share what any of them
    is linked to. Rows with a null id come back unlinked: component_id null and
    kept true. An empty table gives no rows; other columns are ignored.
    """
    rows, bands = layout(percent)
    texts = docs.select(F.col(id_col).alias("d"), F.col(text_col).cast("string").alias("t"))
    kind = dict(texts.dtypes)["d"]
    signed = materialize(texts.mapInArrow(_signatures(k, rows, bands), f"doc_id {kind}, n_shingles long, high long, low long, signature binary, bands array<long>"), "signatures")
    usable = signed.where("n_shingles > 0 and doc_id is not null")
    smallest = usable.groupBy("high", "low", "n_shingles").agg(F.min("doc_id").alias("rep"))
    key = ["doc_id", "high", "low", "n_shingles"]
    # one row for each class, also where rows repeat an id
    reps = materialize(
        usable.join(smallest.withColumnRenamed("rep", "doc_id"), key, "left_semi").groupBy(*key).agg(F.first("signature").alias("signature"), F.first("bands").alias("bands"))
        .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "signature", "bands"),
        "representatives",
    )
    entries = reps.select("rep", "n", F.posexplode("bands").alias("band", "value"))
    buckets = materialize(entries.groupBy("band", "value").agg(F.min("rep").alias("pivot"), F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    members = materialize(entries.join(buckets, ["band", "value"]).select("band", "value", "rep", "n", "pivot", "members"), "members")
    signs = reps.select("rep", "n", "signature", "bands")
    pairs = members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct()
    linked = _linked(pairs, signs, texts, k, percent, kind)
    # copies of one set hang on its representative as they are
    copies = usable.select(*key).join(smallest, ["high", "low", "n_shingles"]).where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    found = components(linked.unionAll(copies))
    more = _rest(members, signs, found, texts, k, percent, kind)
    if more is not None:
        found = components(found.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b")).unionAll(more))
    named = signed.select("doc_id", "n_shingles").join(found.select(F.col("node").alias("doc_id"), "comp"), "doc_id", "left")
    comp = F.coalesce("comp", "doc_id")
    return named.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(comp == F.col("doc_id"), F.lit(True)).alias("kept"))


def _linked(pairs: DataFrame, signs: DataFrame, texts: DataFrame, k: int, percent: int, kind: str) -> DataFrame:
    """The pairs (a, b) of representatives whose full sets are similar enough, written to the shared folder."""
    left = signs.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    right = signs.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    likely = pairs.join(left, "a").join(right, "b").where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    likely = materialize(likely.select("a", "b", "sa", "sb").mapInArrow(_prune(percent), f"a {kind}, b {kind}"), "likely")
    needed = likely.select(F.col("a").alias("d")).unionAll(likely.select(F.col("b").alias("d"))).distinct()
    sets = _gather(texts, materialize(needed, "needed"), k, kind, "sets")
    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    return materialize(likely.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_confirm(percent), f"a {kind}, b {kind}"), "links")


def _rest(members: DataFrame, signs: DataFrame, found: DataFrame, texts: DataFrame, k: int, percent: int, kind: str) -> DataFrame | None:
    """Links between members of a bucket that are not in one component yet; None if there are none."""
    # of two members one is the pivot, so they have been compared
    tagged = members.where("members > 2").join(found.select(F.col("node").alias("rep"), "comp"), "rep", "left").select("band", "value", "rep", "n", F.coalesce("comp", "rep").alias("comp"))
    of_comp = tagged.groupBy("band", "value", "comp").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))
    mixed = of_comp.groupBy("band", "value").agg(F.max(F.struct("size", "comp", "shingles")).alias("main"), F.count(F.lit(1)).alias("comps"), F.sum("shingles").alias("shingles")).where("comps > 1")
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(c / BLOCK_SHINGLES)).cast("int")
    mixed = mixed.select("band", "value", F.col("main.comp").alias("main"), blocks(F.col("shingles") - F.col("main.shingles")).alias("xs"), blocks(F.col("shingles")).alias("ys"))
    tagged = materialize(tagged.join(mixed, ["band", "value"]), "mixed")
    sets = _gather(texts, materialize(tagged.select(F.col("rep").alias("d")).distinct(), "needed"), k, kind, "mixed-sets")
    # a stray meets every block of members, a member every block of strays; blocks are dealt by a hash
    own = lambda c, seed: F.pmod(F.xxhash64("rep", F.lit(seed)), F.col(c)).cast("int")
    placed = tagged.withColumn("stray", F.col("comp") != F.col("main")).withColumn("x0", own("xs", 1)).withColumn("y0", own("ys", 2))
    pair = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    across = F.transform(F.sequence(F.lit(0), F.col("xs") - 1), lambda x: pair(x, F.col("y0")))
    along = F.when(F.col("stray"), F.transform(F.sequence(F.lit(0), F.col("ys") - 1), lambda y: pair(F.col("x0"), y))).otherwise(F.array().cast("array<struct<x:int,y:int>>"))
    met = placed.withColumn("p", F.explode(F.array_distinct(F.concat(across, along)))).select("band", "value", "p.x", "p.y", "rep", "comp", "n", "stray", (F.col("stray") & (F.col("p.x") == F.col("x0"))).alias("as_stray"), (F.col("p.y") == F.col("y0")).alias("as_member"))
    full = met.join(signs.drop("n").join(sets.withColumnRenamed("doc_id", "rep"), "rep"), "rep")
    dealt = full.repartition("band", "value", "x", "y").sortWithinPartitions("band", "value", "x", "y")
    links = materialize(dealt.mapInArrow(_across(percent), f"a {kind}, b {kind}"), "across")
    return None if links.isEmpty() else links
