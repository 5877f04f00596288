"""Trees of paths and declarations: rows, closures, validation, coverage, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.operators import ordered
from lithos.plans.lineage import cut

#: Signs before digits, and letters without their marks (fixed values), for natural order.
_SIGNS, _PLAIN = ":;<=>?@[\\]^_`{|}~", ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def prefixes(path: Column) -> Column:
    """The path and every directory above it, shortest first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def path_tree(files: DataFrame, scope: list[str], path: str = "path") -> DataFrame:
    """Directory and file rows: scope, node, depth from 0, is_file, files (at or below it)."""
    nodes = files.select(*scope, F.col(path).alias("_path"), F.explode(prefixes(F.col(path))).alias("node"))
    return nodes.groupBy(*scope, "node").agg(F.count(F.lit(1)).alias("files"), F.max(F.col("node") == F.col("_path")).alias("is_file")).select(*scope, "node", (F.size(F.split("node", "/")) - 1).alias("depth"), "is_file", "files")


def ancestor_closure(files: DataFrame, scope: list[str], path: str = "path") -> DataFrame:
    """(scope, node, ancestor, distance) for every node of a path tree. Paths name their ancestors, so no recursion is needed."""
    nodes = files.select(*scope, F.explode(prefixes(F.col(path))).alias("node")).distinct()
    above = nodes.select(*scope, "node", F.posexplode(F.reverse(prefixes(F.col("node")))).alias("distance", "ancestor"))
    return above.where("distance > 0").select(*scope, "node", "ancestor", "distance")


def closure(links: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, node, ancestor, distance) of child-to-parent links (scope, node, parent), by doubling.

    After round r all ancestors within 2**r are known, so rounds grow with the
    logarithm of the depth; a node on a cycle is never its own ancestor in the
    result. Rounds are checkpointed, so a lost executor costs one round.
    """
    found = cut(links.where("parent is not null and node <> parent").select(*scope, "node", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    while True:
        far = found.alias("a").join(found.select(*scope, F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("distance").alias("more")), [*scope, "ancestor"])
        more = far.where("node <> top").select(*scope, "node", F.col("top").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        new = cut(found.unionAll(more).groupBy(*scope, "node", "ancestor").agg(F.min("distance").alias("distance")))
        if new.count() == found.count():
            return new
        found = new


def forest_errors(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Broken rules of (scope, stable_key, parent_key): duplicate_key, self_parent, dangling_parent, cyclic_parent."""
    error = lambda df, name: df.select(*scope, "stable_key", F.lit(name).alias("error"))
    double = nodes.groupBy(*scope, "stable_key").count().where("count > 1")
    keys = nodes.select(*scope, F.col("stable_key").alias("parent_key")).distinct()
    linked = nodes.where("parent_key is not null")
    dangling = linked.join(keys, [*scope, "parent_key"], "left_anti").distinct()
    up = closure(linked.where("stable_key <> parent_key").select(*scope, F.col("stable_key").alias("node"), F.col("parent_key").alias("parent")), scope)
    # two nodes that are above each other lie on a cycle
    back = up.select(*scope, F.col("ancestor").alias("node"), F.col("node").alias("ancestor"))
    cyclic = up.join(back, [*scope, "node", "ancestor"], "left_semi").select(*scope, F.col("node").alias("stable_key")).distinct()
    return error(double, "duplicate_key").unionAll(error(linked.where("stable_key = parent_key").distinct(), "self_parent")).unionAll(error(dangling, "dangling_parent")).unionAll(error(cyclic, "cyclic_parent"))


def allocated_keys(items: DataFrame, scope: list[str], base: str, ordinal: list[str]) -> DataFrame:
    """``items`` with stable_key: the base key at its first use in a scope, then with ~1, ~2 and so on."""
    n = F.row_number().over(Window.partitionBy(*scope, base).orderBy(*ordinal)) - 1
    return items.withColumn("stable_key", F.when(n == 0, F.col(base)).otherwise(F.concat(base, F.lit("~"), n.cast("string"))))


def line_coverage(spans: DataFrame, scope: list[str], first: str = "first", last: str = "last") -> DataFrame:
    """How many spans cover each stretch of lines: scope, start, end (inclusive), depth; only where depth > 0.

    Opening and closing events are summed at each place before the running sum,
    so its window sees a row per boundary and not per span or line.
    """
    events = spans.select(*scope, F.col(first).cast("long").alias("at"), F.lit(1).alias("d")).unionAll(spans.select(*scope, (F.col(last) + 1).cast("long").alias("at"), F.lit(-1).alias("d")))
    net = events.groupBy(*scope, "at").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*scope).orderBy("at")
    run = net.select(*scope, F.col("at").alias("start"), (F.lead("at").over(order) - 1).alias("end"), F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("depth"))
    return run.where("depth > 0 and end is not null")


def history_steps(commits: DataFrame, scope: list[str], target: DataFrame, base: DataFrame) -> DataFrame:
    """First-parent steps from each scope's target down to its base, newest first: parent, commit, position from 1.

    ``commits`` have scope, commit, parent; ``target`` and ``base`` scope and commit. A
    base that is no ancestor is an error, given as one row without parent. Rounds
    follow the logarithm of the longest chain.
    """
    chain = cut(target.select(*scope, "commit", F.lit(0).cast("long").alias("distance")))
    jump = cut(commits.where("parent is not null").select(*scope, "commit", F.col("parent").alias("up")))
    reach = 1
    while True:
        # everything within 2 * reach steps, by jumps of reach; rows stay as many as commits
        more = cut(chain.join(jump, [*scope, "commit"]).select(*scope, F.col("up").alias("commit"), (F.col("distance") + reach).alias("distance")))
        if more.isEmpty():
            break
        chain = chain.unionAll(more)
        jump = cut(jump.join(jump.select(*scope, F.col("commit").alias("up"), F.col("up").alias("far")), [*scope, "up"]).select(*scope, "commit", F.col("far").alias("up")))
        reach *= 2
    stop = chain.join(base.select(*scope, "commit"), [*scope, "commit"]).select(*scope, F.col("distance").alias("stop"))
    steps = chain.join(stop, scope).where("distance < stop").join(commits.select(*scope, "commit", "parent"), [*scope, "commit"])
    found = steps.select(*scope, "parent", "commit", (F.col("distance") + 1).cast("long").alias("position"))
    lost = target.join(stop, scope, "left_anti").select(*scope, F.lit(None).cast("string").alias("parent"), F.col("commit").cast("string").alias("commit"), F.lit(0).cast("long").alias("position"))
    return found.select(*scope, F.col("parent").cast("string").alias("parent"), F.col("commit").cast("string").alias("commit"), "position").unionAll(lost)


def merge_base(commits: DataFrame, left: str, right: str) -> DataFrame:
    """The best common ancestors of two commits of (commit, parent), one row for each parent: those above no other common one."""
    links = commits.select(F.lit(0).alias("g"), F.col("commit").alias("node"), "parent")
    up = closure(links, ["g"])
    reach = lambda c: up.where(F.col("node") == c).select(F.col("ancestor").alias("commit")).unionAll(commits.where(F.col("commit") == c).select("commit")).distinct()
    both = reach(left).intersect(reach(right))
    older = up.join(both.select(F.col("commit").alias("node")), "node").join(both.select(F.col("commit").alias("ancestor")), "ancestor").select(F.col("ancestor").alias("commit")).distinct()
    return both.join(older, "commit", "left_anti")


def shared_prefixes(files: DataFrame, scope: list[str], path: str = "path") -> DataFrame:
    """Each path with how many leading components it shares with the path before it, in order of bytes: what a tree need not draw again."""
    parts = files.select(*scope, F.col(path).alias("path"), F.split(path, "/").alias("a")).distinct()
    seen = parts.withColumn("b", F.lag("a").over(Window.partitionBy(*scope).orderBy("path")))
    least = F.least(F.size("a"), F.size("b"))
    same = F.filter(F.sequence(F.lit(1), least), lambda i: F.slice("a", 1, i) == F.slice("b", 1, i))
    return seen.select(*scope, "path", F.when(F.col("b").isNull(), 0).otherwise(F.size(same)).alias("shared"))


def collapsed(nodes: DataFrame, scope: list[str], closed: DataFrame) -> DataFrame:
    """Rows of a path tree that stay when the folders in ``closed`` (scope, node) are shut: those below none of them."""
    above = nodes.select(*scope, "node", F.explode(prefixes(F.col("node"))).alias("up")).where("up <> node")
    hidden = above.join(closed.select(*scope, F.col("node").alias("up")), [*scope, "up"], "left_semi").select(*scope, "node").distinct()
    return nodes.join(hidden, [*scope, "node"], "left_anti")


def natural_key(name: Column) -> Column:
    """A string by whose bytes names sort as people sort them: runs of digits by their value, letters without case and common marks, other signs first; names that are alike in this by themselves."""
    low = F.translate(F.lower(name), _SIGNS + _PLAIN[0], "".join(chr(2 + i) for i in range(len(_SIGNS))) + _PLAIN[1])
    digits = lambda part: F.regexp_replace(part, "^0+(?=[0-9])", "")
    # a number is its length in five digits, then itself
    part = lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits(p)).cast("string"), 5, "0"), digits(p))).otherwise(p)
    parts = F.transform(F.regexp_extract_all(low, F.lit("[0-9]+|[^0-9]+"), F.lit(0)), part)
    return F.concat(F.array_join(parts, ""), F.lit("\x01"), name)


def natural_rows(nodes: DataFrame, scope: list[str]) -> DataFrame:
    """Rows of a path tree (scope, node, is_file) with row_no, from 0: below each folder its folders first, then its files, both in natural order."""
    names = F.split("node", "/")
    last = F.size(names) - 1
    kind = lambda i: F.when((i < last) | ~F.col("is_file"), "0").otherwise("1")
    key = F.array_join(F.transform(F.sequence(F.lit(0), last), lambda i: F.concat(kind(i), natural_key(F.get(names, i)))), "\x01")
    rows = nodes.withColumn("_key", key).withColumn("_one", F.lit(1))
    found = ordered.running_sum(rows, scope, ["_key"], "_one", "_n")
    return found.withColumn("row_no", (F.col("_n") - 1).cast("long")).drop("_key", "_one", "_n")


def nearest_files(rows: DataFrame, scope: list[str], hints: DataFrame) -> DataFrame:
    """(scope, hint, node) for row numbers ``hints`` (scope, hint): the file at that row, else the next one below, else the scope's last; null where it has none.

    Rows and hints are merged in one order from below, so a hint takes the last
    file that came before it.
    """
    files = rows.where("is_file").select(*scope, "row_no", "node")
    asked = hints.select(*scope, "hint").distinct()
    merged = files.select(*scope, (-F.col("row_no")).alias("at"), F.lit(0).alias("turn"), "node").unionAll(asked.select(*scope, (-F.col("hint").cast("long")).alias("at"), F.lit(1).alias("turn"), F.lit(None).cast("string").alias("node")))
    found = ordered.latest(merged, scope, ["at", "turn"], "node", "next").where("turn = 1").select(*scope, (-F.col("at")).alias("hint"), "next")
    end = files.groupBy(*scope).agg(F.max_by("node", "row_no").alias("last"))
    return found.join(end, scope, "left").select(*scope, "hint", F.coalesce("next", "last").alias("node"))
