"""Graph operators over an edge table (src, dst): trees, reachability, impact, flow.

All of them go level by level: a written frontier joins the edges, so depth and
number of rows are bounded by nothing but the graph. Results defined by paths keep
one row for each path: ``tree`` carries a count of paths for each node and only
lays them out in its result, ``flow`` carries the paths. Results defined by nodes
(``reached``) have a distinct in between, so cycles and diamonds cost no more than
their edges. Every level reads ``edges`` once: give a stored table, or ``settled`` one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.plans.store import settled


def neighbours(edges: DataFrame, name: str) -> DataFrame:
    """One row: the node, its sorted distinct callees and callers."""
    near = edges.where((F.col("src") == name) | (F.col("dst") == name))
    return near.agg(
        F.lit(name).alias("entry"),
        F.array_sort(F.collect_set(F.when(F.col("src") == name, F.col("dst")))).alias("calls"),
        F.array_sort(F.collect_set(F.when(F.col("dst") == name, F.col("src")))).alias("called_by"),
    )


def links(edges: DataFrame, name: str) -> DataFrame:
    """name, direction (calls or called_by) of each neighbour: ``neighbours`` as rows, for nodes with too many for one list."""
    calls = edges.where(F.col("src") == name).select(F.col("dst").alias("name"), F.lit("calls").alias("direction"))
    return calls.unionByName(edges.where(F.col("dst") == name).select(F.col("src").alias("name"), F.lit("called_by").alias("direction"))).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """name, n_calls, n_callers of every node: ``neighbours`` of all nodes at once, as counts."""
    both = edges.select(F.col("src").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("name"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("name").agg(F.sum("o").alias("n_calls"), F.sum("i").alias("n_callers"))


def _levels(front: DataFrame, grow, depth: int) -> list[DataFrame]:
    """Written frontiers of 1 to ``depth`` steps, until one is empty; ``grow`` makes the next from one."""
    out = []
    for _ in range(depth):
        front = settled(grow(front))
        if front.isEmpty():
            break
        out.append(front)
    return out


def tree(edges: DataFrame, root: str, depth: int = 2) -> DataFrame:
    """src, dst, depth of every step of every path of at most ``depth`` steps from ``root``; a row for each path."""
    step = edges.select("src", "dst")

    def grow(front: DataFrame) -> DataFrame:
        nodes = front.groupBy(F.col("dst").alias("src")).agg(F.sum("paths").alias("paths"))
        return step.join(nodes, "src").select("src", "dst", "paths")

    start = edges.sparkSession.range(1).select(F.lit(root).alias("dst"), F.lit(1).cast("long").alias("paths"))
    found = [level.select("src", "dst", "paths", F.lit(d).alias("depth")) for d, level in enumerate(_levels(start, grow, depth), 1)]
    if not found:
        return step.where("false").select("src", "dst", F.lit(0).alias("depth"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.select("src", "dst", "depth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("paths")))).drop("col")


COUNT = "decimal(38,0)"


def path_sizes(edges: DataFrame, root: str, depth: int) -> list[DataFrame]:
    """For each level the steps that paths from ``root`` take there: src, dst, size, before.

    ``size`` counts the paths that begin with the step, itself included, of at most ``depth`` steps in
    all, and ``before`` those of the same node's steps to lesser names. A node stands once in a level,
    however many paths lead to it, so levels have no more rows than the graph has edges. Exact below 10^38.
    """
    step = settled(edges.select("src", "dst").distinct())
    front, levels = edges.sparkSession.range(1).select(F.lit(root).alias("src")), []
    for level in _levels(front, lambda f: step.join(f, "src").select(F.col("dst").alias("src")).distinct(), depth - 1):
        levels.append(front)
        front = level
    levels.append(front)
    below, out = None, []
    w = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    for nodes in reversed(levels):
        rows = step.join(nodes, "src")
        rows = rows.withColumn("size", F.lit(1).cast(COUNT)) if below is None else rows.join(below, "dst", "left").withColumn("size", (1 + F.coalesce("total", F.lit(0))).cast(COUNT))
        rows = settled(rows.select("src", "dst", "size", F.coalesce(F.sum("size").over(w), F.lit(0)).cast(COUNT).alias("before")))
        below = rows.groupBy(F.col("src").alias("dst")).agg(F.sum("size").cast(COUNT).alias("total"))
        out.append(rows)
    return out[::-1]


def paths_page(sizes: list[DataFrame], root: str, first: int, count: int) -> DataFrame:
    """rank, path, depth of the paths with ranks ``first`` (from 0) to ``first + count - 1`` in pre-order, names rising, found without the others.

    ``sizes`` comes from ``path_sizes``; ``path`` begins with the root. Each level joins the ranges of
    ranks still asked for to the steps of their nodes and keeps the steps whose ranges overlap.
    """
    number = lambda x: F.lit(str(x)).cast(COUNT)
    front = sizes[0].sparkSession.range(1).select(F.array(F.lit(root)).alias("path"), F.lit(root).alias("src"), number(first).alias("lo"), number(first + count).alias("hi"), number(0).alias("at"))
    out = []
    for depth, steps in enumerate(sizes, 1):
        # ``at`` is the rank of the node's first step; lo and hi, the end excluded, are ranks of the whole.
        begin = F.col("at") + F.col("before")
        hit = front.join(steps, "src").select(F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("src"), "lo", "hi", begin.cast(COUNT).alias("rank"), "size")
        hit = settled(hit.where((F.col("rank") < F.col("hi")) & (F.col("rank") + F.col("size") > F.col("lo"))))
        out.append(hit.where(F.col("rank") >= F.col("lo")).select("rank", "path", F.lit(depth).alias("depth")))
        front = hit.where(F.col("size") > 1).select("path", "src", "lo", "hi", (F.col("rank") + 1).cast(COUNT).alias("at"))
    return reduce(DataFrame.unionByName, out)


def reached(edges: DataFrame, seeds: DataFrame, depth: int, key: tuple[str, ...] = ()) -> DataFrame:
    """Every distinct (key, name, depth) with a path of exactly ``depth`` >= 1 steps from the seed's ``name``.

    ``seeds``: name and the key columns, which go along with it.
    """
    keys = list(key)
    step = edges.select(F.col("src").alias("name"), F.col("dst").alias("next"))
    start = seeds.select(*keys, F.col("name")).distinct()
    found = _levels(start, lambda front: front.join(step, "name").select(*keys, F.col("next").alias("name")).distinct(), depth)
    if not found:
        return start.where("false").select(*keys, "name", F.lit(0).alias("depth"))
    return reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(found, 1)])


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _seed(edges: DataFrame, name: str) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(name).alias("name"))


def transitive_callees(edges: DataFrame, name: str, depth: int = 2) -> DataFrame:
    """Distinct nodes within ``depth`` steps and the least number of steps."""
    return reached(edges, _seed(edges, name), depth).groupBy("name").agg(F.min("depth").alias("depth"))


def function_impact(edges: DataFrame, name: str, depth: int = 5) -> DataFrame:
    """name, depth: distinct pairs of a caller and a number of steps at which it reaches ``name``."""
    return reached(reverse(edges), _seed(edges, name), depth)


def affected_counts(edges: DataFrame, depth: int = 5, lg_k: int = 14) -> DataFrame:
    """name, depth, affected: for every function and each depth from 1 on, about how many distinct functions reach it within so many steps.

    ``function_impact`` of all functions at once, as counts: a distinct-count sketch for each function goes
    along the edges, and a round for each depth merges those of its callers, combined map-side. The work of a
    round is one row an edge, whatever the sets' sizes. The relative standard error is 1.04 / sqrt(2^lg_k), 0.8 %
    by default; a function counts itself if it is on a cycle, as it does there. Functions that nobody calls give no rows.
    """
    step = settled(edges.select("src", "dst").distinct())
    direct = settled(step.groupBy(F.col("dst").alias("name")).agg(F.hll_sketch_agg("src", lg_k).alias("own")))
    now, out = direct.withColumnRenamed("own", "sketch"), []
    for d in range(1, depth + 1):
        if d > 1:
            # A function's callers, and the callers of each within one step less.
            passed = step.join(now.select(F.col("name").alias("src"), "sketch"), "src").select(F.col("dst").alias("name"), "sketch")
            now = settled(passed.unionByName(direct.select("name", F.col("own").alias("sketch"))).groupBy("name").agg(F.hll_union_agg("sketch").alias("sketch")))
        out.append(now.select("name", F.lit(d).alias("depth"), F.hll_sketch_estimate("sketch").alias("affected")))
    return reduce(DataFrame.unionByName, out)


def table_impact(edges: DataFrame, usage: DataFrame, table: str, depth: int = 5) -> DataFrame:
    """name, operation, depth of everything that uses ``table`` directly or through calls.

    Users are taken in order of name, each before its callers; who is met first
    that way is listed first and once. So a user that calls an earlier user is
    listed as indirect.
    """
    users = usage.where(F.col("table_name") == table).groupBy(F.col("function_name").alias("user")).agg(F.min("operation").alias("operation"))
    direct = users.select("user", F.lit(0).alias("kind"), F.lit(0).alias("depth"), F.col("user").alias("name"), "operation")
    callers = reached(reverse(edges), users.select("user", F.col("user").alias("name")), depth, ("user",))
    events = direct.unionByName(callers.select("user", F.lit(1).alias("kind"), "depth", "name", F.lit("indirect").alias("operation")))
    first = F.min(F.struct("user", "kind", "depth", "operation")).alias("x")
    return events.groupBy("name").agg(first).select("name", F.col("x.operation").alias("operation"), F.col("x.depth").alias("depth"), F.col("x.user").alias("via"), F.col("x.kind").alias("kind"))


def flow(edges: DataFrame, usage: DataFrame, root: str, depth: int = 5, skip: tuple[str, ...] = ("CM_LOG_01",)) -> DataFrame:
    """path, name, depth and sql_operations of every path from ``root``, 0 to ``depth`` steps; ordered by path it is pre-order.

    Steps into ``skip`` are left out, though ``root`` may be one of them.
    """
    step = (edges.where(~F.col("dst").isin(*skip)) if skip else edges).select(F.col("src").alias("name"), F.col("dst").alias("next"))
    start = edges.sparkSession.range(1).select(F.array(F.lit(root)).alias("path"), F.lit(root).alias("name"))
    found = [start, *_levels(start, lambda front: front.join(step, "name").select(F.concat("path", F.array("next")).alias("path"), F.col("next").alias("name")), depth)]
    steps = reduce(DataFrame.unionByName, [level.withColumn("depth", F.lit(d)) for d, level in enumerate(found)])
    used = usage.join(steps.select(F.col("name").alias("function_name")).distinct(), "function_name", "left_semi")
    ops = used.select(F.col("function_name").alias("name"), F.struct("table_name", "operation").alias("op")).distinct().groupBy("name").agg(F.array_sort(F.collect_list("op")).alias("sql_operations"))
    return steps.join(ops, "name", "left").select("path", "name", "depth", F.coalesce("sql_operations", F.array().cast("array<struct<table_name:string,operation:string>>")).alias("sql_operations"))


def tables_touched(steps: DataFrame) -> DataFrame:
    """table_name: the distinct tables of a ``flow``."""
    return steps.select(F.explode("sql_operations.table_name").alias("table_name")).distinct()


def tables_used(usage: DataFrame, name: str) -> DataFrame:
    """Distinct (table_name, operation) of one function."""
    return usage.where(F.col("function_name") == name).select("table_name", "operation").distinct()
