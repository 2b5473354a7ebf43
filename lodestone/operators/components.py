"""Cyclic graphs as a whole: strongly connected components, and reachability of all nodes by way of them.

Functions that call each other in circles reach the same others, so reachability is held
between components, a row for each pair of them, and the members beside it: a component of n
nodes costs n rows, not n^2. Every step is a join of written tables; none collects rows.

Edges (src, dst) may repeat and lead back to their own node; those with a null end are left
out. A graph without edges has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.store import settled

PARTS = 8


def _set(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull()).distinct()


def _nodes(step: DataFrame) -> DataFrame:
    return step.select(F.col("src").alias("name")).unionAll(step.select(F.col("dst").alias("name"))).distinct()


def between_cycles(step: DataFrame) -> DataFrame:
    """The edges on paths from a cycle to a cycle: those that nothing leads to, or that lead nowhere on, go in rounds."""
    count = step.count()
    while count:
        onward = settled(step.join(step.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        step = settled(onward.join(onward.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        before, count = count, step.count()
        if count == before:
            break
    return step


def colours(step: DataFrame) -> DataFrame:
    """name, colour: the least name from which each node is reached, its own included."""
    now = settled(_nodes(step).select("name", F.col("name").alias("colour"), F.lit(True).alias("new")))
    while not now.where("new").isEmpty():
        passed = step.join(now.where("new").select(F.col("name").alias("src"), "colour"), "src").groupBy(F.col("dst").alias("name")).agg(F.min("colour").alias("other"))
        less = F.coalesce(F.col("other") < F.col("colour"), F.lit(False))
        now = settled(now.join(passed, "name", "left").select("name", F.when(less, F.col("other")).otherwise(F.col("colour")).alias("colour"), less.alias("new")))
    return now.select("name", "colour")


def strong_components(edges: DataFrame) -> DataFrame:
    """name, component: the least name of the nodes that each node reaches and is reached by.

    Forward and backward by colours: every node takes the least name that reaches it; of a colour's
    nodes those that reach the node of that name are its component. All colours go at once; what is
    left of each goes through the next round, without edges between colours, which no component crosses.
    """
    return _components(settled(_set(edges)))


def _components(whole: DataFrame) -> DataFrame:
    """``strong_components`` of written, distinct edges without nulls."""
    step, found = between_cycles(whole.where(F.col("src") != F.col("dst"))), []
    while not step.isEmpty():
        colour = colours(step)
        inside = step.join(colour.select(F.col("name").alias("src"), "colour"), "src").join(colour.select(F.col("name").alias("dst"), F.col("colour").alias("to")), "dst")
        inside = settled(inside.where(F.col("colour") == F.col("to")).select("src", "dst", "colour"))
        front = settled(colour.where(F.col("name") == F.col("colour")))
        own = front
        while not front.isEmpty():
            back = inside.join(front.select(F.col("name").alias("dst")), "dst").select(F.col("src").alias("name"), "colour").distinct()
            front = settled(back.join(own, "name", "left_anti"))
            own = settled(own.unionByName(front))
        found.append(own)
        left = inside.join(own.select(F.col("name").alias("src")), "src", "left_anti").join(own.select(F.col("name").alias("dst")), "dst", "left_anti")
        step = between_cycles(settled(left.select("src", "dst")))
    if not found:
        return _nodes(whole).select("name", F.col("name").alias("component"))
    return _nodes(whole).join(reduce(DataFrame.unionByName, found), "name", "left").select("name", F.coalesce("colour", "name").alias("component"))


def _between(edges: DataFrame, members: DataFrame) -> DataFrame:
    """a, b: the components of the ends of each of distinct edges; distinct. Nodes that are a component alone are looked up by none."""
    groups = members.where(F.col("name") != F.col("component")).select("component").distinct()
    moved = settled(members.join(groups, "component", "left_semi"))
    ends = lambda end, as_: moved.select(F.col("name").alias(end), F.col("component").alias(as_))
    met = edges.join(ends("src", "a"), "src", "left").join(ends("dst", "b"), "dst", "left")
    met = settled(met.select(F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"), (F.col("a").isNotNull() | F.col("b").isNotNull()).alias("met")))
    return met.where(~F.col("met")).select("a", "b").unionByName(met.where("met").select("a", "b").distinct())


def _closed(on: DataFrame) -> DataFrame:
    """a, b: every pair with a path of at least one of the edges ``on``, which lead from component to component."""
    fresh, parts = on, [on]
    while not fresh.isEmpty():
        further = fresh.join(on.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct()
        fresh = settled(further.join(reduce(DataFrame.unionByName, parts), ["a", "b"], "left_anti"))
        parts = [*parts, fresh] if len(parts) < 16 else [settled(reduce(DataFrame.unionByName, [*parts, fresh]))]
    return reduce(DataFrame.unionByName, parts)


def _reach(edges: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``reach`` of distinct edges without nulls as (a, b) in two disjoint tables, the second not yet distinct.

    Only components that lead on go through rounds. What leads nowhere on is on no path but as its
    end, so one more join gives it all that reach those before it: the second table.
    """
    step = _between(edges, members)
    on = step.where(F.col("a") != F.col("b"))
    leads = on.select(F.col("a").alias("b")).distinct().withColumn("leads", F.lit(True))
    split = settled(on.join(leads, "b", "left").select("a", "b", F.coalesce("leads", F.lit(False)).alias("leads")))
    closed = settled(_closed(split.where("leads").select("a", "b")))
    last = split.where(~F.col("leads")).select("a", "b")
    behind = last.join(closed.select(F.col("a").alias("above"), F.col("b").alias("a")), "a").select(F.col("above").alias("a"), "b")
    return closed.unionByName(step.where(F.col("a") == F.col("b"))), last.unionByName(behind)


def reach(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component, reached: every pair of components with a path of at least one edge, a cyclic one with itself.

    ``members`` comes from ``strong_components``. Pairs found in a round go one edge on in the next, if they are new.
    """
    inner, ends = _reach(settled(_set(edges)), members)
    return inner.unionByName(ends.distinct()).select(F.col("a").alias("component"), F.col("b").alias("reached"))


def affected_exactly(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """name, component, affected: of every node, how many nodes reach it, itself included if it is on a cycle; 0 where none does.

    Counts are sums of the sizes of components, so no set of nodes is held. ``members``: the
    ``strong_components`` of the edges, where they are known.
    """
    whole = settled(_set(edges))
    members = settled(_components(whole)) if members is None else members
    sizes = settled(members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1").withColumnRenamed("component", "a"))
    inner, ends = _reach(whole, members)
    weighed = lambda pairs, *keys: pairs.join(sizes, "a", "left").groupBy("b", *keys).agg(F.sum(F.coalesce("size", F.lit(1))).alias("affected")).select("b", "affected")
    # Pairs are made distinct and summed where they lie; those of one end are dealt into PARTS, since any number may lead to it.
    dealt = ends.withColumn("part", F.pmod(F.xxhash64("a"), F.lit(PARTS))).repartition("b", "part").distinct()
    counts = weighed(inner).unionByName(weighed(dealt, "part")).groupBy(F.col("b").alias("component")).agg(F.sum("affected").alias("affected"))
    return members.join(counts, "component", "left").select("name", "component", F.coalesce("affected", F.lit(0)).cast("long").alias("affected"))
