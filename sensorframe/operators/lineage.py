"""Ancestor closure, independence and set operators on a graph given as an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorframe.sources.storage import written


def ancestors(edges: DataFrame) -> DataFrame:
    """(id, ancestor, depth) for every node with parents, depth being the shortest. ``edges`` has child and parent.

    Rounds double the depth that is covered: pairs at exactly the last depth are joined with all pairs known so far, so a chain of n
    takes log n rounds. The last round finds no pair at its full depth, which ends walks through cycles as well; a node that is its
    own ancestor lies on a cycle.
    """
    known = written(edges.distinct().select(F.col("child").alias("id"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "ancestors")
    last, depth = known, 1
    while not last.isEmpty():
        on = F.col("l.ancestor") == F.col("k.id")
        far = last.alias("l").join(known.alias("k"), on).groupBy("l.id", "k.ancestor").agg((F.min("k.depth") + depth).alias("depth"))
        far = written(far.join(known, ["id", "ancestor"], "left_anti"), "ancestors")
        known, depth = known.unionByName(far), 2 * depth
        last = far.where(F.col("depth") == depth)
    return known


def independent_subset(items: DataFrame, dependent: DataFrame, key: list[str], exact: int = 20) -> DataFrame:
    """The largest set of items without a dependent pair, of each group ``key``; of several the first in id order.

    ``items`` has the key and id, ``dependent`` pairs a, b of ids in any order; pairs across groups do not count. Groups of more
    than ``exact`` items, for which the search is exponential, take items in id order that depend on none taken before, in rounds
    that decide all items at once whose smaller dependents are decided. Adds ``exact``: whether the set is surely the largest.
    """
    items = written(items.select(*key, "id").distinct(), "items")
    both = dependent.where("a <> b").select(F.col("a").alias("id"), F.col("b").alias("other"))
    both = both.union(both.select("other", "id")).distinct()
    links = both.join(items, "id").join(items.select(*key, F.col("id").alias("other")), [*key, "other"])
    sizes = items.groupBy(key).agg((F.count("*") <= exact).alias("exact"))
    small = items.join(sizes.where("exact"), key).join(links.groupBy(*key, "id").agg(F.collect_set("other").alias("others")), [*key, "id"], "left")
    ids = small.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("others", F.array().cast(small.schema["others"].dataType)).alias("others")))).alias("all"))
    kind = items.schema["id"].dataType.simpleString()

    @F.udf(f"array<{kind}>")
    def largest(rows):
        bit = {r.id: 1 << i for i, r in enumerate(rows)}
        against = [sum(bit[o] for o in r.others) for r in rows]
        best: list[int] = []

        def grow(start: int, barred: int, taken: list[int]) -> None:
            nonlocal best
            if len(taken) > len(best):
                best = list(taken)
            for i in range(start, len(rows)):
                if len(taken) + len(rows) - i <= len(best):
                    return
                if not barred >> i & 1:
                    grow(i + 1, barred | against[i], [*taken, i])

        grow(0, 0, [])
        return [rows[i].id for i in best]

    out = ids.select(*key, F.explode(largest("all")).alias("id"), F.lit(True).alias("exact"))
    rest = written(items.join(sizes.where("NOT exact").select(key), key), "undecided")
    big = written(links.join(rest, [*key, "id"], "left_semi"), "undecided-links")
    while not rest.isEmpty():
        waits = big.where("other < id").select(*key, "id").distinct()
        taken = written(rest.join(waits, [*key, "id"], "left_anti"), "taken")
        out = out.unionByName(taken.select(*key, "id", F.lit(False).alias("exact")))
        barred = big.join(taken, [*key, "id"], "left_semi").select(*key, F.col("other").alias("id")).distinct()
        rest = written(rest.join(taken.union(barred), [*key, "id"], "left_anti"), "undecided")
        big = written(big.join(rest, [*key, "id"], "left_semi").join(rest.withColumnRenamed("id", "other"), [*key, "other"], "left_semi"), "undecided-links")
    return out


def independence(pairs: DataFrame, closure: DataFrame, family: DataFrame) -> DataFrame:
    """Class of each pair (a, b): same_source, unknown without a family, partial with a shared ancestor or family, else independent."""
    up = closure.groupBy("id").agg(F.collect_set("ancestor").alias("up"))
    p = pairs
    for side in ("a", "b"):
        p = p.join(up.select(F.col("id").alias(side), F.col("up").alias(f"up_{side}")), side, "left")
        p = p.join(family.select(F.col("id").alias(side), F.col("family").alias(f"f_{side}")), side, "left")
    shared = F.coalesce(F.arrays_overlap("up_a", "up_b"), F.lit(False)) | (F.col("f_a") == F.col("f_b"))
    kind = F.when(F.col("a") == F.col("b"), "same_source").when(F.col("f_a").isNull() | F.col("f_b").isNull(), "unknown").when(shared, "partial").otherwise("independent")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), kind.alias("class"), F.size(F.array_intersect(F.coalesce("up_a", F.array()), F.coalesce("up_b", F.array()))).alias("shared"))


def resolve(artifacts: DataFrame, edges: DataFrame) -> DataFrame:
    """The lineage of every artifact: (id, status, ancestors, missing, families).

    ``artifacts`` has id and families (an array, null where unknown), ``edges`` child and parent; edges of children that are no artifacts are not
    followed. Status is cycle where a cycle can be reached, else incomplete where an ancestor is no artifact (``missing`` lists those,
    comma separated), else complete. ``families`` joins those of the artifact and all its known ancestors, and is null as soon as one is
    unknown. An id that is only asked for, without an artifact, has no row: its status is root_missing by a left join.
    """
    nodes = artifacts.select("id", "families")
    closure = ancestors(edges.join(nodes.select(F.col("id").alias("child")), "child", "left_semi").select("child", "parent"))
    loops = closure.where(F.col("id") == F.col("ancestor")).select(F.col("id").alias("ancestor"), F.lit(True).alias("_loop"))
    up = closure.join(nodes.select(F.col("id").alias("ancestor"), F.lit(True).alias("_known"), F.col("families").alias("_families")), "ancestor", "left").join(loops, "ancestor", "left")
    g = up.groupBy("id").agg(
        F.count("*").alias("ancestors"), F.bool_or(F.coalesce("_loop", F.lit(False))).alias("_cycle"), F.collect_list(F.when(F.col("_known").isNull(), F.col("ancestor"))).alias("_missing"),
        F.bool_or(F.col("_known").isNotNull() & F.col("_families").isNull()).alias("_unknown"),
    )
    own = nodes.select("id", F.explode("families").alias("f")).union(up.select("id", F.explode("_families")))
    names = own.distinct().groupBy("id").agg(F.array_join(F.sort_array(F.collect_list("f")), ",").alias("_names"))
    d = nodes.join(g, "id", "left").join(names, "id", "left")
    status = F.when(F.col("_cycle"), "cycle").when(F.size("_missing") > 0, "incomplete").otherwise("complete")
    unknown = F.col("families").isNull() | F.coalesce("_unknown", F.lit(False))
    return d.select("id", status.alias("status"), F.coalesce("ancestors", F.lit(0)).alias("ancestors"), F.coalesce(F.array_join(F.sort_array("_missing"), ","), F.lit("")).alias("missing"), F.when(~unknown, F.coalesce("_names", F.lit(""))).alias("families"))
