"""Vertex programs: an active set of vertices sends along edges, messages to a vertex are reduced, and values change.

Pre-aggregation (partial aggregates before the exchange by target) keeps hot targets from one task. Loops cut
their lineage by written tables.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.session import materialize
from .edges import out_degree, vertices_of


def process_vertices(vertices: DataFrame, value: Column, active: Column | None = None) -> DataFrame:
    """The sum of an expression over (active) vertices."""
    return (vertices if active is None else vertices.where(active)).agg(F.sum(value).alias("total"))


def process_edges(active: DataFrame, edges: DataFrame, message: Column, reduce: Callable[[Column], Column]) -> DataFrame:
    """Active vertices (v, ...) send ``message`` along their edges: v, value, reduced over each target."""
    met = active.join(edges, active["v"] == edges["src"])
    return met.select(F.col("dst").alias("v"), message.alias("m")).groupBy("v").agg(reduce(F.col("m")).alias("value"))


def next_frontier(active: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """v: the vertices that active(v) reach over an edge and that are not in seen(v)."""
    met = active.select(F.col("v").alias("src")).join(edges.select("src", "dst"), "src").select(F.col("dst").alias("v")).distinct()
    return met.join(seen.select("v"), "v", "left_anti")


#: Most vertices whose values are gathered on the driver.
MOST_GATHERED = 50_000_000


def gather(values: DataFrame, column: str, missing=0, most: int = MOST_GATHERED) -> np.ndarray:
    """values(v, column) as one array on the driver, by vertex id; ``missing`` where a vertex has no row. The largest id is checked first."""
    top = values.agg(F.max("v")).collect()[0][0]
    if top is None:
        return np.empty(0)
    if top >= most:
        raise ValueError(f"{top + 1} vertices are too many to gather (at most {most})")
    rows = values.select("v", column).toArrow()
    got = rows.column(column).to_numpy()
    out = np.full(top + 1, missing, got.dtype)
    out[rows.column("v").to_numpy()] = got
    return out


def pagerank(vertices: DataFrame, edges: DataFrame, iterations: int, damping: float = 0.85) -> DataFrame:
    """v, rank: from 1, rank = (1 - damping) + damping x the sum of rank / out-degree of those that point at v; not
    normalized, and what vertices without out-edges hold is not passed on."""
    degree = out_degree(edges)
    ranks = vertices.select("v", F.lit(1.0).alias("rank"))
    linked = materialize(edges.select("src", "dst").join(degree.select(F.col("v").alias("src"), "degree"), "src"), "links")
    for i in range(iterations):
        sent = linked.join(ranks.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum(F.col("rank") / F.col("degree")).alias("got"))
        ranks = vertices.join(sent, "v", "left").select("v", (F.lit(1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 4 == 3 and i + 1 < iterations:
            ranks = materialize(ranks, "ranks")
    return ranks


def _relax(start: DataFrame, edges: DataFrame, message: Column, most: int) -> DataFrame:
    """v, value: least values from start(v, value), relaxed from the vertices that changed until none does."""
    best = materialize(start, "values")
    frontier = best
    for _ in range(most):
        sent = frontier.join(edges, frontier["v"] == edges["src"]).select(F.col("dst").alias("v"), message.alias("m")).groupBy("v").agg(F.min("m").alias("m"))
        moved = materialize(sent.join(best, "v", "left").where(F.col("value").isNull() | (F.col("m") < F.col("value"))).select("v", F.col("m").alias("value")), "frontier")
        if moved.isEmpty():
            return best
        best = materialize(best.join(moved, "v", "left_anti").unionByName(moved), "values")
        frontier = moved
    raise RuntimeError("values did not settle")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """v, component: the smallest vertex reachable over edges in either direction.

    Alternating large and small stars: rounds grow with the logarithm of the diameter, not the diameter.
    """
    given = materialize(edges.select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "given")
    everyone = vertices_of(given.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    links, mark = given.where("a > b"), None
    for _ in range(most_rounds):
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])
        if not now[0] or now == mark:
            break
        mark = now
        sides = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        links = materialize(sides.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a > b").distinct(), "links")
        least = links.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = links.join(least, links["a"] == least["u"]).where("b > m").select(F.col("b").alias("x"), F.col("m").alias("y"))
        links = materialize(moved.unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y"))).select(F.col("x").alias("a"), F.col("y").alias("b")).where("a > b").distinct(), "links")
    else:
        raise RuntimeError("components did not settle")
    return everyone.join(links.withColumnRenamed("a", "v"), "v", "left").select("v", F.coalesce("b", "v").alias("component"))


def sssp(edges: DataFrame, root: int, most_rounds: int = 10_000) -> DataFrame:
    """v, distance from the root over edge weights w; unreached vertices have no row."""
    start = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(0.0).alias("value"))
    weighted = edges.select("src", "dst", F.col("w").cast("double").alias("w"))
    return _relax(start, weighted, F.col("value") + F.col("w"), most_rounds).select("v", F.col("value").alias("distance"))


def bfs(edges: DataFrame, root: int, most_rounds: int = 10_000) -> DataFrame:
    """v, level, parent (the smallest at the level before; the root has none); unreached vertices have no row."""
    start = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(0).cast("long").alias("value"))
    levels = _relax(start, edges.select("src", "dst"), F.col("value") + 1, most_rounds).select("v", F.col("value").alias("level"))
    above = levels.select(F.col("v").alias("src"), F.col("level").alias("up"))
    parents = edges.select("src", "dst").join(above, "src").join(levels.select(F.col("v").alias("dst"), "level"), "dst").where("level = up + 1").groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
    return levels.join(parents, "v", "left").select("v", "level", "parent")


def betweenness(edges: DataFrame, root: int, most_rounds: int = 10_000) -> DataFrame:
    """v, paths (shortest ones from the root), dependency on v of the root's shortest paths; every vertex has a row, 0 where unreached.

    Edges are those of a simple directed graph (repeated edges count as one).
    """
    simple = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "simple")
    level = materialize(bfs(simple, root, most_rounds).select("v", "level"), "levels")
    a = level.select(F.col("v").alias("src"), F.col("level").alias("up"))
    down = materialize(simple.join(a, "src").join(level.select(F.col("v").alias("dst"), F.col("level").alias("low")), "dst").where("low = up + 1"), "down")
    depth = level.agg(F.max("level")).collect()[0][0]
    root_row = edges.sparkSession.range(1).select(F.lit(root).cast("long").alias("v"), F.lit(1.0).alias("paths"))
    by_level, now = [root_row], root_row
    for k in range(depth):
        now = materialize(down.where(F.col("up") == k).join(now.withColumnRenamed("v", "src"), "src").groupBy(F.col("dst").alias("v")).agg(F.sum("paths").alias("paths")), "paths")
        by_level.append(now)
    below = by_level[depth].select("v", "paths", F.lit(0.0).alias("dependency"))
    out = [below]
    for k in range(depth - 1, -1, -1):
        sent = down.where(F.col("up") == k).join(below.select(F.col("v").alias("dst"), ((1 + F.col("dependency")) / F.col("paths")).alias("m")), "dst").groupBy(F.col("src").alias("v")).agg(F.sum("m").alias("m"))
        below = materialize(by_level[k].join(sent, "v", "left").select("v", "paths", (F.coalesce("m", F.lit(0.0)) * F.col("paths")).alias("dependency")), "below")
        out.append(below)
    reached = out[0]
    for t in out[1:]:
        reached = reached.unionByName(t)
    zero = F.lit(0.0)
    return vertices_of(edges).join(reached, "v", "left").select("v", F.coalesce("paths", zero).alias("paths"), F.coalesce("dependency", zero).alias("dependency"))


