"""Edge-list rewrites, joins and aggregates. An undirected edge is stored as two rows, duplicates and self-loops kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import accept
from ..functions.session import discard, materialize, numbered, running_sum
from .flat import degrees, pairs, write_flat


def to_undirected(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, other columns copied: one scan, no shuffle."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    both = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("e"), *rest).select("e.src", "e.dst", *rest)


def transpose(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def valid_edges(edges: DataFrame, vertices: int) -> DataFrame:
    """Edges whose ends are both below the number of vertices."""
    return edges.where((F.col("src") < vertices) & (F.col("dst") < vertices))


def local_vertices(vertices: DataFrame, begin, end, column: str = "v") -> DataFrame:
    """Vertices in [begin, end)."""
    return vertices.where((F.col(column) >= begin) & (F.col(column) < end))


def distinct_neighbours(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def max_vertex_id(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_vertex"))


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()


def dense_ids(edges: DataFrame) -> DataFrame:
    """v -> id from 0 in order of v."""
    return numbered(vertices_of(edges), "v", name="id")


def set_ids(sets: DataFrame) -> DataFrame:
    """The same of the items of sets(p), any two of a set being an edge, with pairs: how many others an item meets, repeats included."""
    items = sets.where(F.size("p") > 1).select(F.explode("p").alias("v"), (F.size("p") - 1).cast("long").alias("pairs"))
    return numbered(items.groupBy("v").agg(F.sum("pairs").alias("pairs")), "v", name="id")


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Both ends replaced by ids(v, id); an equi-join an end."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    a = ids.select(F.col("v").alias("src"), F.col("id").alias("a"))
    b = ids.select(F.col("v").alias("dst"), F.col("id").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), *rest)


def first_seen_ids(edges: DataFrame, *order: str) -> DataFrame:
    """v -> id by first appearance, scanning src then dst in the given order of rows (a total order)."""
    rows = numbered(edges.select("src", "dst", *[c for c in order if c not in ("src", "dst")]), *order, name="at")
    seen = rows.select(F.posexplode(F.array("src", "dst")).alias("side", "v"), "at")
    first = seen.groupBy("v").agg(F.min(2 * F.col("at") + F.col("side")).alias("first"))
    return numbered(first, "first", name="id").select("v", "id")


def sort_adjacency(edges: DataFrame) -> DataFrame:
    """src -> neighbours ascending, with multiplicity: a vertex's whole list in a row, for vertices of bounded degree."""
    return edges.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("v")).agg(F.count("*").alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("degree"))


def degree_buckets(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """How many of vertices(v) have out-degree zero, one, and more."""
    d = F.coalesce("degree", F.lit(0))
    return vertices.join(out_degree(edges), "v", "left").agg(F.count_if(d == 0).alias("zero"), F.count_if(d == 1).alias("one"), F.count_if(d > 1).alias("more"))


def totals(edges: DataFrame, per_vertex: int = 5) -> DataFrame:
    """Edge total and workload total, the sum of (per_vertex + degree) over vertices that have edges."""
    return out_degree(edges).agg(F.sum("degree").alias("edge_total"), F.sum(F.col("degree") + per_vertex).alias("workload_total"))


def max_degree_vertex(edges: DataFrame) -> DataFrame:
    """The smallest vertex of the largest degree."""
    best = F.max(F.struct(F.col("degree"), (-F.col("v")).alias("less"))).alias("m")
    return out_degree(edges).agg(best).select((-F.col("m.less")).alias("v"), F.col("m.degree").alias("degree"))


def common_neighbours(edges: DataFrame) -> DataFrame:
    """edges(src, dst, ...) of an undirected list given once -> the same rows with cn, the number of other
    vertices next to both ends (for a self-loop: its other neighbours).

    Every edge is directed to its end of higher degree, so no vertex keeps more than sqrt(2 E) neighbours and a hub's
    list is short; the ends' lists are intersected edge by edge, and each triangle found counts for its three edges.
    Joining plain wedges would make the sum of squared degrees.

    Edges that flat files take (see flat.py) are counted over those, without a shuffle of lists.
    """
    if sorted(edges.columns) == ["dst", "src"]:
        given = materialize(edges, "given")
        if graph := write_flat(given):
            discard(given)
            kinds = dict(edges.dtypes)
            return pairs(edges.sparkSession, graph, False).select(*[F.col(c).cast(kinds[c]).alias(c) for c in edges.columns], "cn")
        edges = given
    return common_neighbours_joined(edges)


def common_neighbours_joined(edges: DataFrame) -> DataFrame:
    """The same by joins of each edge's lists."""
    both = materialize(to_undirected(edges.select("src", "dst")).where("src <> dst").distinct(), "both")
    degree = out_degree(both)
    a, b = (degree.select(F.col("v").alias(c), F.col("degree").alias(f"{c}_degree")) for c in ("src", "dst"))
    rising = both.join(a, "src").join(b, "dst").where(F.struct("src_degree", "src") < F.struct("dst_degree", "dst")).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    rising = materialize(rising, "rising")
    lists = materialize(rising.groupBy("a").agg(F.collect_list("b").alias("up")), "up")
    met = rising.join(lists, "a").join(lists.select(F.col("a").alias("b"), F.col("up").alias("top")), "b")
    # made by a generator, so that what reads c does not intersect again
    third = met.select("a", "b", F.explode(F.array(F.array_intersect("up", "top"))).alias("c")).where(F.size("c") > 0)

    def side(x: str):
        return F.transform("c", lambda c: F.struct(F.least(F.col(x), c).alias("x"), F.greatest(F.col(x), c).alias("y"), F.lit(1).cast("long").alias("n")))

    own = F.array(F.struct(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.size("c").cast("long").alias("n")))
    counted = third.select(F.explode(F.concat(own, side("a"), side("b"))).alias("t")).groupBy("t.x", "t.y").agg(F.sum("t.n").alias("cn"))
    loops = degree.select(F.col("v").alias("x"), F.col("v").alias("y"), F.col("degree").alias("cn"))
    loops = loops.join(edges.where("src = dst").select(F.col("src").alias("x")).distinct(), "x", "left_semi")
    keyed = edges.withColumn("x", F.least("src", "dst")).withColumn("y", F.greatest("src", "dst"))
    return keyed.join(counted.unionByName(loops), ["x", "y"], "left").drop("x", "y").withColumn("cn", F.coalesce("cn", F.lit(0).cast("long")))


def shared_neighbours(lists: DataFrame, pairs: DataFrame) -> DataFrame:
    """lists(src, nbrs) and pairs(x, y) -> x, y, shared: the size of the intersection of both ends' lists, of those that share any."""
    a = lists.select(F.col("src").alias("x"), F.col("nbrs").alias("a"))
    b = lists.select(F.col("src").alias("y"), F.col("nbrs").alias("b"))
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return pairs.join(a, "x").join(b, "y").select("x", "y", shared.alias("shared")).where("shared > 0")


def csr(edges: DataFrame) -> DataFrame:
    """v, begin, end: where each vertex's neighbours begin and end in one array of all, by vertex."""
    rows = running_sum(out_degree(edges), "degree", "v")
    return rows.select("v", (F.col("upto") - F.col("degree")).alias("begin"), F.col("upto").alias("end"))


def local_pairs(pairs: DataFrame, owned: DataFrame) -> DataFrame:
    """pairs(src, dst, cn) and owned(v, part) -> part, key, cn: what each part looks up, the pairs that have an end in it."""
    ends = pairs.select(pair_key(F.col("src"), F.col("dst")).alias("key"), "cn", F.explode(F.array("src", "dst")).alias("v"))
    return ends.join(owned.select("v", "part"), "v").select("part", "key", "cn").distinct()


def lookup(pairs: DataFrame, edges: DataFrame, value: str, missing=0) -> DataFrame:
    """pairs(src, dst) with the edges' value, or ``missing`` where there is no such edge."""
    return pairs.join(edges.select("src", "dst", value), ["src", "dst"], "left").fillna({value: missing})


def not_an_edge(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def with_degrees(undirected: DataFrame) -> DataFrame:
    """Degrees of both ends beside each row."""
    d = out_degree(undirected)
    a = d.select(F.col("v").alias("src"), F.col("degree").alias("src_degree"))
    b = d.select(F.col("v").alias("dst"), F.col("degree").alias("dst_degree"))
    return undirected.join(a, "src").join(b, "dst")


def edge_degrees(edges: DataFrame) -> DataFrame:
    """Once-given undirected edges(src, dst) -> both directions with the degrees of both ends; over flat files no join is made."""
    given = materialize(edges.select("src", "dst"), "given")
    if graph := write_flat(given):
        discard(given)
        return degrees(edges.sparkSession, graph)
    return with_degrees(to_undirected(given))


def accept_chances(edges: DataFrame) -> DataFrame:
    """Once-given undirected edges -> both directions with cn and the chance that a walker at src moves to dst."""
    given = materialize(edges, "given")
    graph = write_flat(given) if sorted(edges.columns) == ["dst", "src"] else None
    if graph:
        discard(given)
        both = pairs(edges.sparkSession, graph, True)
    else:
        both = with_degrees(to_undirected(common_neighbours_joined(given)))
    return both.withColumn("accept", accept(F.col("src_degree"), F.col("dst_degree"), F.col("cn")))


def edge_difference(edges: DataFrame, removed: DataFrame) -> DataFrame:
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_anti")


def pair_key(src: Column, dst: Column) -> Column:
    """Two ids below 2^32 as one."""
    return F.shiftleft(src.cast("long"), 32).bitwiseOR(dst.cast("long"))
