"""Hand-computed micro graphs and plain-Python versions of the graph operators."""

import math
import os
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import session
from quillgraph.functions.session import numbered, running_sum
from quillgraph.operators import corpus, edges, embed, flat, linkpred, partition, programs, walk
from quillgraph.plans import queries
from quillgraph.sources import graphs

T1 = [(0, 1), (0, 2), (1, 2), (2, 3), (3, 4)]


def frame(spark, rows, schema="src long, dst long"):
    return spark.createDataFrame(rows, schema)


def pairs(df):
    return {tuple(r)[0]: tuple(r)[1] for r in df.collect()}


@pytest.fixture(scope="module")
def t1(spark):
    return frame(spark, T1)


def test_degrees_and_totals(spark, t1):
    und = edges.to_undirected(t1)
    assert pairs(edges.out_degree(und)) == {0: 2, 1: 2, 2: 3, 3: 2, 4: 1}
    assert tuple(edges.totals(und).collect()[0]) == (10, 35)
    assert tuple(edges.max_degree_vertex(und).collect()[0]) == (2, 3)
    lone = spark.range(7).withColumnRenamed("id", "v")
    assert tuple(edges.degree_buckets(lone, und).collect()[0]) == (2, 1, 4)


def test_common_neighbours_and_acceptance(t1):
    got = {(r["src"], r["dst"]): r["cn"] for r in edges.common_neighbours(t1).collect()}
    assert got == {(0, 1): 1, (0, 2): 1, (1, 2): 1, (2, 3): 0, (3, 4): 0}
    chance = {(r["src"], r["dst"]): r["accept"] for r in edges.accept_chances(t1).collect()}
    want = {(0, 1): 1, (0, 2): 1.5, (2, 0): 0.75, (2, 3): 0.5, (3, 2): 0.75, (3, 4): 1, (4, 3): 2}
    for k, v in want.items():
        assert chance[k] == pytest.approx(math.tanh(v))


def test_self_loops_and_repeats(spark):
    t3 = frame(spark, [(0, 0), (0, 1), (0, 1), (1, 2)])
    assert edges.to_undirected(t3).count() == 8
    assert edges.distinct_neighbours(t3).count() == 3
    assert sorted(r["cn"] for r in edges.common_neighbours(t3).collect()) == [0, 0, 0, 1]  # the self-loop shares its other neighbour with itself


def test_first_seen(spark):
    t4 = frame(spark, [(0, 10, 7), (1, 7, 3), (2, 10, 3)], "n long, src long, dst long")
    assert pairs(edges.first_seen_ids(t4, "n")) == {10: 0, 7: 1, 3: 2}


def test_numbered_and_running(spark):
    rows = frame(spark, [(i % 7, i) for i in range(200)])
    got = sorted((r["src"], r["dst"], r["n"]) for r in numbered(rows, "src", "dst").collect())
    assert [r[2] for r in got] == list(range(200))
    total = {r["dst"]: r["upto"] for r in running_sum(rows, "src", "dst").collect()}
    assert total[199] == sum(i % 7 for i in range(200)) and total[3] == 6


def test_ranges(spark, t1):
    vertices = spark.range(5).withColumnRenamed("id", "v")
    ranges = partition.workload_ranges(vertices, edges.to_undirected(t1), 2)
    assert [tuple(r) for r in ranges.collect()] == [(0, 0, 3), (1, 3, 5)]
    owned = partition.owner(vertices, ranges)
    assert tuple(partition.edge_cut(t1, owned).collect()[0]) == (5, 1)
    many = [tuple(r) for r in partition.workload_ranges(vertices, edges.to_undirected(t1), 9).collect()]
    assert many[0][1] == 0 and many[-1][2] == 5 and all(a[2] == b[1] for a, b in zip(many, many[1:]))


def test_stream_and_greedy(spark, t1):
    both = [(a, b) for a, b in T1] + [(b, a) for a, b in T1]
    assert partition.stream_order(both, list(range(5))) == [2, 3, 4, 1, 0]
    assert partition.stream_order(both, list(range(6)), depth_first=False) == [2, 0, 1, 3, 4, 5]
    near = {}
    for a, b in both:
        near.setdefault(a, {})[b] = 1.0
    got = partition.greedy([2, 3, 4, 1, 0], near, 2)
    assert got[2] == 0 and set(got) == set(range(5))
    und = edges.to_undirected(t1).withColumn("w", F.lit(1.0))
    assert pairs(partition.greedy_partition(und, 2)) == got
    stream = partition.level_stream(und)
    assert [r["v"] for r in stream.orderBy("at").collect()] == [2, 0, 1, 3, 4]
    batched = partition.greedy_batches(und, stream, 2, 2)
    assert set(pairs(batched)) == set(range(5))
    with pytest.raises(ValueError):
        partition.greedy_partition(und, 2, most_edges=3)


def python_walk(adj, start, key, min_steps, bound, cap):
    """One walker, step by step, with running entropy and correlation."""
    from quillgraph.functions.rng import u32_py

    seen, cur, hs = [start], start, [0.0]

    def stop():
        k = len(seen)
        counts = {}
        for v in seen:
            counts[v] = counts.get(v, 0) + 1
        hs.append(-sum(c / k * math.log2(c / k) for c in counts.values()))
        n = np.arange(1, k + 1)
        h = np.round(hs, 12)
        r = float(np.corrcoef(h, n)[0, 1]) if h.std() > 0 else 0.0
        return k - 1 > min_steps and (r * r < bound or r < 0)

    for k in range(cap):
        pool = adj.get(cur, [])
        if not pool or (len(pool) == 2 and pool[0][0] == cur):
            break
        pool = [x for x in pool if x[0] != cur] if k == 0 else pool
        if not pool:
            break
        cand, chance = pool[u32_py(*key, k, "n") % len(pool)]
        rejected = chance <= u32_py(*key, k, "a") / 2**32
        seen.append(cand)
        if stop():
            return seen
        if rejected:
            seen.append(cur)
            if stop():
                return seen
        else:
            cur = cand
    return seen


def random_graph(n, m, seed):
    rng = np.random.default_rng(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, n, (m, 2)).tolist() if a != b})


@pytest.mark.parametrize("bound", [0.999, 0.8])
def test_walk_equals_python_and_both_ways_agree(spark, bound):
    g = frame(spark, random_graph(30, 60, 3))
    chances = edges.accept_chances(g).cache()
    walkers = walk.init_walkers(spark, 30, 30)
    a = sorted(map(tuple, walk.draw_local(walkers, chances, 12).collect()))
    b = sorted(map(tuple, walk.draw_joined(walkers, chances, 12).collect()))
    assert a == b and a
    adj = {}
    for r in sorted(chances.collect(), key=lambda r: (r["src"], r["dst"])):
        adj.setdefault(r["src"], []).append((r["dst"], r["accept"]))
    got = {}
    for r in walk.paths(walk.entropy_walk(walkers, chances, bound=bound)).collect():
        got[r["walker"]] = list(r["path"])
    for w in range(30):
        assert got[w] == python_walk(adj, w, (7, 0, w), 20, bound, 10_000)
    few = walk.entropy_walk(walkers, chances, bound=bound, max_draws=30).collect()
    for w in range(30):
        own = sorted((r["step"], r["vertex"], r["capped"]) for r in few if r["walker"] == w)
        assert [v for _, v, _ in own] == python_walk(adj, w, (7, 0, w), 20, bound, 30)
        assert {c for _, _, c in own} == {len(own) < len(got[w])}


def test_isolated_self_loop_stays(spark):
    loop = spark.createDataFrame([(0, 0, 0.5), (0, 0, 0.5)], "src long, dst long, accept double")
    seen = walk.entropy_walk(walk.init_walkers(spark, 1, 1), loop)
    assert [(r["step"], r["vertex"]) for r in seen.collect()] == [(0, 0)]


def test_entropy_of_prefixes(spark):
    seen = spark.createDataFrame([(0, 0, i, v) for i, v in enumerate((0, 1, 0, 2))], "round int, walker long, step int, vertex long")
    got = [r["h"] for r in walk.running(seen).orderBy("step").collect()]
    assert got == pytest.approx([0, 1, 0.918296, 1.5], abs=1e-6)


def test_relative_entropy(spark, t1):
    und = edges.to_undirected(t1)
    even = spark.createDataFrame(list(enumerate((2, 2, 3, 2, 1))), "v long, cn long")
    assert walk.relative_entropy(und, even).collect()[0]["d"] == pytest.approx(0, abs=1e-12)
    assert walk.relative_entropy(und, even.where("v < 4")).collect()[0]["d"] == float("inf")


def test_rounds_end(spark, t1):
    out = walk.rounds(spark, edges.to_undirected(t1), edges.accept_chances(t1), 5, 5, tolerance=0.05).collect()
    assert out[-1]["visits"] > 100 and len(out) <= 20


def test_corpus(spark):
    counts = spark.createDataFrame([(5, 3), (2, 7), (9, 3)], "v long, cn long")
    ranked = corpus.vocab_rank(counts)
    assert {r["v"]: r["rank"] for r in ranked.collect()} == {2: 0, 5: 1, 9: 2}
    assert sorted(map(tuple, corpus.freq_blocks(ranked).collect())) == [(3, 1, 2), (7, 0, 1)]
    cdf = {r["rank"]: r["cdf"] for r in corpus.unigram_cdf(ranked).collect()}
    assert cdf[2] == pytest.approx(1) and cdf[0] == pytest.approx(7**0.75 / (7**0.75 + 2 * 3**0.75))
    path = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4]), (0, 2, [])], "round int, walker long, path array<long>")
    assert corpus.sentence_cut(path).count() == 1 and corpus.null_sentences(path).collect()[0][0] == 1
    for r in corpus.context_pairs(path, 2).collect():
        assert r["walker"] == 0 and r["center"] != r["context"]


def test_pagerank(spark, t1):
    und = edges.to_undirected(t1)
    got = pairs(programs.pagerank(edges.vertices_of(und), und, 1))
    assert [got[i] for i in range(5)] == pytest.approx([0.858333, 0.858333, 1.425, 1.283333, 0.575], abs=1e-6)


def test_components_and_search(spark):
    t2 = frame(spark, [*T1, (5, 6)])
    assert pairs(programs.connected_components(t2)) == {0: 0, 1: 0, 2: 0, 3: 0, 4: 0, 5: 5, 6: 5}
    und = edges.to_undirected(t2)
    assert {r["v"]: r["level"] for r in programs.bfs(und, 0).collect()} == {0: 0, 1: 1, 2: 1, 3: 2, 4: 3}
    chain = frame(spark, [(i, i + 1) for i in range(40)])
    assert set(pairs(programs.connected_components(chain)).values()) == {0}


def test_shortest_paths_equal_python(spark):
    rng = np.random.default_rng(5)
    rows = [(int(a), int(b), float(w)) for a, b, w in zip(rng.integers(0, 25, 80), rng.integers(0, 25, 80), rng.integers(1, 9, 80))]
    best, todo = {0: 0.0}, deque([0])
    while todo:
        v = todo.popleft()
        for a, b, w in rows:
            if a == v and best[v] + w < best.get(b, 1e9):
                best[b] = best[v] + w
                todo.append(b)
    assert pairs(programs.sssp(frame(spark, rows, "src long, dst long, w double"), 0)) == best


def test_betweenness_equals_python(spark, t1):
    got = {r["v"]: r["dependency"] for r in programs.betweenness(edges.to_undirected(frame(spark, [*T1, (5, 6)])), 0).collect()}
    assert [got[i] for i in range(7)] == pytest.approx([4, 0, 2, 1, 0, 0, 0])


def test_split(spark):
    rows = random_graph(40, 120, 9)
    out = linkpred.split(frame(spark, rows), 0.3).collect()
    parts = {p: {(r["src"], r["dst"]) for r in out if r["part"] == p} for p in ("train", "positive", "negative")}
    assert parts["train"] | parts["positive"] == set(rows) and not parts["train"] & parts["positive"]
    assert len(parts["positive"]) == int(0.3 * len(rows))
    left = {v for e in parts["train"] for v in e}
    assert left == {v for e in rows for v in e}
    both = set(rows) | {(b, a) for a, b in rows}
    assert not parts["negative"] & both and len(parts["negative"]) == len(parts["positive"])


def test_auc(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.5), (0, 0.5), (0, 0.1)], "label int, score double")
    assert linkpred.auc(scored).collect()[0]["auc"] == pytest.approx(0.875)


def test_update_follows_the_gradient():
    rng = np.random.default_rng(0)
    wih, woh = (rng.normal(0, 0.3, (6, 4)).astype(np.float32) for _ in range(2))
    a, b = wih.copy(), woh.copy()
    embed.sgns_update(a, b, 0, np.array([1, 2]), np.array([3, 3, 0]), 0.1)
    s = lambda x: 1 / (1 + np.exp(-x))
    want = woh[3] - 0.1 * 2 * sum(s(woh[3] @ wih[c]) * wih[c] for c in (1, 2))
    assert np.allclose(b[3], want, atol=1e-5) and np.allclose(b[4], woh[4])


@pytest.mark.parametrize("sync", ["full", "hotness"])
def test_training_separates_cliques(spark, sync):
    rng = np.random.default_rng(1)
    rows = [(0, w, [int(x) + 10 * (w % 2) for x in rng.integers(0, 10, 20)]) for w in range(200)]
    path = spark.createDataFrame(rows, "round int, walker long, path array<long>")
    ranked = corpus.vocab_rank(path.select(F.explode("path").alias("v")).groupBy("v").agg(F.count("*").alias("cn")))
    vectors = embed.train(path, ranked, dim=8, epochs=3, alpha=0.1, shards=2, sync=sync)
    got = embed.nearest(vectors, 3).collect()
    assert np.mean([(r["v"] < 10) == (r["other"] < 10) for r in got]) > 0.9


def test_empty_graph(spark):
    none = frame(spark, [])
    assert edges.common_neighbours(none).count() == 0 and edges.dense_ids(none).count() == 0
    assert programs.connected_components(none).count() == 0
    vertices = spark.range(0).withColumnRenamed("id", "v")
    assert partition.workload_ranges(vertices, none, 3).count() == 0


@pytest.mark.parametrize("second", [False, True])
def test_weighted_walk_equals_python(spark, second):
    from quillgraph.functions.rng import u32_py

    rng = np.random.default_rng(2)
    rows = [(a, b, float(w)) for (a, b), w in zip(random_graph(12, 60, 4), rng.random(60) * 5 + 0.1)]
    both = rows + [(b, a, w) for a, b, w in rows]
    near = {}
    for a, b, w in sorted(both):
        near.setdefault(a, []).append((b, w))
    starts = sorted(near)
    walkers = spark.createDataFrame([(0, v, v) for v in starts], "round int, walker long, cur long")
    got = {(r["walker"], r["step"]): r["vertex"] for r in walk.weighted_walk(walkers, frame(spark, both, "src long, dst long, w double"), 6, second).collect()}
    for v in starts:
        cur, prev = v, None
        for k in range(6):
            weights = [(x, (2.0 if x == prev else 1.0) if second else w) for x, w in near[cur]]
            goal = u32_py(7, 0, v, k, "w") / 2**32 * sum(w for _, w in weights)
            total = 0.0
            for x, w in weights:
                total += w
                if total > goal:
                    break
            cur, prev = x, cur
            assert got[(v, k + 1)] == cur


def test_walks_end_by_chance(spark, t1):
    und = edges.to_undirected(t1).withColumn("w", F.lit(1.0))
    walkers = spark.createDataFrame([(0, v, v) for v in range(5)], "round int, walker long, cur long")
    ended = walk.weighted_walk(walkers, und, 6, ends=F.when(F.col("step") >= 2, 1.0).otherwise(0.0))
    assert {r["walker"]: r["n"] for r in ended.groupBy("walker").agg(F.max("step").alias("n")).collect()} == {v: 2 for v in range(5)}


def test_common_neighbours_over_flat_files(spark, monkeypatch):
    """No list is joined for a simple graph; a hub, ids without edges and steps smaller than a list change nothing."""
    g = frame(spark, sorted({*random_graph(400, 1500, 3), *((0, x) for x in range(1, 390))}))
    want = sorted(map(tuple, edges.common_neighbours_joined(g).collect()))
    both = sorted((a, b, cn) for x, y, cn in want for a, b in ((x, y), (y, x)))
    monkeypatch.setattr(edges, "common_neighbours_joined", lambda e: pytest.fail("joined"))
    for task in (flat.TASK, 700):
        monkeypatch.setattr(flat, "TASK", task)
        assert sorted(map(tuple, edges.common_neighbours(g).collect())) == want
        assert sorted((r["src"], r["dst"], r["cn"]) for r in edges.accept_chances(g).collect()) == both
    monkeypatch.setattr(flat, "STEP", 50)
    graph = flat.write_flat(g)
    got = [flat.shared(graph.begin(), graph.near(), a, min(a + 333, graph.edges), np.zeros(graph.ids, bool)) for a in range(0, graph.edges, 333)]
    assert np.concatenate(got).tolist() == [x[2] for x in both]


def test_flat_files_take_simple_graphs_only(spark):
    for rows in ([], [(1, 2), (1, 2)], [(1, 1), (1, 2)], [(2, 1)], [(-1, 2)], [(1, 1 << 40)], [(1, None), (1, 2)]):
        assert flat.write_flat(spark.createDataFrame(rows, "src long, dst long")) is None
    g = spark.createDataFrame([(1, 2), (2, 1)], "src long, dst long")
    assert sorted(r["cn"] for r in edges.common_neighbours(g).collect()) == [0, 0]


def test_draws_over_flat_files_agree(spark):
    g = frame(spark, sorted({*random_graph(60, 200, 5), *((0, x) for x in range(1, 50)), (70, 71)}))
    walkers = walk.init_walkers(spark, 150, 75, 3)  # ids 60 to 69 and 72 to 74 have no edges
    graph = flat.write_common(spark, flat.write_flat(g))
    want = sorted(map(tuple, walk.draw_local(walkers, edges.accept_chances(g), 12).collect()))
    assert sorted(map(tuple, walk.draw(walkers, graph, 12).collect())) == want and want
    far = walk.entropy_walk(walkers, graph, bound=0.85)
    assert sorted(map(tuple, far.collect())) == sorted(map(tuple, walk.entropy_walk(walkers, edges.accept_chances(g), bound=0.85).collect()))


def test_streams_and_degrees_over_flat_files(spark, monkeypatch):
    """No limit of edges for the streams; the order is that of plain Python."""
    rows = sorted({*random_graph(80, 150, 9), *((3, x) for x in range(4, 40)), (90, 91), (91, 95)})
    g, near = frame(spark, rows), sorted({x for r in rows for x in r})
    want = sorted(map(tuple, edges.with_degrees(edges.to_undirected(g)).select("src", "dst", "src_degree", "dst_degree").collect()))
    monkeypatch.setattr(partition, "_check", lambda *_: pytest.fail("an edge limit"))
    for deep in (True, False):
        for by in (True, False):
            got = [r["v"] for r in partition.stream_edges(g, deep, by).orderBy("at").collect()]
            assert got == partition.stream_order([e for a, b in rows for e in ((a, b), (b, a))], near, deep, by)
    monkeypatch.setattr(edges, "with_degrees", lambda *_: pytest.fail("joined"))
    assert sorted(map(tuple, edges.edge_degrees(g).select("src", "dst", "src_degree", "dst_degree").collect())) == want


def test_written_tables_leave_no_shuffle_files(spark):
    tracker = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    before = tracker.shuffleStatuses().size()
    kept = session.materialize(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert tracker.shuffleStatuses().size() <= before
    assert kept.count() == 7
    session.discard(kept)
    assert not os.path.exists(kept._written.removeprefix("file://"))


def test_walks_keep_little_on_disk(spark, monkeypatch):
    """Neither draws nor common neighbours are written, and a walk's rows are exchanged as one; hubs and long walks change nothing."""
    g = frame(spark, sorted({*random_graph(60, 200, 5), *((0, x) for x in range(1, 500)), (700, 701)}))
    walkers = walk.init_walkers(spark, 900, 750, 3)
    chances = edges.accept_chances(g)
    graph = flat.write_flat(g)
    want = sorted(map(tuple, walk.draw_local(walkers, chances, 12).collect()))
    assert sorted(map(tuple, walk.draw(walkers, graph, 12).collect())) == want
    whole = [sorted(map(tuple, walk.entropy_walk(walkers, chances, bound=0.85, max_draws=m).collect())) for m in (None, 30)]
    monkeypatch.setattr(walk, "draw", lambda *_: pytest.fail("draws are written"))
    monkeypatch.setattr(walk, "PACKED", 700)
    assert [sorted(map(tuple, walk.entropy_walk(walkers, graph, bound=0.85, max_draws=m).collect())) for m in (None, 30)] == whole
    assert not os.path.exists(f"{graph.folder}/common".removeprefix("file://"))
    plan = walk.running(walk.visits_flat(walkers, graph))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.index("Generate") < plan.index("Exchange hashpartitioning")


def test_flat_files_are_sorted_a_range_at_a_time(spark, monkeypatch):
    g = frame(spark, sorted({*random_graph(300, 900, 4), *((0, x) for x in range(1, 290))}))
    want, made, real = flat.write_flat(g), [], flat.materialize
    monkeypatch.setattr(flat, "SORTED", 500)
    monkeypatch.setattr(flat, "materialize", lambda *a: made.append(a) or real(*a))
    got = flat.write_flat(g)
    assert got.begin().tolist() == want.begin().tolist() and got.near().tolist() == want.near().tolist()
    assert len(made) == -(-got.edges // 500)


def test_dense_graph_is_made_without_joins(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(6)
    lines = [(int(o), int(p) * 7 + 3) for o, p in zip(rng.integers(0, 60, 300), rng.integers(0, 50, 300))]
    spark.createDataFrame(lines + [(70, None), (71, 3)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = sorted(map(tuple, graphs.co_purchase(spark, str(tmp_path)).collect()))
    for at_once in (graphs.PAIRS, 100):
        monkeypatch.setattr(graphs, "PAIRS", at_once)
        g = graphs.co_purchase_written(spark, str(tmp_path))
        assert sorted(map(tuple, g.collect())) == want
    ids = session.materialize(edges.dense_ids(g), "ids")
    assert sorted(map(tuple, flat.relabel(g, ids).collect())) == sorted(map(tuple, edges.relabel(g, ids).collect()))
    text = g.select(F.col("src").cast("string"), F.col("dst").cast("string"))
    assert flat.relabel(text, ids) is None
    session.discard(g)
    none = spark.createDataFrame([], "l_orderkey long, l_partkey long")
    none.write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert graphs.co_purchase_written(spark, f"{tmp_path}/none").count() == 0


def test_flat_files_of_sets(spark, monkeypatch):
    """Sets' pairs, met in many sets or one, equal the files of the same graph's edges; a hub, a set of one, none."""
    rng = np.random.default_rng(8)
    rows = [sorted({5, *(rng.integers(0, 400, int(rng.integers(0, 9))) * 3 + 5).tolist()}) for _ in range(300)] + [[7000], [5, 8000], [], None] + [[8, 11]] * 50
    for kind in ("bigint", "int"):
        sets = spark.createDataFrame([(x,) for x in rows], f"p array<{kind}>").repartition(3)
        sets = session.materialize(sets, "sets")
        ids = session.materialize(edges.set_ids(sets), "ids")
        pairs = sorted({(a, b) for x in rows if x for a in x for b in x if a < b})
        want = flat.write_flat(session.materialize(edges.relabel(frame(spark, pairs), ids), "dense"))
        for at_once, step, most in ((flat.SORTED, flat.STEP, 16), (300, 40, 16), (300, 40, 3)):
            made, real = [], session.materialize
            with monkeypatch.context() as m:
                m.setattr(flat, "SORTED", at_once), m.setattr(flat, "STEP", step), m.setattr(flat, "MOST_ROUNDS", most)
                m.setattr(flat, "materialize", lambda df, name: made.append(name) or real(df, name))
                got = flat.write_sets(sets, ids)
            assert got.ids == want.ids and got.edges == want.edges == 2 * len(pairs)
            assert got.begin().tolist() == want.begin().tolist() and got.near().tolist() == want.near().tolist()
            assert made.count("flat-parts") == (1 if at_once > 300 else most)
            assert sorted(os.listdir(got.folder.removeprefix("file://"))) == ["begin", "near"]
            given = flat.once_given(spark, got)
            number = {r["v"]: r["id"] for r in ids.collect()}
            assert sorted(map(tuple, given.collect())) == sorted((number[a], number[b]) for a, b in pairs) and flat.write_flat(given) is got
    assert flat.write_sets(spark.createDataFrame([(["a", "b"],)], "p array<string>"), ids) is None
    assert flat.write_sets(sets.where("size(p) < 2"), ids.limit(0)) is None


def test_shares_are_even_and_split_hubs(monkeypatch):
    weights = np.array([1, 0, 3, 1000, 0, 4, 8, 0, 500, 1], np.int64)
    monkeypatch.setattr(flat, "TASK", 3)
    got = flat._shares(weights, 7)
    assert len(got) == 8 and got == sorted(got) and got[0] == 0 and got[-1] == 10 << 32
    assert [x >> 32 for x in got[1:-1]] == [3, 3, 3, 3, 8, 8] and all(0 <= (x & 0xFFFFFFFF) < 10 for x in got)


def test_dense_graph_keeps_no_table_of_edges(spark, tmp_path, monkeypatch):
    """What vocab_rank, vocab_file and walk_capped begin with leaves its ids and flat files, and no edge is written on the way."""
    rng = np.random.default_rng(6)
    lines = [(int(o), int(p) * 7 + 3) for o, p in zip(rng.integers(0, 60, 300), rng.integers(0, 50, 300))]
    spark.createDataFrame(lines + [(70, None), (71, 3)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(graphs, "co_purchase_written", lambda *_: pytest.fail("edges are written"))
    root = session.shared_dir(spark, "x").removeprefix("file://").rpartition("/")[0]
    before = {*os.listdir(root)}
    g, ids = queries.dense(spark, str(tmp_path))
    left = {x.split("-")[1] for x in {*os.listdir(root)} - before}
    assert "flat" in left and not left & {"co", "dense", "baskets"}
    monkeypatch.undo()
    co = graphs.co_purchase(spark, str(tmp_path))
    assert sorted(map(tuple, ids.collect())) == sorted(map(tuple, edges.dense_ids(co).collect()))
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, edges.relabel(co, ids).collect()))
    spark.createDataFrame([], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/none/lineitem.parquet")
    assert queries.dense(spark, f"{tmp_path}/none")[0].count() == 0


def test_negative_draws_are_looked_up(spark, monkeypatch):
    ranked = spark.createDataFrame([(10 + i, 40 - i, i) for i in range(30)], "v long, cn long, rank long")
    cdf = corpus.unigram_cdf(ranked)
    want = sorted(map(tuple, corpus.negative_draws_joined(cdf, 2000).collect()))
    monkeypatch.setattr(corpus, "negative_draws_joined", lambda *_: pytest.fail("joined"))
    got = corpus.negative_draws(cdf, 2000)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 2000
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_inputs_are_made_by_tasks(spark, monkeypatch):
    ranked = spark.range(9000).select((F.col("id") * 3).alias("v"), (8999 - F.col("id")).alias("rank"))
    wih, woh = embed.init_matrices(9000, 8)
    monkeypatch.setattr(embed, "init_matrices", lambda *_: pytest.fail("on the driver"))
    got = {r["rank"]: (r["v"], r["vec"]) for r in embed.first_inputs(ranked, 8).collect()}
    assert all(got[i][0] == (8999 - i) * 3 and got[i][1] == wih[i].tolist() for i in range(0, 9000, 7)) and not woh.any()


def test_relative_entropy_reads_degrees_in_place(spark, monkeypatch):
    g = frame(spark, sorted({*random_graph(60, 200, 5), *((0, x) for x in range(1, 50)), (70, 71)}))
    graph = flat.write_flat(g)
    counts = edges.vertices_of(g).select("v", (F.col("v") % 7 + 1).alias("cn"))
    want = walk.relative_entropy(edges.to_undirected(g), counts).collect()[0]["d"]
    degree = sorted(map(tuple, edges.out_degree(edges.to_undirected(g)).collect()))
    monkeypatch.setattr(walk, "out_degree", lambda *_: pytest.fail("all edges are counted"))
    assert walk.relative_entropy(graph, counts).collect()[0]["d"] == pytest.approx(want, abs=1e-12)
    monkeypatch.setattr(flat, "TASK", 10)
    assert sorted(map(tuple, flat.vertex_degrees(spark, graph).collect())) == degree


@pytest.mark.parametrize("each", [1, 2])
def test_windows_at_once_equal_one_by_one(each):
    """Of windows that share no row; contexts and negatives that repeat, targets among the negatives, and a walk that has ended."""
    rng = np.random.default_rng(3)
    start = [rng.normal(0, 2, (60, 4)).astype(np.float32) for _ in range(2)]
    targets = np.array([[0, 1], [20, 20], [40, -1]])
    contexts = np.array([[[2, 2, 3], [4, -1, 5]], [[22, -1, -1], [23, 24, 22]], [[41, 42, -1], [-1, -1, -1]]])
    negatives = np.array([[6, 6, 1, 7], [26, 20, 27, 26], [46, 47, 46, 40]])
    a, b = (m.copy() for m in start), (m.copy() for m in start)
    (wih, woh), (x, y) = a, b
    embed.update_windows(wih, woh, targets[:, :each], contexts[:, :each], negatives, 0.3)
    real = lambda c: c[c >= 0]
    for t, c, neg in zip(targets, contexts, negatives):
        if each == 2 and t[1] >= 0:
            embed.pair_update(x, y, (t[0], t[1]), (real(c[0]), real(c[1])), neg, 0.3)
        else:
            embed.sgns_update(x, y, t[0], real(c[0]), neg, 0.3)
    assert np.allclose(wih, x, atol=1e-5) and np.allclose(woh, y, atol=1e-5) and not np.allclose(wih, start[0])


@pytest.mark.parametrize("options", [{}, {"sync": "hotness", "syncs": 3, "pair_windows": True}, {"sync": "full", "syncs": 2, "sample": 0.05}])
def test_training_in_step(spark, monkeypatch, options):
    """Many walks at once, models in the shared folder of which only the last average stays, a rerun that agrees."""
    rng = np.random.default_rng(1)
    rows = [(w, [int(x) + 100 * (w % 2) for x in rng.integers(0, 100, 20 + w % 3)]) for w in range(1500)]
    path = spark.createDataFrame(rows, "walker long, path array<long>")
    ranked = session.materialize(corpus.vocab_rank(path.select(F.explode("path").alias("v")).groupBy("v").agg(F.count("*").alias("cn"))))
    calls, real = [], embed.shared_dir
    monkeypatch.setattr(embed, "shared_dir", lambda s, name: calls.append(real(s, name)) or calls[-1])
    vectors = [embed.train(path, ranked, dim=8, epochs=3, alpha=0.1, shards=2, **options) for _ in range(2)]
    first, again = ({r["v"]: r["vec"] for r in x.collect()} for x in vectors)
    assert first == again and len(first) == 200
    left = os.listdir(calls[0].removeprefix("file://"))
    assert not [x for x in left if x.startswith("model-")] and sum(x.startswith("mean-") for x in left) == 1
    got = embed.nearest(vectors[0], 3).collect()
    assert np.mean([(r["v"] < 100) == (r["other"] < 100) for r in got]) > 0.9


def test_negatives_are_looked_up_in_place(spark, monkeypatch):
    """The same pairs as by joins: for few, for all that are free, and from more draws than the first."""
    for g in (random_graph(40, 120, 8), sorted({*random_graph(12, 60, 2), (0, 14)}), [(a, b) for a in range(6) for b in range(a + 1, 6)]):
        g = frame(spark, sorted(set(g)))
        for count in (5, 90, 4000):
            want = sorted(map(tuple, linkpred.negatives(g, count).collect()))
            written = session.materialize(g)
            with monkeypatch.context() as m:
                m.setattr(linkpred, "vertices_of", lambda *_: pytest.fail("joined"))
                assert sorted(map(tuple, linkpred.negatives(written, count).collect())) == want and want


def test_cosines_are_read_in_place(spark, monkeypatch):
    rng = np.random.default_rng(4)
    vectors = spark.createDataFrame([(int(v) * 3, i, [float(x) for x in rng.normal(size=6)]) for i, v in enumerate(rng.permutation(30))], "v long, rank long, vec array<float>")
    ends = [(int(a), int(b), i % 2) for i, (a, b) in enumerate(rng.integers(0, 95, (300, 2)))]
    pairs = spark.createDataFrame(ends + [(3, 6, 1)], "src long, dst long, label int")
    got = embed.cosines(pairs, vectors)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(embed, "column_file", lambda *_: None)
    want = embed.cosines(pairs, vectors)
    assert got.dtypes == want.dtypes
    a, b = (sorted((r["src"], r["dst"], r["label"], round(r["score"], 6)) for r in x.collect()) for x in (got, want))
    assert a == b and len(a) > 10
