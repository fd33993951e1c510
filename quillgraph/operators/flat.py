"""A simple undirected graph as flat files in the shared folder, which all workers map into memory.

``begin`` (where each id's neighbours begin, 8 bytes an id) and ``near`` (the neighbours, ascending, 4 bytes a directed edge).
Common neighbours and walks read it in place, so that no list of neighbours is shuffled. It takes a shared folder that is
mounted and ids that lie close; where the graph is another, callers have joins that do the same.
"""

from __future__ import annotations

import os
import shutil
from collections import deque
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import filesystem, make_dir, whole_file
from ..functions.session import discard, materialize, shared_dir, shuffle_partitions

#: Ids an edge at most, and at all.
SPARSE, MOST_IDS = 16, 1 << 28
#: Directed edges of a task, and those looked at together.
TASK, STEP = 1 << 20, 1 << 18
#: Directed edges that are sorted, and so shuffled, at a time.
SORTED = 48_000_000
#: Most shares in which sets are read again and again, so that time grows as the input; beyond, a share is larger.
MOST_ROUNDS = 16


@dataclass
class Flat:
    """The files' folder, the number of ids and of directed edges."""

    folder: str
    ids: int
    edges: int
    #: Whether the file of common neighbours is there.
    counted: bool = False

    def map(self, name: str, kind) -> np.ndarray:
        return mapped(f"{self.folder}/{name}", kind)

    def begin(self) -> np.ndarray:
        return self.map("begin", "<i8")

    def near(self) -> np.ndarray:
        return self.map("near", "<i4")

    def common(self) -> np.ndarray:
        """The number of common neighbours of each directed edge, once written."""
        return self.map("common", "<i4")

    def tasks(self, spark: SparkSession) -> DataFrame:
        """(a, b): ranges of directed edges, one a row and task."""
        n = max(1, -(-self.edges // TASK))
        return spark.range(0, n, 1, n).select((F.col("id") * TASK).alias("a"), F.least((F.col("id") + 1) * TASK, F.lit(self.edges)).alias("b"))

    def join_parts(self, name: str, parts: list[str]) -> None:
        """One file of the parts, which go."""
        with whole_file(f"{self.folder}/{name}") as out:
            for part in parts:
                path = filesystem(f"{self.folder}/{part}")[1]
                with open(path, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 22)
                os.remove(path)


def write_flat(edges: DataFrame) -> Flat | None:
    """The flat form of written edges(src, dst) given once with src < dst, or None if they are not such, or their ids or the shared folder do not fit."""
    if getattr(edges, "_flat", None):  # made before
        return edges._flat
    spark = edges.sparkSession
    folder = shared_dir(spark, "flat")
    if not isinstance(filesystem(folder)[0], pafs.LocalFileSystem) or any(t not in ("bigint", "int") for c, t in edges.dtypes if c in ("src", "dst")):
        return None
    n, low, high, wrong = edges.agg(F.count("*"), F.min("src"), F.max("dst"), F.count_if(~F.coalesce(F.col("src") < F.col("dst"), F.lit(False)))).collect()[0]
    if not n or wrong or low < 0 or high >= min(MOST_IDS, max(1 << 16, SPARSE * n)):
        return None
    make_dir(folder)
    ids = high + 1
    pair = lambda a, b: F.shiftleft(F.col(a).cast("long"), 32).bitwiseOR(F.col(b).cast("long"))
    keys = edges.select(F.explode(F.array(pair("src", "dst"), pair("dst", "src"))).alias("key"))
    # ranges of ids one after another, so that the shuffle files of one at a time are there
    rounds = -(-2 * n // SORTED)
    some = (keys.where(F.col("key").between(F.lit((i * ids // rounds) << 32), F.lit(((i + 1) * ids // rounds << 32) - 1))) if rounds > 1 else keys for i in range(rounds))
    # hubs are split: the whole pair is what rows are dealt by
    graph = _write_keys(spark, folder, ids, (x.repartitionByRange(shuffle_partitions(spark), "key") for x in some))
    if graph is not None and hasattr(edges, "_written"):  # a plan may give other rows next time
        edges._flat = graph
    return graph


def _write_keys(spark: SparkSession, folder: str, ids: int, rounds, repeated: bool = False) -> Flat | None:
    """The files of directed edges src << 32 | dst, of which ``rounds`` has tables(key), dealt by ranges, higher ones in later tables; None if
    some come twice, unless they are ``repeated`` and to be stored once."""

    def write(batches):
        from pyspark import TaskContext

        # a task that is run again writes under another name
        task = TaskContext.get()
        name = f"part-{task.stageId()}-{task.partitionId()}-{task.taskAttemptId()}"
        rows, repeats, last, first, counts = 0, 0, -1, -1, []
        with whole_file(f"{folder}/{name}.near") as out:
            for batch in batches:
                key = batch.column(0).to_numpy()
                if not len(key):
                    continue
                first = int(key[0]) if first < 0 else first
                fresh = np.diff(key, prepend=last) != 0
                last = int(key[-1])
                if not fresh.all():
                    repeats += int((~fresh).sum())
                    key = key[fresh]
                out.write((key & 0xFFFFFFFF).astype("<i4").tobytes())
                rows += len(key)
                src = key >> 32
                at = np.flatnonzero(np.diff(src, prepend=-1))
                counts.append((src[at], np.diff(np.append(at, len(src)))))
        with whole_file(f"{folder}/{name}.size") as out:
            for src, size in counts:
                out.write(np.stack([src, size]).T.astype("<i8").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first, rows, repeats)], ["name", "first", "n", "repeats"])

    made = []
    for dealt in rounds:
        parts = materialize(dealt.sortWithinPartitions("key").mapInArrow(write, "name string, first long, n long, repeats long"), "flat-parts")
        made += parts.where("n > 0").orderBy("first").collect()
        discard(parts)
    if not repeated and any(r["repeats"] for r in made):
        return None
    graph = Flat(folder, ids, sum(r["n"] for r in made))
    sizes = np.zeros(ids + 1, np.int64)
    for r in made:
        name = f"{folder}/{r['name']}.size"
        got = mapped(name, "<i8").reshape(-1, 2)
        np.add.at(sizes, got[:, 0] + 1, got[:, 1])
        os.remove(filesystem(name)[1])
    with whole_file(f"{folder}/begin") as out:
        out.write(np.cumsum(sizes).astype("<i8").tobytes())
    graph.join_parts("near", [f"{r['name']}.near" for r in made])
    return graph


def _shares(weights: np.ndarray, parts: int) -> list[int]:
    """The keys src << 32 | dst that part the edges into shares of equal weight; weights: that of each src, spread over all dst."""
    n, before, out = len(weights), 0, []
    total = sum(int(weights[i : i + TASK].sum()) for i in range(0, n, TASK))
    goals = np.arange(1, parts) * total // parts
    for i in range(0, n, TASK):
        own = np.array(weights[i : i + TASK])
        upto = before + np.cumsum(own)
        mine = goals[(goals >= before) & (goals < upto[-1])]
        at = np.searchsorted(upto, mine, "right")
        inside = (mine - upto[at] + own[at]) / own[at]
        out += ((i + at) << 32 | (inside * n).astype(np.int64)).tolist()
        before = int(upto[-1])
    return [0, *out, n << 32]


def write_sets(sets: DataFrame, ids: DataFrame) -> Flat | None:
    """The flat form of the graph that joins any two items of a set: sets(p), written arrays of distinct items, which ids(v, pairs, id) number
    densely in their order, pairs being how many others the sets have beside an item, repeats included. Its edges go to the files from
    the sets, no table of them is written. None where types or the shared folder do not fit."""
    spark = sets.sparkSession
    if dict(sets.dtypes)["p"] not in ("array<bigint>", "array<int>") or dict(ids.dtypes)["v"] not in ("bigint", "int"):
        return None
    pairs, n = ids.agg(F.sum("pairs"), F.count("*")).collect()[0]
    if not pairs or n > MOST_IDS:
        return None
    file, weights = column_file(ids, "id", "v", "<i8"), column_file(ids, "id", "pairs", "<i8")
    if file is None:
        return None
    folder, tasks = shared_dir(spark, "flat"), shuffle_partitions(spark)
    make_dir(folder)
    rounds = min(MOST_ROUNDS, -(-pairs // SORTED))
    # known before, so that pairs need not be made once more for a sample
    shares = _shares(mapped(weights, "<i8"), rounds * tasks)

    def of(bounds: list[int]) -> DataFrame:
        low, high, inner = bounds[0], bounds[-1], np.array(bounds[1:-1], np.int64)

        def run(batches):
            known = np.array(mapped(file, "<i8"))
            for batch in batches:
                cells = batch.column(0)
                sizes = np.asarray(cells.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                at = np.searchsorted(known, cells.flatten().to_numpy().astype(np.int64))
                begin, sizes = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
                own = np.flatnonzero((at >= low >> 32) & (at <= high >> 32))
                ends = np.cumsum(sizes[own])
                i = 0
                while i < len(own):
                    # as many items as make a step
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
                    some = own[i:j]
                    places, mine = spread(begin[some], sizes[some]), np.repeat(some, sizes[some])
                    key = at[mine] << 32 | at[places]
                    key = np.unique(key[(places != mine) & (key >= low) & (key < high)])
                    part = np.searchsorted(inner, key, "right").astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part)], ["key", "part"])
                    i = j

        return sets.where(F.size("p") > 1).select("p").mapInArrow(run, "key long, part int").repartitionById(len(inner) + 1, "part").select("key")

    graph = _write_keys(spark, folder, n, (of(shares[i * tasks : (i + 1) * tasks + 1]) for i in range(rounds)), repeated=True)
    for name in (file, weights):
        os.remove(filesystem(name)[1])
    return graph


def once_given(spark: SparkSession, graph: Flat) -> DataFrame:
    """src, dst of every edge with src < dst, read in place: a written table like others, in the files' folder."""

    def run(batches):
        begin, near = graph.begin(), graph.near()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                for lo in range(a, b, STEP):
                    hi = min(b, lo + STEP)
                    dst, src = np.array(near[lo:hi], np.int64), np.searchsorted(begin, np.arange(lo, hi), "right") - 1
                    up = src < dst
                    yield pa.RecordBatch.from_arrays([pa.array(src[up]), pa.array(dst[up])], ["src", "dst"])

    out = graph.tasks(spark).mapInArrow(run, "src long, dst long")
    out._flat, out._written = graph, graph.folder
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of ranges, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def shared(begin: np.ndarray, near: np.ndarray, a: int, b: int, mark: np.ndarray) -> np.ndarray:
    """For the directed edges [a, b) the number of common neighbours of their ends. ``mark``: a False for each id.

    Of each edge the shorter list is looked up in the longer one: marked, or searched where the edge's own end has the shorter.
    """
    out = np.zeros(b - a, np.int32)
    first, last = np.searchsorted(begin, [a, b - 1], "right") - 1
    for u in range(int(first), int(last) + 1):
        lo, hi = int(begin[u]), int(begin[u + 1])
        if lo == hi:
            continue
        own = near[lo:hi]
        some = near[max(lo, a) : min(hi, b)]
        base = max(lo, a) - a
        starts = begin[some]
        sizes = begin[some + 1] - starts
        long_ = sizes > 64 * (hi - lo)
        if long_.any():
            for i in np.flatnonzero(long_).tolist():
                other = near[starts[i] : starts[i] + sizes[i]]
                at = np.searchsorted(other, own)
                out[base + i] = int((other[np.minimum(at, len(other) - 1)] == own).sum())
            sizes = np.where(long_, 0, sizes)
        mark[own] = True
        ends = np.cumsum(sizes)
        i = 0
        while i < len(some):
            # as many lists as make a step
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
            hits = np.concatenate([[0], np.cumsum(mark[near[spread(starts[i:j], sizes[i:j])]], dtype=np.int64)])
            stops = ends[i:j] - (ends[i - 1] if i else 0)
            got = hits[stops] - hits[stops - sizes[i:j]]
            out[base + i : base + j] = np.where(long_[i:j], out[base + i : base + j], got)
            i = j
        mark[own] = False
    return out


def shared_ends(begin: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The number of common neighbours of each pair of ends; a pair's shorter list is marked, or searched for in a much longer one."""
    swap = begin[a + 1] - begin[a] > begin[b + 1] - begin[b]
    keys, back = np.unique(np.where(swap, b, a) << 32 | np.where(swap, a, b), return_inverse=True)
    short, long_ = keys >> 32, keys & 0xFFFFFFFF
    out = np.empty(len(keys), np.int64)
    places = zip(*[x.tolist() for x in (begin[short], begin[short + 1], begin[long_], begin[long_ + 1])])
    for i, (lo, hi, first, last) in enumerate(places):
        own, other = near[lo:hi], near[first:last]
        if last - first > 16 * (hi - lo):
            at = np.searchsorted(other, own)
            out[i] = np.count_nonzero(other[np.minimum(at, len(other) - 1)] == own)
        else:
            mark[own] = True
            out[i] = np.count_nonzero(mark[other])
            mark[own] = False
    return out[back]


def pairs(spark: SparkSession, graph: Flat, both: bool) -> DataFrame:
    """src, dst, cn, src_degree, dst_degree of every edge, in both directions or with src < dst."""

    def run(batches):
        begin, near = graph.begin(), graph.near()
        mark = np.zeros(graph.ids, bool)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                for lo in range(a, b, STEP):
                    hi = min(b, lo + STEP)
                    cn, dst = shared(begin, near, lo, hi, mark), np.asarray(near[lo:hi])
                    src = np.searchsorted(begin, np.arange(lo, hi), "right") - 1
                    rows = [src, dst.astype(np.int64), cn.astype(np.int64), begin[src + 1] - begin[src], begin[dst + 1] - begin[dst]]
                    rows = rows if both else [x[src < dst] for x in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in rows], ["src", "dst", "cn", "src_degree", "dst_degree"])

    return graph.tasks(spark).mapInArrow(run, "src long, dst long, cn long, src_degree long, dst_degree long")


def degrees(spark: SparkSession, graph: Flat) -> DataFrame:
    """src, dst, src_degree, dst_degree of every edge in both directions, without a join."""

    def run(batches):
        begin, near = graph.begin(), graph.near()
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                for lo in range(a, b, STEP):
                    hi = min(b, lo + STEP)
                    dst, src = np.array(near[lo:hi], np.int64), np.searchsorted(begin, np.arange(lo, hi), "right") - 1
                    rows = [src, dst, begin[src + 1] - begin[src], begin[dst + 1] - begin[dst]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x)) for x in rows], ["src", "dst", "src_degree", "dst_degree"])

    return graph.tasks(spark).mapInArrow(run, "src long, dst long, src_degree long, dst_degree long")


def vertex_degrees(spark: SparkSession, graph: Flat) -> DataFrame:
    """v, degree of every vertex that has edges."""
    n = max(1, -(-graph.ids // TASK))

    def run(batches):
        begin = graph.begin()
        for batch in batches:
            for i in batch.column(0).to_pylist():
                degree = np.diff(begin[i * TASK : (i + 1) * TASK + 1])
                v = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(v + i * TASK), pa.array(degree[v])], ["v", "degree"])

    return spark.range(0, n, 1, n).mapInArrow(run, "v long, degree long")


def stream(spark: SparkSession, graph: Flat, depth_first: bool, by_degree: bool) -> DataFrame:
    """at, v: the visiting order of partition.stream_order(), by one task that reads the files in place; of a vertex it holds a few numbers."""

    def run(_):
        begin, near = np.array(graph.begin()), graph.near()
        degree = np.diff(begin)
        marked = degree == 0
        todo, out, n = deque([int(degree.argmax())]), np.empty(int((~marked).sum()), np.int64), 0
        marked[todo[0]] = True
        while todo:
            v = todo.pop() if depth_first else todo.popleft()
            out[n] = v
            n += 1
            own = near[begin[v] : begin[v + 1]]
            fresh = own[~marked[own]]
            if len(fresh):
                marked[fresh] = True
                if by_degree:
                    size = degree[fresh]
                    fresh = fresh[np.argsort(size if depth_first else -size, kind="stable")]
                todo.extend(fresh.tolist())
        out[n:] = np.flatnonzero(~marked)
        for a in range(0, len(out), 1 << 16):
            some = out[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(some))), pa.array(some)], ["at", "v"])

    return spark.range(0, 1, 1, 1).mapInArrow(run, "at long, v long")


def write_common(spark: SparkSession, graph: Flat) -> Flat:
    """Adds the file of common neighbours, for walks that make more draws than there are edges; others count those of the edges they draw."""

    def run(batches):
        from pyspark import TaskContext

        begin, near = graph.begin(), graph.near()
        mark = np.zeros(graph.ids, bool)
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                name = f"part-{a}-{TaskContext.get().taskAttemptId()}.common"
                with whole_file(f"{graph.folder}/{name}") as out:
                    for lo in range(a, b, STEP):
                        out.write(shared(begin, near, lo, min(b, lo + STEP), mark).astype("<i4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a])], ["name", "a"])

    made = materialize(graph.tasks(spark).mapInArrow(run, "name string, a long"), "flat-common").orderBy("a").collect()
    graph.join_parts("common", [r["name"] for r in made])
    return replace(graph, counted=True)


def holds(begin: np.ndarray, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether b is a neighbour of a, of each pair: halving the lists of all at once."""
    low, high = begin[a].copy(), begin[a + 1]
    last = high.copy()
    while (go := np.flatnonzero(low < high)).size:
        mid = (low[go] + high[go]) >> 1
        less = near[mid] < b[go]
        low[go[less]] = mid[less] + 1
        high[go[~less]] = mid[~less]
    found = low < last
    found[found] = near[low[found]] == b[found]
    return found


def free_draws(graph: Flat, draws: DataFrame) -> DataFrame:
    """draws(id, x, y): numbers of vertices that have edges -> id, src, dst of those that are no edge."""

    def run(batches):
        begin, near = np.array(graph.begin()), graph.near()
        vertices = np.flatnonzero(np.diff(begin))
        for batch in batches:
            id_, x, y = (batch.column(i).to_numpy() for i in range(3))
            src, dst = vertices[x], vertices[y]
            free = ~holds(begin, near, src, dst)
            yield pa.RecordBatch.from_arrays([pa.array(c[free]) for c in (id_, src, dst)], ["id", "src", "dst"])

    return draws.select("id", "x", "y").mapInArrow(run, "id long, src long, dst long")


def column_file(df: DataFrame, key: str, value: str, kind: str) -> str | None:
    """The file of a column of rows that ``key`` numbers densely from 0, in that order (of arrays their items), or None where the
    shared folder does not fit."""
    spark = df.sparkSession
    folder = shared_dir(spark, "column")
    if not isinstance(filesystem(folder)[0], pafs.LocalFileSystem):
        return None
    make_dir(folder)

    def write(batches):
        from pyspark import TaskContext

        name, first, rows = f"part-{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}", -1, 0
        with whole_file(f"{folder}/{name}") as out:
            for batch in batches:
                if batch.num_rows:
                    first = batch.column(0)[0].as_py() if first < 0 else first
                    rows += batch.num_rows
                    cells = batch.column(1)
                    out.write((cells.flatten() if pa.types.is_list(cells.type) else cells).to_numpy().astype(kind).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, first, rows)], ["name", "first", "n"])

    dealt = df.select(F.col(key).cast("long"), value).repartitionByRange(shuffle_partitions(spark), key).sortWithinPartitions(key)
    made = materialize(dealt.mapInArrow(write, "name string, first long, n long"), "column-parts")
    names = [r["name"] for r in made.where("n > 0").orderBy("first").collect()]
    discard(made)
    Flat(folder, 0, 0).join_parts("whole", names)
    return f"{folder}/whole"


def mapped(uri: str, kind: str) -> np.ndarray:
    path = filesystem(uri)[1]
    return np.asarray(np.memmap(path, kind, "r")) if os.path.getsize(path) else np.empty(0, kind)


def relabel(edges: DataFrame, ids: DataFrame) -> DataFrame | None:
    """edges(src, dst) with both ends replaced by ids(v, id), which number all v in their order: looked up in a file of them, no
    join. None where the shared folder or the types do not fit."""
    if any(t not in ("bigint", "int") for c, t in (*edges.dtypes, *ids.dtypes) if c in ("src", "dst", "v")):
        return None
    file = column_file(ids, "id", "v", "<i8")
    if file is None:
        return None

    def run(batches):
        known = np.array(mapped(file, "<i8"))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(known, batch.column(c).to_numpy().astype(np.int64))) for c in ("src", "dst")], ["src", "dst"])

    return edges.select("src", "dst").mapInArrow(run, "src long, dst long")
