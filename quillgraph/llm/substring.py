"""Substring dedup: words of a passage that stands earlier in the corpus are removed, by suffix automata.

A window of ``width`` words has one anchor, its leftmost smallest hash of ``GRAM`` consecutive words. Equal windows have
equal anchors at equal places, so the windows of one anchor occurrence (a segment, of at most
2 width - GRAM words) need only be compared with segments of the same anchor hash. The reference
shards are therefore made by anchor hash: a suffix automaton is built over a shard's distinct segments in
corpus order, and each segment is streamed through the automaton of those before it; windows with a
matching statistic of ``width`` stand earlier. (Automata of plain text shards, broadcast to all
documents, match every document with every shard: their cost grows with the square of the corpus.)

What goes to the automata is cut down exactly: anchors that occur once are dropped by a pre-aggregated
count; equal segments are reduced to their first occurrence, the others being removed whole; anchors
with a single distinct segment need no automaton. Anchors with more than ``SHARD`` distinct segments go by windows: a
pre-aggregated first place for every window hash. Texts stay in one file a task in the shared
folder and are never shuffled.

Order: doc_id (null first), then place; rows with the same doc_id are one document in this order.
Nulls: a null text has no words. Fewer words than ``width``: nothing is removed. No rows: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, make_dir, materialize, pylist, rows_of, shared_dir, shuffle_partitions, table, text_rows, whole_file

WIDTH, GRAM, SHARD = 20, 6, 2000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """64-bit hashes of each text's words; each distinct word of the batch is hashed once."""
    from xxhash import xxh64_intdigest

    cut = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
    ends = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    coded = cut.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxh64_intdigest(x.encode(), 7) for x in words), np.uint64, len(words))
    at = coded.indices.to_numpy()
    hashes = table[at] if len(words) else np.empty(0, np.uint64)
    full = np.array([x != "" for x in words], bool)[at] if len(words) else np.empty(0, bool)
    return [hashes[a:b][full[a:b]] for a, b in zip(ends, ends[1:])]


def rolled(h: np.ndarray, width: int, start: np.uint64 = np.uint64(1)) -> np.ndarray:
    """A hash of every ``width`` consecutive entries."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * _ODD + h[k : k + n] + start
        return _mix(out)


def segments(h: np.ndarray, width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of a document's word hashes: anchor hash, content hash, first window and number of windows of each segment."""
    n = len(h) - width + 1
    if n < 1:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    grams, span = rolled(h, gram), width - gram + 1
    best = np.empty(n, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    for i in range(0, n, 1 << 15):
        best[i : i + (1 << 15)] = view[i : i + (1 << 15)].argmin(axis=1)
    anchor = best + np.arange(n)
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, n))
    with np.errstate(over="ignore"):
        windows = rolled(h, width, np.uint64(3))
        # a segment's content: a sum of its windows' hashes, each weighed by its place
        place = _mix((np.arange(n) - np.repeat(first, count) + 1).astype(np.uint64) * _ODD)
        content = _mix(np.add.reduceat(windows * (place | np.uint64(1)), first) + count.astype(np.uint64))
    return grams[anchor[first]], content, first, count


class Automaton:
    """A suffix automaton over several strings, each state with the number of the string that first made it."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, symbols: list[int]) -> None:
        last = 0
        nxt, link, size = self.next, self.link, self.size
        for c in symbols:
            if (known := nxt[last].get(c)) is not None:
                # generalized: the string goes on in a state that is there already
                if size[known] == size[last] + 1:
                    last = known
                    continue
                clone = len(nxt)
                nxt.append(dict(nxt[known]))
                link.append(link[known])
                size.append(size[last] + 1)
                p = last
                while p != -1 and nxt[p].get(c) == known:
                    nxt[p][c] = clone
                    p = link[p]
                link[known] = clone
                last = clone
                continue
            state = len(nxt)
            nxt.append({})
            link.append(0)
            size.append(size[last] + 1)
            p = last
            while p != -1 and c not in nxt[p]:
                nxt[p][c] = state
                p = link[p]
            if p != -1:
                q = nxt[p][c]
                if size[q] == size[p] + 1:
                    link[state] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    link.append(link[q])
                    size.append(size[p] + 1)
                    while p != -1 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[state] = clone
            last = state

    def windows(self, symbols: list[int], width: int) -> list[int]:
        """Starts of the windows of ``width`` symbols that the automaton's strings hold: where the matching statistic reaches it."""
        out, state, matched = [], 0, 0
        nxt, link, size = self.next, self.link, self.size
        for i, c in enumerate(symbols):
            while state and c not in nxt[state]:
                state = link[state]
                matched = size[state]
            if c in nxt[state]:
                state = nxt[state][c]
                matched += 1
            if matched >= width:
                out.append(i - width + 1)
                if matched > width:
                    matched = width
                while size[link[state]] >= width:
                    state = link[state]
        return out


def _runs(starts: list[int]) -> list[tuple[int, int]]:
    """(first, last) of each run of consecutive numbers."""
    out = []
    for x in starts:
        if out and out[-1][1] == x - 1:
            out[-1] = (out[-1][0], x)
        else:
            out.append((x, x))
    return out


def earlier(contents: list[list[int]], width: int = WIDTH) -> list[list[tuple[int, int]]]:
    """Of a shard's distinct segments in corpus order: runs of the windows that stand in one before."""
    automaton, out = Automaton(), []
    for symbols in contents:
        out.append(_runs(automaton.windows(symbols, width)) if out else [])
        automaton.add(symbols)
    return out


def _texts(folder: str, p: int):
    """(row, doc_id, text) of a task's file, in order; a row group at a time."""
    import pyarrow.parquet as pq

    fs, path = filesystem(f"{folder}/texts-{p:06d}.parquet")
    with fs.open_input_file(path) as f:
        row = 0
        for batch in pq.ParquetFile(f).iter_batches(500):
            for doc_id, text in zip(pylist(batch, "doc_id"), pylist(batch, "text")):
                yield row, doc_id, text
                row += 1


def _beside_texts(folder: str, rows: DataFrame, work, schema: str, columns: tuple[str, ...], all_rows: bool) -> DataFrame:
    """rows(p, row, ...) meet the texts they belong to: work(doc_id, text, the text's rows) yields output rows.

    Dealt by task file; ``all_rows``: texts without rows are worked as well (rows with row = -1 only name a file).
    """
    from pyspark.sql.types import _parse_datatype_string

    names = [f.name for f in _parse_datatype_string(schema).fields]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def meet(batches):
        def flat():
            for batch in batches:
                yield from zip(*(pylist(batch, c) for c in ("p", "row", *columns)))

        out, held = [], 0
        for p, own in itertools.groupby(flat(), key=lambda r: r[0]):
            own = itertools.groupby(own, key=lambda r: r[1])
            at, rows = next(own, (None, ()))
            while at == -1:
                at, rows = next(own, (None, ()))
            for row, doc_id, text in _texts(folder, p):
                mine = []
                if row == at:
                    mine = [r[2:] for r in rows]
                    at, rows = next(own, (None, ()))
                elif not all_rows:
                    if at is None:
                        break
                    continue
                out += work(doc_id, text, mine)
                if len(out) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    dealt = rows.select("p", "row", *columns).repartition(shuffle_partitions(rows.sparkSession), "p").sortWithinPartitions("p", "row", *columns)
    return dealt.mapInArrow(meet, schema)


def removed_windows(docs: DataFrame, folder: str, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """Stores documents(doc_id, text) in ``folder`` by task; returns (files: p, spans: p, row, a, b). A span is the
    words [a, b) of a document's row that stand earlier."""
    make_dir(folder)

    def cut(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        p, row, writer = TaskContext.get().partitionId(), 0, None
        with whole_file(f"{folder}/texts-{p:06d}.parquet") as out:
            kept = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
            with pq.ParquetWriter(out, kept, compression="zstd") as writer:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((p, -1, None, 0, 0, 0, 0), kinds)], names)
                for batch in batches:
                    for part in rows_of(batch, 4 << 20):
                        ids = pylist(part, "doc_id")
                        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pylist(part, "text"), pa.string())], schema=kept))
                        got = [segments(h, width, gram) for h in word_hashes(pylist(part, "text"))]
                        n = np.array([len(g[0]) for g in got])
                        anchors, contents, first, count = (np.concatenate([g[k] for g in got]) for k in range(4))
                        key = np.repeat(np.array([-(1 << 63) if x is None else x for x in ids], np.int64), n)
                        rows = np.repeat(np.arange(row, row + len(ids)), n)
                        row += len(ids)
                        if len(anchors):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(anchors), p, np.int32)), pa.array(rows.astype(np.int32)), pa.array(key), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchors.view(np.int64)), pa.array(contents.view(np.int64))], names)

    schema = "p int, row int, doc long, lo int, n int, anchor long, content long"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
    every = materialize(text_rows(docs, "doc_id", "text").mapInArrow(cut, schema), "segments")
    files, every = every.where("row = -1").select("p", "row"), every.where("row >= 0")
    again = materialize(every.groupBy("anchor").count().where("count > 1").select("anchor"), "anchors")
    here = materialize(every.join(again, "anchor"), "repeated")
    first = F.min(F.struct("doc", "lo", "p", "row", "n")).alias("f")
    distinct = materialize(here.groupBy("anchor", "content").agg(first).select("anchor", "content", "f.*"), "distinct")
    many = materialize(distinct.groupBy("anchor").count().where("count > 1"), "many")
    reps = distinct.join(many, "anchor")

    def contents(doc_id, text, mine):
        h = word_hashes([text])[0]
        return [(anchor, content, key, lo, size, h[lo : lo + n + width - 1].tobytes()) for lo, n, key, anchor, content, size in mine]

    filled = materialize(_beside_texts(folder, reps.withColumnRenamed("count", "shard"), contents, "anchor long, content long, doc long, lo int, shard long, words binary", ("lo", "n", "doc", "anchor", "content", "shard"), False), "contents")

    def match(batches):
        def flat():
            for batch in batches:
                yield from zip(*(pylist(batch, c) for c in ("anchor", "content", "words")))

        out = []
        for anchor, rows in itertools.groupby(flat(), key=lambda r: r[0]):
            rows = list(rows)
            for (_, content, _), runs in zip(rows, earlier([np.frombuffer(r[2], np.uint64).tolist() for r in rows], width)):
                out += [(anchor, content, a, b) for a, b in runs]
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "content", "a", "b"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["anchor", "content", "a", "b"])

    runs_schema = "anchor long, content long, a long, b long"
    runs = filled.where(F.col("shard") <= shard).repartition(shuffle_partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor", "doc", "lo").mapInArrow(match, runs_schema)

    def windows(batches):
        for batch in batches:
            for anchor, content, doc, lo, words in zip(*(pylist(batch, c) for c in ("anchor", "content", "doc", "lo", "words"))):
                h = np.frombuffer(words, np.uint64)
                one, two = rolled(h, width, np.uint64(5)).view(np.int64), rolled(h, width, np.uint64(11)).view(np.int64)
                k = len(one)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(k, anchor)), pa.array(np.full(k, content)), pa.array(np.full(k, doc)), pa.array(np.arange(lo, lo + k)), pa.array(np.arange(k)), pa.array(one), pa.array(two)], ["anchor", "content", "doc", "start", "a", "one", "two"])

    crowded = filled.where(F.col("shard") > shard)
    if not crowded.isEmpty():
        each = materialize(crowded.mapInArrow(windows, "anchor long, content long, doc long, start long, a long, one long, two long"), "windows")
        least = materialize(each.groupBy("one", "two").agg(F.min(F.struct("doc", "start")).alias("least"), F.count("*").alias("k")).where("k > 1").drop("k"), "windows")
        late = each.join(least, ["one", "two"]).where(F.struct("doc", "start") > F.col("least"))
        runs = runs.unionByName(late.select("anchor", "content", "a", F.col("a").alias("b")))
    runs = runs.groupBy("anchor", "content").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    judged = materialize(distinct.select("anchor", "content", F.col("doc").alias("doc0"), F.col("lo").alias("lo0")).join(runs, ["anchor", "content"], "left"), "judged")
    found = here.join(judged, ["anchor", "content"])
    is_first = (F.col("doc") == F.col("doc0")) & (F.col("lo") == F.col("lo0"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("a"), (F.col("n") - 1).cast("long").alias("b")))
    span = F.explode(F.when(is_first, F.col("runs")).otherwise(whole)).alias("r")
    spans = found.select("p", "row", "lo", span).select("p", "row", (F.col("lo") + F.col("r.a")).cast("int").alias("a"), (F.col("lo") + F.col("r.b") + width).cast("int").alias("b"))
    return files, spans


def remove(docs: DataFrame, folder: str, width: int = WIDTH, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """documents(doc_id, text) -> doc_id, n_words, n_removed, kept (the words left, joined by spaces)."""
    files, spans = removed_windows(docs, folder, width, gram, shard)

    def left(doc_id, text, mine):
        words = text.encode().split()
        keep, end = [], 0
        for a, b in mine:
            if a > end:
                keep += words[end:a]
            end = max(end, b)
        keep += words[end:]
        return [(doc_id, len(words), len(words) - len(keep), b" ".join(keep).decode())]

    marked = spans.unionByName(files.select("p", "row", F.lit(0).alias("a"), F.lit(0).alias("b")))
    return _beside_texts(folder, marked, left, "doc_id long, n_words long, n_removed long, kept string", ("a", "b"), True)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove(table(spark, sf_dir, "documents"), shared_dir(spark, "substring"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as texts; one is repeated if it is not the first of its text in order of doc_id and place.
OP5_SQL = r"""
with docs as (select doc_id, row_number() over (order by doc_id nulls first, rowid) as d, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from (select doc_id, text, row_number() over () as rowid from documents)),
words as (select d, unnest(words) as word, generate_subscripts(words, 1) as i from docs),
windows as (select d, i, string_agg(word, ' ') over w as body, count(*) over w as n from words window w as (partition by d order by i rows between current row and 19 following)),
later as (select d, i from (select d, i, row_number() over (partition by body order by d, i) as k from windows where n = 20) where k > 1),
gone as (select distinct d, i + k as i from later, range(20) r(k)),
left_ as (select d, string_agg(word, ' ' order by i) as kept, count(*) as n from words anti join gone using (d, i) group by d)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from docs left join left_ using (d)
"""
