"""SimHash near-duplicates, found by BK-trees of shards of fingerprints.

A document's fingerprint has the bits that are set in over half the hashes of its word shingles.
Of 2 radius bands of the 64 bits, fingerprints within the radius agree on radius bands at least, so the
distinct fingerprints are dealt into shards by the bits of each choice of radius bands (six choices of 32 bits for a
radius of two): a tree of one shard is built and asked where the shard lies, and no tree is sent to fingerprints that
cannot match it. (Broadcasting every shard's tree to all fingerprints asks each tree about each fingerprint: its cost
grows with the square of the corpus.) In a shard's BK-tree a child's key is its Hamming distance to the
parent, and a search follows only the edges within the radius of its own distance.

A tree answers each fingerprint with one link to every component of the shard (so far) within the
radius, not with every partner: enough for the components, and at most one link a fingerprint and
component. A shard of more than ``SHARD`` fingerprints is dealt again in the same way by the bits that it does not
share: these halve each time, so every shard ends within the bound and every link comes from a tree.

``similar`` adds what no radius can give. Five-word shingles of similarity (Jaccard) 0.8 leave fingerprints about ten bits apart, and a
search that wide reads nearly all of them. There documents are linked too if they agree on one of ``BANDS`` bands of
``ROWS`` least hashes of their shingles: 99 % of pairs at 0.8, fewer than 4 % at 0.5. A band's documents are linked to one of them,
so a group of any size costs a link a document and band, and none is left out.

Nulls: a null text is the empty text: fingerprint zero, linked like any other. A null doc_id counts
for the fingerprint's group but is never the smallest, except if all are null. Repeated rows are equal copies:
a row each. No rows: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.programs import connected_components
from .common import fresh, materialize, pylist, rows_of, table, text_rows

SEED, WORDS, RADIUS = 42, 3, 2
#: Most fingerprints of a tree's shard.
SHARD = 2048
#: Least hashes of a band, and bands: documents whose shingles have a similarity of 0.8 agree on a band with a chance of 0.99.
ROWS, BANDS = 10, 40


def shingle_hashes(text: str, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """Hashes of the shingles of the ASCII-lower-cased text, one for each time it occurs; the whole of a shorter text is a shingle."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), seed)] if found else [], "<u8")
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    return np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    """Shingles count as often as they occur; 0 for a text without words."""
    return majority(shingle_hashes(text, words, seed))


@functools.cache
def _orders() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands, one pair for each order of the shingles."""
    got = np.random.default_rng(5).integers(0, 1 << 63, (2, ROWS * BANDS), np.uint64)
    return got[0] * np.uint64(2) + np.uint64(1), got[1]


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of the band's number and its least hashes. No shingles: no keys."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    times, plus = _orders()
    least = np.full(len(times), np.iinfo(np.uint64).max)
    for i in range(0, len(hashes), 256):
        least = np.minimum(least, (hashes[i : i + 256, None] * times + plus).min(axis=0))
    key = np.arange(BANDS, dtype=np.uint64) + np.uint64(1)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + column
    return key ^ (key >> np.uint64(29))


def fingerprints(docs: DataFrame, row: str, words: int = WORDS, seed: int = SEED, keys: bool = False) -> DataFrame:
    """documents(doc_id, text, and the column ``row``, a number) -> doc_id, row, fp (64 bits in a long), and keys of bands if asked for."""

    def make(batches):
        for batch in batches:
            for part in rows_of(batch, 8 << 20):
                hashes = [shingle_hashes(x, words, seed) for x in pylist(part, "text")]
                part = part.drop_columns(["text"]).append_column("fp", pa.array(np.array([majority(h) for h in hashes], np.uint64).view(np.int64)))
                yield part.append_column("keys", pa.array([band_keys(h).view(np.int64) for h in hashes], pa.list_(pa.int64()))) if keys else part

    rows = text_rows(docs.select("doc_id", F.col(row).cast("long").alias("row"), "text"), "doc_id", "row", "text")
    return rows.mapInArrow(make, "doc_id long, row long, fp long" + (", keys array<long>" if keys else ""))


class BKTree:
    """Nodes are [value, {distance: child}]."""

    def __init__(self):
        self.root = None

    def near(self, value: int, radius: int):
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            distance = (node[0] ^ value).bit_count()
            if distance <= radius:
                yield node[0]
            children = node[1]
            for d in range(max(1, distance - radius), distance + radius + 1):
                if d in children:
                    todo.append(children[d])

    def add(self, value: int) -> None:
        if self.root is None:
            self.root = [value, {}]
            return
        node = self.root
        while True:
            distance = (node[0] ^ value).bit_count()
            if distance == 0:
                return
            child = node[1].get(distance)
            if child is None:
                node[1][distance] = [value, {}]
                return
            node = child


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links of a shard's distinct values, enough for its components: a spanning forest."""
    tree, parent, out = BKTree(), {}, []

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values:
        parent[value] = value
        for other in tree.near(value, radius):
            a, b = top(value), top(other)
            if a != b:
                parent[a] = b
                out.append((value, other))
        tree.add(value)
    return out


def choices(free: int, radius: int) -> list[int]:
    """Masks of the choices of ``radius`` of 2 radius bands of the bits of ``free``: numbers that differ in at most
    ``radius`` of these bits agree on one of the masks at least."""
    bits = [i for i in range(64) if free >> i & 1]
    n = 2 * radius
    bands = [sum(1 << i for i in bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]
    return [sum(c) for c in itertools.combinations(bands, radius)]


def _long(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(values: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """Distinct values(fp) -> links (a, b) between values within the radius (one at least), enough for the components."""
    spark, every = values.sparkSession, (1 << 64) - 1

    def search(batches):
        key, held, out = None, [], []
        for batch in batches:
            for mask, bits, fp in zip(*(pylist(batch, c) for c in ("mask", "bits", "fp"))):
                if key != (mask, bits):
                    out += shard_links(held, radius)
                    key, held = (mask, bits), []
                held.append(fp & every)
            if len(out) > 50_000:
                yield _links(out)
                out = []
        out += shard_links(held, radius)
        yield _links(out)

    masks, found = choices(every, radius), None
    dealt = values.select("fp", F.explode(F.array(*[F.lit(_long(m)) for m in masks])).alias("mask"))
    while True:
        dealt = dealt.withColumn("bits", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = materialize(dealt.groupBy("mask", "bits").count().where("count > 1"), "simhash-shards")
        small = dealt.join(sizes.where(F.col("count") <= shard).select("mask", "bits"), ["mask", "bits"])
        near = small.repartition("mask", "bits").sortWithinPartitions("mask", "bits", "fp").mapInArrow(search, "a long, b long")
        found = near if found is None else found.unionByName(near)
        large = sizes.where(F.col("count") > shard).select("mask", "bits")
        if large.isEmpty():
            return found
        # what a crowded shard shares grows by half of what it does not; the last few bits have few values
        after = {m: [m | c for c in choices(every & ~m, radius)] for m in masks if (every & ~m).bit_count() >= 2 * radius}
        steps = [(_long(m), _long(c)) for m, more in after.items() for c in set(more)]
        if not steps:
            raise ValueError(f"a tree's shard must hold at least {1 << (2 * radius)} fingerprints")
        masks = sorted({c for more in after.values() for c in more})
        steps = F.broadcast(spark.createDataFrame(steps, "mask long, next long"))  # a few hundred rows
        crowd = dealt.join(large, ["mask", "bits"], "left_semi").join(steps, "mask")
        dealt = materialize(crowd.select("fp", F.col("next").alias("mask")).distinct(), "simhash-crowd")


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])


def similar(fps: DataFrame) -> DataFrame:
    """fps(fp, keys) -> links (a, b) of fingerprints whose documents agree on a band: each to the smallest that has its key."""
    kinds = fps.groupBy("fp", F.xxhash64("keys").alias("kind")).agg(F.first("keys").alias("keys"))
    keyed = materialize(kinds.select("fp", F.explode("keys").alias("key")).distinct(), "simhash-keys")
    least = keyed.groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").select("key", "b")
    return keyed.join(least, "key").select(F.col("fp").alias("a"), "b").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, alike: bool = False, row: str | None = None) -> DataFrame:
    """documents(doc_id, text) -> doc_id, row, fp, component (a fingerprint), component_id (the smallest doc_id reachable).

    ``row``: the column that numbers the rows of docs; without it their place does. ``alike`` links by similar() too.
    """
    if row is None:
        row = fresh(docs, "near_row")
        docs = docs.withColumn(row, F.monotonically_increasing_id())
    fps = materialize(fingerprints(docs, row, words, keys=alike), "simhash-fps")
    values = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-values")
    near = links(values.select("fp"), radius)
    if alike:
        near = near.unionByName(similar(fps))
    groups = connected_components(near.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    grouped = values.join(groups.withColumnRenamed("v", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = materialize(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "simhash-least")
    named = materialize(grouped.join(least, "component").select("fp", "component", "component_id"), "simhash-named")
    return fps.drop("keys").join(named, "fp").select("doc_id", "row", "fp", "component", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, words: int = 5, alike: bool = True) -> DataFrame:
    """One document of each group, with its columns: that with the smallest doc_id, then the first row.

    docs must be rows of files (a row's number is its place in them, alike in every scan).
    """
    row = fresh(docs, "near_row")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = near_duplicates(numbered.select("doc_id", "text", row), radius, words, alike, row)
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")).alias("least"))
    return numbered.join(least.select(F.col("least.row").alias(row)), row, "left_semi").select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
