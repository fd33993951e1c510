"""Packing documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the capacity; the full pieces are windows of their own, and
the tails are packed whole. Tails are dealt in blocks of a bounded number; a block's tails go into
the fewest windows that their sum allows, by multiway differencing: the two partial partitions with
the largest spread are merged, the largest window of one on the smallest of the other, until one
partition is left. Its windows are nearly equal; if one is above the capacity, a window is added and
the block packed again. Blocks are made inside a partition as its documents stream by; the tails left
at the ends of partitions (less than a block each) meet in a second, small pass.

Nulls: a null text is the empty text (only the end id). Repeated rows are packed for each; they share
doc_id and start, and differ in their window. No rows: no pieces. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pylist, table, text_rows
from .tokens import encoder, gathered

#: Tails of a block.
BLOCK = 1024
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def difference(lengths: list[int], windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of the windows (only the non-empty ones).

    A partial partition is its non-empty windows, fullest first; all others are empty.
    """
    # a window is one number: its sum, then the number of a node; nodes from len(lengths) on join two others
    n, joins = len(lengths), []
    bits = 24
    mask = (1 << bits) - 1
    heap = [(-x, i, [x << bits | i]) for i, x in enumerate(lengths)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        if (over := len(a) + len(b) - windows) > 0:
            # the fullest windows of either lie on empty ones of the other; the last `over` of a meet those of b, opposed
            at = n + len(joins)
            meet, other = a[len(a) - over :], b[len(b) - over :][::-1]
            joins += [(x & mask, y & mask) for x, y in zip(meet, other)]
            a = a[: len(a) - over] + b[: len(b) - over] + [((x >> bits) + (y >> bits)) << bits | k for k, (x, y) in enumerate(zip(meet, other), at)]
        else:
            a = a + b
        a.sort(reverse=True)
        heapq.heappush(heap, (-((a[0] >> bits) - ((a[-1] >> bits) if len(a) == windows else 0)), tick, a))
        tick += 1

    def members(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            if (x := todo.pop()) >= n:
                todo.extend(joins[x - n])
            else:
                out.append(x)
        return sorted(out)

    return [members(x & mask) for x in heap[0][2]] if heap else []


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``, as few as differencing reaches."""
    windows = max(1, -(-sum(lengths) // capacity))
    while True:
        out = difference(lengths, windows)
        if all(sum(lengths[i] for i in w) <= capacity for w in out):
            return out
        windows += 1


def _block(rows: list[tuple], capacity: int, first: int) -> tuple[pa.RecordBatch, int]:
    """rows (doc_id, start, doc_tokens, ids) of one block -> its pieces, windows numbered from ``first``."""
    width = np.dtype("<u4").itemsize
    lengths = [len(r[3]) // width for r in rows]
    out = []
    windows = pack(lengths, capacity)
    for k, members in enumerate(windows):
        offset = 0
        for i in members:
            doc_id, start, total, raw = rows[i]
            out.append((doc_id, start, lengths[i], total, raw, first + k, offset))
            offset += lengths[i]
    return _batch(out), first + len(windows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 2
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, block: int = BLOCK) -> DataFrame:
    """documents(doc_id, text) -> pieces: doc_id, start, length, doc_tokens, ids (little-endian uint32),
    sequence_id, offset. A sequence is the pieces of one sequence_id in order of offset.

    The high bits of a sequence_id are the task that made it, so numbers need no global count.
    """

    def first_pass(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        number, tails, out = TaskContext.get().partitionId() << 32, [], []
        held = 0
        for part in gathered(batches):
            for doc_id, raw in zip(pylist(part, "doc_id"), enc.encode(part.column("text"))):
                raw = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes() + end
                total = len(raw) // 4
                for start in range(0, total - total % capacity, capacity):
                    out.append((doc_id, start, capacity, total, raw[4 * start : 4 * (start + capacity)], number, 0))
                    number += 1
                if total % capacity:
                    start = total - total % capacity
                    tails.append((doc_id, start, total, raw[4 * start :]))
                held += len(raw)
                if len(tails) >= block:
                    made, number = _block(tails, capacity, number)
                    yield made
                    tails = []
                if held > 8 << 20 and out:
                    yield _batch(out)
                    out, held = [], 0
        if out:
            yield _batch(out)
        if tails:
            yield _batch([(doc_id, start, len(raw) // 4, total, raw, None, None) for doc_id, start, total, raw in tails])

    pieces = materialize(text_rows(docs, "doc_id", "text").mapInArrow(first_pass, PIECES), "pack-pieces")
    left = pieces.where("sequence_id is null")
    groups = max(1, -(-left.count() // block))

    def second_pass(key, t):
        t = t.sort_by([("doc_id", "ascending"), ("start", "ascending"), ("ids", "ascending")])
        rows = list(zip(*(t.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))))
        made, _ = _block(rows, capacity, (1 << 62) + (key[0].as_py() << 32))
        return pa.Table.from_batches([made])

    # dealt by the row's place in the written table, so that repeated rows spread as well
    dealt = left.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    packed = dealt.groupBy("g").applyInArrow(second_pass, PIECES)
    return pieces.where("sequence_id is not null").unionByName(packed)


def crc32s(ids: DataFrame) -> DataFrame:
    """Replaces the column ids by ids_crc32."""
    return ids.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` by word_bpe_49k with end id 2 in windows of 4096."""
    import public_tokenizers

    return crc32s(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2))
