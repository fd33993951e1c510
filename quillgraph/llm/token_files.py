"""Token-ID output: flat unsigned integer files with 64-bit document offsets, memory-mapped.

Format, for each shard of a range-partitioned corpus (ascending doc_id):

* ``shard-NNNNNN.bin``: the ids of its documents one after another, little-endian, two bytes if the
  vocabulary fits them, else four;
* ``shard-NNNNNN.idx``: little-endian int64: the number of documents n, then n + 1 offsets (in ids)
  into the .bin, n doc_ids, and n flags (1: the doc_id is null).

A shard knows nothing of the others; its base, the ids in all shards before it, is a prefix sum
over the shards' totals, one small row a shard. Files appear under their names only when whole, so
a task that is run again after a lost executor leaves the same files.

Nulls: a null text is the empty text (only the end id); null doc_ids come first. Repeated doc_ids
are ordered by text. No rows: no shards and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, make_dir, pylist, shared_dir, shuffle_partitions, table, text_rows, whole_file
from .tokens import encoder, gathered

MANIFEST = "shard int, dtype string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shards: int | None = None) -> list[tuple]:
    """Writes documents(doc_id, text); returns (shard, dtype, n_docs, n_tokens, base), a row a shard.

    ``shards`` defaults to spark.sql.shuffle.partitions: a shard is one task's sorted range.
    """
    make_dir(folder)
    spark = docs.sparkSession

    def write(batches):
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), None
        sizes, ids, null = [], [], []
        batches = iter(batches)
        first = next((b for b in batches if len(b)), None)
        if first is None:
            return
        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype).tobytes()
        with whole_file(f"{folder}/shard-{shard:06d}.bin") as out:
            for part in gathered(itertools.chain([first], batches)):
                for x in enc.encode(part.column("text")):
                    out.write(x)
                    out.write(end)
                    sizes.append(len(x) // enc.dtype.itemsize + 1)
                got = pylist(part, "doc_id")
                null += [x is None for x in got]
                ids += [x or 0 for x in got]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        with whole_file(f"{folder}/shard-{shard:06d}.idx") as out:
            for x in ([len(ids)], offsets, ids, null):
                out.write(np.asarray(x).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "dtype": [enc.dtype.str], "n_docs": pa.array([len(ids)], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})

    rows = text_rows(docs, "doc_id", "text").repartitionByRange(shards or shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    done = sorted(tuple(x) for x in rows.mapInArrow(write, MANIFEST).collect())
    bases = itertools.accumulate((x[3] for x in done), initial=0)
    return [(*x, base) for x, base in zip(done, bases)]


class Shard:
    """A shard's files: ids memory-mapped where the file system is local, else read by ranges."""

    def __init__(self, folder: str, shard: int, dtype: str):
        self.dtype = np.dtype(dtype)
        fs, path = filesystem(f"{folder}/shard-{shard:06d}")
        with fs.open_input_file(f"{path}.idx") as f:
            raw = np.frombuffer(f.read(), "<i8")
        n = int(raw[0])
        self.offsets, self.doc_ids, self.null = raw[1 : n + 2], raw[n + 2 : 2 * n + 2], raw[2 * n + 2 :].astype(bool)
        self.mapped = None
        if fs.type_name == "local":
            self.mapped = np.memmap(f"{path}.bin", self.dtype, "r") if self.offsets[-1] else np.empty(0, self.dtype)
        else:
            self.file = fs.open_input_file(f"{path}.bin")

    def ids(self, k: int) -> np.ndarray:
        a, b = int(self.offsets[k]), int(self.offsets[k + 1])
        if self.mapped is not None:
            return self.mapped[a:b]
        return np.frombuffer(self.file.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)

    def __len__(self) -> int:
        return len(self.doc_ids)


def read_token_files(spark: SparkSession, folder: str, manifest: list[tuple]) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of 32-bit ids)."""

    def read(batches):
        for batch in batches:
            for shard, dtype, base in zip(pylist(batch, "shard"), pylist(batch, "dtype"), pylist(batch, "base")):
                s = Shard(folder, shard, dtype)
                for a in range(0, len(s), 20_000):
                    span = range(a, min(a + 20_000, len(s)))
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(s.doc_ids[span.start : span.stop], pa.int64(), mask=s.null[span.start : span.stop]),
                        "start": pa.array(s.offsets[span.start : span.stop] + base, pa.int64()),
                        "n_tokens": pa.array(np.diff(s.offsets[span.start : span.stop + 1]), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(s.ids(k).astype("<u4")) for k in span], pa.int64()),
                    })

    shards = spark.createDataFrame(manifest, f"{MANIFEST}, base long")
    shards = shards.repartition(max(1, len(manifest)), "shard") if manifest else shards
    return shards.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` by byte_bpe_50k with end id 2, written and read back."""
    import public_tokenizers

    folder = shared_dir(spark, "tokens")
    manifest = write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"), 2)
    return read_token_files(spark, folder, manifest)
