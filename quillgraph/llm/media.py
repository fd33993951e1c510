"""Media columns: payloads kept as content-defined chunks, each distinct chunk stored once.

A payload is held as a WAV file of 8-bit mono samples. The file is cut where a rolling gear hash of
the last 32 bytes has zeros in its mask (between a least and a most length), every chunk is named by
its SHA-256, compressed, and appended to the pack of its task; a pack never holds a chunk twice.
Spark then picks one place for every digest over all packs, a sweep copies only the picked chunks
to the final packs, and each medium is left with an ordered list of digests, which joins to their
places. Reading back fetches the chunks, verifies each against its digest and the whole against its
own, and only then takes the samples out of the WAV file. Bytes of chunks are never shuffled.

Packs appear under their names only when whole, and the sweep of a pack that has been swept already
(its task is run again after a lost executor) finds the final pack and the same offsets.

Nulls: a null text is the empty text; a null doc_id is kept. The empty text is 64 zero bytes. Repeated
rows are media of their own with the same chunks. No rows: no packs and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, make_dir, materialize, pylist, rows_of, shared_dir, shuffle_partitions, table, text_rows, whole_file

UNIT = 64
LEAST, MOST, MASK = 2 << 10, 64 << 10, np.uint32(((1 << 13) - 1) << 19)
LEVEL = 3
RATE = 8000
#: Copies of a repeated digest's place, so that a hot chunk's users are dealt over as many tasks.
SALTS = 32
RECIPE = "src int, row long, doc_id long, n_bytes long, media_sha256 binary, seq int, digest binary, pack int, off long, clen int"


@functools.cache
def _gear() -> np.ndarray:
    return np.frombuffer(hashlib.shake_128(b"gear").digest(4 * 256), "<u4").astype(np.uint32)


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``.

    The gear hash h = 2 h + G[byte] in 32 bits holds the last 32 bytes; it is summed by doubling spans.
    """
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = _gear()[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)  # the right side is made before the sum
    places = (np.flatnonzero((h & MASK) == 0) + 1).tolist()
    out, start, i = [], 0, 0
    while n - start > LEAST:
        while i < len(places) and places[i] < start + LEAST:
            i += 1
        end = min(places[i] if i < len(places) else n, start + MOST, n)
        out.append(end)
        start = end
    if start < n:
        out.append(n)
    return out


def wav(payload: bytes) -> bytes:
    n = len(payload)
    return b"RIFF" + struct.pack("<I", 36 + n) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", n) + payload


def samples(media: bytes) -> bytes:
    if media[:4] != b"RIFF" or media[8:16] != b"WAVEfmt " or media[36:40] != b"data":
        raise ValueError("not a WAV file of this writer")
    return media[44 : 44 + struct.unpack("<I", media[40:44])[0]]


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(UNIT - len(raw) if not raw else -len(raw) % UNIT)


def feature(payload: bytes) -> str:
    """Mean, mean square and crossings of the middle level of the samples, from whole numbers."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    return f"mean={int(x.sum()) / len(x):.4f};power={int((x * x).sum()) / len(x):.3f};crossings={int(np.count_nonzero(np.diff(x >= 128)))}"


def store(docs: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """documents(doc_id, text) -> (recipes, places): a row a chunk of each medium, and a row a distinct digest
    with salt (SALTS rows for digests that are used more than once), pack, off, clen in ``folder``/packs."""
    make_dir(f"{folder}/staged")
    make_dir(f"{folder}/packs")

    def write(batches):
        import zstandard
        from pyspark import TaskContext

        src, row, off, here = TaskContext.get().partitionId(), 0, 0, {}
        packer, out = zstandard.ZstdCompressor(level=LEVEL), []
        with whole_file(f"{folder}/staged/pack-{src:06d}") as pack:
            for batch in batches:
                for part in rows_of(batch, 8 << 20):
                    for doc_id, text in zip(pylist(part, "doc_id"), pylist(part, "text")):
                        n_bytes, payload = payload_of(text)
                        media = wav(payload)
                        whole, start = hashlib.sha256(media).digest(), 0
                        for seq, end in enumerate(cuts(media)):
                            chunk = media[start:end]
                            start = end
                            digest = hashlib.sha256(chunk).digest()
                            if digest not in here:
                                body = packer.compress(chunk)
                                pack.write(body)
                                here[digest] = (off, len(body))
                                off += len(body)
                            out.append((src, row, doc_id, n_bytes, whole, seq, digest, src, *here[digest]))
                        row += 1
                    if len(out) > 10_000:
                        yield _batch(out)
                        out = []
        if out:
            yield _batch(out)

    recipes = materialize(text_rows(docs, "doc_id", "text").mapInArrow(write, RECIPE), "media-recipes")
    salt = F.pmod(F.xxhash64("src", "row"), F.lit(SALTS)).cast("int")
    picked = recipes.groupBy("digest").agg(F.min(F.struct("pack", "off", "clen")).alias("at"), F.count("*").alias("n"), F.min(salt).alias("salt"))

    def sweep(key, t):
        pack = key[0].as_py()
        t = t.sort_by("off")
        offs, sizes = t.column("off").to_pylist(), t.column("clen").to_pylist()
        fs, old = filesystem(f"{folder}/staged/pack-{pack:06d}")
        fs, new = filesystem(f"{folder}/packs/pack-{pack:06d}")
        if not fs.get_file_info(new).is_file:
            with fs.open_input_file(old) as f, whole_file(f"{folder}/packs/pack-{pack:06d}") as out:
                for off, size in zip(offs, sizes):
                    out.write(f.read_at(size, off))
        if fs.get_file_info(old).is_file:
            fs.delete_file(old)
        moved = [0, *itertools.accumulate(sizes)][:-1]
        return t.set_column(t.schema.get_field_index("off"), "off", pa.array(moved, pa.int64()))

    schema = "digest binary, n long, salt int, pack int, off long, clen int"
    places = picked.select("digest", "n", "salt", "at.*").groupBy("pack").applyInArrow(sweep, schema)
    copies = F.explode(F.when(F.col("n") > 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array("salt"))).alias("salt")
    places = materialize(materialize(places, "media-places").select("digest", copies, "pack", "off", "clen"), "media-salted")
    return recipes.drop("pack", "off", "clen").withColumn("salt", salt), places


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in RECIPE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])


class _Packs:
    """The packs' files, the last few held open."""

    def __init__(self, folder: str, most: int = 8):
        self.open = functools.lru_cache(most)(self._open)
        self.folder = folder

    def _open(self, pack: int):
        fs, path = filesystem(f"{self.folder}/packs/pack-{pack:06d}")
        return fs.open_input_file(path)

    def read(self, pack: int, off: int, size: int) -> bytes:
        return self.open(pack).read_at(size, off)


def restore(recipes: DataFrame, places: DataFrame, folder: str) -> DataFrame:
    """-> doc_id, n_bytes, media (the verified WAV file): a row a medium.

    Media are dealt by the task that wrote them, so most of a task's chunks lie in one pack.
    """
    found = recipes.join(places, ["digest", "salt"], "left")
    dealt = found.repartition(shuffle_partitions(recipes.sparkSession), "src").sortWithinPartitions("src", "row", "seq")

    def read(batches):
        import zstandard

        packs, unpacker = _Packs(folder), zstandard.ZstdDecompressor()
        key, parts, head, out, held = None, [], None, [], 0

        def end():
            media = b"".join(parts)
            if hashlib.sha256(media).digest() != head[2]:
                raise ValueError(f"medium {key}: what was read does not match its digest")
            return (head[0], head[1], media)

        columns = ("src", "row", "seq", "doc_id", "n_bytes", "media_sha256", "digest", "pack", "off", "clen")
        for batch in batches:
            for src, row, _, doc_id, n_bytes, whole, digest, pack, off, clen in zip(*(pylist(batch, c) for c in columns)):
                if key != (src, row):
                    if key is not None:
                        out.append(end())
                        held += len(out[-1][2])
                    key, parts, head = (src, row), [], (doc_id, n_bytes, whole)
                    if held > 8 << 20:
                        yield _media(out)
                        out, held = [], 0
                chunk = unpacker.decompress(packs.read(pack, off, clen))
                if hashlib.sha256(chunk).digest() != digest:
                    raise ValueError(f"pack {pack} at {off}: the chunk does not match its digest")
                parts.append(chunk)
        if key is not None:
            out.append(end())
            yield _media(out)

    return dealt.mapInArrow(read, "doc_id long, n_bytes long, media binary")


def _media(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "n_bytes", "media"])


def describe(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media -> sizes, digests and the feature of each medium's samples."""

    def look(batches):
        for batch in batches:
            rows = []
            for doc_id, n_bytes, raw in zip(*(pylist(batch, c) for c in ("doc_id", "n_bytes", "media"))):
                payload = samples(raw)
                rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(payload)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
    return media.mapInArrow(look, schema)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a medium, stored in chunks, read back and described."""
    folder = shared_dir(spark, "media")
    recipes, places = store(table(spark, sf_dir, "documents"), folder)
    return describe(restore(recipes, places, folder))


#: The payload's bytes as rows; the checksum by its table of 256 remainders.
OP9_SQL = r"""
with recursive bits(b, k, c) as (
  select range, 0, range::bigint from range(256)
  union all
  select b, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
remainders as (select list(c order by b) as t from bits where k = 8),
docs as (select row_number() over () as d, doc_id, encode(coalesce(text, '')) as raw from documents),
padded as (select d, doc_id, octet_length(raw) as n, raw || unhex(repeat('00', cast(case when octet_length(raw) = 0 then 64 else (64 - octet_length(raw) % 64) % 64 end as int))) as payload from docs),
cells as (select d, cast(('0x' || unnest(regexp_extract_all(hex(payload), '..'))) as bigint) as b, unnest(range(octet_length(payload))) as i from padded),
steps as (select d, b, i, (lag(b) over (partition by d order by i) >= 128) <> (b >= 128) as crossed from cells),
sums as (select d, sum(b) as s, sum(b * b) as q, count(*) filter (crossed) as z, count(*) as n from steps group by d),
tails as (select d, list(b order by i) as tail from (select d, b, i, count(*) over (partition by d) as n from cells) where i >= n - 64 group by d),
checks as (select d, xor(list_reduce(tail, lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::bigint), 4294967295::bigint) as crc from tails, remainders),
media as (select *, octet_length(payload) as m, unhex('52494646' || le(36 + octet_length(payload)) || '57415645666D74201000000001000100401F0000401F00000100080064617461' || le(octet_length(payload))) || payload as wav from padded)
select doc_id, n as n_bytes, m as payload_bytes, sha256(payload) as payload_sha256, crc as tail_crc32, m + 44 as media_bytes, sha256(wav) as media_sha256,
  printf('mean=%.4f;power=%.3f;crossings=%d', s / m, q / m, z) as feature
from media join (select d, s, q, z from sums) using (d) join checks using (d)
"""
for _size in ("36 + octet_length(payload)", "octet_length(payload)"):  # four bytes, the least first
    OP9_SQL = OP9_SQL.replace(f"le({_size})", " || ".join(f"printf('%02X', (({_size}) >> {k}) & 255)" for k in (0, 8, 16, 24)))
