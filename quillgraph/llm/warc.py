"""WARC files of pages, each record a Zstandard frame of its own, all sharing a dictionary.

A file begins with one skippable frame that holds the dictionary, then come a warcinfo record and
the pages' records, every one compressed alone, so any record can be read from its offset with the
dictionary at hand. Of the pages with equal payloads that with the largest page_id is archived as a
response; the others are revisit records that refer to it. A revisit record holds the HTTP header
(with the payload's Content-Length) but no payload.

Payloads are never shuffled: tasks keep their pages in a file each in the shared folder, digests alone meet, and what
they decide is dealt back to the files.

The dictionary is trained on the driver from a bounded sample: the first ``SAMPLE_CHARS`` characters of the ``SAMPLE_ROWS`` pages with the
smallest hash. Only compression depends on it.

Nulls: a null html is the empty payload; a null page_id ranks below all others and is written as
"null"; a null url as an empty target. Repeated rows (equal page_id and payload): one of them is the
response, the others revisit it. No rows: no files and no rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, make_dir, materialize, pylist, rows_of, shared_dir, small_batches, table, whole_file

SAMPLE_ROWS, SAMPLE_CHARS, DICT_BYTES = 1000, 20_000, 64 << 10
SKIPPABLE = 0x184D2A5D
#: Parts into which equal payloads are dealt for the join, so one hot payload is no single task's.
SALTS = 32
LEVEL = 3
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2000-01-01T00:00:00Z"  # records carry no time of their own: equal input, equal files


def train_dictionary(pages: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICT_BYTES) -> bytes:
    """A trained dictionary, or the plain text of the sample where it is too small to train on."""
    import zstandard

    fit = pages.where("html is not null").select(F.substring("html", 1, SAMPLE_CHARS).alias("html"), F.xxhash64("page_id", "html").alias("h"))
    # the hashes first, so that no task sends more than those and no more than ``rows`` payloads reach the driver
    last = fit.select("h").orderBy("h").limit(rows).agg(F.max("h")).collect()[0][0]
    sample = fit.where(F.col("h") <= F.lit(last)).orderBy("h").limit(rows).collect() if last is not None else []
    texts = [_http(len(p := r["html"].encode())) + p for r in sample]
    try:
        return zstandard.train_dictionary(size, texts, k=512, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(texts)[:size]


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _uri(page_id) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, revisits: bool, refers_to) -> bytes:
    target = "".join(c if c.isprintable() else "%" + c.encode().hex() for c in url or "")
    fields = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _uri(page_id)), ("WARC-Date", _DATE), ("WARC-Target-URI", target), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisits:
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", _uri(refers_to))]
    return _record(fields, _http(len(payload)) + (b"" if revisits else payload))


def keep_pages(pages: DataFrame, folder: str) -> DataFrame:
    """Keeps pages(page_id, url, html) in ``folder``, a file a task: p, row, page_id, digest; row -1 only names a file."""
    small_batches(pages.sparkSession)
    make_dir(folder)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary()]
    kept = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string())])

    def keep(batches):
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        p, n = TaskContext.get().partitionId(), 0
        with whole_file(f"{folder}/pages-{p:06d}.parquet") as out:
            with pq.ParquetWriter(out, kept, compression="zstd") as writer:
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((p, -1, None, b""), kinds)], ["p", "row", "page_id", "digest"])
                for batch in batches:
                    for part in rows_of(batch, 8 << 20, "html"):
                        part = pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(c)).cast(kept.field(c).type) for c in kept.names], schema=kept)
                        writer.write_batch(part, row_group_size=max(1, len(part)))
                        digests = [hashlib.sha1(x.encode()).digest() for x in pylist(part, "html")]
                        yield pa.RecordBatch.from_arrays([pa.array([p] * len(part), kinds[0]), pa.array(range(n, n + len(part)), kinds[1]), part.column(0), pa.array(digests, kinds[3])], ["p", "row", "page_id", "digest"])
                        n += len(part)

    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    return materialize(rows.mapInArrow(keep, "p int, row long, page_id long, digest binary"), "warc-pages")


def assign(kept: DataFrame) -> DataFrame:
    """keep_pages()'s rows -> p, row, refers_to, first of those that revisit another page (first: its page_id is known), and of
    row -1 of each file.

    Counts are pre-aggregated by digest; pages meet only the digests that occur more than once, each in
    SALTS copies, so the pages of one hot payload are dealt over as many tasks.
    """
    rows = kept.where("row >= 0")
    first = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "p", "row")).alias("first")
    many = rows.groupBy("digest").agg(F.count("*").alias("n"), first).where("n > 1")
    many = materialize(many.select("digest", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), "first"), "warc-digests")
    met = rows.withColumn("salt", F.pmod(F.xxhash64("p", "row"), F.lit(SALTS)).cast("int")).join(many, ["digest", "salt"])
    again = met.where((F.col("first.p") != F.col("p")) | (F.col("first.row") != F.col("row"))).select("p", "row", F.col("first.page_id").alias("refers_to"))
    return again.unionByName(kept.where("row = -1").select("p", "row", F.lit(None).cast("long").alias("refers_to")))


def write_warc(marks: DataFrame, pages: str, folder: str, dictionary: bytes, level: int = LEVEL) -> list[str]:
    """Writes the pages kept in the folder ``pages`` under assign()'s marks, an archive a file; returns their URIs (a row a file)."""
    make_dir(folder)

    def archive(p: int, marked) -> pa.RecordBatch:
        import pyarrow.parquet as pq
        import zstandard

        name, n = f"{folder}/part-{p:06d}.warc.zst", 0
        packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        at, refers_to = next(marked, (None, None))
        fs, path = filesystem(f"{pages}/pages-{p:06d}.parquet")
        with fs.open_input_file(path) as f, whole_file(name) as out:
            out.write(SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary)
            info = b"software: quillgraph\r\nformat: WARC File Format 1.1\r\n"
            out.write(packer.compress(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{p}>"), ("WARC-Date", _DATE), ("Content-Type", "application/warc-fields")], info)))
            for batch in pq.ParquetFile(f).iter_batches(500):
                for page_id, url, html in zip(*(pylist(batch, c) for c in ("page_id", "url", "html"))):
                    payload = html.encode()
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    out.write(packer.compress(page_record(page_id, url, payload, digest, n == at, refers_to)))
                    if n == at:
                        at, refers_to = next(marked, (None, None))
                    n += 1
        return pa.RecordBatch.from_pydict({"file": [name], "n": pa.array([n], pa.int64())})

    def write(batches):
        flat = (r for batch in batches for r in zip(*(pylist(batch, c) for c in ("p", "row", "refers_to"))))
        for p, own in itertools.groupby(flat, key=lambda r: r[0]):
            yield archive(p, ((row, to) for _, row, to in own if row >= 0))

    done = marks.repartition("p").sortWithinPartitions("p", "row").mapInArrow(write, "file string, n long").collect()
    return sorted(r["file"] for r in done if r["n"])


def records(uri: str, chunk: int = 64 << 10):
    """(header fields, block) of each record of a .warc.zst file, read as a stream."""
    import zstandard

    fs, path = filesystem(uri)
    with fs.open_input_stream(path, compression=None) as f:
        head = f.read(8)
        if int.from_bytes(head[:4], "little") != SKIPPABLE:
            raise ValueError(f"{uri}: no dictionary frame")
        dictionary = f.read(int.from_bytes(head[4:], "little"))
        unpacker = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        rest = f.read(chunk)
        while rest:
            frame, parts = unpacker.decompressobj(), []
            while not frame.eof:
                if not rest and not (rest := f.read(chunk)):
                    raise ValueError(f"{uri}: cut off")
                parts.append(frame.decompress(rest))
                rest = frame.unused_data if frame.eof else b""
            head, _, block = b"".join(parts).partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
            yield fields, block[: int(fields["Content-Length"])]
            rest = rest or f.read(chunk)


def read_warc(spark: SparkSession, files: list[str]) -> DataFrame:
    """From the files: page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are computed from the payload that was read; a revisit's come from its header.
    """
    kind = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda uri: None if uri is None or uri == "<urn:page:null>" else int(uri[len("<urn:page:") : -1])

    def read(batches):
        for batch in batches:
            for uri in pylist(batch, "file"):
                out, held = [], 0
                for fields, block in records(uri):
                    if fields["WARC-Type"] == "warcinfo":
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if fields["WARC-Type"] == "response":
                        length, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
                            raise ValueError(f"{uri}: {fields['WARC-Record-ID']} does not match its digest")
                    else:
                        payload, digest = None, fields["WARC-Payload-Digest"][5:]
                        length = int(http.rpartition(b"Content-Length: ")[2])
                    out.append((number(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], payload, length, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To"))))
                    held += len(block)
                    if held > 16 << 20 or len(out) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)
                        out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), schema.types)], schema=schema)

    names = spark.createDataFrame([(x,) for x in files], "file string")
    names = names.repartition(len(files), "file") if files else names
    return names.mapInArrow(read, kind)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page archived with dictionary compression and read back."""
    pages = table(spark, sf_dir, "pages")
    kept, folder = shared_dir(spark, "warc-kept"), shared_dir(spark, "warc")
    files = write_warc(assign(keep_pages(pages, kept)), kept, folder, train_dictionary(pages))
    return read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of the SHA-1: forty binary strings of four bits, cut by five.
OP3_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as hex from pages),
d as (
  select page_id, strlen(html) as payload_bytes, hex,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + cast(list_sum(list_transform(range(5), lambda k:
        ((strpos('0123456789abcdef', substr(hex, 1 + (5 * i + k) // 4, 1)) - 1) >> (3 - (5 * i + k) % 4) & 1) << (4 - k))) as bigint), 1)), '') as payload_digest,
    max(page_id) over (partition by hex) as top
  from p)
select page_id, payload_bytes, payload_digest,
  case when page_id = top then 'response' else 'revisit' end as record_type,
  case when page_id <> top then top end as refers_to
from d
"""
