"""Every registered query of the subpackage, called as it is registered: columns, types, and rows against SQL or plain Python."""

import math
import os
import zlib
from collections import Counter

import duckdb
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from quillgraph.llm import quality, registry

from test_operators import BYTE, WORDS, crc, groups, plain_base, plain_fingerprint, plain_ids

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")

COLUMNS = {
    "op1_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op2_pack": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3_warc": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op4_quality": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5_substring": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_secrets": "doc_id bigint, start bigint, length bigint, accepted boolean",
    "op7_simhash": "doc_id bigint, fingerprint string, component_id bigint",
    "op8_mix": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_media": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.fixture(scope="module")
def results(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = registry.QUERIES[name](spark, DATA)
            made[name] = (dict(made[name].dtypes), made[name].collect())
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(results, name):
    types, rows = results(name)
    for column in COLUMNS[name].split(", "):
        at, kind = column.split()
        assert types[at] == kind
    assert (rows or name == "op6_secrets") and set(registry.QUERIES) == set(COLUMNS)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_sql(results, duck, name):
    types, rows = results(name)
    want = duck.sql(registry.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(types)
    flat = lambda r: tuple(round(x, 6) if isinstance(x, float) else x for x in r)
    assert Counter(flat(r[c] for c in want.columns) for r in rows) == Counter(map(flat, want.fetchall()))


def test_token_files_and_packs(results, texts):
    start, want = 0, []
    for d in sorted(texts):
        ids = plain_ids(BYTE, texts[d])
        want.append((d, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in results("op1_token_files")[1]) == want
    rows, parts, windows = results("op2_pack")[1], Counter(), {}
    for r in rows:
        ids = plain_ids(WORDS, texts[r["doc_id"]])
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]])
        parts.update((r["doc_id"], i) for i in range(r["start"], r["start"] + r["length"]))
        windows.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(parts.values()) == {1} and len(parts) == sum(len(plain_ids(WORDS, t)) for t in texts.values())
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096


def test_bands(results, duck):
    """Base columns and the verdict from the bits per word: quartiles over distinct texts by language and class, word by word."""
    docs = {d: (t or "", lang or "") for d, t, lang in duck.sql("select doc_id, text, lang from documents").fetchall()}
    rows, values, copies = results("op4_quality")[1], {}, Counter()
    for r in rows:
        text, lang = docs[r["doc_id"]]
        base = plain_base(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base
        assert r["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        if not r["base_failed"]:
            at = (lang, int(math.log2(r["n_words"])))
            copies[at, text] += 1
            values[at, text] = math.floor(math.log(r["bits"]) / quality.BIN) * quality.BIN
    sizes = Counter()
    for (at, _), n in copies.items():
        sizes[at] += n

    def quartiles(some):
        some = sorted(some)
        at = lambda q: some[math.ceil(q * len(some)) - 1]
        return at(0.25), at(0.75)

    for r in rows:
        if r["base_failed"]:
            assert not r["kept"]
            continue
        text, lang = docs[r["doc_id"]]
        at = (lang, int(math.log2(r["n_words"])))
        own = [v for (a, _), v in values.items() if a == at]
        own = own if len(own) >= quality.CLASS_ROWS else [v for (a, _), v in values.items() if a[0] == lang]
        q1, q3 = quartiles(own)
        width = quality.FENCE * max(q3 - q1, quality.BIN)
        value = math.log(r["bits"])
        learnt = sizes[at] >= quality.CLASS_ROWS and copies[at, text] >= quality.LEARNT * sizes[at]
        if min(abs(value - q1 + width), abs(value - q3 - width)) > 1e-9:
            assert r["kept"] == ((value >= q1 - width or learnt) and value <= q3 + width)


def test_fingerprints(results, texts):
    order = sorted(texts)
    fps = [plain_fingerprint(texts[d]) for d in order]
    want = [(d, f"{f:016x}", order[t]) for d, f, t in zip(order, fps, groups(fps))]
    assert sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in results("op7_simhash")[1]) == want


def test_toxicity_rows(results, duck):
    rows = results("op10_toxicity")[1]
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    assert sorted(r["doc_id"] for r in rows) == sorted(x for (x,) in duck.sql("select doc_id from documents").fetchall())


def test_secrets_rows(results, texts):
    for r in results("op6_secrets")[1]:
        assert 0 <= r["start"] and 0 < r["length"] and r["start"] + r["length"] <= len(texts[r["doc_id"]])
    found = {r["doc_id"] for r in results("op6_secrets")[1] if r["accepted"]}
    assert {d for d, t in texts.items() if 'token = "' in (t or "")} == found


def test_pipeline_runs(spark, texts):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows and {r["doc_id"] for r in rows} <= set(texts)
    held = Counter()
    for r in rows:
        held[r["doc_id"]] += r["length"]
    totals = {r["doc_id"]: r["doc_tokens"] for r in rows}
    assert all(n % totals[d] == 0 and n // totals[d] <= 3 for d, n in held.items())  # whole documents, up to three times
    windows = Counter()
    for r in rows:
        windows[r["sequence_id"]] += r["length"]
    assert max(windows.values()) <= 4096


def test_empty_tables(spark, tmp_path):
    """Every query and the whole pipeline on tables without rows."""
    import corpus_pipeline

    for name in ("documents", "pages", "labels"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, run in registry.QUERIES.items():
        assert run(spark, str(tmp_path)).collect() == [], name
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


