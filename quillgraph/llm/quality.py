"""Quality rules: word and line rules, then n-gram perplexity bands.

The language model is a modified Kneser-Ney model over bytes, one for each language, of order five.
Its counts are Spark aggregates over every byte of every document: tasks add up their own n-grams,
Spark sums them, takes continuation counts, discounts (from the counts of counts one to four), back-off
weights and interpolated probabilities order by order, and stores the model as arrays sorted by the n-gram itself
(its bytes as a number: 32 bits up to order three, 64 above), in the shared folder. No n-gram is lost or taken for
another, so a language's model grows with its distinct n-grams. An array is one or more flat files, a range of n-grams each; where the
shared folder is a mounted file system they are memory-mapped, so that a machine's workers share the pages that they look at, else a worker
reads a language's arrays when it meets its first document.

Bands: the logarithm of a document's bits per word (the binary logarithm of its perplexity) must lie within ``FENCE``
interquartile ranges of the quartiles of its language and length class (the power of two below n_words); a class of fewer than
``CLASS_ROWS`` texts is judged by its language's quartiles. Quartiles are exact over bins of 0.001,
of all distinct texts that pass the other rules: a text counts once, so a group of copies cannot make the band its own.
The model counts every row and so learns a text of many copies by heart; where a text's copies are a quarter of a class of
``CLASS_ROWS`` rows or more, its low perplexity tells nothing about it and only the upper end of the band applies.

Nulls: a null text is the empty text (no words: it fails the rule on words); a null lang is a language of
its own. Repeated rows are judged alike, each counted. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import filesystem, make_dir, materialize, pylist, rows_of, shared_dir, small_batches, small_side, table, text_rows, whole_file

ORDER = 5
FENCE, CLASS_ROWS, BIN = 3.0, 100, 0.001
#: A text whose copies are this share of its class's rows is not rejected for a low perplexity.
LEARNT = 0.25
LEAST_WORDS, MOST_REPEATED = 50, 50
SYMBOLS, SPACES = "#*$%&|<>", " \t\n\x0b\x0c\r"


def base(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    raw = text.encode()
    words = raw.split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeated, n = 0, len(words)
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.fromiter((seen.setdefault(x, len(seen)) for x in words), np.int64, n)
        pairs = ids[:-1] * len(seen) + ids[1:]
        if len(seen) > 1 << 20:  # the product of three would not fit
            pairs = np.unique(pairs, return_inverse=True)[1].reshape(-1)
        keys = pairs[:-1] * len(seen) + ids[2:]
        ordered = np.sort(keys)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            covered = np.zeros(n, bool)
            at = np.flatnonzero(np.isin(keys, twice))
            for k in range(3):
                covered[at + k] = True
            repeated = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def grams(raw: bytes) -> np.ndarray:
    """The n-gram of order five that ends at each byte, as a number; the text begins after line breaks."""
    b = np.frombuffer(b"\n" * (ORDER - 1) + raw, np.uint8).astype(np.uint64)
    out = np.zeros(len(raw), np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(8)) | b[k : k + len(raw)]
    return out


def key_type(n: int) -> tuple[str, type]:
    """Spark's and numpy's type of the keys of n-grams of n bytes."""
    return ("int", np.int32) if n <= 3 else ("long", np.int64)


def count_grams(docs: DataFrame) -> DataFrame:
    """documents(text, lang) -> lang, gram, n: every n-gram of the highest order, counted."""

    def count(batches):
        held: dict = {}
        sizes: dict = {}

        def fold(lang):
            keys = np.concatenate([k for k, _ in held[lang]])
            n = np.concatenate([c for _, c in held[lang]])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            held[lang] = [(keys[first], np.add.reduceat(n, first))]
            sizes[lang] = len(first)

        for batch in batches:
            for part in rows_of(batch, 4 << 20):
                by: dict = {}
                for lang, text in zip(pylist(part, "lang"), pylist(part, "text")):
                    if text:
                        by.setdefault(lang, []).append(grams(text.encode()))
                for lang, arrays in by.items():
                    got = np.sort(np.concatenate(arrays))
                    first = np.flatnonzero(np.concatenate([[True], got[1:] != got[:-1]]))
                    held.setdefault(lang, []).append((got[first], np.diff(np.append(first, len(got)))))
                    if sum(len(k) for k, _ in held[lang]) > 4 * sizes.get(lang, 1 << 18):
                        fold(lang)
        for lang in held:
            fold(lang)
            keys, n = held[lang][0]
            for i in range(0, len(keys), 1 << 17):
                some = keys[i : i + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int64)), pa.array(n[i : i + (1 << 17)].astype(np.int64))], ["lang", "gram", "n"])

    counted = text_rows(docs, "text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build_model(docs: DataFrame, folder: str) -> None:
    """Writes the arrays of keys and values (log2 of probabilities, kind p, and of back-off weights, kind g) and, for each order and kind,
    a table of its files: lang, file, rows, first key."""
    make_dir(folder)
    level = materialize(count_grams(docs).withColumn("lang", F.coalesce("lang", F.lit(""))), "grams")
    levels = {ORDER: level}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialize(levels[n + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 8 * n) - 1)).alias("gram")).agg(F.count("*").alias("n")), "grams")
    lower = None
    for n in range(1, ORDER + 1):
        rows = levels[n]
        found = rows.groupBy("lang").agg(*[F.greatest(F.count_if(F.col("n") == i), F.lit(1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
        y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
        steps = [F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.1)), F.lit(i - 0.05)).alias(f"d{i}") for i in (1, 2, 3)]
        found = small_side(found.select("lang", *steps), "discounts")  # a row a language
        off = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        rows = rows.join(found, "lang").withColumn("off", off).withColumn("context", F.shiftright("gram", 8))
        contexts = rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("off").alias("kept"))
        contexts = materialize(contexts.select("lang", "context", "total", (F.col("kept") / F.col("total")).alias("weight")), "contexts")
        rows = rows.join(contexts, ["lang", "context"])
        if lower is None:
            rows = rows.withColumn("below", F.lit(1 / 256))
        else:
            rows = rows.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower, ["lang", "suffix"])
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("weight") * F.col("below")
        probs = materialize(rows.select("lang", "gram", "n", p.alias("p")), "probs")
        lower = probs.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("below"))
        for kind, t, size, value in (("p", probs.withColumnRenamed("gram", "key"), n, "p"), ("g", contexts.withColumnRenamed("context", "key"), n - 1, "weight")):
            t = t.select("lang", F.col("key").cast(key_type(size)[0]).alias("key"), F.log2(value).cast("float").alias("value"))
            t = t.repartitionByRange("lang", "key").sortWithinPartitions("lang", "key")
            t.mapInArrow(_store(f"{folder}/{kind}{n}"), FILES).write.parquet(f"{folder}/{kind}{n}.files")


FILES = "lang string, file string, rows long, first long"


def _store(name: str):
    """A task's sorted rows(lang, key, value) as flat files, two a language."""

    def runs(batches):
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            codes = langs.indices.to_numpy()
            cuts = [0, *(np.flatnonzero(codes[1:] != codes[:-1]) + 1).tolist(), len(codes)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield langs.dictionary[int(codes[a])].as_py(), batch.column(1).to_numpy()[a:b], batch.column(2).to_numpy()[a:b]

    def store(batches):
        from pyspark import TaskContext

        for i, (lang, own) in enumerate(itertools.groupby(runs(batches), key=lambda r: r[0])):
            file, rows, first = f"{name}-{TaskContext.get().partitionId():06d}-{i}", 0, None
            with whole_file(f"{file}.key") as keys, whole_file(f"{file}.value") as values:
                for _, key, value in own:
                    keys.write(key.tobytes())
                    values.write(value.tobytes())
                    first = int(key[0]) if first is None else first
                    rows += len(key)
            yield pa.RecordBatch.from_pydict({"lang": [lang], "file": [file], "rows": pa.array([rows], pa.int64()), "first": pa.array([first], pa.int64())})

    return store


#: Entries of an array that is read whole if it lies in several files.
WHOLE = 1 << 22


def _flat(uri: str, kind: type, mapped: bool = True) -> np.ndarray:
    fs, path = filesystem(uri)
    if mapped and fs.type_name == "local":
        return np.memmap(path, kind, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


class Sorted:
    """Sorted keys and their values, in one or more ranges."""

    def __init__(self, files: list[tuple], kind: type):
        files = sorted(files, key=lambda f: f[2])
        if 1 < len(files) and sum(rows for _, rows, _ in files) <= WHOLE:  # a few MB: one array instead of many maps
            keys, values = (np.concatenate([_flat(f"{file}.{end}", t, False) for file, _, _ in files]) for end, t in (("key", kind), ("value", np.float32)))
            self.first, self.ranges = np.array([files[0][2]], np.int64), [(keys, values)]
        else:
            self.first = np.array([f[2] for f in files], np.int64)
            self.ranges = [(_flat(f"{file}.key", kind), _flat(f"{file}.value", np.float32)) for file, _, _ in files]
        self.kind = kind

    def __len__(self) -> int:
        return sum(len(keys) for keys, _ in self.ranges)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, float]:
        """Which of the keys are there, and the sum of their values."""
        key = key.astype(self.kind)
        hit, total = np.zeros(len(key), bool), 0.0
        own = np.searchsorted(self.first, key, "right") - 1 if len(self.ranges) > 1 else None
        for i, (keys, values) in enumerate(self.ranges):
            here = slice(None) if own is None else np.flatnonzero(own == i)
            some = key[here]
            if len(some):
                at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
                found = keys[at] == some
                hit[here] = found
                total += float(values[at[found]].sum(dtype=np.float64))
        return hit, total


@functools.lru_cache(maxsize=6)
def _arrays(folder: str, lang: str) -> list[tuple[Sorted, Sorted]]:
    """A language's probabilities and back-off weights of each order (from one)."""
    import pyarrow.dataset as ds

    def read(name: str, size: int) -> Sorted:
        fs, path = filesystem(f"{folder}/{name}.files")
        files = ds.dataset(path, filesystem=fs, format="parquet").to_table(filter=ds.field("lang") == lang)
        return Sorted(list(zip(*(files.column(c).to_pylist() for c in ("file", "rows", "first")))), key_type(size)[1])

    return [(read(f"p{n}", n), read(f"g{n}", n - 1)) for n in range(1, ORDER + 1)]


def bits(raw: bytes, model: list[tuple[Sorted, Sorted]]) -> float:
    """Bits of a whole text under the model."""
    total, step = 0.0, 1 << 20
    every = grams(raw)
    for i in range(0, len(every), step):
        left = every[i : i + step]
        for n in range(ORDER, 0, -1):
            probs, weights = model[n - 1]
            gram = left & np.uint64((1 << 8 * n) - 1)
            hit, some = probs.find(gram)
            total -= some
            left, gram = left[~hit], gram[~hit]
            if not len(left):
                break
            total -= weights.find(gram >> np.uint64(8))[1]
        total += 8.0 * len(left)
    return total


#: Columns that measure() adds, and the names they have in op4's result.
MEASURES = {"quality_n_words": "n_words", "quality_word_chars": "word_chars", "quality_n_symbols": "n_symbols", "quality_n_dup_lines": "n_dup_lines", "quality_n_repeat_words": "n_repeat_words", "quality_bits": "bits"}


def measure(docs: DataFrame, folder: str, keep: list[str]) -> DataFrame:
    """documents(text, lang, ...) -> the columns ``keep`` as they are, quality_lang, quality_hash (of the text), and MEASURES."""
    small_batches(docs.sparkSession)
    kept = docs.select(*keep, F.col("text").alias("quality_text"), F.coalesce("lang", F.lit("")).alias("quality_lang"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("quality_hash"))
    schema = T.StructType([*kept.drop("quality_text").schema.fields, *[T.StructField(x, T.DoubleType() if x == "quality_bits" else T.LongType()) for x in MEASURES]])
    names = [f.name for f in schema.fields]

    def look(batches):
        for batch in batches:
            for part in rows_of(batch, 8 << 20, "quality_text"):
                texts = [x or "" for x in pylist(part, "quality_text")]
                rows = [base(x) for x in texts]
                langs, rate = pylist(part, "quality_lang"), [None] * len(texts)
                for i in sorted(range(len(texts)), key=langs.__getitem__):  # a language's arrays are loaded once a part
                    if rows[i][0]:
                        rate[i] = bits(texts[i].encode(), _arrays(folder, langs[i])) / rows[i][0]
                counts = [pa.array(c, pa.int64()) for c in zip(*rows)]
                part = part.drop_columns(["quality_text"])
                yield pa.RecordBatch.from_arrays([*part.columns, *counts, pa.array(rate, pa.float64())], names)

    return kept.mapInArrow(look, schema)


def judge(docs: DataFrame, keep: list[str], fence: float = FENCE) -> DataFrame:
    """documents(text, lang, ...) -> the columns ``keep``, quality_lang, MEASURES, quality_base_failed, quality_kept."""
    folder = shared_dir(docs.sparkSession, "model")
    build_model(docs, folder)
    words = F.col("quality_n_words")
    failed = (words < LEAST_WORDS) | (100 * F.col("quality_n_repeat_words") > MOST_REPEATED * words)
    rows = materialize(measure(docs, folder, keep).withColumn("quality_base_failed", failed), "quality")
    rows = rows.withColumn("quality_class", F.floor(F.log2(F.greatest(words, F.lit(1)))).cast("int"))
    by = ["quality_lang", "quality_class"]
    texts = rows.where("not quality_base_failed and quality_bits > 0").groupBy(*by, F.floor(F.log("quality_bits") / BIN).alias("bin"), "quality_hash").agg(F.count("*").alias("copies"))
    texts = materialize(texts, "quality-texts")
    bins = materialize(texts.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum("copies").alias("rows")), "bins")
    sizes = bins.groupBy(*by).agg(F.sum("rows").alias("rows")).where(F.col("rows") >= CLASS_ROWS)
    # at most 1 / LEARNT texts a class
    learnt = texts.join(small_side(sizes, "quality-sizes"), by).where(F.col("copies") >= LEARNT * F.col("rows")).select(*by, "quality_hash", F.lit(True).alias("quality_learnt"))

    def quartiles(t: DataFrame, *by: str) -> DataFrame:
        t = t.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
        whole = Window.partitionBy(*by)
        t = t.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("all", F.sum("n").over(whole))
        return t.groupBy(*by).agg(F.max("all").alias("n"), *[F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin") * BIN)).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))])

    classes = quartiles(bins, *by).where(F.col("n") >= CLASS_ROWS).select(*by, F.struct("q1", "q3").alias("quality_own"))
    langs = quartiles(bins, "quality_lang").select("quality_lang", F.struct("q1", "q3").alias("quality_all"))
    # a row a language, or a language and length class
    rows = rows.join(small_side(langs, "quality-langs"), "quality_lang", "left").join(small_side(classes, "quality-classes"), by, "left")
    rows = rows.join(small_side(learnt, "quality-learnt"), [*by, "quality_hash"], "left")
    band = F.coalesce("quality_own", "quality_all")
    width = F.greatest(band["q3"] - band["q1"], F.lit(BIN)) * fence
    value = F.log("quality_bits")
    inside = ((value >= band["q1"] - width) | F.col("quality_learnt").isNotNull()) & (value <= band["q3"] + width)
    return rows.select(*keep, "quality_lang", *MEASURES, "quality_base_failed", (~F.col("quality_base_failed") & F.coalesce(inside, F.lit(False))).alias("quality_kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with their columns."""
    whole = docs.select("text", "lang", F.struct(*docs.columns).alias("quality_doc"))  # names of docs meet none of ours
    return judge(whole, ["quality_doc"]).where("quality_kept").select("quality_doc.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "documents"), ["doc_id"])
    return judged.select("doc_id", *[F.col(a).alias(b) for a, b in MEASURES.items()], F.col("quality_base_failed").alias("base_failed"), F.col("quality_kept").alias("kept"))
