"""Toxicity: gradient-boosted trees over dense features of a text, with isotonic calibration.

The lexicon (words and word beginnings with the log-odds by which toxic texts use them more, at the
lower end of their confidence interval) is counted in Spark over one half of the labelled rows; trees and calibration
are fitted on the driver to the features of the other half, so no row weighs its own words. Labels,
language, source and doc_id are no inputs of a score. At most about ``ROWS`` labelled rows (chosen
by a hash of the doc_id) are learned from; every document is scored, over its whole text.

Nulls: a null text is the empty text; rows of ``labels`` with a null toxic or doc_id are not learned
from; a document with a null doc_id is scored, its doc_id's text being empty. Repeated documents get equal scores.
Without labels of both kinds every score is the labelled share of toxic rows (0 if there are none).
No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, pylist, rows_of, table, text_rows
from .trees import Calibrated

#: Labelled rows learned from, and terms of the lexicon.
ROWS, TERMS = 30_000, 4000
CUTOFF = 0.7
#: Second-person words in English, German, French and Spanish; fixed values.
YOU = frozenset("you your yours yourself u ur ya du dich dir dein deine deinen deiner ihr euch euer sie tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros os".split())
#: Characters that stand for letters; fixed values.
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"})
NEAR = 5
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_RUN = re.compile(r"(.)\1\1")
_CACHE = 200_000


def word_terms(word: str) -> list[str]:
    """The terms of a bare lower-case word: itself, and its beginnings of four to six letters."""
    return [word, *(f"{word[:k]}*" for k in (4, 5, 6) if len(word) > k)]


def bare(word: str) -> str:
    return _EDGE.sub("", word.lower())


class Words:
    """Attributes of words, a row a word, kept in a bounded cache.

    Columns: lexicon weight, strong, obfuscated, second person, capitals, punctuation, exclamations, odd spelling, length.
    """

    WIDTH = 9

    def __init__(self, lexicon: dict[str, float], strong: float = 2.0):
        self.lexicon, self.strong, self.row = lexicon, strong, {}
        self.table = np.zeros((_CACHE + 1, self.WIDTH), np.float32)

    def look(self, raw: str) -> tuple:
        word = bare(raw)
        weight = max((self.lexicon.get(x, 0.0) for x in word_terms(word)), default=0.0) if word else 0.0
        plain, hidden = weight, 0.0
        if weight < self.strong and not raw.isalpha():
            letters = re.sub(r"[\W_\d]", "", raw.lower().translate(LEET))
            if letters != word and len(letters) > 3:
                hidden = max(self.lexicon.get(x, 0.0) for x in word_terms(letters))
        marks = sum(not c.isalnum() for c in raw)
        odd = bool(_RUN.search(word)) or (any(c.isdigit() for c in word) and any(c.isalpha() for c in word))
        return (max(plain, hidden), max(plain, hidden) >= self.strong, hidden >= self.strong, word in YOU, len(word) > 1 and raw.isupper(), marks, raw.count("!"), odd, len(raw))

    def rows(self, words: list[str]) -> np.ndarray:
        """Attributes of the words of a text; what the cache has no room for is looked up again."""
        row, get = self.row, self.row.get
        if fresh := set(words).difference(row):
            if len(row) + len(fresh) > _CACHE:
                row.clear()
            for x in list(fresh)[:_CACHE]:
                self.table[len(row)] = self.look(x)
                row[x] = len(row)
        at = np.fromiter((get(x, -1) for x in words), np.int64, len(words))
        out = self.table[at]
        for i in np.flatnonzero(at < 0):
            out[i] = self.look(words[i])
        return out


FEATURES = 17


def features(text: str, words: Words) -> np.ndarray:
    found = text.split()
    if not found:
        return np.zeros(FEATURES)
    a = words.rows(found).astype(np.float64)
    n = len(found)
    weight, strong, hidden, you, caps, marks, cries, odd, size = a.T
    hits, persons = np.flatnonzero(strong), np.flatnonzero(you)
    near = 0
    if len(hits) and len(persons):
        i = np.searchsorted(persons, hits)
        gap = np.minimum(np.abs(hits - persons[np.maximum(i - 1, 0)]), np.abs(persons[np.minimum(i, len(persons) - 1)] - hits))
        near = int((gap <= NEAR).sum())
    top = np.sort(weight)[::-1][:5]
    return np.array([np.log1p(n), strong.sum() / n, np.log1p(strong.sum()), weight.sum() / n, top[0], top.mean(), np.log1p((weight > 1).sum()), (weight > 4).sum() / n, hidden.sum() / n, you.sum() / n, near / n, np.log1p(near), caps.sum() / n, marks.sum() / size.sum(), cries.sum() / n, odd.sum() / n, size.mean()])


def _held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, rows: int = ROWS, terms: int = TERMS):
    """(lexicon, model): the model is a Calibrated, or the share of toxic rows where only one kind is labelled."""
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).withColumn("part", _held_out()).where("part <> 1")
    known = materialize(known, "labels")
    total = max(known.count(), 1)
    # a bounded sample: about ``rows`` of them
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(min(1.0, rows / total) * (1 << 20)))
    # a repeated doc_id is learned from once, by its first text
    texts = text_rows(docs, "doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic", "part").agg(F.min("text").alias("text"))
    texts = materialize(texts, "labelled")

    def count(batches):
        got: dict[str, list[int]] = {}
        for batch in batches:
            for part in rows_of(batch):
                for text, toxic in zip(pylist(part, "text"), pylist(part, "toxic")):
                    kind = 1 if toxic else 0
                    for term in {t for w in {bare(x) for x in set(text.split())} if w for t in word_terms(w)} | {""}:
                        got.setdefault(term, [0, 0])[kind] += 1
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array([v[1] for v in got.values()], pa.int64()), pa.array([v[0] for v in got.values()], pa.int64())], ["term", "toxic", "clean"])

    counts = materialize(texts.where("part = 0").mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic >= 3 or term = ''"), "terms")
    ends = counts.where("term = ''").collect()
    t, c = (ends[0]["toxic"], ends[0]["clean"]) if ends else (0, 0)
    odds = F.log((F.col("toxic") + 0.5) / (t + 1)) - F.log((F.col("clean") + 0.5) / (c + 1)) - 2 * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    best = counts.where("term <> ''").withColumn("weight", odds).where("weight >= 1").orderBy(F.desc("weight"), "term").limit(terms)
    lexicon = {r["term"]: float(r["weight"]) for r in best.select("term", "weight").collect()}

    def measure(batches):
        words = Words(lexicon)
        for batch in batches:
            for part in rows_of(batch):
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(pylist(part, "toxic"), pa.int32()), pa.array([features(x, words).tolist() for x in pylist(part, "text")], pa.list_(pa.float64()))], ["doc_id", "toxic", "x"])

    got = texts.where("part = 2").mapInArrow(measure, "doc_id long, toxic int, x array<double>").collect()
    got.sort(key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([1.0 if r["toxic"] else 0.0 for r in got])
    folds = [y[np.arange(len(y)) % 3 != k] for k in range(3)]
    if any(not 0 < f.sum() < len(f) for f in folds):
        return lexicon, float(y.mean()) if len(y) else 0.0
    return lexicon, Calibrated(x, y)


def score(docs: DataFrame, lexicon: dict[str, float], model) -> DataFrame:
    """documents(doc_id, text) -> doc_id, score."""

    def judge(batches):
        words = Words(lexicon)
        for batch in batches:
            for part in rows_of(batch, 8 << 20):
                x = np.array([features(t, words) for t in pylist(part, "text")]).reshape(-1, FEATURES)
                p = np.full(len(x), model) if isinstance(model, float) else model.predict(x)
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(np.clip(p, 0.0, 1.0), pa.float64())], ["doc_id", "score"])

    return text_rows(docs, "doc_id", "text").mapInArrow(judge, "doc_id long, score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, *learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (_held_out() == 1).alias("held_out"), "score", (F.col("score") >= CUTOFF).cast("int").alias("predicted"))
