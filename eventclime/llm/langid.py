"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Three steps: inverse document frequencies of hashed character 1- to 3-grams
over all training documents; weights by follow-the-regularised-leader
(FTRL-proximal, elastic net) on a bounded, stratified sample; a temperature
that calibrates the probabilities on documents the weights have not seen.
Term frequencies are relative, so a text's logits are the mean of its
n-grams' rows in one (buckets x languages) table: a prediction reads the text
once, whatever its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
SAMPLE_PER_LANG = 1500      # bound of the labelled sample, by language
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 0.1, 0.02, 0.01
SCALE = 10.0                # term frequencies are shares times this
UNKNOWN = "und"
BLOCK = 1 << 20             # code points worked on at once
_TOP = (1 << 63) - 1
_MULT = [np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)]


def ngram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of the 1-, 2- and 3-grams of the lower-cased text between two
    spaces, in blocks (each block carries the two characters before it)."""
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), "<u4")
    for s in range(0, len(code), BLOCK):
        part = code[max(0, s - 2):s + BLOCK]
        lead = s - max(0, s - 2)
        a = part * _MULT[0]
        b = (a[:-1] ^ (a[:-1] >> np.uint32(15))) * _MULT[1] + a[1:]
        c = (b[:-1] ^ (b[:-1] >> np.uint32(13))) * _MULT[2] + a[2:]
        grams = [a[lead:], b[max(0, lead - 1):], c[max(0, lead - 2):]]
        yield np.concatenate([((g ^ (g >> np.uint32(16))) * _MULT[1]) >> np.uint32(32 - BUCKETS_LOG2) for g in grams])


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _counts(text: str) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for part in ngram_buckets(text):
        out += np.bincount(part, minlength=BUCKETS)
    return out


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(BUCKETS, np.int64), 0
    for b in batches:
        for t in b.column(0):
            if has_letter(text := t.as_py()):
                df += _counts(text) > 0
                n += 1
    if n:
        at = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], ["bucket", "df"])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that have each bucket, and all documents with a letter.  At
    most one row per bucket reaches the driver."""
    rows = texts.mapInArrow(_document_frequencies, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"].to_numpy(np.int64)] = rows["df"].to_numpy(np.int64)
    return df[:BUCKETS], int(df[-1])


def sample(train: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """About ``per_lang`` rows of each language, by a hash of the id (the same
    rows every time; all rows of a language that has no more)."""
    sizes = {r[0]: r[1] for r in train.groupBy("lang").count().collect()}
    if not sizes:
        return train.limit(0)
    part = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 1)     # 63 bits: the rate is never rounded to 0
    limit = F.lit(0).cast("long")
    for lang, n in sizes.items():
        limit = F.when(F.col("lang") == lang, F.lit(min(_TOP, int(per_lang / n * 2 ** 63))).cast("long")).otherwise(limit)
    return train.where(part <= limit)


class Ftrl:
    """FTRL-proximal for a softmax over sparse rows, with elastic net."""

    def __init__(self, classes: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = _softmax(x @ w)
        p[y] -= 1
        g = x[:, None] * p
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _softmax(v: np.ndarray) -> np.ndarray:
    e = np.exp(v - v.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: pd.DataFrame, idf: np.ndarray, epochs: int = EPOCHS) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, bucket table idf x weight, bias, temperature) from the
    sample (text, lang, calibrate, order)."""
    rows = rows.sort_values(["order", "text"], kind="stable")
    langs = sorted(rows["lang"].unique())
    data = []
    for text, lang, calibrate in zip(rows["text"], rows["lang"], rows["calibrate"]):
        count = _counts(text)
        at = np.nonzero(count)[0]
        x = count[at] * (SCALE / count.sum()) * idf[at]
        data.append((np.append(at, BUCKETS), np.append(x, 1.0), langs.index(lang), calibrate))
    model = Ftrl(len(langs))
    fit = [d for d in data if not d[3]] or data
    for _ in range(epochs):
        for at, x, y, _c in fit:
            model.learn(at, x, y)
    w = model.weights()
    held = [d for d in data if d[3]] or data
    logits = np.array([x @ w[at] for at, x, _y, _c in held])
    right = np.array([y for _, _, y, _c in held])

    def loss(t):
        p = _softmax(logits / t)[np.arange(len(right)), right]
        return -np.log(np.maximum(p, 1e-12)).mean()

    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 241))
    return langs, (w[:-1] * idf[:, None] * SCALE).astype(np.float32), w[-1], float(grid[np.argmin([loss(t) for t in grid])])


def _predict(langs, table, bias, temperature):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = table.value
        for b in batches:
            names, scores = [], []
            for t in b.column(0):
                text = t.as_py()
                if not langs or not has_letter(text):
                    names.append(UNKNOWN), scores.append(0.0)
                    continue
                total, n = np.zeros(len(langs)), 0
                for part in ngram_buckets(text):
                    total += w[part].sum(axis=0, dtype=np.float64)
                    n += len(part)
                p = _softmax((total / n + bias) / temperature)
                names.append(langs[k := int(p.argmax())]), scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*b.schema.names[1:], "lang_pred", "score"])
    return run


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """One row per document: doc_id, training, lang_pred, score.

    ``training`` marks the rows that may be learned from (null: not); of these
    the rows with a language and a letter in their text are used.  Null texts
    and texts without a letter get ``und`` with score 0, and so does every
    text if there is nothing to learn from.  Repeated rows are predicted alike
    and counted as often as they occur.  An empty table gives no rows; other
    columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"),
                       F.col(lang_col).alias("lang"))
    learn = rows.where("training and lang is not null and text is not null")
    df, n = document_frequencies(learn.select("text"))
    langs, table, bias, temperature = [], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0
    if n:
        idf = np.log((1 + n) / (1 + df)) + 1
        bit = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0
        picked = sample(learn, per_lang).select("text", "lang", bit.alias("calibrate"), F.xxhash64("doc_id", F.lit("order")).alias("order")).toPandas()
        picked = picked[picked["text"].map(has_letter)]
        if len(picked):
            langs, table, bias, temperature = train(picked, idf)
    shared = spark.sparkContext.broadcast(table)     # buckets x languages: bounded
    return rows.drop("lang").mapInArrow(_predict(langs, shared, bias, temperature),
                                        f"doc_id {dict(rows.dtypes)['doc_id']}, training boolean, lang_pred string, score double")
