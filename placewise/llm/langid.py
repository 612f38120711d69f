"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed character n-grams of orders 1 to 3 of the whole lower-cased text; an n-gram's value is its
share of the text's n-grams of that order times its inverse document frequency, counted over all training
documents. The weights are trained by follow-the-regularised-leader (FTRL-proximal) with elastic-net penalties
on a bounded sample of labelled rows, then a temperature is fitted on rows of the sample that training left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.llm.common import STEP_BYTES, fold, forget, fresh, least_hashed, save, table, within_bytes

ORDERS = (1, 2, 3)
#: Hashed features of each order.
BUCKETS = 1 << 15
#: Most labelled rows that the weights are trained on (their document frequencies come from all training rows).
SAMPLE = 3000
#: Rows of each language that are in the sample at least, where it has so many; and bytes of the sample's vectors at most.
LEAST_ROWS, SAMPLE_BYTES = 50, 256 << 20
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.01
UNKNOWN = "und"
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def grams(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order: its number, the hashed n-grams of all texts end to end, and first and end position of each text's."""
    padded = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(p) for p in padded])
    starts = ends - [len(p) for p in padded]
    for k, order in enumerate(ORDERS):
        n = max(0, len(points) - order + 1)
        h = np.full(n, order, np.uint32)
        for i in range(order):
            h = (h ^ points[i : i + n]) * _MULTIPLY[i]
            h ^= h >> np.uint32(15)
        yield k, (h & np.uint32(BUCKETS - 1)).astype(np.int32), starts, np.maximum(starts, ends - order + 1)


def _text_steps(texts: list[str]) -> Iterator[tuple[int, int]]:
    i, held = 0, 0
    for j, t in enumerate(texts):
        if j > i and held + len(t) > STEP_BYTES // 2:
            yield i, j
            i, held = j, 0
        held += len(t)
    if i < len(texts):
        yield i, len(texts)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a partition: documents, and how many hold each feature."""
    df, n, seen = np.zeros(len(ORDERS) * BUCKETS, np.int64), 0, np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        n += len(texts)
        for i, j in _text_steps(texts):
            for k, h, starts, ends in grams(texts[i:j]):
                for a, b in zip(starts, ends, strict=True):
                    own = h[a:b]
                    at = np.arange(len(own))
                    seen[own] = at
                    df[own[seen[own] == at] + k * BUCKETS] += 1
    if n:
        nz = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(nz, -1), pa.int32()), pa.array(np.append(df[nz], n), pa.int64())], ["feature", "n"])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, lang, text. Features and term frequencies of each row in place of its text."""
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            ids, tfs = [], []
            for k, h, starts, ends in grams([text]):
                own, n = np.unique(h[starts[0] : ends[0]], return_counts=True)
                ids.append(own + k * BUCKETS)
                tfs.append(n / max(1, n.sum()))
            out.append((np.concatenate(ids).astype(np.int32).tobytes(), np.concatenate(tfs).astype(np.float32).tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array([r[k] for r in out], pa.binary()) for k in (0, 1)]], ["doc_id", "lang", "ids", "tf"])


@dataclass
class Model:
    classes: list[str]
    #: features x classes, inverse document frequencies multiplied in
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def scores(self, texts: list[str]) -> np.ndarray:
        logits = np.tile(self.bias, (len(texts), 1)).astype(np.float64)
        for k, h, starts, ends in grams(texts):
            table = self.weights[k * BUCKETS : (k + 1) * BUCKETS]
            for c in range(len(self.classes)):
                sums = np.concatenate(([0.0], np.cumsum(table[h, c], dtype=np.float64)))
                logits[:, c] += (sums[ends] - sums[starts]) / np.maximum(1, ends - starts)
        return softmax(logits / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_features: int, n_classes: int, epochs: int, seed: int = 7) -> np.ndarray:
    """FTRL-proximal for softmax regression; rows: features, values, class. Returns features x classes, sparse by L1."""
    z, s = np.zeros((n_features, n_classes)), np.zeros((n_features, n_classes))

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(s[ids])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            ids, values, label = rows[r]
            w = weights(ids)
            p = softmax(values @ w)
            p[label] -= 1
            g = values[:, None] * p[None, :]
            z[ids] += g - (np.sqrt(s[ids] + g * g) - np.sqrt(s[ids])) / ALPHA * w
            s[ids] += g * g
    return weights(np.arange(n_features))


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section over its logarithm."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        top = x.max(axis=1)
        return float(np.mean(np.log(np.exp(x - top[:, None]).sum(axis=1)) + top - x[np.arange(len(labels)), labels]))

    a, b, r = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def least_of_each(known: DataFrame, size: int, salts: int = 256) -> DataFrame:
    """The ids of the size rows of least hash of each language (doc_id, lang), chosen in groups of partitions first."""
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "doc_id"))
    hashed = known.where("doc_id IS NOT NULL").withColumns({"h": F.xxhash64("doc_id"), "salt": F.pmod(F.spark_partition_id(), F.lit(salts))})
    first = hashed.withColumn("place", place("lang", "salt")).where(F.col("place") <= size).drop("place")
    return first.withColumn("place", place("lang")).where(F.col("place") <= size).select("doc_id")


def train(docs: DataFrame, may_learn: Column, sample: int = SAMPLE) -> Model:
    """Fit on the rows of docs (doc_id, text, lang) for which may_learn holds and text and lang aren't null.

    Of rows that repeat an id and a language the least text counts in the sample. Without rows the model knows no
    language. Equal tables give equal models.
    """
    known = docs.where(may_learn & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counted = known.select("text").mapInArrow(_document_frequencies, "feature int, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(ORDERS) * BUCKETS)
    n_docs = int(counted.loc[counted.feature == -1, "n"].sum())
    counted = counted[counted.feature >= 0]
    df[counted.feature.to_numpy()] = counted.n.to_numpy()
    # at most `sample` ids and LEAST_ROWS of each language; ids are drawn first, so that no text moves but those of the sample
    ids = F.broadcast(least_hashed(known.select("doc_id"), sample).unionByName(least_of_each(known.select("doc_id", "lang"), min(sample, LEAST_ROWS))).distinct())
    drawn = known.join(ids, "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    kind = drawn.select("doc_id").schema.simpleString()[7:-1]
    vectors = save(drawn.mapInArrow(_vectors, f"{kind}, lang string, ids binary, tf binary"))
    rows = within_bytes(vectors, F.octet_length("ids") + F.octet_length("tf"), ["lang"], SAMPLE_BYTES).toPandas().sort_values(["lang", "ids", "tf"])
    forget(vectors)
    classes = sorted(rows.lang.unique())
    if not classes:
        return Model([], np.zeros((len(df), 0)), np.zeros(0), 1.0)
    idf = np.log((n_docs + 1) / (df + 1)) + 1
    at = {c: i for i, c in enumerate(classes)}
    bias = len(df)
    data = []
    for r in rows.itertuples():
        ids, tf = np.frombuffer(r.ids, np.int32), np.frombuffer(r.tf, np.float32)
        data.append((np.append(ids, bias), np.append(tf * idf[ids], 1.0), at[r.lang]))
    # a language of few rows learns from all of them
    spare = (rows.groupby("lang").lang.transform("size") >= 5).to_numpy()
    held = [len(data) >= 50 and i % 5 == 0 and bool(spare[i]) for i in range(len(data))]
    aside = [d for d, h in zip(data, held, strict=True) if h]
    w = ftrl([d for d, h in zip(data, held, strict=True) if not h], len(df) + 1, len(classes), EPOCHS)
    temperature = fit_temperature(np.array([v @ w[i] for i, v, _ in aside]).reshape(-1, len(classes)), np.array([c for *_, c in aside], int))
    return Model(classes, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], temperature)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add lang_pred and score to docs; columns of those names are replaced.

    Null texts, and texts without a letter, get `und` with score 0; so does every text if nothing could be learned.
    The score is the calibrated probability of lang_pred; of equal ones the first language by code point is taken.
    Equal texts get equal results, repeated rows are kept; an empty table stays empty.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size: features x classes

    @F.pandas_udf("struct<lang string, score double>")
    def judged(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = sent.value
        for part in parts:
            texts = [t or "" for t in part]
            lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            for i, j in _text_steps(texts) if m.classes else ():
                p = m.scores(texts[i:j])
                best = p.argmax(axis=1)
                lang[i:j], score[i:j] = np.array(m.classes, object)[best], p[np.arange(j - i), best]
            for i, t in enumerate(texts):
                if not any(map(str.isalpha, t)):
                    lang[i], score[i] = UNKNOWN, 0.0
            yield pd.DataFrame({"lang": lang, "score": np.clip(score, 0, 1)})

    name = fresh("_judged", docs.columns)
    out = docs.withColumn(name, judged(F.col(text)))
    return out.withColumns({"lang_pred": F.col(name)["lang"], "score": F.col(name)["score"]}).drop(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold("doc_id", 5) != 0)
    held = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return predict(held, model).drop("text")
