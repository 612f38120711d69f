"""Shared pieces of the training-data operators: scratch tables, folds, Arrow text access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.sources.scratch import shared_dir

#: A word, as every operator here counts it: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on; a longer document forms a step of its own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, k: int) -> Column:
    """crc32 of the id as text, modulo k. A null id falls in fold 0."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(k)


def fresh(name: str, columns: Sequence[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def save(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder as Parquet and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/placewise-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete what save() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.saved_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: A key of more rows than this, and than one in HOT_KEYS of all rows, is hot; so at most HOT_KEYS keys are.
HOT_ROWS, HOT_KEYS = 1000, 10_000


def join_hot(rows: DataFrame, counted: DataFrame, key: str, values: Sequence[str], size: Column, total: int, spread: str) -> DataFrame:
    """rows with the values of their key; those of a key without a row in counted go.

    counted: a row for each key, with the values; size: an expression over it that says how many of all `total` rows
    have the key. The hot keys' values are broadcast, at most HOT_KEYS rows, and their rows dealt by column `spread`,
    so that no key's rows meet in one task. key and spread are longs; values aren't null.
    """
    hot = counted.where(size > max(HOT_ROWS, total // HOT_KEYS)).select(F.col(key).alias("_hot"), *[F.col(v).alias(f"_hot_{v}") for v in values])
    rest = counted.select(F.col(key).alias("_at"), *values)
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = marked.withColumn("_by", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(F.xxhash64(spread)))
    met = dealt.join(rest, F.col("_by") == F.col("_at"), "left")
    known = [F.when(F.col("_hot").isNull(), F.col(v)).otherwise(F.col(f"_hot_{v}")).alias(v) for v in values]
    return met.where(F.col("_hot").isNotNull() | F.col("_at").isNotNull()).select(*rows.columns, *known)


def least_hashed(ids: DataFrame, size: int) -> DataFrame:
    """The size different doc_ids of least hash; null is one. A bound on the hash keeps most ids from being sorted at all."""
    h, n = F.xxhash64("doc_id"), ids.count()
    share = 2 * size / max(1, n)
    drawn = ids.select("doc_id").where(h < F.lit(int(share * 2**64) - 2**63)).distinct() if share < 1 else ids.select("doc_id").distinct()
    if share < 1 and drawn.limit(size).count() < size:  # few ids, often repeated
        drawn = ids.select("doc_id").distinct()
    return drawn.orderBy(h, "doc_id").limit(size)


def within_bytes(rows: DataFrame, size: Column, by: Sequence[str], limit: int) -> DataFrame:
    """Of a bounded sample's rows those that keep it under limit bytes: of each of the groups `by` in turn the one of least
    hash of doc_id."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
    total = F.sum("_size").over(Window.orderBy("_turn", *by).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"_turn": turn, "_size": size}).withColumn("_total", total).where(F.col("_total") <= limit).drop("_turn", "_size", "_total")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes end to end, and the n + 1 bounds of its rows. A null row is empty."""
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, bounds, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def compressed(column: pa.Array, level: int = 1) -> pa.Array:
    """Each text as UTF-8 under zstandard; null counts as empty. Works through few rows at a time."""
    to, out = zstandard.ZstdCompressor(level=level), []
    for i in range(0, len(column), 128):
        out += [to.compress((t or "").encode("utf-8", "surrogatepass")) for t in column.slice(i, 128).to_pylist()]
    return pa.array(out, pa.binary())


def steps(bounds: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes together, or of one longer row."""
    n, i = len(bounds) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_bounds(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and the number of words of each row."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.concatenate(([False], inside[:-1])) if len(data) else np.zeros(0, bool)
    cut = bounds[:-1][bounds[:-1] < len(data)]
    before[cut] = False  # a row's first byte never continues the row before it
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) if len(data) else np.zeros(0, bool)
    ends_at = bounds[1:][bounds[1:] > 0] - 1
    after[ends_at] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, bounds))


_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = max(n, STEP_BYTES + 1)
        _POWERS[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, b, np.uint64)))) for b in (BASE, INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, alike wherever it stands."""
    up, down = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
