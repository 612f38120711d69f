"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document gets a rate r = min(cap, exp(lambda * size / scale)): of all rates under the cap that meet the
source's token target, those of least relative entropy to taking every document once. The dual variable
lambda of each source is found by safeguarded Newton steps; a step is one aggregation of the histogram
(source, size, documents), which is exact and smaller than the corpus. Rates become whole copies by a
common shift per source: document i gains its first copy where the shift reaches 1 - r - u, its second one
later, with u from a hash of its id. The shift whose taken words come nearest the target is read from a
histogram of these points, so that no window ever holds a source's documents.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placewise.llm.common import WORD, forget, save, table

WEIGHTS, SHARE, CAP = (5.0, 2.0, 1.0), 1.5, 2
#: Steps of the shift between a document's first and second copy.
BINS = 4096
#: Newton stops where every source's expected words are this near their target, as a share of it.
TOLERANCE, MOST_STEPS = 1e-9, 60
#: Per-source tables of up to so many bytes are broadcast (ROW_BYTES a row and the source's name); larger ones are joined by a shuffle.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def _key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last."""
    return F.when(source.isNull(), "z").otherwise(F.concat(F.lit("s"), source))


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """key, source_size -> with target: shares of the total by weight, none above cap times its size, the excess reshared."""
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy("key")) - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy()
    by_ratio = Window.orderBy("_ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        sizes.withColumn("_w", weight)
        .withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumns({"_total": F.sum("source_size").over(every) * F.lit(share), "_all": F.sum("_w").over(every)})
        .withColumns({"_rank": F.row_number().over(Window.orderBy("_ratio", "key")), "_capped": F.coalesce(F.sum("_cap").over(by_ratio), F.lit(0.0)), "_gone": F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0))})
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_all") - F.col("_gone")))
        .withColumn("_free", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_rank", "_level"))).over(every))
        .withColumn("target", F.when(F.col("_free").isNull() | (F.col("_rank") < F.col("_free._rank")), F.col("_cap")).otherwise(F.col("_w") * F.col("_free._level")))
        .select("key", "source_size", "target")
    )


def _rate(lam: Column, size: Column, scale: Column, cap: float) -> Column:
    x = F.when(scale > 0, lam * size / scale).otherwise(F.lit(0.0))
    return F.least(F.lit(float(cap)), F.exp(F.least(x, F.lit(math.log(cap) + 1e-9))))


def balance(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, int]:
    """From rows (key, doc_id, size): a row for each source with source_size, target, lam, scale, full and shift; and the bytes of a table of the sources."""
    hist = save(sizes.groupBy("key", "size").agg(F.count("*").alias("n")))
    totals = hist.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("_squares"))
    scale = totals.select("key", F.when(F.col("source_size") > 0, F.round(F.col("_squares") / F.col("source_size"), 6)).otherwise(F.lit(0.0)).alias("scale"))
    state = source_targets(totals.select("key", "source_size"), weights, share, cap).join(scale, "key")
    full = (F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * F.lit(float(cap)) * F.lit(1 - 1e-9))
    state = save(state.withColumns({"full": full, "lam": F.lit(0.0), "lo": F.lit(-math.inf), "hi": F.lit(math.inf), "error": F.when(full, 0.0).otherwise(1.0)}))
    size = state.agg(F.sum(F.octet_length("key") + ROW_BYTES)).first()[0] or 0
    for _ in range(MOST_STEPS):
        if not state.agg(F.max("error")).first()[0] or state.where(F.col("error") > TOLERANCE).isEmpty():
            break
        rate = _rate(F.col("lam"), F.col("size"), F.col("scale"), cap)
        words = F.col("n") * F.col("size") * rate
        sums = (
            hist.join(_small(state.where(F.col("error") > TOLERANCE).select("key", "lam", "scale"), size), "key")
            .groupBy("key").agg(F.sum(words).alias("_f"), F.sum(F.when(rate < cap, words * F.col("size") / F.col("scale")).otherwise(0.0)).alias("_slope"))
        )
        gap = F.col("_f") - F.col("target")
        stepped = (
            state.join(_small(sums, size), "key", "left")
            .withColumn("_busy", F.col("_f").isNotNull())
            .withColumns({"lo": F.when(F.col("_busy") & (gap <= 0), F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("_busy") & (gap > 0), F.col("lam")).otherwise(F.col("hi"))})
            .withColumn("error", F.when(F.col("_busy"), F.abs(gap) / F.col("target")).otherwise(F.col("error")))
            .withColumn("_newton", F.when(F.col("_slope") > 0, F.col("lam") - gap / F.col("_slope")))
            .withColumn("_safe", F.when(F.col("lo") == -math.inf, F.least(F.col("hi") * 2, F.col("hi") - 1)).when(F.col("hi") == math.inf, F.greatest(F.col("lo") * 2, F.col("lo") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2))
            .withColumn("_next", F.when((F.col("_newton") > F.col("lo")) & (F.col("_newton") < F.col("hi")), F.col("_newton")).otherwise(F.col("_safe")))
            .withColumn("lam", F.when(F.col("_busy") & (F.col("error") > TOLERANCE), F.col("_next")).otherwise(F.col("lam")))
            .select("key", "source_size", "target", "scale", "full", "lam", "lo", "hi", "error")
        )
        before, state = state, save(stepped)
        forget(before)
    forget(hist)
    params = state.select("key", "source_size", "target", F.round("lam", 9).alias("lam"), "scale", "full")
    # where the shift is: words gained up to each bin, once for first copies and once for each later one
    first = sizes.join(_small(params, size), "key").groupBy("key", _bin(cap).alias("bin")).agg(F.sum("size").alias("w"))
    points = first.select("key", F.explode(F.array(*[F.struct((F.col("bin") + F.lit(i * BINS)).alias("bin"), F.col("w").alias("w")) for i in range(cap)])).alias("p")).groupBy("key", "p.bin").agg(F.sum("p.w").alias("w"))
    reached = F.sum("w").over(Window.partitionBy("key").orderBy("bin"))
    # "none taken" is a choice too: a shift before the first point
    none = params.select("key", F.lit(-(1 << 40)).alias("bin"), F.lit(0).cast("long").alias("w"))
    choice = (
        points.select("key", F.col("bin").cast("long").alias("bin"), "w").unionByName(none).withColumn("_sum", reached).join(_small(params.select("key", "target"), size), "key")
        .groupBy("key").agg(F.min(F.struct(F.abs(F.col("_sum") - F.col("target")).alias("off"), F.col("bin").alias("bin"))).alias("best"))
        .select("key", F.col("best.bin").alias("shift"))
    )
    done = save(params.join(_small(choice, size), "key"))
    forget(state)
    return done, size


def _bin(cap: int) -> Column:
    u = F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("lam"), F.col("size"), F.col("scale"), cap))
    return F.floor((F.lit(1.0) - rate - u) * BINS).cast("long")


def _copies(cap: int) -> Column:
    first = _bin(cap)
    return sum([F.when(first + i * BINS <= F.col("shift"), 1).otherwise(0) for i in range(cap)], F.lit(0)).cast("long")


def mix_counts(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken (words the mix takes of it).

    A null source is a source of its own, sorted last. A null or blank text has size 0 and takes 0 words. Rows
    that repeat a doc_id share its number of copies. An empty table gives an empty result. Other columns don't
    matter.
    """
    sizes = save(docs.select(_key(F.col("source")).alias("key"), "doc_id", n_words(F.col("text")).alias("size")))
    params, size = balance(sizes, weights, share, cap)
    return sizes.join(_small(params, size), "key").select("doc_id", "size", "source_size", "target", (F.col("size") * _copies(cap)).alias("taken"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """The documents themselves, each as often as the mix takes it. Documents without words add nothing and go."""
    columns = docs.columns
    keyed = docs.select(F.struct(*[docs[c] for c in columns]).alias("_doc"), docs["doc_id"].alias("doc_id"), _key(docs["source"]).alias("key"), n_words(docs["text"]).alias("size"))
    sizes = save(keyed.select("key", "doc_id", "size"))
    params, size = balance(sizes, weights, share, cap)
    taken = keyed.join(_small(params, size), "key").withColumn("_n", F.when(F.col("size") > 0, _copies(cap)).otherwise(0).cast("int")).where("_n > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).select("_doc.*")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
