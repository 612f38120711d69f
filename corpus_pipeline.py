"""The corpus pipeline: language ID, quality, near-duplicates, mixing, packing, one after the other.

Each stage takes the documents that the one before kept and returns documents with the same columns, whatever these
are; the last returns the places of their pieces in token sequences. No stage fails on nulls in any column, on empty
texts or on an empty table, which gives an empty result. A document needs the columns doc_id, text, lang and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placewise.llm import dedup, langid, mixing, packing, quality
from placewise.llm.common import fold, forget, fresh, save, table

#: Documents in no known language go, and those whose language is less probable than this.
LANGUAGE_FROM = 0.5

#: Names of rows whose id is null or repeated are hashes from here on, so that ids of one row go first.
NAMED_FROM = 1 << 62

#: Words whose ids a packing worker keeps: workers hold them beside what the other stages need.
WORDS_KEPT = 400_000


def _whole_rows(docs: DataFrame) -> tuple[DataFrame, str]:
    """A column with all of a row, and the text beside it."""
    row = fresh("_doc", ["text"])
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), docs["text"].alias("text")), row


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter (null texts too) and those whose language is less probable than LANGUAGE_FROM.

    Learns from rows with text and lang outside of fold 0 of 5; if there is none, no language is known and all
    documents go. Repeated rows share a result.
    """
    model = langid.train(docs, fold("doc_id", 5) != 0)
    held, row = _whole_rows(docs)
    return langid.predict(held, model).where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_FROM)).select(f"{row}.*")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier predicts 0. A null text is judged as the empty one.

    Learns from the labels of these documents outside of fold 2 of 4; without labels of both kinds the net gives
    their share, and with no label at all it can reject nothing: every document stays. Repeated rows share a result.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = quality.train(docs, labels, fold("doc_id", 4) != 2)
    if net.blank:
        return docs
    held, row = _whole_rows(docs)
    return quality.predict(held, net).where("predicted = 1").select(f"{row}.*")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, of those whose id no other row has the one of least id.

    Texts without words link with nothing and stay. What counts is the row: where ids are null or repeated, rows that
    differ in id or text are documents of their own (named by a hash), and of rows alike in both one stays.
    """
    ids = docs.select("doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    row = fresh("_doc", ["doc_id", "text", "n"])
    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias(row), docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    again = save(ids.select(F.col("doc_id").cast("long").alias("again"), F.lit(True).alias("n")))
    repeated = not again.isEmpty()
    if repeated:
        hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.coalesce("doc_id", F.lit(0)), "text"), 2) + F.lit(NAMED_FROM)
        named = F.when(F.col("n"), hashed).otherwise(F.col("doc_id"))
        held = save(held.join(again, F.col("doc_id").eqNullSafe(F.col("again")), "left").select(row, named.alias("doc_id"), "text"))
    gone = dedup.near_duplicates(held.select("doc_id", "text")).where("NOT kept").select("doc_id").distinct()
    kept = held.join(gone, "doc_id", "left_anti")
    if repeated:  # rows alike in id and text have one name, and so one of them stays
        kept = kept.groupBy("doc_id").agg(F.first(row).alias(row))
    return kept.select(f"{row}.*")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (0 to 2 times); documents without words add nothing and go. A null
    source is one of its own; rows that repeat an id share their number of copies."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Copies are packed each on its own; a
    null text is one piece that holds the end id alone."""
    return packing.pack(docs.select("doc_id", "text"), packing.tokenizer_path(), words_kept=WORDS_KEPT)


STAGES = [
    ("language ID", language_stage),
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", dedup_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Trained models and Newton iterations have no SQL; tests/llm/test_pipeline.py holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
