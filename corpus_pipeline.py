"""From raw documents to packed training sequences, as stages over tables.

Each stage works on all rows that the one before it kept; between stages the
rows are written as Parquet and read again, so a lost executor costs no more
than the tasks of one stage. Every stage but the last returns the columns of
``documents``, also those a user has added, under whatever name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkloom.llm import decontaminate, ngram_jaccard, packing, quality, secret_scan
from sparkloom.llm.queries import BATCH_ROWS, vocabulary
from sparkloom.session import ensure_importable, materialize, table


def _ready(spark: SparkSession) -> None:
    ensure_importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _apart(docs: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step`` over ``docs`` under numbered column names but for the ones it
    works on, so that none of a user's columns bears a name the step adds."""
    names = {c: c if c in ("doc_id", "text", "n_chars") else f"_{i}" for i, c in enumerate(docs.columns)}
    return step(docs.toDF(*names.values())).select(*(F.col(v).alias(k) for k, v in names.items()))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    _ready(spark)
    return _apart(docs, lambda d: quality.quality_rules(d).where("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, 0.8) the smallest doc_id;
    rows that share it stay together, and rows without one stay, as do null
    and empty texts, which are near nothing."""
    _ready(spark)

    def step(d: DataFrame) -> DataFrame:
        classes = ngram_jaccard.similar_classes(d, k=5, num=80, den=100, count_links=False)
        gone = materialize(classes.where("component_id <> doc_id").select("doc_id").distinct())
        return d.join(gone, "doc_id", "left_anti")

    return _apart(docs, step)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; all, if there are no items."""
    _ready(spark)
    items = table(spark, sf_dir, "benchmark")
    return _apart(docs, lambda d: decontaminate.leaks(d, items).where(F.size("leaks") == 0))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text, null
    texts stay null."""
    _ready(spark)
    kind = docs.schema["n_chars"].dataType
    return _apart(docs, lambda d: secret_scan.mask_secrets(d).withColumn("n_chars", F.char_length("text").cast(kind)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in training sequences."""
    _ready(spark)
    return packing.pack(packing.pieces(docs, vocabulary()))


STAGES = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("secret_scans", mask_secrets),
    ("best_fit_packing", pack_sequences),
]

#: Sketch joins, BM25 and tokenizers are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
