"""A corpus pipeline: quality, language, near-duplicates, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, mixing, near_dup, piece_bpe, quality
from graphloom.llm.common import BROADCAST_IDS, cut, fold, fresh_folder, matching, remove, table
from graphloom.llm.queries import tokenizer_model, words_of


#: Rows of the Arrow batches that the stages ask of Spark. They run one after another in the same executors, whose JVM keeps
#: the buffers of the largest batch; Spark's own bound, 10,000 rows, took some 200 MB of an executor more.
BATCH_ROWS = 1024
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch to BATCH_ROWS; ``run`` sets back what was there before."""
    if not 0 < int(spark.conf.get(_ARROW_ROWS)) <= BATCH_ROWS:
        spark.conf.set(_ARROW_ROWS, str(BATCH_ROWS))


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry ranker accepts; it learns from the labels outside the held-out fold.

    The threshold is a quantile of the scores of all ``docs``. A null text is an empty one; rows are judged each by
    itself, so repeated rows stay or go together, and rows with a null id are judged too. Very long texts are read whole,
    an empty table stays empty, and extra columns stay whatever their names.
    """
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")).where(fold("doc_id", 4) != 2)
    rows = docs.select("text", F.struct("*").alias("row"))
    return quality.score(rows, quality.fit(docs, labels)).where("accepted").select("row.*")


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a language's centroid; a missing language is filled in.

    Texts that are null, empty or without letters are rejected. Repeated rows stay or go together, null ids are ids like
    others, very long texts are read whole, an empty table stays empty, and extra columns stay whatever their names.
    """
    bounded_batches(spark)
    rows = docs.select("text", F.struct("*").alias("row"))
    found = language.identify(rows, language.fit(docs.where(fold("doc_id", 5) != 0))).where(~F.col("rejected"))
    return found.select("row.*", F.col("lang_pred").alias("@lang")).withColumn("lang", F.coalesce("lang", "@lang")).select(*docs.columns)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest doc_id.

    Rows that share a doc_id, or have none, are told apart by their text: they are compared under numbers of their own, the
    hash of id and text, and the smallest number of a group stays. So no text goes unless a near-duplicate stays, and of
    rows that repeat id and text one stays. Empty and null texts are in no group. An empty table stays empty; extra
    columns stay whatever their names (of rows that repeat id and text, those of one of them).
    """
    bounded_batches(spark)
    own, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    shared = cut(docs.where("doc_id is not null").groupBy(own.alias("@shared")).count().where("count > 1").select("@shared"))
    few = shared.count()
    alike = bool(few) or not docs.where("doc_id is null").isEmpty()
    rows = docs.withColumn("@id", own)
    if alike:
        rows = docs.join(F.broadcast(shared) if few <= BROADCAST_IDS else shared, own == F.col("@shared"), "left")
        alone = F.col("doc_id").isNotNull() & F.col("@shared").isNull()
        rows = rows.withColumn("@id", F.when(alone, own).otherwise(F.xxhash64(own, F.col("text").isNull(), text))).withColumn("@twice", ~alone)
    groups = cut(near_dup.near_duplicates(rows.select(F.col("@id").alias("doc_id"), "text"), k=5, percent=80))
    out = matching(rows, cut(groups.where(~F.col("kept")).select(F.col("doc_id").alias("@id")).distinct()), "@id", "left_anti")
    if alike:
        out = out.where("not `@twice`").unionByName(out.where("`@twice`").dropDuplicates(["@id"]))
    return out.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents drawn and repeated so that each source's words come near its target.

    A null source is a source of its own; null and empty texts have no words and are only copied, with their source.
    Null ids are kept, rows that repeat id, text and source are drawn together, an empty table stays empty, and extra
    columns stay whatever their names.
    """
    return mixing.mixed_rows(docs, words_of("text"))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text.

    Every row gives a row, repeated ones and such with a null id too; null and empty texts give the begin and end ids.
    Whole texts are encoded, a word of any length in a time of n * log(n). Extra columns are not read.
    """
    bounded_batches(spark)
    out = piece_bpe.encode_decode(docs, tokenizer_model())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("language", known_languages),
    ("near_dedup", without_copies),
    ("mixing", mixed_sources),
    ("tokens", tokenised),
]

#: The ranker and the centroids are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; what a stage returns is written to the shared folder and read again.

    A stage's rows are removed when the next stage has written its own, the last ones when the session's JVM ends.
    """
    docs, folder, before, rows = table(spark, sf_dir, "documents"), fresh_folder(spark, "pipeline"), None, spark.conf.get(_ARROW_ROWS)
    try:
        for name, stage in STAGES:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before:
                remove(spark, before)
            before = f"{folder}/{name}"
    finally:
        spark.conf.set(_ARROW_ROWS, rows)
    return docs
