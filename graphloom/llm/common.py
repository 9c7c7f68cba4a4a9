"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch that a function gets at a time, so that it makes few Python objects at once. What Spark sends at
#: a time has at most 64 MB (spark.sql.execution.arrow.maxBytesPerBatch) or one row.
BATCH_ROWS = 256

#: Rows (not bytes) under which a set of bare ids may be broadcast; 16 bytes a row, so 16 MB at most.
BROADCAST_IDS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a checkpoint folder that the context has.

    Where none is set, a session on one machine gets a temporary folder there (tests); a cluster raises, as its executors
    would each write to a disk of their own.
    """
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        context.setCheckpointDir(found)
    return found


def fresh_folder(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one; it is removed when the session's JVM ends."""
    out = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    path, files = _hadoop(spark, out)
    files.mkdirs(path)
    files.deleteOnExit(path)
    return out


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder with all that it holds."""
    path, files = _hadoop(spark, folder)
    files.delete(path, True)


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint, so that a lost executor costs a reread and not the whole lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tidy:
    """A function of an iterator that gets few rows at a time and, when it ends, gives the worker's free memory back to the system; workers live on between tasks."""

    def __init__(self, inner):
        self.inner = inner

    def __call__(self, batches: Iterator) -> Iterator:
        try:
            yield from self.inner(b.slice(at, BATCH_ROWS) for b in batches for at in range(0, b.num_rows, BATCH_ROWS))
        finally:
            give_back()


def give_back() -> None:
    """Gives a worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with a tidy function."""
    return df.mapInArrow(Tidy(run), schema)


def column_of(run: Callable[[pa.Array], pa.Array], kind: str):
    """A column function of one text column from ``run``, which takes an Arrow array of few texts and gives one as long."""

    def tidy(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for own in texts:
                parts = [run(own.slice(at, BATCH_ROWS)) for at in range(0, max(1, len(own)), BATCH_ROWS)]
                yield parts[0] if len(parts) == 1 else pa.concat_arrays(parts)
        finally:
            give_back()

    return F.arrow_udf(tidy, kind)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column | str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the text "null"."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("null")).cast("binary")) % F.lit(of)


def matching(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Rows of ``df`` whose key is in ``ids`` (or, with left_anti, isn't). ``ids`` is broadcast only after a count shows that it is small."""
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return df.join(ids, key, how)


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int, seed: str) -> DataFrame:
    """(doc_id, label, text) of at most ``most`` labelled documents, those of least hash, one row each; checkpointed.

    Labels other than 0 and 1, null ids and labels of ids that no document has are left out; of several labels of an id
    the largest counts, of several texts the least by code point.
    """
    one = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    one = one.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = cut(one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
    if texts.select("doc_id").count() > chosen.count():  # only ids are read for this
        texts = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return cut(texts)
