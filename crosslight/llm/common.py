"""Small helpers that the training-data operators share."""

from __future__ import annotations

import functools
import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: Words whose hashes a task keeps; Python workers outlive their tasks, so what each holds at most counts for the executor.
KNOWN = 80_000


def words(text: str) -> list[str]:
    """Lower-cased runs of word characters of a whole text."""
    return WORD.findall(text.lower())


def small_batches(spark: SparkSession, mb: int = 3) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't fill a Python worker.

    Bounded tables that the driver fetches come as Arrow too, not as a Python object for each row.
    """
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{mb}m")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4000")


def release() -> None:
    """Give back to the system what earlier tasks of this Python worker have freed; for the start of a task.

    Workers outlive their tasks, so what one has needed at most would stay with the executor.
    """
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU library has it
    if trim:
        trim(0)


def tidied(run: Callable) -> Callable:
    """A task's function from an iterator to another one, with `release` before its first batch and after its last.

    A worker that waits for its next task, of whatever stage, then keeps nothing of the last one.
    """

    @functools.wraps(run)
    def tidy(batches):
        release()
        try:
            yield from run(batches)
        finally:
            release()

    return tidy


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by the cluster; a local one only on a local master.

    A cluster without one raises an error: what an executor wrote to its own disk others would not find.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named and context._jsc.sc().getCheckpointDir().isEmpty() and not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(named or f"/tmp/checkpoints/{uuid.uuid4().hex}")
    return named or context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and cut off from the plan that made them."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def beside(docs: DataFrame, id_col: str, text_col: str, run: Callable, fields: str) -> DataFrame:
    """The id of every row, and the fields that `run` makes of its text (an iterator of series to one of frames).

    The id stays on Spark's side, whatever its type: in pandas a null would turn whole numbers into
    floats and change large ones.
    """
    made = F.pandas_udf(run, fields)
    return docs.select(F.col(id_col), made(F.col(text_col)).alias("_made")).select(id_col, "_made.*")


def utf8_size(column: str) -> F.Column:
    """Bytes of a text in UTF-8; 0 for null."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
