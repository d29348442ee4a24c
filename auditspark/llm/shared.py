"""Small helpers that the corpus operators share: the shared folder, written tables, bounded samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into one output batch, and rows that Spark hands to Python at once.
ROWS_PER_BATCH, ARROW_ROWS = 512, 2000
#: The C library's call that returns freed memory to the system, where it has one.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: In a worker: whose tasks have left something there for later ones, and the call that drops it.
_left: dict = {"owner": None, "forget": None}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only in local mode, as in tests, one is made and set where the session names none.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder as Parquet and read back: computed once, and safe from lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``ARROW_ROWS`` rows from now on, unless the session asks for fewer: rows are whole documents."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ARROW_ROWS:
        spark.conf.set(name, ARROW_ROWS)


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns an operator works on as (id, text); a null text counts as empty. Other columns never matter."""
    small_batches(df.sparkSession)
    return df.select(df[id_col].alias("id"), F.coalesce(df[text_col].cast("string"), F.lit("")).alias("text"))


def give_back() -> None:
    """Returns to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _begin(owner: str | None, forget: Callable[[], None] | None) -> None:
    """Drops what tasks of another owner have left in this worker."""
    if _left["owner"] != owner and _left["forget"]:
        _left["forget"]()
    _left.update(owner=owner, forget=forget)


def lean(run: Callable[[Iterator], Iterator], owner: str | None = None, forget: Callable[[], None] | None = None) -> Callable[[Iterator], Iterator]:
    """``run`` (for mapInArrow or mapInPandas) in a worker that keeps little, since workers live on through many stages.

    What tasks of ``owner`` keep for each other stays until a task of something else begins, which calls ``forget`` first;
    without an owner it goes with the task. At the end of every task freed memory goes back to the system.
    """

    def task(batches: Iterator) -> Iterator:
        _begin(owner, forget)
        try:
            yield from run(batches)
        finally:
            if forget and not owner:
                forget()
            give_back()

    return task


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_PER_BATCH) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to at most ``rows`` rows, so that Python objects of one slice only are alive at a time.

    What is kept of earlier batches goes back to the system after each.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        give_back()


def by_length(batches: Iterator[pa.RecordBatch], size: int, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) in batches of at most ``rows`` texts of similar length, together of about ``size`` bytes at most.

    Rows come out in another order inside each incoming batch. A text longer than ``size`` is a batch of its own.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
        order = np.argsort(lengths, kind="stable")
        ends = np.cumsum(lengths[order])
        at = 0
        while at < len(order):
            done = ends[at - 1] if at else 0
            to = max(at + 1, min(at + rows, int(np.searchsorted(ends, done + size, "right"))))
            yield batch.take(pa.array(order[at:to]))
            at = to
        give_back()


def sampled_ids(df: DataFrame, id_col: str, most: int) -> DataFrame:
    """At most ``most`` ids, those with the smallest hashes: a bounded sample that doesn't depend on partitioning."""
    key = F.xxhash64(F.col(id_col).cast("string"), F.lit("sample"))
    return df.select(F.col(id_col)).orderBy(key, F.col(id_col)).limit(most)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine (every machine has them)."""
    import public_tokenizers

    return public_tokenizers.path(name)
