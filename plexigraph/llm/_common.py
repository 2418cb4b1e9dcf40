"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.session import checkpoint_dir


#: Bytes of an Arrow batch on its way to a Python worker. Spark's own default is 64 MB, of which a
#: worker holds several copies (Arrow, strings, arrays).
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; also where the queries bound the session's Arrow batches."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_BYTES; a smaller setting stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, "64m")
    size = int(now.lower().rstrip("b")) if now.lower().rstrip("b").isdigit() else BATCH_BYTES + 1
    if size > BATCH_BYTES or size <= 0:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, one of its own for local sessions without it."""
    return checkpoint_dir(spark)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage at a table that outlives any executor, so a lost executor costs a
    re-read and not a recomputation. What is in the table is stable from here on, also values such
    as monotonically_increasing_id; one made on top of it is not, as it follows each job's splits.
    """
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{shared_dir(spark).rstrip('/')}/plexigraph/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STASHED.append(path)
    return spark.read.schema(df.schema).parquet(path)


_CACHES: dict[str, dict] = {}


def cache_of(owner: str) -> dict:
    """What an operator keeps in a reused Python worker from task to task; others' caches go.

    Workers outlive jobs, so without this a pipeline's executors would hold the tables of all its
    stages at once.
    """
    for other in [k for k in _CACHES if k != owner]:
        del _CACHES[other]
        trim()
    return _CACHES.setdefault(owner, {})


def trim() -> None:
    """Give freed memory back to the system; a task's arrays would stay in its worker's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # not glibc: nothing to trim


def release(spark: SparkSession) -> None:
    """Have executors collect garbage and give back the heap that they no longer need.

    A heap that one stage of a pipeline has filled otherwise keeps its size through the next ones,
    beside their Python workers. One task for each core, so a busy executor may be left out.
    """
    cores = spark.sparkContext.defaultParallelism
    gc = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, cores, 1, cores).select(gc.alias("gc")).write.format("noop").mode("overwrite").save()


def parts(batches, column: int, rows: int = 256, size: int = 1 << 20):
    """Slices of Arrow batches of at most `rows` rows and about `size` bytes of a text column, one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at, before = 0, 0
        while at < batch.num_rows:
            to = min(max(int(np.searchsorted(ends, before + size, "right")), at + 1), at + rows)
            yield batch.slice(at, to - at)
            at, before = to, int(ends[min(to, batch.num_rows) - 1])
    trim()


_STASHED: list[str] = []


def clear_stashed(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Delete tables that this driver has stashed, once nothing lazy needs them; returns how many.

    `since` spares those that were there at an earlier `stashed()`, `keep` the last few.
    """
    gone = _STASHED[since : len(_STASHED) - keep]
    del _STASHED[since : len(_STASHED) - keep]
    n = 0
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n


def stashed() -> int:
    """How many tables are stashed now."""
    return len(_STASHED)


def if_small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows, counted now; else as it is.

    For narrow, stored tables: counting one reads no more than its footers.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df without the columns that an operator is about to produce (case-insensitive, as Spark)."""
    low = {x.lower() for x in names}
    return df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() not in low])
