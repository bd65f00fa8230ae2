"""Helpers that the operators share: table access, the shared folder, materialised steps."""

from __future__ import annotations

import ctypes
import gc
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.shared import materialise, shared_dir

__all__ = ["KEPT", "free", "identified", "materialise", "release", "shared_dir", "slices", "small", "swept", "table", "without"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table, read by Spark so that any store Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of ``rows`` rows and about ``size`` bytes at most (or one row), so that what a kernel holds besides its input stays small."""
    for batch in batches:
        step = max(1, min(rows, int(size * batch.num_rows / max(batch.nbytes, 1))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


#: What kernels keep in a worker from task to task, by the operator that keeps it.
KEPT: dict[str, dict] = {}


def release(own: str = "") -> None:
    """Give memory that a kernel has freed back to the system: a Python worker lives on for other tasks, and drops what operators but ``own`` kept in it."""
    if dropped := [held for name, held in KEPT.items() if name != own and held]:
        for held in dropped:
            held.clear()
        del dropped
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def swept(spark: SparkSession) -> None:
    """Let Spark delete the files of shuffles that no plan can ask for any more: its cleaner sees them once the driver's JVM collects.

    Python's own cycles hold plans too, and what a job has just left is let go only after its listeners are through: hence twice, with a pause.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


#: So many rows, of so many bytes as JSON, are broadcast; more are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 64 << 20


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, already materialised, marked for broadcast if it has few rows and bytes."""
    n, length = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if n <= rows and (length or 0) <= size else df


#: So many broadcasts of BROADCAST_ROWS rows at most take part in one join; beyond that it shuffles.
TURNS = 4


def without(rows: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """``rows`` whose ``row`` (a long, never null) isn't in ``dropped``.

    64 neighbouring numbers share one row of what is broadcast, as bits, so that many dropped rows don't make the texts of all go through a shuffle.
    """
    cell, bits, columns = free(rows, "__cell"), free(rows, "__bits"), rows.columns
    cell_of, bit = F.shiftright(F.col(row), 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(row).bitwiseAND(63).cast("int"))
    masks = materialise(dropped.groupBy(cell_of.alias(cell)).agg(F.bit_or(bit).alias(bits)), "dropped")
    turns = max(1, -(-masks.count() // BROADCAST_ROWS))
    parts = [masks] if turns > TURNS else [F.broadcast(masks.filter(F.pmod(F.xxhash64(cell), F.lit(turns)) == turn)) for turn in range(turns)]
    for part in parts:
        rows = rows.withColumn(cell, cell_of).join(part, cell, "left").filter(F.col(bits).isNull() | (F.col(bits).bitwiseAND(bit) == 0)).select(*columns)
    return rows


def free(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` is called so."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def identified(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` with a column that tells its rows apart: doc_id, or numbers where doc_ids are null, repeated or no integers.

    Only ids are grouped to find that out; numbered rows are written first, so that they keep their numbers.
    """
    whole = docs.schema["doc_id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    if not whole or docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL").limit(1).count():
        return materialise(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    return docs.withColumn(name, F.col("doc_id").cast("bigint"))
