"""A table that is replaced as a whole: upserts and deletes write a new version, then one pointer names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upserted(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` with the rows of ``new`` in place of those with their keys; columns that one side lacks are null."""
    return base.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def deleted(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_anti")


def n_deleted(base: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return base.join(keys.select(*on).distinct(), on, "left_semi").groupBy(*on).agg(F.count(F.lit(1)).alias("n_deleted"))


class Versioned:
    """Parquet versions below ``path``; readers see the version that was last published, whole.

    A version's number is taken by creating its pointer, which only one writer can do: another that read the same base gets an error, not a lost update.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _numbers(self) -> list[int]:
        return sorted(int(s.getPath().getName().removeprefix("pointer-")) for s in self.fs.globStatus(self._path("pointer-*")) or [])

    def _data(self, number: int) -> str:
        with_name = self.fs.open(self._path(f"pointer-{number:08d}"))
        try:
            return bytes(with_name.readAllBytes()).decode()
        finally:
            with_name.close()

    def read(self) -> DataFrame | None:
        if not (found := self._numbers()):
            return None
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.path}/{self._data(found[-1])}")

    def publish(self, df: DataFrame, over: int | None = None) -> None:
        """Write all of ``df``, then name it: a crash in between leaves the old version.  ``over``: the number of versions that ``df`` was made from."""
        name = f"data-{uuid.uuid4().hex}"
        numbers = self._numbers()
        number = (numbers[-1] + 1 if numbers else 0) if over is None else over
        df.write.parquet(f"{self.path}/{name}")
        draft = self._path(f"draft-{name}")
        out = self.fs.create(draft)
        out.write(bytearray(name.encode()))
        out.close()
        if self.fs.exists(self._path(f"pointer-{number:08d}")) or not self.fs.rename(draft, self._path(f"pointer-{number:08d}")):
            self.fs.delete(draft, False)
            self.fs.delete(self._path(name), True)
            raise RuntimeError(f"another writer published version {number} of {self.path}")
        for old in self._numbers()[: -self.keep]:
            self.fs.delete(self._path(self._data(old)), True)
            self.fs.delete(self._path(f"pointer-{old:08d}"), False)

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        over = (self._numbers() or [-1])[-1] + 1
        base = self.read()
        self.publish(new if base is None else upserted(base, new, keys), over)

    def delete(self, keys: DataFrame, on: list[str]) -> None:
        over = (self._numbers() or [-1])[-1] + 1
        if (base := self.read()) is not None:
            self.publish(deleted(base, keys, on), over)


def is_indexed(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """For each path whether the store has chunks of it: file_path, indexed."""
    have = indexed_paths(chunks).withColumn("__have", F.lit(True))
    return paths.select("file_path").distinct().join(have, "file_path", "left").select("file_path", F.coalesce("__have", F.lit(False)).alias("indexed"))


def indexed_paths(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path").distinct()


def n_rows(chunks: DataFrame) -> DataFrame:
    """The number of stored chunks, as one row."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"))


def mutation_log(rows: DataFrame, action: str, detail: list[str]) -> DataFrame:
    """Log lines: timestamp, file, action, detail as JSON text."""
    return rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.col("file_path").alias("file"), F.lit(action).alias("action"), F.to_json(F.struct(*detail)).alias("detail"))


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def registry_json(named: DataFrame, name: str = "tag") -> DataFrame:
    """A registry's rows (``name``, doc) as an entry of JSON text for each name: count and documents."""
    each = named.dropDuplicates([name, "doc"]).groupBy(name).agg(F.count("doc").alias("count"), F.array_sort(F.collect_list("doc")).alias("documents"))
    return each.select(name, F.to_json(F.struct("count", "documents")).alias("entry"))


def save_registry(named: DataFrame, path: str, name: str = "tag") -> None:
    """Write a registry as lines of JSON, ``{name, entry}``."""
    registry_json(named, name).write.mode("overwrite").json(path)


def load_registry(spark: SparkSession, path: str, name: str = "tag") -> DataFrame:
    """(``name``, doc) rows of a saved registry; damaged entries and lines are left out, a missing file is an empty registry."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], f"{name} string, doc string")
    lines = spark.read.text(path).select(F.from_json("value", f"{name} string, entry string").alias("r")).select("r.*")
    entry = F.from_json("entry", "count bigint, documents array<string>")
    return lines.filter(F.col(name).isNotNull()).select(name, F.explode_outer(entry["documents"]).alias("doc"))
