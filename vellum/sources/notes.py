"""Where notes come from: vault folders, listings, and the test tables."""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vellum.config import DEFAULT
from vellum.functions.markdown import entity_note
from vellum.functions.text import normal_newlines, relevant_path


class VaultReader(DataSourceReader):
    def __init__(self, root: str, files: int):
        self.root, self.files = root, files

    def partitions(self) -> list[InputPartition]:
        found = sorted(os.path.join(d, f) for d, _, names in os.walk(self.root) for f in names)
        return [InputPartition(found[i : i + self.files]) for i in range(0, len(found), self.files)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.value:
            s = os.stat(path)
            with open(path, "rb") as f:
                yield path, f.read(), s.st_mtime, s.st_size


class VaultSource(DataSource):
    """``spark.read.format("vault")``: every file of a folder that all executors see, also those whose names Spark's own sources skip."""

    @classmethod
    def name(cls) -> str:
        return "vault"

    def schema(self) -> str:
        return "path string, content binary, mtime double, size bigint"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return VaultReader(self.options["path"], int(self.options.get("filesPerPartition", "64")))


def lenient(content: pd.Series) -> pd.Series:
    """Bytes as UTF-8 text, without those that aren't."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "ignore"))


def read_notes(files: DataFrame) -> DataFrame:
    """Notes of files (path, content, mtime): file_path, text (plain newlines; null if the bytes aren't UTF-8), body_text (without bad bytes), hash, mtime.

    A damaged note stops nothing: it has no text, so it gets no chunks, and :func:`quarantined` lists it.  Only damaged ones are decoded in Python.
    """
    whole = F.is_valid_utf8(F.col("content").cast("string"))
    rescue = F.pandas_udf(lenient, "string")(F.when(~whole, F.col("content")))
    plain = normal_newlines(F.col("content").cast("string"))
    return files.select(F.col("path").alias("file_path"), F.when(whole, plain).alias("text"), F.when(whole, plain).otherwise(normal_newlines(rescue)).alias("body_text"), F.sha2("content", 256).alias("hash"), "mtime")


def quarantined(notes: DataFrame) -> DataFrame:
    """Notes whose bytes aren't UTF-8: file_path, hash."""
    return notes.filter("text IS NULL").select("file_path", "hash")


def vault(spark: SparkSession, root: str, ignored: tuple[str, ...] = DEFAULT.ignored_dirs) -> DataFrame:
    """Notes of a vault, as :func:`read_notes` gives them."""
    if not os.path.isdir(root):
        raise FileNotFoundError(f"no vault at {root}")
    spark.dataSource.register(VaultSource)
    files = spark.read.format("vault").load(root).withColumn("inside", F.expr(f"substring(path, {len(root.rstrip('/')) + 2})"))
    return read_notes(files.filter(relevant_path(F.col("inside"), ignored)))


def vault_objects(spark: SparkSession, root: str, ignored: tuple[str, ...] = DEFAULT.ignored_dirs) -> DataFrame:
    """As :func:`vault`, from any store that Spark reads; names that start with ``_`` or ``.`` aren't seen."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    kept = files.filter(relevant_path(F.col("path"), ignored))
    return read_notes(kept.select("path", "content", (F.unix_micros("modificationTime") / 1e6).alias("mtime")))


def write_notes(notes: DataFrame, only_new: bool = False) -> DataFrame:
    """Write (file_path, text) below the mount that executors share: file_path, written, hash of each note.

    Every note is written under another name and then renamed, so readers and repeated tasks see it whole.  ``only_new``: files that exist stay as they are.
    The rows are the writes that the watcher is to leave out; materialise them once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw, written = (text or "").encode("utf-8", "surrogatepass"), path is not None and not (only_new and os.path.exists(path))
                if written:
                    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                    draft = os.path.join(os.path.dirname(path), f".{os.path.basename(path)}.{uuid.uuid4().hex}")
                    with open(draft, "wb") as f:
                        f.write(raw)
                    os.replace(draft, path)
                rows.append((path, written, hashlib.sha256(raw).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.bool_(), pa.string()))], names=["file_path", "written", "hash"])

    return notes.select("file_path", "text").mapInArrow(run, "file_path string, written boolean, hash string")


def write_entity_notes(entities: DataFrame, root: str) -> DataFrame:
    """A stub note for each entity (entity, kind) that has none yet, in the vault's folder ``entities``."""
    name = F.replace("entity", F.lit("/"), F.lit("-"))
    path = F.concat(F.lit(f"{root.rstrip('/')}/entities/"), name, F.lit(".md"))
    return write_notes(entities.select(path.alias("file_path"), entity_note(F.col("entity"), F.col("kind")).alias("text")), only_new=True)


def copy_files(copies: DataFrame) -> DataFrame:
    """Copy (source, target) on the shared mount: target, size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = []
            for source, target in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                os.makedirs(os.path.dirname(target) or ".", exist_ok=True)
                draft = f"{target}.{uuid.uuid4().hex}.part"
                shutil.copyfile(source, draft)
                os.replace(draft, target)
                sizes.append(os.path.getsize(target))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(sizes, pa.int64())], names=["target", "size"])

    return copies.select("source", "target").mapInArrow(run, "target string, size bigint")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The test documents as Markdown notes with frontmatter, a heading, paragraphs, a rule and a managed section."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit('---\ntitle: "'), i, F.lit('"\ntags: ['), F.col("source"), F.lit(", "), F.col("lang"), F.lit("]\n---\n\n# Note "), i, F.lit("\n\n"))
    tail = F.concat(F.lit("\n\n---\n\n## Related Notes\n\n- [["), (F.col("doc_id") + 1).cast("string"), F.lit("]] — near\n"))
    return d.select("doc_id", F.concat(F.lit("vault/"), F.col("source"), F.lit("/"), i, F.lit(".md")).alias("file_path"), F.concat(head, F.replace("text", F.lit("\n"), F.lit("\n\n")), tail).alias("text"))
