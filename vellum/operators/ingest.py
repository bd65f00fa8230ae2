"""Journal pages: extracted fields to one Markdown note, and images as bytes."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import image
from vellum.functions.text import page_id, quoted_lines, unfenced, words
from vellum.operators.prompts import PAGE, TRANSCRIBE
from vellum.shared import materialise
from vellum.sources.notes import copy_files, write_notes


def extracted(answer: Column) -> Column:
    """Fields of a vision answer; one that isn't JSON is all text."""
    plain = F.struct(answer.alias("text"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("written_date"), F.lit("Untitled Entry").alias("title"))
    parsed = F.from_json(unfenced(answer), PAGE)
    return F.when(unfenced(answer).rlike(r"(?s)^\{.*\}$") & parsed["text"].isNotNull(), parsed).otherwise(plain)


def image_names(page: Column, files: Column) -> Column:
    """Attachment names: the page's, numbered if there are several, with each file's suffix."""
    suffix = lambda f: F.regexp_extract(f, r"(\.[^.]*)$", 1)
    return F.transform(files, lambda f, i: F.concat(page, F.when(F.size(files) > 1, F.concat(F.lit(" - p"), (i + 1).cast("string"))).otherwise(""), suffix(f)))


def front(page: Column, title: Column, date: Column, images: Column, now: Column) -> Column:
    """A page's frontmatter; tags are left to the reasoning pass."""
    written = F.when(F.coalesce(date, F.lit("")) != "", F.concat(F.lit('\nwritten_date: "'), date, F.lit('"'))).otherwise("")
    sources = F.array_join(F.transform(images, lambda i: F.concat(F.lit('"[['), i, F.lit(']]"'))), ", ")
    return F.concat(F.lit("---\nid: "), page, F.lit('\ntitle: "'), title, F.lit('"\ndate: '), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), written, F.lit("\ntags: []\nsource_pages: ["), sources, F.lit("]\n---"))


def page_note(page: Column, e: Column, images: Column, now: Column) -> Column:
    """The whole note of a page: frontmatter, title, summary, images, the entry as a quote, metadata."""
    title, text = F.coalesce(e["title"], F.lit("Untitled Entry")), F.coalesce(e["text"], F.lit(""))
    summary = F.when(F.coalesce(e["summary"], F.lit("")) != "", F.concat(F.lit("## 🧠 AI Summary\n\n"), e["summary"], F.lit("\n"))).otherwise("")
    shown = F.array_join(F.transform(images, lambda i: F.concat(F.lit("![["), i, F.lit("]]"))), "\n")
    about = F.concat(F.lit("## Metadata\n\n- **Word Count:** "), words(text).cast("string"), F.lit("\n- **Processing Date:** "), F.date_format(now, "yyyy-MM-dd HH:mm:ss"))
    parts = [front(page, title, e["written_date"], images, now), F.lit("\n\n# "), title, F.lit("\n\n---\n\n"), summary, F.lit("\n---\n\n"), shown, F.lit("\n\n---\n\n## Entry\n\n"), quoted_lines(text), F.lit("\n\n---\n\n"), about, F.lit("\n")]
    return F.concat(*parts)


def pages(answers: DataFrame, now: Column | None = None) -> DataFrame:
    """(page, answer, files array) -> page, page_id, file_path, images, n_words, text of one note each."""
    e = answers.withColumn("e", extracted(F.col("answer"))).withColumn("page_id", page_id(F.col("e.title"), F.col("e.written_date")))
    named = e.withColumn("images", image_names(F.col("page_id"), F.col("files")))
    return named.select("page", "page_id", F.concat("page_id", F.lit(".md")).alias("file_path"), "images", words(F.coalesce("e.text", F.lit(""))).alias("n_words"), page_note(F.col("page_id"), F.col("e"), F.col("images"), F.current_timestamp() if now is None else now).alias("text"))


def prepared(files: DataFrame, decode: Callable[[bytes], np.ndarray] = image.read_png) -> DataFrame:
    """Image files (path, content) as the vision model gets them: path, height, width, base64 (PNG), error.

    ``decode`` turns a file into pixels; a file that it can't read has an error and stops nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # an image at a time is in memory
                height = width = text = error = None
                try:
                    p = image.prepared(decode(batch.column(1)[i].as_py()))
                    (height, width), text = p.shape, image.encoded(p)
                except Exception as e:  # noqa: BLE001 - a decoder's error is recorded with its file
                    error = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pydict({"path": batch.column(0).slice(i, 1), "height": pa.array([height], pa.int32()), "width": pa.array([width], pa.int32()), "base64": pa.array([text], pa.string()), "error": pa.array([error], pa.string())})

    return files.select("path", "content").mapInArrow(run, "path string, height int, width int, base64 string, error string")


Vision = Callable[[list[str], str], str]


def stub_vision(images: list[str], instruction: str) -> str:
    """Reads nothing, but answers in the form that is asked for."""
    return json.dumps({"text": "\n".join(f"page {i}: {len(b)} characters" for i, b in enumerate(images, 1)), "summary": "", "written_date": None, "title": f"Pages {len(images)}"})


def transcribed(groups: DataFrame, vision: Vision = stub_vision) -> DataFrame:
    """(page, images array of base64, files array) -> page, answer, files, error: one request for all images of an entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers, errors = [], []
            for own in batch.column(1).to_pylist():
                try:
                    answers.append(vision(own, TRANSCRIBE))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any provider's error is recorded with its row
                    answers.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(answers, pa.string()), batch.column(2), pa.array(errors, pa.string())], names=["page", "answer", "files", "error"])

    return groups.select("page", "images", "files").mapInArrow(run, "page string, answer string, files array<string>, error string")


def entry(spark: SparkSession, paths: list[str], vault: str, *, vision: Vision = stub_vision, decode: Callable[[bytes], np.ndarray] = image.read_png, now: Column | None = None) -> DataFrame:
    """One journal entry from its page images: the note in the vault's folder ``processed``, the images in ``attachments``; page_id, file_path, n_words."""
    listed = spark.createDataFrame(list(enumerate(paths)), "i int, path string")
    raw = spark.read.format("binaryFile").load(paths).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    ready = materialise(prepared(raw, decode), "pages")
    if bad := ready.filter("error IS NOT NULL").select("path", "error").first():
        raise ValueError(f"{bad.path}: {bad.error}")
    in_order = F.array_sort(F.collect_list(F.struct("i", "path", "base64")))
    groups = listed.join(ready, "path").agg(in_order.alias("x")).select(F.lit("entry").alias("page"), F.col("x.base64").alias("images"), F.col("x.path").alias("files"))  # the images of one entry
    answers = materialise(transcribed(groups, vision), "answers")
    if error := answers.first().error:
        raise RuntimeError(error)
    made = materialise(pages(answers, now), "entries")
    root = vault.rstrip("/")
    each = made.select(F.posexplode("images").alias("i", "name"))
    copies = each.join(listed, "i").select(F.col("path").alias("source"), F.concat(F.lit(f"{root}/attachments/"), "name").alias("target"))
    materialise(copy_files(copies), "copies")
    notes = made.select(F.concat(F.lit(f"{root}/processed/"), "file_path").alias("file_path"), "text")
    materialise(write_notes(notes), "writes")
    return made.select("page_id", F.concat(F.lit(f"{root}/processed/"), "file_path").alias("file_path"), "n_words")


def scale(height: Column, width: Column, most: int = 2048) -> Column:
    """Factor that brings an image within ``most`` pixels a side, never above 1."""
    return F.least(F.lit(1.0), most / height, most / width)


def rotation(angles: Column) -> Column:
    """Median of the angles found; 0 where there are none or it is 45 degrees or more."""
    s = F.array_sort(angles)
    n = F.size(s)
    middle = (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2
    return F.when((n > 0) & (F.abs(middle) < 45), middle).otherwise(0.0)


def images(spark, path: str) -> DataFrame:  # noqa: ANN001
    """Image files as rows path, length, base64."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path)
    return files.select("path", "length", F.base64("content").alias("base64"))
