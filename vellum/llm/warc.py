"""WARC archives with an externally merged capture index.

Pages become gzip members of WARC files, one record each; a payload that another page carries too is written once, as the response of
the largest page_id, and the other pages get revisit records that name it.  Every writing task sorts its captures by URL key and
timestamp and stores them as a run.  The runs are then merged: the key space is cut into ranges, and each merging task
streams its range of every run through a loser tree, so each range's captures come out in global order with one comparison a tree
level and one block of a run in memory.  A run is text, a capture a line, with a directory of its blocks at the end.  Where more runs than ``fan_in`` reach into a range, groups of
``fan_in`` are merged first and written as longer runs, pass by pass, so no more files than that are open at once.

A capture's timestamp is page_id seconds after 2024-01-01, as pages carry no time of their own.  A null html counts as empty; a null url has the empty key; payloads below ``least`` bytes are never revisits; repeated page_ids are
captures of their own (those with the largest page_id all hold the payload); a null page_id sorts lowest.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import io
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise, shared_dir, slices
from vellum.llm.dac import get, put, store  # noqa: F401

BLOCK_LINES = 512
NO_PAGE = -(1 << 63) - 1
EPOCH = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query, lower case, without scheme, port 80/443, ``www`` and fragment."""
    try:
        parts = urlsplit(url.strip() if "://" in url else f"http://{url.strip()}")
    except ValueError:  # not a URL: the string is its own key
        return url.strip().lower()
    host = re.sub(r":(80|443)$", "", parts.netloc.lower().rpartition("@")[2])
    labels = [x for x in host.split(".") if x]
    if labels[:1] == ["www"]:
        labels = labels[1:]
    return ",".join(reversed(labels)) + ")" + (parts.path.lower() or "/") + (f"?{parts.query.lower()}" if parts.query else "")


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next winner costs one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs, k = runs, len(runs)
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * max(1, k)
        for i in range(k):
            self.play(i, True)

    def less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) < (y, b)) if x is not None else False

    def play(self, i: int, build: bool) -> None:
        k, winner = len(self.runs), i
        node = (i + k) // 2
        while node > 0:
            if build and self.tree[node] < 0:
                self.tree[node] = winner
                return
            if self.less(self.tree[node], winner):
                self.tree[node], winner = winner, self.tree[node]
            node //= 2
        self.tree[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs:
            i = self.tree[0]
            if (head := self.heads[i]) is None:
                return
            yield head
            self.heads[i] = next(self.runs[i], None)
            self.play(i, False)


def record(kind: str, page_id: int | None, url: str, date: str, digest: str, length: int, payload: bytes, refers: int | None) -> bytes:
    """One WARC record as a gzip member.

    A response's id is of its page and its payload's digest, so a revisit can name it: pages with one page_id and one payload share a record's id.
    """
    name = lambda x, kind: f"<urn:x-page:{'' if x is None else x}:{kind}:{digest}>"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id, kind)}", f"WARC-Date: {date}", f"WARC-Target-URI: {url.replace('\r', '%0D').replace('\n', '%0A')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {length}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers, 'response')}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> dict:
    """A record's headers and payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    fields["payload"] = block.partition(b"\r\n\r\n")[2]
    return fields


def plan(pages: DataFrame, least: int) -> DataFrame:
    """Each page with its payload, digest, and the page it refers to (null: it holds the payload).

    Only digests and ids are grouped, with partial aggregation; what the large column joins with are groups of two pages or more.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    base = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    full = base.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload").cast("bigint"))
    ids = full.select("page_id", "digest", "length", F.xxhash64("payload").alias("second"))
    groups = ids.filter(F.col("length") >= least).groupBy("digest", "length", "second").agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "length", "second", "holder")
    # Ids and digests are joined, split by Spark where a payload is common; payloads go to the writer untouched.
    return full.withColumn("second", F.xxhash64("payload")).join(groups, ["digest", "length", "second"], "left")


def write(pages: DataFrame, path: str, *, least: int = 1000, target_bytes: int = 64 << 20) -> DataFrame:
    """Write archives and sorted index runs below ``path``; returns a row for each run: run, first key, last key, lines.

    A file name carries the attempt that wrote it, so a task that runs again leaves no half-written file behind what is
    returned here.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        seq, held, size = 0, [], 0
        out = io.BytesIO()

        def flush() -> pa.RecordBatch:
            nonlocal seq, size, out
            base = f"{path}/archive-{context.partitionId():06d}-{seq:04d}-{context.taskAttemptId()}"
            put(f"{base}.warc.gz", out.getvalue())
            held.sort()
            put(f"{base}.cdx", run_bytes([(*x, f"{base}.warc.gz") for x in held]))
            row = pa.RecordBatch.from_pydict({"run": [f"{base}.cdx"], "low": [held[0][0]], "high": [held[-1][0]], "keys": [[x[0] for x in held[:: max(1, len(held) // 32)]]], "lines": [len(held)], "bytes": [size]})
            seq, size, out = seq + 1, 0, io.BytesIO()
            held.clear()
            return row

        for batch in slices(batches, 128):
            for r in batch.to_pylist():
                refers = None if r["holder"] == r["page_id"] else r["holder"]
                moment = EPOCH + datetime.timedelta(seconds=(r["page_id"] or 0) % (1 << 31))
                member = record("response" if refers is None else "revisit", r["page_id"], r["url"], moment.strftime("%Y-%m-%dT%H:%M:%SZ"), r["digest"], r["length"], r["payload"], refers)
                held.append((url_key(r["url"]), moment.strftime("%Y%m%d%H%M%S"), NO_PAGE if r["page_id"] is None else r["page_id"], out.tell(), len(member)))
                out.write(member)
                size += len(member)
                if size >= target_bytes:
                    yield flush()
        if held:
            yield flush()

    return plan(pages, least).mapInArrow(run, "run string, low string, high string, keys array<string>, lines bigint, bytes bigint")


def run_bytes(captures: Iterable[tuple]) -> bytes:
    """A run: lines of captures (key, timestamp, page, offset, length, file), then its blocks' first keys and places."""
    blocks, offsets, at = [], [], 0
    for part in _chunks(captures, BLOCK_LINES):
        block = "".join(json.dumps(x) + "\n" for x in part).encode()
        offsets.append((part[0][0], at, len(block)))
        blocks.append(block)
        at += len(block)
    tail = json.dumps(offsets).encode()
    return b"".join(blocks) + tail + len(tail).to_bytes(8, "little")


def lines_of(run: str, low: str | None, high: str | None) -> Iterator[tuple]:
    """Captures of a run whose key is in [low, high), one block in memory at a time."""
    fs, path = store(run)
    with fs.open_input_file(path) as f:
        end = f.size()
        n = int.from_bytes(f.read_at(8, end - 8), "little")
        offsets = json.loads(f.read_at(n, end - 8 - n))
        first = 0
        while low is not None and first + 1 < len(offsets) and offsets[first + 1][0] < low:
            first += 1
        for _, at, size in offsets[first:]:
            for line in f.read_at(size, at).splitlines():
                x = tuple(json.loads(line))
                if high is not None and x[0] >= high:
                    return
                if low is None or x[0] >= low:
                    yield x


def merged(runs: list[str], low: str | None, high: str | None) -> Iterator[tuple]:
    """Captures of all runs in [low, high) in order of key, timestamp and page."""
    yield from LoserTree([lines_of(r, low, high) for r in runs])


def fewer(tasks: DataFrame, fan_in: int, path: str) -> DataFrame:
    """One pass: of each range's runs, every ``fan_in`` are merged into one that is written; part, low, high, runs."""
    group = F.floor(F.col("i") / fan_in).alias("g")
    groups = tasks.select("part", "low", "high", F.posexplode("runs").alias("i", "run")).groupBy("part", "low", "high", group).agg(F.array_sort(F.collect_list("run")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                name = t["runs"][0]
                if len(t["runs"]) > 1:
                    name = f"{path}/merged-{t['part']:06d}-{t['g']:06d}-{TaskContext.get().taskAttemptId()}.cdx"
                    put(name, run_bytes(merged(t["runs"], t["low"], t["high"])))
                yield pa.RecordBatch.from_pylist([{"part": t["part"], "low": t["low"], "high": t["high"], "run": name}], pa.schema([("part", pa.int32()), ("low", pa.string()), ("high", pa.string()), ("run", pa.string())]))

    made = materialise(groups.repartition("part", "g").select("part", "low", "high", "g", "runs").mapInArrow(run, "part int, low string, high string, run string"), "warc-pass")
    return made.groupBy("part", "low", "high").agg(F.array_sort(F.collect_list("run")).alias("runs"))


def index(runs: DataFrame, ranges: int | None = None, fan_in: int = 64) -> DataFrame:
    """The merged capture index: part (ranges in key order), place, url_key, timestamp, page_id, file, offset, length.

    ``runs`` has a row for each archive, with at most 65 of its keys; ranges are cut at quantiles of those keys, one for each ``fan_in`` archives at least.  A
    range's task gets only the names of the runs that reach into it.
    """
    spark = runs.sparkSession
    n = ranges or spark.sparkContext.defaultParallelism * 4
    n_runs = runs.count()
    n = max(n, n_runs // fan_in)
    every = max(1, 65 * n_runs // 500_000)  # so many keys are enough to cut at, and few enough to be numbered
    cuts = runs.select(F.explode("keys").alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(every)) == 0).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    bounds = cuts.select("k", F.percent_rank().over(_by("k")).alias("p")).select("k", F.floor(F.col("p") * n).alias("b")).groupBy("b").agg(F.min("k").alias("low"))
    ordered = bounds.select(F.row_number().over(_by("low")).alias("part"), F.when(F.row_number().over(_by("low")) > 1, F.col("low")).alias("low"), F.lead("low").over(_by("low")).alias("high"))
    reach = (F.col("r.low") < F.coalesce("o.high", F.lit("\U0010ffff"))) & (F.col("r.high") >= F.coalesce("o.low", F.lit("")))
    tasks = F.broadcast(ordered).alias("o").join(runs.select("run", "low", "high").alias("r"), reach).groupBy("o.part", "o.low", "o.high").agg(F.array_sort(F.collect_list("run")).alias("runs"))
    tasks = materialise(tasks, "warc-ranges")  # n rows, which also bounds the broadcast
    while tasks.filter(F.size("runs") > fan_in).limit(1).count():
        tasks = fewer(tasks, fan_in, shared_dir(spark, "warc-merged"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                for place, chunk in enumerate(_chunks(merged(t["runs"], t["low"], t["high"]), 4096)):
                    cols = list(zip(*chunk, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t["part"]] * len(chunk), pa.int32()), pa.array(range(place * 4096, place * 4096 + len(chunk)), pa.int64()), pa.array(cols[0]), pa.array(cols[1]),
                         pa.array([None if p == NO_PAGE else p for p in cols[2]], pa.int64()), pa.array(cols[5]), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())],
                        names=["part", "place", "url_key", "timestamp", "page_id", "file", "offset", "length"])

    schema = "part int, place bigint, url_key string, timestamp string, page_id bigint, file string, offset bigint, length bigint"
    return tasks.repartition(n, "part").mapInArrow(run, schema)


def _by(column: str) -> Column:
    from pyspark.sql import Window

    return Window.orderBy(column)


def _chunks(items: Iterable, n: int) -> Iterator[list]:
    chunk: list = []
    for x in items:
        chunk.append(x)
        if len(chunk) == n:
            yield chunk
            chunk = []
    if chunk:
        yield chunk


def read(captures: DataFrame, *, task_bytes: int = 32 << 20) -> DataFrame:
    """Records that an index names, read from the archives: page_id, payload, payload_bytes, payload_digest, record_type, refers_to.

    Offsets are sorted by file within each task, so every archive is read forwards.  A response's digest and length are computed from
    what was read and held against its headers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = "", None
        for batch in slices(batches, 256):
            rows = []
            for file, offset, length, page_id in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "page_id")), strict=True):
                if file != name:
                    fs, path = store(file)
                    name, source = file, fs.open_input_file(path)
                f = parse(source.read_at(length, offset))
                digest = base64.b32decode(f["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                size, refers = int(f["X-Payload-Length"]), None
                if f["WARC-Type"] == "response":
                    if (hashlib.sha1(f["payload"]).hexdigest(), len(f["payload"])) != (digest, size):
                        raise ValueError(f"damaged record at {offset} of {file}")
                else:
                    refers = int(f["WARC-Refers-To"].split(":")[2])
                rows.append((page_id, size, digest, f["WARC-Type"], refers))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    # As many tasks as the archives' bytes ask for: the index itself says nothing about them.
    size = captures.agg(F.sum("length")).first()[0] or 0
    n = max(1, min(captures.sparkSession.sparkContext.defaultParallelism * 4, size >> 20), size // task_bytes)
    spread = captures.select("file", "offset", "length", "page_id").repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def roundtrip(pages: DataFrame, *, least: int = 1000) -> DataFrame:
    """Write all pages, merge the index, and read every record back through it."""
    runs = materialise(write(pages, shared_dir(pages.sparkSession, "warc"), least=least), "warc-runs")
    return read(materialise(index(runs), "warc-index"))


#: The same in DuckDB.
SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
  max(page_id) OVER (PARTITION BY sha256(body)) AS holder FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to FROM d
"""
