"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected onto a few random orthogonal directions, shifted, and ordered along a Hilbert curve; ``curves`` such orders,
each with directions and a shift of its own, are range-partitioned and sorted by Spark.  A query looks at the ``window`` places before and behind its own place in
each order.  The orders carry a sketch of a byte a component instead of the vectors, with a bound of its error: a query keeps every
candidate whose upper bound reaches the k-th largest lower bound, the orders' candidates are merged, and for those left each vector is fetched once and its inner
product summed in doubles, in a fixed order, so equal vectors have equal scores.

For the largest inner product, vectors get one more coordinate that makes all norms equal, and queries get 0 there.  The scale of the grid comes from a bounded
sample of vectors.  The window isn't guessed: ``probes`` queries are answered by brute force over all vectors, and the window is the rank distance within
which the share ``recall`` of their true neighbours lies in at least one order (and ``least`` at least).  Every row is indexed and no block has a cap.

Equal vectors are one place in the orders, under their smallest vec_id, with the k + 1 smallest of their vec_ids: no more can be among a query's nearest.
Rows whose vector is null, zero, or holds null or non-finite components take no part, nor do those without a vec_id or of another length
than the most frequent one; repeated vec_ids count once, with their first vector in array order.  Ties go to the smaller vec_id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise, slices, small
from vellum.llm.jaccard import runs_of

U = np.uint64


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve of points (n, m) on a grid of 2**bits cells a side, by undoing the curve's turns bit by bit."""
    x = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        here, below = U(1 << level), U((1 << level) - 1)
        for i in range(len(x)):
            turned = (x[i] & here) != 0
            swap = np.where(turned, U(0), (x[0] ^ x[i]) & below)
            x[0] = x[0] ^ np.where(turned, below, swap)
            x[i] = x[i] ^ swap if i else x[0]
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> U(level)) & U(1) != 0, U((1 << level) - 1), U(0))
    key = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for i in range(len(x)):
            key = (key << U(1)) | (((x[i] ^ flip) >> U(level)) & U(1))
    return key


class Curves:
    """The projections, shifts and grid of all orders."""

    def __init__(self, sample: np.ndarray, longest: float, curves: int, axes: int, bits: int, seed: int = 20240101):
        rng = np.random.default_rng(seed)
        self.longest, self.bits = longest, bits
        width = sample.shape[1] + 1
        axes = min(axes, width)
        self.turns = [np.linalg.qr(rng.standard_normal((width, axes)))[0] for _ in range(curves)]
        self.shifts = rng.uniform(-0.08, 0.08, (curves, axes))
        lifted = self.lift(sample)
        self.mean = [(lifted @ t).mean(0) for t in self.turns]
        self.scale = [(lifted @ t).std(0) * 6 + 1e-12 for t in self.turns]

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.c_[x, rest]

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        """(n, curves) keys of vectors, or of queries: those are stretched to the common norm, with 0 in the added coordinate."""
        y = np.c_[x * (self.longest / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)), np.zeros(len(x))] if query else self.lift(x)
        side = 1 << self.bits
        return np.stack([hilbert_keys(np.clip(((y @ t - m) / s + 0.5 + shift) * side, 0, side - 1), self.bits) for t, m, s, shift in zip(self.turns, self.mean, self.scale, self.shifts, strict=True)], 1).astype(np.int64)


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, in the elements' own type."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    kind = "float" if element == "float" else "double"
    v = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding")).filter("vec_id IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0")
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = v.filter(~odd).filter(F.exists("embedding", lambda x: x != 0))
    return v.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def distinct(good: DataFrame, k: int) -> DataFrame:
    """Each different vector once: node (its smallest vec_id), ids (its k + 1 smallest, as a query leaves out its own at most), embedding.

    Spark cuts each task's rows to the first k + 1 of a vector before the shuffle, so a vector that many rows share is no hot key.
    """
    first = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = good.withColumn("i", first).filter(F.col("i") <= k + 1)
    return few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("node"), "ids", "embedding")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def inner(a: Column, b: Column) -> Column:
    """Inner product in doubles, summed from the first component to the last: equal vectors have equal scores."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


class Sketches:
    """Vectors in one byte a component, with a bound on what any inner product can be off by."""

    def __init__(self, x: np.ndarray):
        self.scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
        self.cells = np.rint(x / self.scale[:, None]).astype(np.int8)
        self.gap = np.linalg.norm(x - self.cells * self.scale[:, None], axis=1) + 1e-12 * np.linalg.norm(x, axis=1)

    def packed(self) -> list[bytes]:
        head = np.stack([self.scale, self.gap], 1).astype("<f8")
        return [h.tobytes() + c.tobytes() for h, c in zip(head, self.cells, strict=True)]


def unpacked(rows: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as their sketches give them, and their gaps."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), 16 + width)
    head = np.ascontiguousarray(raw[:, :16]).view("<f8")
    return raw[:, 16:].view(np.int8) * head[:, :1], head[:, 1].copy()


def numbers(rows: list[dict], name: str, kind: str) -> np.ndarray:
    """The packed numbers of a column of rows, one after the other."""
    return np.frombuffer(b"".join(r[name] for r in rows), kind)


def hopeful(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Places of the candidates that may be among the k best: all whose upper bound reaches the k-th largest lower one."""
    if len(low) <= k:
        return np.flatnonzero(high > -np.inf)
    return np.flatnonzero((high >= np.partition(low, len(low) - k)[len(low) - k]) & (high > -np.inf))


def exact(nodes: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, width: int) -> DataFrame:
    """Brute force for a bounded set of queries: query, node of the k nearest vectors; each task sends its best only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(query_ids), 0), np.int64), np.zeros((len(query_ids), 0))
        for b in slices(batches, 4096):
            own = np.asarray(b.column(0))
            s = queries @ matrix(b.column(1), width).T
            s[query_ids[:, None] == own[None, :]] = -np.inf
            scores, ids = np.hstack([scores, s]), np.hstack([ids, np.broadcast_to(own, s.shape)])
            if scores.shape[1] > k:
                at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, ids = np.take_along_axis(scores, at, 1), np.take_along_axis(ids, at, 1)
        q = np.repeat(query_ids, scores.shape[1])
        real = scores.ravel() > -np.inf
        yield pa.RecordBatch.from_pydict({"query": pa.array(q[real], pa.int64()), "node": pa.array(ids.ravel()[real], pa.int64()), "score": pa.array(scores.ravel()[real], pa.float64())})

    found = nodes.select("node", "embedding").mapInArrow(run, "query bigint, node bigint, score double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return found.withColumn("k", place).filter(F.col("k") <= k).drop("k")


def ordered(nodes: DataFrame, curves: Curves, width: int) -> DataFrame:
    """All orders, materialised: curve, part and pos (place in it), kind (0 vector, 1 query), node, sketch (a query's: its whole vector)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2048):
            ids, x, asked = np.asarray(b.column(0)), matrix(b.column(1), width), np.asarray(b.column(2))
            rows = [(0, ids, pa.array(Sketches(x).packed(), pa.binary()), curves.keys(x, False))]
            if asked.any():
                rows.append((1, ids[asked], pa.array([r.tobytes() for r in x[asked].astype("<f8")], pa.binary()), curves.keys(x[asked], True)))
            for kind, i, raw, keys in rows:
                for c in range(keys.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), c, np.int32)), pa.array(keys[:, c]), pa.array(np.full(len(i), kind, np.int32)), pa.array(i), raw], names=["curve", "key", "kind", "node", "sketch"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), *b.columns], names=["part", "pos", *b.schema.names])
            at += n

    rows = nodes.select("node", "embedding", "asked").mapInArrow(keyed, "curve int, key bigint, kind int, node bigint, sketch binary")
    spread = rows.repartitionByRange("curve", "key", "kind", "node").sortWithinPartitions("curve", "key", "kind", "node")
    done = spread.mapInArrow(numbered, "part int, pos bigint, curve int, key bigint, kind int, node bigint, sketch binary")
    return materialise(done.select("part", "pos", "curve", "kind", "node", "sketch"), "orders")


def placed(orders: DataFrame) -> DataFrame:
    """Ranks from places within partitions: one row a partition and curve gives what stands before."""
    counts = orders.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small(materialise(counts.select("curve", "part", (before - F.col("first")).alias("shift")), "offsets"), 100_000)
    return orders.join(offsets, ["curve", "part"]).select("curve", (F.col("pos") + F.col("shift")).alias("place"), "kind", "node", "sketch")


def calibrated(places: DataFrame, truth: DataFrame, recall: float, least: int) -> int:
    """The window that holds the share ``recall`` of true neighbours in at least one order."""
    at = places.select("curve", "place", "kind", "node")
    v = at.filter("kind = 0").drop("kind").join(F.broadcast(truth.select("query", "node")), "node")  # probes x k rows
    q = at.filter("kind = 1").select("curve", F.col("place").alias("own"), F.col("node").alias("query")).join(F.broadcast(truth.select("query").distinct()), "query")
    nearest = v.join(q, ["curve", "query"]).groupBy("query", "node").agg(F.min(F.abs(F.col("place") - F.col("own"))).alias("gap"))
    found = nearest.agg(F.percentile("gap", F.lit(recall))).first()[0]
    return max(least, int(np.ceil((found or 0) * 1.1)))


def candidates(places: DataFrame, window: int, k: int, width: int, block: int) -> DataFrame:
    """query, node: what each query's windows hold and may be among its k nearest, by sketches.

    Orders are cut into blocks of ``block`` places, whatever the window, so a task's memory is bounded; a query goes to each block that its window reaches.
    """
    own = places.withColumn("block", F.floor(F.col("place") / block))
    reach = F.sequence(F.floor((F.greatest(F.col("place") - window, F.lit(0))) / block), F.floor((F.col("place") + window) / block))
    both = own.filter("kind = 0").unionByName(places.filter("kind = 1").withColumn("block", F.explode(reach)))

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Block after block: its vectors come first, then queries in batches."""
        key, ids, spots, x, gaps = None, [], [], [], []

        for b in batches:
            marks = np.stack([np.asarray(b.column(c)).astype(np.int64) for c in ("curve", "block", "kind")])
            edges = [0, *(np.flatnonzero((np.diff(marks, axis=1) != 0).any(0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                g = b.slice(lo, hi - lo)
                here = tuple(marks[:2, lo].tolist())
                if here != key:
                    key, ids, spots, x, gaps = here, [], [], [], []
                own_ids, own_spots, raw = np.asarray(g.column("node")), np.asarray(g.column("place")), g.column("sketch").to_pylist()
                if marks[2, lo] == 0:
                    vectors, gap = unpacked(raw, width)
                    for held, more in ((ids, own_ids), (spots, own_spots), (x, vectors), (gaps, gap)):
                        held.append(more)
                    continue
                if not ids:
                    continue
                all_ids, all_spots, all_x, all_gaps = (np.concatenate(a) for a in (ids, spots, x, gaps))
                asked = np.frombuffer(b"".join(raw), "<f8").reshape(-1, width)
                out: dict[str, list] = {"query": [], "nodes": [], "low": [], "high": []}
                for at in range(0, len(own_ids), 128):
                    q = asked[at : at + 128]
                    s = q @ all_x.T
                    off = np.linalg.norm(q, axis=1)[:, None] * all_gaps[None, :]
                    far = np.abs(own_spots[at : at + 128, None] - all_spots[None, :]) > window
                    low, high = np.where(far, -np.inf, s - off), np.where(far, -np.inf, s + off)
                    for i in range(len(q)):
                        keep = hopeful(low[i], high[i], k)
                        if len(keep):
                            out["query"].append(int(own_ids[at + i]))
                            out["nodes"].append(all_ids[keep].tobytes())
                            out["low"].append(low[i, keep].tobytes())
                            out["high"].append(high[i, keep].tobytes())
                yield pa.RecordBatch.from_pydict({n: pa.array(c, pa.int64() if n == "query" else pa.binary()) for n, c in out.items()})

    dealt = both.repartition("curve", "block").sortWithinPartitions("curve", "block", "kind", "node")
    parts = dealt.select("curve", "block", "kind", "place", "node", "sketch").mapInArrow(rank, "query bigint, nodes binary, low binary, high binary")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, rows in runs_of(batches, "query"):
            nodes, first = np.unique(numbers(rows, "nodes", "<i8"), return_index=True)
            keep = hopeful(numbers(rows, "low", "<f8")[first], numbers(rows, "high", "<f8")[first], k)
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.full(len(keep), query, np.int64)), "node": pa.array(nodes[keep])})

    return parts.repartition("query").sortWithinPartitions("query").mapInArrow(merge, "query bigint, node bigint")


def search(vectors: DataFrame, *, is_query: str = "vec_id % 20 = 0", k: int = 20, curves: int = 16, axes: int = 8, bits: int = 5, recall: float = 0.97, probes: int = 128, sample: int = 10_000, least: int = 64, block: int = 4096) -> DataFrame:
    """The k nearest of every query among all other rows: query_id, rank, vec_id, score."""
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    good = materialise(usable(vectors), "vectors")
    widths = good.groupBy(F.size("embedding").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    if not widths:
        return vectors.sparkSession.createDataFrame([], schema)
    width = widths[0]["w"]
    good = good.filter(F.size("embedding") == width)
    queries = good.filter(is_query).select("vec_id", "embedding")
    one = distinct(good, k).join(queries.select("embedding", F.lit(True).alias("asked")).distinct(), "embedding", "left")
    nodes = materialise(one.select("node", "ids", "embedding", F.coalesce("asked", F.lit(False)).alias("asked")), "nodes")
    longest = float(np.sqrt(nodes.agg(F.max(inner(F.col("embedding"), F.col("embedding")))).first()[0]))
    draw = F.xxhash64("node", F.lit(5))
    seen = matrix(nodes.orderBy(draw).limit(sample).select("embedding").toArrow().column(0).combine_chunks(), width)
    shape = Curves(seen, longest, curves, axes, bits)
    probe = nodes.filter("asked").orderBy(draw).limit(probes).select("node", "embedding").toArrow()
    if not probe.num_rows:
        return vectors.sparkSession.createDataFrame([], schema)
    truth = materialise(exact(nodes, matrix(probe.column("embedding").combine_chunks(), width), np.asarray(probe.column("node")), k, width), "truth")
    places = placed(ordered(nodes, shape, width))
    window = calibrated(places, truth, recall, least)
    pairs = candidates(places, window, k + 1, width, block)

    # Each vector is fetched once for its candidates, and the exact scores are summed in a fixed order.
    asked = nodes.filter("asked").select(F.col("node").alias("query"), F.col("embedding").alias("q"))
    scored = pairs.join(nodes.select("node", "ids", "embedding"), "node").join(asked, "query").select("query", inner(F.col("q"), F.col("embedding")).alias("score"), F.explode("ids").alias("vec_id"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = materialise(scored.withColumn("k", place).filter(F.col("k") <= k + 1).groupBy("query").agg(F.collect_list(F.struct("k", "score", "vec_id")).alias("best")), "found")

    # Rows with one vector share a search; each leaves itself out.
    of = queries.join(nodes.filter("asked").select("embedding", F.col("node").alias("query")), "embedding").select(F.col("vec_id").alias("query_id"), "query")
    own = of.join(found, "query").withColumn("best", F.slice(F.filter(F.array_sort("best"), lambda x: x["vec_id"] != F.col("query_id")), 1, k))
    return own.select("query_id", F.posexplode("best").alias("i", "x")).select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
