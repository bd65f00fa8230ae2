"""N-gram Jaccard join as a metric-space join: pivots, Voronoi regions, triangle-inequality windows, exact.

Jaccard distance d = 1 - J is a metric, but most documents are at distance 1 from each other, where pivots that are documents
tell nothing.  The first pivots are therefore the smallest sets there are, single shingles {s}: d(A, {s}) is 1 - 1/|A| if A holds s, else 1, so A lies in
the regions of its own shingles, all equally near, and a global order (rare ones first) breaks ties.  A partner within r = 1 - t
holds all but a share r of A's shingles; A's window are its first |A| - ceil(t|A|) + 1 pivots, and both meet in the region of their first common one.  A shingle that no other
document has makes an empty region: a document whose whole window is empty has no partner and is settled.  The regions that share documents form blocks, and blocks hold every link.

Within a block documents are pivots.  Each joins the Voronoi region of its nearest pivot p; a document y is replicated into the window of any region q
with d(y, q) <= d(y, home) + r, which the triangle inequality asks for; those at 1 - r or more from all pivots are a region of their own.  Regions are divided again until they are small, and there
pairs are compared unless |d(x, p) - d(y, p)| > r for some pivot p, or they are connected already: all documents within r of one pivot are.
Blocks that are too heavy for one task are divided the same way by Spark, and what can't be divided is compared in blocks of pairs.

Documents with equal sets are one node.  Null or empty texts, and texts without words, have the empty set: no links, a component of their own.
Repeated doc_ids keep a row each; a null doc_id links like others and never names a component that has another.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm import shingles as sh
from vellum.llm.common import free, identified, materialise, release, slices, small, swept, without
from vellum.llm.components import components

#: Postings that a bucket holds at most, on average: a task needs about 60 bytes for each.
PER_BUCKET = 1_000_000

#: Upper bits of a shingle that postings carry: shingles alike in them count as one pivot, which only makes more candidates.  Sets are compared by all 64.
CARRIED = 48


def bucket_bits(n_postings: int) -> int:
    """Upper bits by which shingles are dealt out, by the size of the corpus."""
    return min(24, max(5, (max(1, n_postings) // PER_BUCKET).bit_length()))


def window(n: np.ndarray, percent: int) -> np.ndarray:
    """How many pivots a set of n shingles must look at."""
    return n - -(-percent * n // 100) + 1


def members(docs: DataFrame, text: str = "text", k: int = 5, row: str = "__row") -> DataFrame:
    """doc_id, row, node (a set's fingerprint, 0 if empty), n_shingles of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            own = [(sh.fingerprint(x), len(x)) for x in sh.sets(b.column(2), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64())], names=["doc_id", "row", "node", "n_shingles"])
        release("shingles")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(row).alias("row"), text).mapInArrow(run, "doc_id bigint, row bigint, node bigint, n_shingles bigint")


def planes(x: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, the low one first, up to the last that isn't zero; ahead of them their number.

    The last plane has few values, mostly small ones, and is compressed by Zstandard if that makes it shorter: then 128 is added to the number, and how many numbers there are follows in four bytes.
    """
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    each = x.view(np.uint8).reshape(-1, 8)[:, :width].T
    top = each[-1].tobytes()
    less = pa.compress(top, codec="zstd", asbytes=True) if len(top) > 32 else top
    if len(less) + 4 < len(top):
        return bytes([width + 128]) + len(x).to_bytes(4, "little") + each[:-1].tobytes() + less
    return bytes([width]) + each.tobytes()


def unplanes(data: bytes) -> np.ndarray:
    """What :func:`planes` was given."""
    width, start = data[0], 1
    if width > 128:
        width, start, n = width - 128, 5, int.from_bytes(data[1:5], "little")
        data = data[: 5 + (width - 1) * n] + pa.decompress(data[5 + (width - 1) * n :], decompressed_size=n, codec="zstd", asbytes=True)
    out = np.zeros(((len(data) - start) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, offset=start).reshape(width, -1).T
    return out.view("<u8")[:, 0]


def steps(low: np.ndarray, bucket: int = 0, bits: int = CARRIED) -> bytes:
    """Ascending numbers of a bucket as :func:`planes` of their differences."""
    return planes(np.diff(low, prepend=np.uint64(bucket << (CARRIED - bits))))


def climbed(data: bytes, bucket: int = 0, bits: int = CARRIED) -> np.ndarray:
    """What :func:`steps` was given."""
    return np.cumsum(unplanes(data), dtype=np.uint64) + np.uint64(bucket << (CARRIED - bits))


KINDS = {"bucket": pa.int32(), "batch": pa.int64(), "nodes": pa.binary(), "sizes": pa.binary(), "own": pa.binary(), "low": pa.binary(), "df": pa.binary()}
SCHEMA = "bucket int, batch bigint, nodes binary, sizes binary, own binary, low binary, df binary"


def packed(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({c: pa.array([r.get(c) for r in rows], kind) for c, kind in KINDS.items()})


def postings(docs: DataFrame, text: str, k: int, bits: int) -> DataFrame:
    """Shingles of different sets by bucket: for each bucket and batch the shingles, in CARRIED bits, and their owners, numbers within the batch.

    One more row for each batch, in any bucket, holds the owners' nodes and sizes, so that these don't go to every bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024, 8 << 20):
            nodes: dict[int, np.ndarray] = {}
            for x in sh.sets(b.column(0), k):
                if len(x):
                    nodes.setdefault(sh.fingerprint(x), x)
            if not nodes:
                continue
            ids, sizes = np.fromiter(nodes, np.int64, len(nodes)), np.array([len(x) for x in nodes.values()], np.int32)
            every, owner = np.concatenate(list(nodes.values())), np.repeat(np.arange(len(ids), dtype=np.uint16), sizes)
            del nodes, x
            order = np.argsort(every, kind="stable")
            every, owner = every[order] >> np.uint64(64 - CARRIED), owner[order]
            del order
            ends = np.append(np.searchsorted(every, np.arange(1 << bits, dtype=np.uint64) << np.uint64(CARRIED - bits)), len(every))
            batch = sh.fingerprint(ids.view(np.uint64))
            rows = [{"bucket": batch % (1 << bits), "batch": batch, "nodes": ids.tobytes(), "sizes": sizes.tobytes()}]
            for i in np.flatnonzero(np.diff(ends)).tolist():
                a, z = ends[i], ends[i + 1]
                rows.append({"bucket": i, "batch": batch, "own": planes(owner[a:z]), "low": steps(every[a:z], i, bits)})
            yield packed(rows)
        release("shingles")

    return docs.select(text).mapInArrow(run, SCHEMA)


def runs_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal ``key`` together, of sorted batches."""
    last, rows = None, []
    for b in batches:
        for one in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
            for r in one.to_pylist():
                if r[key] != last and rows:
                    yield last, rows
                    rows = []
                last = r[key]
                rows.append(r)
    if rows:
        yield last, rows


def together(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows of a key whole and in order within partitions, about two buckets' worth in each."""
    return df.repartition(max(buckets // 2, df.sparkSession.sparkContext.defaultParallelism * 4), key).sortWithinPartitions(key)


def shared(dealt: DataFrame, bits: int) -> DataFrame:
    """The postings of pivots that have two or more, with that number (up to 65535); the rows of the batches as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in runs_of(batches, "bucket"):
            out = [r for r in rows if r["low"] is None]
            held = [r for r in rows if r["low"] is not None]
            low = [climbed(r["low"], bucket, bits) for r in held]
            ends = np.cumsum([0, *map(len, low)])
            low = np.concatenate([*low, np.zeros(0, np.uint64)])
            order = np.argsort(low, kind="stable")
            ranked = low[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))[: len(ranked)])
            count = np.diff(np.append(first, len(ranked)))
            df = np.empty(len(low), np.uint16)
            df[order] = np.repeat(np.minimum(count, 65535).astype(np.uint16), count)
            for i, r in enumerate(held):
                own = df[ends[i] : ends[i + 1]]
                keep = np.flatnonzero(own > 1)
                if len(keep):
                    out.append({"bucket": bucket, "batch": r["batch"], "own": planes(unplanes(r["own"])[keep]), "low": steps(low[ends[i] : ends[i + 1]][keep], bucket, bits), "df": planes(own[keep])})
            if out:
                yield packed(out)
        release()

    return together(dealt, "bucket", 1 << bits).mapInArrow(run, SCHEMA)


def unsettled(found: DataFrame, percent: int, bits: int) -> DataFrame:
    """Nodes whose window has a region with others: node, n, pivots (the regions)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, "batch"):
            head = next(r for r in rows if r["nodes"] is not None)
            rows = [r for r in rows if r["low"] is not None]
            if not rows:
                continue
            own, df = (np.concatenate([unplanes(r[c]).astype(np.uint16) for r in rows]) for c in ("own", "df"))
            low = np.concatenate([climbed(r["low"], r["bucket"], bits) for r in rows])
            order = np.lexsort((low, df, own))
            own, low = own[order].astype(np.int64), low[order]
            start = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
            stop = np.append(start[1:], len(own))
            node, size = np.frombuffer(head["nodes"], "<i8")[own[start]], np.frombuffer(head["sizes"], "<i4")[own[start]].astype(np.int64)
            left = window(size, percent) - (size - (stop - start))  # what the window has beside its empty regions
            keep = np.flatnonzero(left > 0)
            if len(keep):
                pivots = pa.array([low[start[i] : min(stop[i], start[i] + left[i])].view(np.int64) for i in keep], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(size[keep]), pivots], names=["node", "n", "pivots"])
        release()

    return together(found, "batch", 1 << bits).mapInArrow(run, "node bigint, n bigint, pivots array<bigint>")


#: Rows of a broadcast table that says which documents' sets are made again.
IN_TURN = 1_000_000


def sets_of(docs: DataFrame, placed: DataFrame, text: str, k: int, row: str) -> DataFrame:
    """block, node, n, shingles (all of them, packed) of the documents in ``placed`` (``row``, block), made again from their texts.

    Texts are cheaper to read twice than sets are to keep.  Documents are asked for by broadcast, in turns if they are many, so no text is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024, 8 << 20):
            own = [(sh.fingerprint(x), len(x), steps(x)) for x in sh.sets(b.column(1), k)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.int64()), pa.array([x[2] for x in own], pa.binary())], names=["block", "node", "n", "shingles"])
        release("shingles")

    placed = materialise(placed, "placed")
    turns = max(1, -(-placed.count() // IN_TURN))
    out = None
    for turn in range(turns):
        asked = placed.filter(F.pmod(F.xxhash64(row), F.lit(turns)) == turn)
        part = docs.join(F.broadcast(asked), row).select("block", text).mapInArrow(run, "block bigint, node bigint, n bigint, shingles binary")
        out = part if out is None else out.unionByName(part)
    return out


class Region:
    """Exact links among the sets of one block, up to what connectivity already tells."""

    def __init__(self, nodes: list[int], sizes: list[int], sets: list[bytes], percent: int, small: int = 16, pivots: int = 8):
        self.nodes, self.n, self.percent, self.small, self.k = nodes, np.array(sizes, np.int64), percent, small, pivots
        self.r = 1 - percent / 100 + 1e-9
        counts = np.array([len(x) // 8 for x in sets], np.int64)
        words, flat, times = np.unique(np.frombuffer(b"".join(sets), "<u8"), return_inverse=True, return_counts=True)
        held = times[flat] > 1  # what only one has isn't common to any two
        self.flat = flat[held]
        self.starts = np.concatenate(([0], np.cumsum(held)))[np.concatenate(([0], np.cumsum(counts)))]
        self.mark = np.zeros(len(words), bool)
        self.root = list(range(len(nodes)))
        self.compared = 0
        everything = np.arange(len(nodes))
        self.divide(everything)

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def roots(self, ids: np.ndarray) -> np.ndarray:
        return np.array([self.find(i) for i in ids.tolist()], np.int64)

    def distances(self, p: int, ids: np.ndarray) -> np.ndarray:
        """d(p, x) for each x, linking those within r: the test itself is on integers."""
        own = self.flat[self.starts[p] : self.starts[p + 1]]
        self.mark[own] = True
        length = self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(length)
        at = np.repeat(self.starts[ids] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        hits = np.concatenate(([0], np.cumsum(self.mark[self.flat[at]])))
        common = hits[ends] - hits[ends - length]
        self.mark[own] = False
        union = self.n[p] + self.n[ids] - common
        self.compared += len(ids)
        for x in ids[100 * common >= self.percent * union].tolist():
            a, b = self.find(p), self.find(x)
            self.root[max(a, b)] = min(a, b)
        return 1 - common / union

    def divide(self, ids: np.ndarray) -> None:
        if len(ids) <= self.small:
            return self.compare(ids, np.zeros((0, len(ids))))
        pivots, far = [], np.full(len(ids), np.inf)
        table = np.empty((self.k, len(ids)))
        for k in range(self.k):  # each next pivot is the one farthest from those before
            p = int(np.argmax(far))
            pivots.append(p)
            table[k] = self.distances(int(ids[p]), ids)
            far = np.minimum(far, table[k])
        if len(set(self.roots(ids).tolist())) == 1:
            return None
        home, nearest = np.argmin(table, 0), far
        near = nearest < 1 - self.r
        regions = [np.flatnonzero(((home == k) & near) | ((table[k] <= nearest + self.r) & (table[k] < 1))) for k in range(self.k)]
        regions.append(np.flatnonzero(~near))
        for own in regions:
            if len(own) > 1 and len(set(self.roots(ids[own]).tolist())) > 1:
                if len(own) <= len(ids) * 0.7:
                    self.divide(ids[own])
                else:
                    self.compare(ids[own], table[:, own])
        return None

    def compare(self, ids: np.ndarray, table: np.ndarray) -> None:
        """Each with those after it that aren't connected with it, unless their sizes or a pivot keep them apart."""
        order = np.argsort(self.n[ids], kind="stable")
        ids, table = ids[order], table[:, order]
        n, roots = self.n[ids], self.roots(ids)
        for i in range(len(ids) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // self.percent, "right"))
            rest = np.arange(i + 1, end)
            rest = rest[roots[rest] != roots[i]]
            if len(rest) and len(table):
                rest = rest[(np.abs(table[:, rest] - table[:, i : i + 1]) <= self.r).all(0)]
            if len(rest):
                self.distances(int(ids[i]), ids[rest])
                roots = self.roots(ids)

    def links(self) -> list[tuple[int, int]]:
        """A star for each component of two nodes or more."""
        least: dict[int, int] = {}
        for i, node in enumerate(self.nodes):
            r = self.find(i)
            least[r] = min(least.get(r, node), node)
        return [(least[self.find(i)], node) for i, node in enumerate(self.nodes) if least[self.find(i)] != node]


def join_regions(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within blocks (block, node, n, shingles) that fit a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs_of(batches, "block"):
            seen = {r["node"]: r for r in rows}
            links = Region(list(seen), [r["n"] for r in seen.values()], [climbed(r["shingles"]).tobytes() for r in seen.values()], percent).links() if len(seen) > 1 else []
            if links:
                yield pa.RecordBatch.from_pydict({"a": [x[0] for x in links], "b": [x[1] for x in links]})

    return blocks.select("block", "node", "n", "shingles").repartition("block").sortWithinPartitions("block").mapInArrow(run, "a bigint, b bigint")


def divide(heavy: DataFrame, percent: int, level: int, k: int = 16) -> tuple[DataFrame, DataFrame]:
    """One level of Voronoi regions for heavy blocks: links to pivots, and the regions as blocks of the next level."""
    r = 1 - percent / 100 + 1e-9
    rank = Window.partitionBy("block").orderBy("at", "node")
    chosen = heavy.withColumn("at", F.xxhash64("node", F.lit(level))).withColumn("i", F.row_number().over(rank)).filter(F.col("i") <= k)  # Spark keeps only the first k of each task
    pivots = small(materialise(chosen.groupBy("block").agg(F.collect_list(F.struct("node", "n", "shingles")).alias("pivots")), "pivots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            out = []
            for row in b.to_pylist():
                own = climbed(row["shingles"])
                common = [len(np.intersect1d(own, climbed(p["shingles"]), assume_unique=True)) for p in row["pivots"]]
                union = [row["n"] + p["n"] - c for p, c in zip(row["pivots"], common, strict=True)]
                d = [1 - c / u for c, u in zip(common, union, strict=True)]
                nearest = min(d)
                cells = [i for i, x in enumerate(d) if (x == nearest and x < 1 - r and i == d.index(nearest)) or (x <= nearest + r and x < 1)]
                cells += [len(d)] if nearest >= 1 - r else []
                linked = [p["node"] for p, c, u in zip(row["pivots"], common, union, strict=True) if 100 * c >= percent * u and p["node"] != row["node"]]
                out.append({"node": row["node"], "n": row["n"], "shingles": row["shingles"], "linked": linked, "cells": [{"block": hash((row["block"], level, i)) & ((1 << 62) - 1), "d": d[i] if i < len(d) else 1.0} for i in cells]})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("node", pa.int64()), ("n", pa.int64()), ("shingles", pa.binary()), ("linked", pa.list_(pa.int64())), ("cells", pa.list_(pa.struct([("block", pa.int64()), ("d", pa.float64())])))]))

    placed = heavy.join(pivots, "block").select("block", "node", "n", "shingles", "pivots").mapInArrow(run, "node bigint, n bigint, shingles binary, linked array<bigint>, cells array<struct<block:bigint,d:double>>")
    placed = materialise(placed, "regions")
    links = placed.select(F.explode("linked").alias("a"), F.col("node").alias("b"))
    cells = placed.select("node", "n", "shingles", F.explode("cells").alias("c")).select("c.block", "c.d", "node", "n", "shingles")
    # Those within r of a region's pivot are connected; they are needed only as far as others may link to them.
    open_ = cells.filter(F.col("d") > r).groupBy("block").agg(F.min("d").alias("nearest"))
    return links, cells.join(open_, "block").filter(F.col("d") >= F.col("nearest") - r).select("block", "node", "n", "shingles")


def in_pairs(heavy: DataFrame, weight: DataFrame, most: int) -> DataFrame:
    """Blocks that stayed heavy, as blocks for each two of their parts: any two nodes meet in one of them."""
    parts = weight.withColumn("parts", F.ceil(2 * F.col("weight") / most).cast("int"))
    own = heavy.join(parts, "block").withColumn("i", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    two = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return two.select(F.xxhash64("block", F.least("i", "j"), F.greatest("i", "j")).alias("block"), "node", "n", "shingles")


def linked(nodes: DataFrame, sets: Callable[[DataFrame], DataFrame], percent: int, most: int = 2_000_000, levels: int = 3) -> DataFrame:
    """Links (a, b) of all unsettled nodes that connect what is connected by pairs of J >= percent / 100; ``sets`` adds shingles to nodes of blocks."""
    region = nodes.select("node", F.explode("pivots").alias("pivot"))
    hubs = region.groupBy("pivot").agg(F.min("node").alias("hub"), F.max("node").alias("other")).filter("hub < other").select("pivot", "hub")
    near = materialise(region.join(hubs, "pivot").select(F.col("hub").alias("a"), F.col("node").alias("b")).filter("a <> b").distinct(), "met")
    blocks = components(near).select("node", F.col("root").alias("block")).join(nodes.select("node", "n"), "node")
    blocks = materialise(blocks, "blocks")
    swept(nodes.sparkSession)
    found = []
    for level in range(levels + 1):
        weights = blocks.groupBy("block").agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("size")).filter("size > 1")
        weights = materialise(weights, "weights")
        heavy = weights.filter(F.col("weight") > most)
        light = blocks.join(weights.filter(F.col("weight") <= most).select("block"), "block", "left_semi")
        found.append(join_regions(light if level else sets(light), percent))
        if not heavy.limit(1).count():
            break
        own = blocks.join(heavy.select("block"), "block", "left_semi")
        own = own if level else materialise(sets(own), "heavy")
        if level == levels:
            found.append(join_regions(in_pairs(own, heavy, most), percent))
        else:
            links, blocks = divide(own, percent, level)
            found.append(links)
            blocks = materialise(blocks, "blocks")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = materialise(out, "links")
    # The kernels of one level give stars that share no node; only several levels need to be connected again.
    return out if len(found) == 1 else components(out).filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def jaccard_components(docs: DataFrame, *, text: str = "text", k: int = 5, percent: int = 80, most: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links reach) of every document."""
    row = free(docs, "__row")
    rows = identified(docs.select("doc_id", text), row)
    all_docs = materialise(members(rows, text, k, row), "members")
    bits = bucket_bits(all_docs.agg(F.sum("n_shingles")).first()[0] or 0)
    per_node = materialise(all_docs.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("kept")), "nodes")
    copied = small(materialise(per_node.filter("copies > 1").select("node", "kept"), "copied"))
    again = all_docs.join(copied, "node").filter("row <> kept").select(F.col("row").alias(row))
    once = without(rows, again, row)  # one text of each set: its shingles are owned by a batch's number alone
    nodes = materialise(unsettled(shared(postings(once, text, k, bits), bits), percent, bits), "unsettled")
    swept(docs.sparkSession)
    kept = per_node.select("node", F.col("kept").alias(row))
    links = linked(nodes, lambda blocks: sets_of(rows, blocks.join(kept, "node").select(row, "block"), text, k, row), percent, most)
    swept(docs.sparkSession)
    star = links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
    rooted = per_node.join(star, "node", "left").withColumn("root", F.coalesce("root", "node"))
    by_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("copies").alias("size")).filter("size > 1").select("root", "component_id")
    named = rooted.join(by_root, "root").select("node", "component_id")
    return all_docs.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
