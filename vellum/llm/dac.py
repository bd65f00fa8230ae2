"""Token-id files with directly addressable codes.

Each id is split into 8-bit chunks, lowest first.  Level k holds the k-th chunks of all ids that have one, and
a bitmap beside it marks the chunks that go on in level k + 1; a rank directory counts the marks before every
512th bit.  Token i is read by taking its chunk in level 0 and, while the mark is set, going to place
rank(i) of the next level: no block is decoded, whatever token is asked for.

Each row is a document of its own: repeated doc_ids keep a row each, in an order that their ids fix; a null
doc_id comes first; a null or empty text has no ids but the end id.  An empty table gives no files and an
empty result.  A file holds at most ``tokens_per_file`` ids and one document more, so memory is bounded.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise, release, shared_dir, slices

MAGIC = b"VDAC0001"
BLOCK = 512
# Unicode White_Space (fixed values).
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")

#: How the library writes bytes that aren't printable Latin-1: from U+0100 on, in order.
ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}

#: Marks that are one match together wherever they follow letters.
TAIL = ".,;:!?%$#&*|()"

#: What a byte is, as bits: neighbours that share one stay together.
LETTER, DIGIT, MARK, SPACE = 1, 2, 4, 8
KINDS = np.array([SPACE if b in b"\t\n\v\f\r " else MARK if b in TAIL.encode() else DIGIT if b in b"0123456789" else LETTER if b < 128 and chr(b).isalpha() else LETTER | DIGIT | MARK for b in range(256)], np.uint8)
#: Capital letters of ASCII as small ones.
SMALL = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: The first n bytes of eight.
BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: So many bytes of a word and their number are two integers.
SHORT = 15
#: So many words are looked up together.
STEP = 1 << 16


def pack(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of (chunks, bitmap, rank directory); the last has no marks."""
    rest, levels = ids.astype(np.uint32), []
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), BLOCK), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate(([0], np.cumsum(per_block))).astype("<u8")
        levels.append(((rest & 255).astype(np.uint8), bits, ranks))
        if not more.any():
            return levels
        rest = rest[more] >> 8


def dump(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: header, documents (id, whether it has one, first token), levels."""
    levels = pack(ids)
    known = np.array([d is not None for d in doc_ids], np.uint8)
    firsts = np.concatenate(([0], np.cumsum(sizes))).astype("<u8")
    out = [MAGIC, struct.pack("<QQQ", len(ids), len(doc_ids), len(levels)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), firsts.tobytes()]
    for chunks, bits, ranks in levels:
        out += [struct.pack("<QQQ", len(chunks), len(bits), len(ranks)), chunks.tobytes(), bits.tobytes(), ranks.tobytes()]
    return b"".join(out)


class Reader:
    """Random access to the tokens of one file's bytes."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n_tokens, n_docs, n_levels = struct.unpack_from("<QQQ", data, 8)
        at = 32

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        numbers, known = take("<i8", n_docs), take("u1", n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(numbers, known, strict=True)]
        self.firsts = take("<u8", n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            sizes = struct.unpack_from("<QQQ", data, at)
            at += 24
            self.levels.append((take("u1", sizes[0]), take("u1", sizes[1]), take("<u8", sizes[2])))

    def token(self, i: int) -> int:
        """The i-th id of the file."""
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            i, shift = self.rank(bits, ranks, i), shift + 8
        return value

    @staticmethod
    def rank(bits: np.ndarray, ranks: np.ndarray, i: int) -> int:
        """Marks before bit i: the directory's count, and those since its last entry."""
        block = i // BLOCK
        return int(ranks[block]) + int(np.unpackbits(bits[block * BLOCK // 8 : (i + 7) // 8], bitorder="little")[: i - block * BLOCK].sum())

    def span(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop, level by level."""
        value, places, shift = np.zeros(stop - start, np.uint32), np.arange(stop - start), 0
        for chunks, bits, ranks in self.levels:
            value[places] |= chunks[start:stop].astype(np.uint32) << np.uint32(shift)
            marks = np.unpackbits(bits[start >> 3 : (stop + 7) >> 3], bitorder="little")[start & 7 :][: stop - start].view(bool)
            places = places[marks]
            if not len(places):
                break
            start = self.rank(bits, ranks, start)
            stop, shift = start + len(places), shift + 8
        return value


def cut(data: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and sizes of the words of texts that begin at ``firsts``."""
    kinds = KINDS[data]
    starts = np.ones(len(data), bool)
    np.equal(kinds[1:] & kinds[:-1], 0, out=starts[1:])
    starts[firsts[firsts < len(data)]] = True
    at = np.flatnonzero(starts)
    sizes, word = np.diff(at, append=len(data)), kinds[at] != SPACE
    return at[word], sizes[word]


def keys(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words there as two integers, of their bytes and their size; ``data`` goes on for 16 bytes behind the last word's beginning."""
    eight = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    return eight[at] & BYTES[np.minimum(sizes, 8)], eight[at + 8] & BYTES[np.maximum(sizes - 8, 0)] | sizes.astype(np.uint64) << np.uint64(56)


def spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` numbers from each start on."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - ends + counts, counts)
    out += np.arange(len(out))
    return out


class Encoder:
    """Ids of texts from a ``tokenizers`` file whose matches never cross white space; ids of words are memoised, ``keep`` words at most and one step more.

    Texts are cut between letters, digits, marks of TAIL and white space, all of ASCII: there the library's matches end too.  Any other character stays with its neighbours.
    Words of SHORT bytes at most are two integers, equal for equal words only, in a hash table of arrays, so a step's words are looked up together.
    """

    def __init__(self, path: str, keep: int = 1_300_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.keep = keep
        #: Ids go about in two bytes each where the vocabulary allows it.
        self.kind = "<u2" if max(self.tokenizer.get_vocab().values()) < 1 << 16 else "<u4"
        self.bits = ((keep + STEP) * 3 // 2).bit_length()
        self.low, self.high, self.place = (np.zeros(1 << self.bits, np.uint64) for _ in range(3))
        self.long: dict[bytes, bytes] = {}
        self.tails: dict[str, list[int]] = {}
        self.clear()

    def clear(self) -> None:
        self.high.fill(0)  # a slot without a word: words have a size
        self.pool, self.filled, self.known = np.zeros(1 << 16, self.kind), 0, 0
        self.long.clear()
        self.tails.clear()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as ``kind`` says."""
        ids, sizes = self.ids(pa.array(texts, pa.large_string()))
        ends = np.cumsum(sizes).tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (null: empty) behind each other, and how many each text has."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        firsts = np.frombuffer(texts.buffers()[1], "<i8", n + 1, 8 * texts.offset) if n else np.zeros(1, np.int64)
        size = int(firsts[-1] - firsts[0])
        data = np.zeros(size + 16, np.uint8)
        if size:
            data[:size] = np.frombuffer(texts.buffers()[2], np.uint8, size, int(firsts[0]))
        firsts = firsts - firsts[0]
        at, sizes = cut(data[:size], firsts)
        small, parts, counts = SMALL[data], [np.zeros(0, self.kind)], [np.zeros(1, np.int64)]
        for i in range(0, len(at), STEP):
            part, count = self.step(data, small, at[i : i + STEP], sizes[i : i + STEP])
            parts.append(part)
            counts.append(count)
        ends = np.cumsum(np.concatenate(counts))
        return np.concatenate(parts), np.diff(ends[np.searchsorted(at, firsts)])

    def step(self, data: np.ndarray, small: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words there behind each other, and how many each word has; ``small`` is ``data`` in small letters."""
        if self.known > self.keep:
            self.clear()
        short = np.where(sizes > SHORT, 0, sizes)
        low, high = keys(small, at, short)
        # the library composes letters before it makes them small, so only words all of ASCII are made small here
        other = np.flatnonzero((low | high) & np.uint64(0x8080808080808080))
        low[other], high[other] = keys(data, at[other], short[other])
        slots, new = self.find(low, high, np.flatnonzero(short))
        base = int(at[0])
        blob = data[base : at[-1] + sizes[-1]].tobytes()
        bare = lambda these: [blob[a:b] for a, b in zip((at[these] - base).tolist(), (at[these] - base + sizes[these]).tolist(), strict=True)]
        if len(new):
            self.add(slots[new], self.learn([w.decode() for w in bare(new)]))
        place, long = self.place[slots], np.flatnonzero(short == 0)
        spelt = self.spell(bare(long))
        starts, counts = (place >> np.uint64(32)).astype(np.int64), (place & np.uint64(0xFFFFFFFF)).astype(np.int64)
        counts[long] = [len(x) // self.pool.itemsize for x in spelt]
        begins = np.cumsum(counts) - counts
        out = self.pool.take(spans(starts, counts), mode="clip")  # long words have no place in the pool
        out[spans(begins[long], counts[long])] = np.frombuffer(b"".join(spelt), self.kind)
        return out, counts

    def find(self, low: np.ndarray, high: np.ndarray, these: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the words ``these``, and one of each word that wasn't there and has a slot from now on."""
        h = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        h = (h ^ h >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15)
        slots, last = (h >> np.uint64(64 - self.bits)).astype(np.int64), len(self.high) - 1
        left, free, new = these, [], [these[:0]]
        while len(left):
            s = slots[left]
            held = self.high[s]
            left, empty = left[(held != high[left]) | (self.low[s] != low[left])], left[held == 0]
            free.append(empty)
            left = left[self.high[slots[left]] != 0]
            slots[left] = slots[left] + 1 & last
        left = np.concatenate([these[:0], *free])
        while len(left):
            ask = left[self.high[slots[left]] == 0]
            self.place[slots[ask]] = ask  # one of those that ask for a slot gets it
            got = ask[self.place[slots[ask]] == ask.astype(np.uint64)]
            self.high[slots[got]], self.low[slots[got]] = high[got], low[got]
            new.append(got)
            s = slots[left]
            left = left[(self.high[s] != high[left]) | (self.low[s] != low[left])]
            slots[left] = slots[left] + 1 & last
        return slots, np.concatenate(new)

    def add(self, slots: np.ndarray, found: list[list[int]]) -> None:
        """Keep the ids of the words that got these slots."""
        counts = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.kind, int(counts.sum()))
        end = self.filled + len(ids)
        if end > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(end, self.kind)))
        self.pool[self.filled : end] = ids
        self.place[slots] = (self.filled + np.cumsum(counts) - counts << 32 | counts).astype(np.uint64)
        self.filled, self.known = end, self.known + len(found)

    def spell(self, words: list[bytes]) -> list[bytes]:
        """Ids of words over SHORT bytes, which may have white space that isn't ASCII's; each counts as many as it is long."""
        parts = {w: [w] if (t := w.decode()).split() == [t] else [x.encode() for x in SPACES.split(t)] for w in set(words) - self.long.keys()}
        new = list(set(chain.from_iterable(parts.values())) - self.long.keys())
        self.long.update(zip(new, (array(self.pool.dtype.char, x).tobytes() for x in self.learn([w.decode() for w in new])), strict=True))
        self.known += sum(1 + len(w) // SHORT for w in new)
        return [self.long[w] if w not in parts else b"".join(map(self.long.__getitem__, parts[w])) for w in words]

    def learn(self, new: list[str]) -> list[list[int]]:
        """Ids of words from the library.

        A run of Latin letters and the marks behind it are matches of their own, and lower-casing is what the library does first; so the letters,
        byte by byte in its alphabet, go to the library's model at once.
        """
        tokens, whole, out = self.tokenizer.model.tokenize, [], []
        for i, w in enumerate(new):
            if w.isascii() and w.isalpha():
                out.append([t.id for t in tokens(w.lower())])
            elif (core := w.rstrip(TAIL)).isalpha() and max(core) < "\u0100":
                ids = [t.id for t in tokens(core.lower().encode().decode("latin-1").translate(ALPHABET))]
                out.append(ids + self.tail(w[len(core) :]) if len(core) < len(w) else ids)
            else:
                whole.append(i)
                out.append([])
        for at in range(0, len(whole), 4096):
            part = whole[at : at + 4096]
            for i, e in zip(part, self.tokenizer.encode_batch_fast([new[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out

    def tail(self, marks: str) -> list[int]:
        if marks not in self.tails:
            self.tails[marks] = self.tokenizer.encode(marks, add_special_tokens=False).ids
        return self.tails[marks]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (any that pyarrow knows)."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put(uri: str, data: bytes) -> None:
    """Write a file under another name, then rename it: readers and repeated tasks see it whole or not at all."""
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    context = TaskContext.get()
    own = f"{path}.{context.taskAttemptId() if context else 0}.part"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def get(uri: str) -> bytes:
    fs, path = store(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def encoded(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """doc_id, tie, kind, ids (with the end id, as integers of that kind) of every text, in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        for batch in slices(batches):
            ids, sizes = enc.ids(batch.column(1))
            ends, n = np.cumsum(sizes), len(sizes)
            ids = np.insert(ids, ends, end_id)
            offsets = pa.array(np.concatenate(([0], ends + np.arange(1, n + 1))) * ids.itemsize, pa.int32())  # fails where they don't fit
            packed = pa.Array.from_buffers(pa.binary(), n, [None, offsets.buffers()[1], pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([enc.kind] * n, pa.string()), packed], names=["doc_id", "kind", "ids"])
        release()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, kind string, ids binary")
    return rows.select("doc_id", F.xxhash64("ids").alias("tie"), "kind", "ids")


def ranged(rows: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """``rows`` (doc_id, tie, ...) in ``n`` partitions by ranges of doc_id, sorted within them.

    The bounds come from the doc_ids of ``docs`` alone, so nothing is encoded twice.  A doc_id (or null) that fills several ranges is parted among them by tie.
    """
    at = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    found = docs.select(at.alias("at")).agg(F.percentile_approx("at", [i / n for i in range(1, n)], 100 * n)).first()[0] if n > 1 else []
    bounds = F.array(*[F.lit(b) for b in found or []]).cast("array<bigint>")
    first = F.size(F.filter(bounds, lambda b: b < F.col("at")))
    equal = F.size(F.filter(bounds, lambda b: b == F.col("at")))
    share = F.least(F.floor((F.col("tie") / F.lit(2.0**64) + 0.5) * (equal + 1)).cast("int"), equal)
    placed = rows.withColumn("at", at).withColumn("part", first + F.when(equal > 1, share).otherwise(0))
    return placed.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions("at", "tie", "ids").drop("at", "part")


def write(rows: DataFrame, docs: DataFrame, path: str, *, tokens_per_file: int = 4_000_000) -> DataFrame:
    """Write what :func:`encoded` gave for ``docs`` in ascending doc_id order; returns one row for each file.

    Ids take half the space of their texts, so they are what is dealt out.  Columns: part and seq (which order the files), file, n_docs, n_tokens.  Every attempt of a task writes files of its own
    name; those that a returned row names are complete.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, seq = context.partitionId(), 0
        ids: list[bytes] = []
        docs_here: list[int | None] = []
        held, kind = 0, "<u4"

        def flush() -> pa.RecordBatch:
            nonlocal seq, held
            sizes = np.array([len(x) // np.dtype(kind).itemsize for x in ids], np.int64)
            name = f"{path}/tokens-{part:06d}-{seq:05d}-{context.taskAttemptId()}.dac"
            put(name, dump(docs_here, sizes, np.frombuffer(b"".join(ids), kind)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "file": [name], "n_docs": [len(sizes)], "n_tokens": [int(sizes.sum())]})
            ids.clear()
            docs_here.clear()
            seq, held = seq + 1, 0
            return row

        for batch in slices(batches):
            kind = batch.column(1)[0].as_py()
            for doc_id, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(own)
                docs_here.append(doc_id)
                held += len(own) // np.dtype(kind).itemsize
                if held >= tokens_per_file:
                    yield flush()
        if ids:
            yield flush()
        release()

    ordered = ranged(rows, docs, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return ordered.select("doc_id", "kind", "ids").mapInArrow(run, "part bigint, seq bigint, file string, n_docs bigint, n_tokens bigint")


def documents(files: DataFrame) -> DataFrame:
    """Read token files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32 of each document.

    ``files`` is what :func:`write` returned, already materialised; it has one row for each file, so its running
    sum is a small step.
    """
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True):
                r = Reader(get(file))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(r.doc_ids, pa.int64()),
                        "start": pa.array(first + r.firsts[:-1], pa.int64()),
                        "n_tokens": pa.array(np.diff(r.firsts), pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(r.span(a, b).astype("<u4").tobytes()) for a, b in zip(r.firsts[:-1].tolist(), r.firsts[1:].tolist(), strict=True)], pa.int64()),
                    }
                )

    spread = placed.select("file", "first").repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "file")
    return spread.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def roundtrip(docs: DataFrame, tokenizer_path: str, *, end_id: int = 1) -> DataFrame:
    """Write all of ``docs`` to the shared folder and read the files back."""
    rows = encoded(docs, tokenizer_path, end_id=end_id)
    return documents(materialise(write(rows, docs, shared_dir(docs.sparkSession, "tokens")), "token-files"))
