"""Byte-level BPE by dynamic matching instead of merging.

Every vocabulary entry is mapped byte by byte to Latin-1 and put into one Aho-Corasick automaton.  A word
is encoded from left to right: the automaton gives how far entries can reach from here; take the longest, keep it if it may stand next to its
predecessor, else a shorter one, else step back.  Two entries may be neighbours exactly when merging their
joined bytes by rank gives those two entries again; that answer is memoised per pair.  A segmentation whose
neighbours are all compatible is the one that rank-ordered merging yields, and a position that failed once is
never tried again, so a word takes time linear in its length.

Results for odd input: a null text counts as empty and gives no ids; repeated rows are encoded each on its
own; texts of any length are handled piece by piece; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from vellum.llm.common import KEPT, release, slices

# Unicode White_Space, which is what \s means to the reference pattern (fixed values).
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def load_ranks(path: str) -> dict[bytes, int]:
    """Entries and ranks of a ``.tiktoken`` file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


#: Later than any merge.
NEVER = 1 << 60


class Memo(dict):
    """A function's answers, at most ``keep`` of them at a time; texts over ``longest`` characters aren't kept, so its bytes are bounded too.

    When half of them are new, they become the old ones, and the old ones that nobody asked for since go: frequent keys stay.
    """

    def __init__(self, f: Callable, keep: int, longest: int = 64):
        super().__init__()
        self.f, self.keep, self.longest, self.old = f, keep, longest, {}

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.f(key)
            if isinstance(key, str) and len(key) > self.longest:
                return value
        if len(self) >= self.keep // 2:
            self.old = dict(self)
            super().clear()
        self[key] = value
        return value

    def clear(self):
        super().clear()
        self.old = {}


class Codec:
    """Encodes and decodes with one vocabulary; ``keep`` bounds each memo."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, keep: int = 300_000):
        self.ranks, self.keep = ranks, keep
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"(?!\S)", f"(?=[{SPACE}]|\\Z)").replace(r"\s", f"[{SPACE}]"))
        self.width = width = max(ranks.values()) + 1
        self.word = [b""] * width
        for entry, rank in ranks.items():
            self.word[rank] = entry
        self.longest = max(map(len, ranks))
        self.pairs = Memo(lambda pair: self.compatible(divmod(pair, width)), keep)  # a pair as one number takes half the memory
        self.known = Memo(self.match, keep)
        self.entries: dict[str, int] = {}
        self.halves = array("i", [-1]) * width, array("i", [-1]) * width  # what an entry is merged from
        for entry, rank in ranks.items():
            last = self.merged(entry, whole=False)
            if len(last) == 2:
                self.halves[0][rank], self.halves[1][rank] = last
            if len(last) < 3:  # others are never the outcome of merging
                self.entries[entry.decode("latin-1")] = rank
        self.automaton = ahocorasick.Automaton()
        for entry, rank in self.entries.items():
            self.automaton.add_word(entry, rank)
        self.automaton.make_automaton()
        self.lengths = np.fromiter(map(len, self.word), np.int64, width)
        self.starts = np.concatenate(([0], np.cumsum(self.lengths)[:-1]))
        self.bytes = np.frombuffer(b"".join(self.word), np.uint8)

    @property
    def size(self) -> dict[int, int]:
        """The length of every entry."""
        return {i: len(b) for b, i in self.ranks.items()}

    def merged(self, word: bytes, whole: bool = True) -> list[int]:
        """Rank-ordered merging of a short byte string, the definition that everything else must meet; not ``whole``: without a last merge."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > (1 if whole else 2):
            best = min(range(len(parts) - 1), key=lambda i: self.ranks.get(parts[i] + parts[i + 1], NEVER))
            if parts[best] + parts[best + 1] not in self.ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, entry: int, side: int) -> list[tuple[bytes, int, int]]:
        """While an entry is built up, its first (``side`` 0) or last (1) part changes: each such part, when it appears and when it is gone."""
        found, gone, halves = [], NEVER, self.halves[side]
        while (deeper := halves[entry]) >= 0:
            found.append((self.word[entry], entry, gone))
            gone, entry = entry, deeper
        found.append((self.word[entry], -1, gone))
        return found

    def compatible(self, pair: tuple[int, int]) -> bool:
        """Whether two entries can be neighbours in a result: no merge across their border comes first.

        Of merges with one rank the leftmost is done first, so the left part goes before such a merge.
        """
        ranks, heads = self.ranks, self.parts(pair[1], 0)
        for a, born, gone in self.parts(pair[0], 1):
            for b, born_b, gone_b in heads:
                if born < gone_b and born_b < gone and (across := ranks.get(a + b)) is not None and across < gone and across <= gone_b:
                    return False
        return True

    def piece(self, word: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        n, entries, latin, pairs, width, most = len(word), self.entries, word.decode("latin-1"), self.pairs, self.width, self.longest
        reach = self.automaton.longest_prefix
        taken: list[int] = []
        starts = [0]
        lengths = [reach(latin[:most])]  # of each open position, the lengths not yet tried
        dead = bytearray(n + 1)
        while (at := starts[-1]) < n:
            last, k = taken[-1] if taken else -1, lengths[-1]
            while k:
                if (rank := entries.get(latin[at : at + k])) is not None and not dead[at + k] and (last < 0 or pairs[last * width + rank]):
                    break
                k -= 1
            if k:
                lengths[-1] = k - 1
                taken.append(rank)
                starts.append(at + k)
                lengths.append(reach(latin[at + k : at + k + most]) if at + k < n else 0)
            else:
                dead[at] = 1
                if not taken:
                    raise ValueError("a byte of the text isn't in the vocabulary")
                starts.pop()
                lengths.pop()
                taken.pop()
        return taken

    def match(self, text: str) -> str:
        """Decimal ids, joined by commas, of one match of the pattern."""
        return ",".join(map(str, self.piece(text.encode("utf-8", "surrogatepass"))))

    def encode(self, text: str) -> tuple[str, np.ndarray]:
        """The ids of a whole text: decimal and joined by commas, and as integers."""
        decimal = ",".join(map(self.known.__getitem__, self.pattern.findall(text)))
        return decimal, np.fromstring(decimal, np.uint32, sep=",") if decimal else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for."""
        n = self.lengths[ids]
        ends = np.cumsum(n)
        if not len(ids):
            return b""
        at = np.repeat(self.starts[ids] - (ends - n), n) + np.arange(ends[-1])
        return self.bytes[at].tobytes()


_codecs: dict[tuple[str, str], Codec] = KEPT.setdefault("bpe", {})


def codec(path: str, pattern: str) -> Codec:
    """The worker's own codec; built once per process."""
    if (key := (path, pattern)) not in _codecs:
        _codecs[key] = Codec(load_ranks(path), pattern)
    return _codecs[key]


#: What can be asked of :func:`tokenise`, with Spark types.
OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_sha256": "string", "decoded": "binary", "decoded_sha256": "string"}


def tokenise(df: DataFrame, ranks_path: str, pattern: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode ``text`` of every row and decode the ids again; returns ``keep`` and the ``outputs`` asked for.

    ``ids`` are the token ids, ``decoded`` the bytes that these ids give; the digests are of both.
    """
    if unknown := set(outputs) - set(OUTPUTS):
        raise ValueError(f"unknown outputs: {sorted(unknown)}")
    narrow = df.select(*keep, df[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1]] + [f"{o} {OUTPUTS[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern)
        kinds = {"array<int>": pa.list_(pa.int32()), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        for batch in slices(batches):
            made: dict[str, list] = {o: [] for o in outputs}
            for t in batch.column("__text"):
                decimal, ids = c.encode(t.as_py() or "")
                back = c.decode(ids) if "decoded" in made or "decoded_sha256" in made else b""
                for o, values in made.items():
                    values.append(
                        ids.astype(np.int32) if o == "ids" else len(ids) if o == "n_tokens" else hashlib.sha256(decimal.encode()).hexdigest() if o == "ids_sha256" else back if o == "decoded" else hashlib.sha256(back).hexdigest()
                    )
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(made[o], kinds[OUTPUTS[o]]) for o in outputs)], names=[*batch.schema.names[:-1], *outputs])
        c.known.clear()
        release("bpe")

    return narrow.mapInArrow(run, schema)
