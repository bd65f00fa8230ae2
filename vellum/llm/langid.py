"""Language identification, word first with backoff to shorter and shorter character n-grams.

Learning counts every word of every text with a known language, over the whole corpus: words are counted in each
task, then summed.  The model holds, for each language, log relative frequencies of its most frequent words and, for each length from ``longest`` down to 1,
of its most frequent n-grams (of words with a mark at either end): those over the least count that leaves at most ``words`` or ``grams`` of them, which a table of how many
have each count tells, so nothing is ever sorted.  What one language keeps has its true frequency in all.  The model's size is bounded, whatever the corpus; what the bound
costs is in the README.

A known word scores by its log frequency in each language.  An unseen word is scored by its n-grams of the greatest length of which any is known, in the mean.  A
text's language has the largest sum, and the score is that language's posterior after the mean over words, so it doesn't saturate with length.

A null text, or one without a letter, gives ``und`` with score 0; so does every text when nothing could be learned.  Ties go to the alphabetically
first language.  Repeated rows are predicted each; null languages aren't learned from; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import Memo
from vellum.llm.common import materialise, release, slices

WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def has_letter(words: list[str]) -> bool:
    """Numbers such as fractions match the pattern but are no letters."""
    return any(c.isalpha() for w in words for c in w)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def counted(docs: DataFrame, flush: int = 200_000) -> DataFrame:
    """lang, word, n over all rows: summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, Counter] = {}

        def out() -> pa.RecordBatch:
            rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "word", "n"])

        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(words_of(text or ""))
            if sum(map(len, counts.values())) > flush:
                yield out()
        if counts:
            yield out()

    return docs.select("text", "lang").mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def gram_counts(words: DataFrame, longest: int) -> DataFrame:
    """lang, size, gram, n from word counts."""
    marked = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    sizes = F.explode(F.sequence(F.lit(1), F.lit(longest))).alias("size")
    each = words.select("lang", "n", marked.alias("m"), sizes).filter(F.length("m") >= F.col("size"))
    cut = F.explode(F.transform(F.sequence(F.lit(1), F.length("m") - F.col("size") + 1), lambda i: F.substring(F.col("m"), i, F.col("size"))))
    return each.select("lang", "size", "n", cut.alias("gram")).groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies by language of words and n-grams; what a language lacks gets its floor."""

    def __init__(self, langs: list[str], words: dict[str, tuple[float, ...]], grams: list[dict[str, tuple[float, ...]]]):
        self.langs, self.words, self.grams = langs, words, grams
        self.memo = Memo(self.scores, 200_000)

    def __reduce__(self) -> tuple:
        return Model, (self.langs, self.words, self.grams)

    def scores(self, word: str) -> tuple[float, ...]:
        return self.words.get(word) or self.unseen(word)

    def unseen(self, word: str) -> tuple[float, ...]:
        for n in range(len(self.grams), 0, -1):
            known = [g for g in map(self.grams[n - 1].get, grams_of(word, n)) if g]
            if known:
                return tuple(sum(x) / len(known) for x in zip(*known, strict=True))
        return (0.0,) * len(self.langs)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            words = words_of(text or "")
            if not words or not self.langs or not has_letter(words):
                out.append((UNKNOWN, 0.0))
                continue
            total = np.array(list(map(self.memo.__getitem__, words))).mean(0)
            best = int(np.argmax(total))
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def frequent(counts: DataFrame, by: list[str], key: str, most: int) -> DataFrame:
    """Rows (``by``, ``key``, n) of the keys that any language keeps: in each group those over the least count that at most ``most`` exceed.

    The cut comes from a table of counts of counts, which stays small; kept keys then meet all counts again, so a key has its true count in every language.
    """
    sizes = counts.groupBy(*by, "n").agg(F.count(F.lit(1)).alias("c"))
    above = F.sum("c").over(Window.partitionBy(*by).orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0))
    cuts = sizes.withColumn("above", above).filter(F.col("above") <= most).groupBy(*by).agg(F.min("n").alias("cut"))
    shared = [c for c in by if c != "lang"]
    kept = counts.join(F.broadcast(cuts), by).filter("n >= cut").select(*shared, key).distinct()  # a row for each language and length
    return counts.join(kept, [*shared, key], "left_semi")


def learn(docs: DataFrame, *, words: int = 30_000, grams: int = 8_000, longest: int = 5) -> Model:
    """Count all rows whose lang is not null, keep each language's most frequent words and n-grams."""
    counts = materialise(counted(docs.filter("lang IS NOT NULL")), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    best = frequent(counts, ["lang"], "word", words).select("lang", F.lit(0).alias("size"), F.col("word").alias("key"), "n")
    pieces = materialise(gram_counts(counts, longest), "grams")
    ranked = frequent(pieces, ["lang", "size"], "gram", grams).select("lang", "size", F.col("gram").alias("key"), "n")
    rows = best.unionByName(ranked).toArrow().to_pylist()  # bounded by the three parameters and the square of the number of languages
    langs = sorted(totals)
    at = {lang: i for i, lang in enumerate(langs)}
    tables: list[dict[str, list[float]]] = [{} for _ in range(longest + 1)]
    mass = np.zeros((longest + 1, len(langs)))
    for r in rows:
        mass[r["size"], at[r["lang"]]] += r["n"]
    mass[0] = [totals[lang] for lang in langs]
    floor = np.log(0.5 / np.maximum(mass, 1))
    for r in rows:
        size, i = r["size"], at[r["lang"]]
        tables[size].setdefault(r["key"], floor[size].tolist())[i] = float(np.log(r["n"] / mass[size, i]))
    frozen = [{k: tuple(v) for k, v in t.items()} for t in tables]
    return Model(langs, frozen[0], frozen[1:])


def predict(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score of every row."""
    narrow = docs.select(*[docs[c] for c in keep], docs[text].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, by the bounds of learn()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in slices(batches):
            found = own.predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])
        release()

    return narrow.mapInArrow(run, f"{kept}, lang_pred string, score double")
