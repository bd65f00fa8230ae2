"""Benchmark decontamination by a distributed positional inverted index, in DataFrame functions only.

Terms of the index are adjacent word pairs (single words only for one-word items), so that even text made of common words has
rare terms.  One pass over the documents stores the hash of every term at its position, whatever the benchmark; the postings (row, position, term) of the
terms that a benchmark has are drawn from it, and their frequencies counted over all documents.  Each test window starts from its rarest terms: their postings,
shifted by the terms' offsets, are candidate starts.  They are intersected with the offset-adjusted lists of all its terms.  Lists may be
shifted by up to ``slop`` words, and as many terms may be missing, as an edit breaks the pairs around it: exact phrases are matches without any shift
or missing term, the others are proximity matches.  A window is dropped at once only if the corpus lacks more terms than may be missing.

Terms are compared by 64-bit hashes: a false match would take wrong hashes of all terms of a window at their places in one text.

Words are runs of small letters, digits and characters beyond ASCII after A-Z are lower-cased.  A null or empty text has no words; an
item without words or with a null item_id takes no part; items with the same words share their windows; repeated documents each get their row.  Empty
tables give an empty result, or rows without hits where only the benchmark is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import materialise, small

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A dictionary of so many terms is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 1_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def windows(benchmark: DataFrame, size: int) -> DataFrame:
    """Windows of the items, one row for each distinct sequence of words: wid, n (words), terms array<struct<off, a, b>>, items array<string>.

    ``wid`` is a number, as it goes with every candidate; materialise the windows before they are used, so that it stays.
    """
    item = benchmark.filter("item_id IS NOT NULL").select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - size, F.lit(0))))
    each = item.select("item", "w", start.alias("j")).select("item", F.slice("w", F.col("j") + 1, F.lit(size)).alias("w"))
    n = F.size("w")
    pair = F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: F.struct(i.alias("off"), F.get("w", i).alias("a"), F.coalesce(F.get("w", i + 1), F.lit("")).alias("b")))
    return each.groupBy("w").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("wid"), n.alias("n"), pair.alias("terms"), "items")


def terms_of(wins: DataFrame) -> DataFrame:
    """wid, n, off, term for each window's terms; a term is the hash of its two words."""
    return wins.select("wid", "n", F.explode("terms").alias("t")).select("wid", "n", "t.off", F.xxhash64("t.a", "t.b").alias("term"))


def index(docs: DataFrame, text: str = "text", single: bool = False) -> DataFrame:
    """The stored index, of every word of every text, whatever will be asked: row, doc_id, n_words, terms, singles.

    ``terms`` holds the hash of each adjacent word pair at its position; ``singles`` those of single words, if items of one word are to be found too.
    Materialise it before it is used; any benchmark can be matched against it.
    """
    w = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col(text)).alias("w"))
    after = F.when(F.size("w") > 1, F.slice("w", 2, F.size("w"))).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.arrays_zip(F.slice("w", 1, F.size(after)).alias("a"), after.alias("b")), lambda x: F.xxhash64(x["a"], x["b"]))
    ones = F.transform("w", lambda x: F.xxhash64(x, F.lit(""))) if single else F.array().cast("array<bigint>")
    return w.select("row", "doc_id", F.size("w").alias("n_words"), pairs.alias("terms"), ones.alias("singles"))


def postings(stored: DataFrame, terms: DataFrame) -> DataFrame:
    """The postings (row, pos, term) of the terms that are asked for."""
    asked = small(materialise(terms.select("term").distinct(), "terms"), BROADCAST_TERMS)
    each = stored.select("row", F.posexplode("terms").alias("pos", "term"))
    ones = stored.filter(F.size("singles") > 0).select("row", F.posexplode("singles").alias("pos", "term"))
    return each.join(asked, "term").select("row", "pos", "term").unionByName(ones.join(asked, "term").select("row", "pos", "term"))


def matches(listed: DataFrame, terms: DataFrame, slop: int = 0) -> DataFrame:
    """Window matches in the postings: row, wid, start, n, exact (false: only by proximity).

    Proximity asks for all of a window's terms but ``slop`` of them, and but half of them at most, each within ``slop`` words of its place.  As an
    inserted word breaks one pair, and a deleted or replaced word two, slop 2 finds windows with any one of these.
    """
    freq = listed.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = terms.select("wid", "n", "off", "term").join(freq, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    by_window = Window.partitionBy("wid")
    ranked = ranked.withColumn("n_terms", F.count(F.lit(1)).over(by_window)).withColumn("absent", F.count_if(F.col("df") == 0).over(by_window))
    ranked = ranked.withColumn("spare", F.least(F.lit(slop), F.floor(F.col("n_terms") / 2))).filter("absent <= spare")
    ranked = ranked.withColumn("k", F.row_number().over(by_window.orderBy("df", "off")))
    ranked = materialise(ranked.select("wid", "n", "off", "term", "k", "n_terms", "spare"), "windows")

    # Of the spare + 1 rarest terms one at least is there, so their postings give all candidates.
    first = small(ranked.filter("k <= spare + 1").select("wid", "term", "off"))
    starts = listed.join(first, "term").select("row", "wid", (F.col("pos") - F.col("off")).alias("start")).distinct()
    # Places are cells of 2 * slop + 1 words: what is within slop of a place lies in two of them at most, so a candidate's terms are sent once or twice, not once for each shift.
    cell = lambda at: F.floor(at / F.lit(2 * slop + 1)).cast("int")
    place = F.col("start") + F.col("off")
    wanted = starts.join(small(ranked.select("wid", "off", "term")), "wid").select("row", "wid", "start", "term", place.alias("at"), F.explode(F.sequence(cell(place - slop), cell(place + slop))).alias("cell"))
    met = wanted.join(listed.withColumn("cell", cell(F.col("pos"))), ["row", "cell", "term"]).filter(F.abs(F.col("pos") - F.col("at")) <= slop)
    counted = met.groupBy("row", "wid", "start").agg(F.count_distinct("at").alias("near"), F.count_if(F.col("pos") == F.col("at")).alias("in_place"))
    return (
        counted.join(small(ranked.filter("k = 1").select("wid", "n", "n_terms", "spare")), "wid")
        .filter(F.col("near") >= F.col("n_terms") - F.col("spare"))
        .select("row", "wid", "start", "n", (F.col("in_place") == F.col("n_terms")).alias("exact"))
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = 10, slop: int = 2) -> DataFrame:
    """For every document: row, doc_id, n_words, n_hit, n_items, items (sorted ids), n_near_items.

    ``n_hit`` counts words inside exact windows, ``items`` have such windows, and ``n_near_items`` counts items that only match by proximity.
    """
    wins = materialise(windows(benchmark, window), "test-windows")
    terms = terms_of(wins)
    single = bool(wins.filter("n = 1").limit(1).count())
    stored = materialise(index(docs, single=single), "index")
    found = materialise(matches(materialise(postings(stored, terms), "postings"), terms, slop), "matches")
    exact = found.filter("exact")
    hit = exact.select("row", F.explode(F.sequence("start", F.col("start") + F.col("n") - 1)).alias("pos")).distinct().groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.groupBy("row", "wid").agg(F.max("exact").alias("exact")).join(wins.select("wid", F.explode("items").alias("item")), "wid")
    named = named.groupBy("row", "item").agg(F.max("exact").alias("exact"))
    items = named.groupBy("row").agg(F.array_sort(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.count_if(~F.col("exact")).alias("n_near_items"))
    rows = stored.select("row", "doc_id", "n_words")
    none = F.array().cast("array<string>")
    return (
        rows.join(hit.join(items, "row", "full"), "row", "left")
        .select("row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("n_near_items", F.lit(0)).cast("bigint").alias("n_near_items"))
        .withColumn("n_items", F.size("items").cast("bigint"))
    )


#: Exact phrases in DuckDB.
SQL = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[j + 1 : j + 10], ' ') AS s, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS j FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT doc_id, i, n, array_to_string(w[i + 1 : i + n], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM dw CROSS JOIN sizes)),
hits AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (s, n)),
hw AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
