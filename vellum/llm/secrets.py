"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found by patterns in every whole text.  Their hashes are then aggregated over the corpus: by how
many owners (values of ``owner``) and by how many repositories (an owner's different texts: exact copies are one) each is used.  A candidate that
several owners share is a widely copied example; one that stays with a single owner, however often that owner repeats it, is a live-looking
credential.  Base kinds are kept whatever their frequency; the frequency adds spans of its own kind ``owned``:
long mixed tokens without a telling name, only where they stay with one owner.

Positions are worked out in time linear in a text's matches.

Positions are code points, end exclusive.  A null text counts as empty; a null owner is an owner of its own; repeated rows each
get their spans; equal secrets are counted once a row.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import materialise, small

# Patterns of the base kinds (fixed values); the number is the least length of the group that counts.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # runs are maximal, so shorter ones can be left out at once
#: A long token of one alphabet, as keys without a name are; it must hold a digit, a small and a large letter.
MIXED = r"[A-Za-z0-9+/_-]{32,}"
KINDS = ("assign", "access", "hex", "owned")
FOUND = "array<struct<start:int,kind:int,end:int,value:string,n_repositories:bigint,n_owners:bigint,live:boolean>>"


def running(values: Column, op: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """Running totals (under ``op``, from 0) of an array of ints: arrays grow by appending within blocks of ``size`` only, so time is linear."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / size).cast("int")), lambda b: F.slice(values, b * size + 1, size))
    zero = F.lit(0).cast("int")
    start = F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out"))

    def whole(acc: Column, block: Column) -> Column:
        return F.struct(op(acc["at"], F.aggregate(block, zero, op)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def inside(acc: Column, x: Column) -> Column:
        now = op(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], F.array(now)).alias("out"))

    before = F.aggregate(blocks, start, whole, lambda acc: acc["out"])
    each = F.zip_with(blocks, before, lambda block, at: F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), inside, lambda acc: acc["out"]))
    return F.when(F.size(values) > 0, F.flatten(each)).otherwise(F.array().cast("array<int>"))


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, those whose group is shorter than ``least`` dropped.

    Matches and the gaps between them alternate, so the running sum of their lengths gives the positions.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = running(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)), lambda a, b: a + b)
    zipped = F.arrays_zip(F.transform(found, F.length).alias("n"), value.alias("v"), ends.alias("end"))
    every = F.transform(zipped, lambda x: F.struct((x["end"] - x["n"]).alias("start"), x["end"].alias("end"), x["v"].alias("value")))
    kept = F.filter(every, lambda x: F.length(x["value"]) >= least) if least else every
    return F.coalesce(kept, F.array().cast("array<struct<start:int,end:int,value:string>>"))


def scan(docs: DataFrame, *, text: str = "text", owner: str = "source", row: Column | None = None) -> DataFrame:
    """Candidates of every document: row, doc_id, __owner, __copy (a hash of the text), found array<struct<start, kind, end, value>>.

    ``row`` tells the rows of the input apart; by default they are numbered, so materialise the result before it
    is used twice.
    """
    t = F.coalesce(F.col("__t"), F.lit(""))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    # Plain searches first: few texts hold any candidate, and the exact positions are worked out for those alone.
    some = F.when(t.rlike(ASSIGN), spans(t, ASSIGN, 2, 6)).otherwise(empty)
    rows = docs.select(*([] if row is None else [row.alias("row")]), "doc_id", F.col(owner).cast("string").alias("__owner"), F.col(text).alias("__t")).select(
        F.xxhash64(t).alias("__copy"),
        (F.monotonically_increasing_id() if row is None else F.col("row")).alias("row"),
        "doc_id",
        "__owner",
        some.alias("assign"),
        F.when(t.contains("AKIA"), spans(t, ACCESS, 0, 20)).otherwise(empty).alias("access"),
        F.when(t.rlike(HEX), spans(t, HEX)).otherwise(empty).alias("hex"),
        F.when(t.rlike(MIXED), spans(t, MIXED)).otherwise(empty).alias("owned"),
    )

    def tagged(kind: int) -> Column:
        return F.transform(F.col(KINDS[kind]), lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    mixed = F.filter(tagged(3), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[a-z]") & x["value"].rlike("[A-Z]"))
    return rows.select("row", "doc_id", "__owner", "__copy", F.array_sort(F.concat(tagged(0), tagged(1), tagged(2), mixed)).alias("found"))


def frequencies(scanned: DataFrame) -> DataFrame:
    """Of each candidate's hash: the repositories and owners that hold it, pre-aggregated before any shuffle on the hash."""
    each = scanned.filter(F.size("found") > 0).select("__copy", F.coalesce("__owner", F.lit("\0")).alias("o"), F.explode(F.array_distinct(F.transform("found", lambda x: x["value"]))).alias("v"))
    repositories = each.select(F.sha2("v", 256).alias("hash"), "o", "__copy").distinct()
    by_owner = repositories.groupBy("hash", "o").agg(F.count(F.lit(1)).alias("n"))
    return by_owner.groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count(F.lit(1)).alias("n_owners"))


def judged(scanned: DataFrame, *, examples_from: int = 2) -> DataFrame:
    """Scanned rows that hold candidates, each with its frequency; ``owned`` spans stay only where they are live.

    A candidate of ``examples_from`` owners or more is an example.  Returns row and found, an array of structs start, kind, end, value,
    n_repositories, n_owners, live.
    """
    one = scanned.filter(F.size("found") > 0).select("row", F.explode("found").alias("x")).withColumn("hash", F.sha2("x.value", 256))
    both = one.join(small(materialise(frequencies(scanned), "frequencies"), 200_000), "hash")  # 80 bytes a hash
    live = F.col("n_owners") < examples_from
    kept = both.filter((F.col("x.kind") < 3) | live)
    span = F.struct("x.start", "x.kind", "x.end", "x.value", "n_repositories", "n_owners", live.alias("live"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("found"))


def joined(found: Column, base_only: bool) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    some = F.filter(found, lambda x: x["kind"] < 3) if base_only else found
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text: Column, found: Column, mark: str = "[SECRET]") -> Column:
    """``text`` with every span's characters replaced by ``mark``; spans are in order of their starts, and those that begin inside others fall away."""
    ends = running(F.transform(found, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
    before = F.concat(F.array(F.lit(0).cast("int")), ends)
    pieces = F.transform(
        F.arrays_zip(found.alias("x"), F.slice(before, 1, F.size(found)).alias("at")),
        lambda p: F.when(p["x"]["start"] >= p["at"], F.concat(F.substring(text, p["at"] + 1, p["x"]["start"] - p["at"]), F.lit(mark))).otherwise(F.lit("")),
    )
    rest = F.substring(text, F.element_at(before, -1) + 1, F.length(text))
    return F.when(F.size(found) > 0, F.concat(F.array_join(pieces, ""), rest)).otherwise(text)


def _kind_sql(kind: int, pattern: str, group: int, keep: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
    SELECT doc_id, source, {kind} AS kind, v, upto - length(m) AS s, upto AS e FROM (
      SELECT doc_id, source, v, m, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM (
        SELECT doc_id, source, unnest(range(len(ms))) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[1:len(ms)]) AS g FROM (
          SELECT doc_id, source, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS vs, string_split_regex(t, '{p}') AS gs
          FROM (SELECT doc_id, source, coalesce(text, '') AS t FROM documents)) WHERE len(ms) > 0)) WHERE {keep}"""


#: The same in DuckDB.
SQL = f"""
WITH found AS ({" UNION ALL ".join((
    _kind_sql(0, ASSIGN, 2, "length(v) >= 6"), _kind_sql(1, ACCESS, 0, "length(v) >= 20"), _kind_sql(2, HEX, 0, "true"),
    _kind_sql(3, MIXED, 0, "regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')")))}),
freq AS (SELECT v, count(DISTINCT coalesce(source, chr(1))) AS n_owners FROM found GROUP BY v),
kept AS (SELECT doc_id, kind, s, e, n_owners, n_owners < 2 AS live,
           (['assign', 'access', 'hex', 'owned'])[kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS one
         FROM found JOIN freq USING (v) WHERE kind < 3 OR n_owners < 2),
agg AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
          string_agg(one, ',' ORDER BY s, kind) FILTER (kind < 3) AS base, string_agg(one, ',' ORDER BY s, kind) AS spans,
          count(*) FILTER (live) AS n_live, max(n_owners) AS most_owners FROM kept GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(most_owners, 0) AS most_owners
FROM documents d LEFT JOIN agg USING (doc_id)
"""
