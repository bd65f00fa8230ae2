"""The registered queries of the note engine, each beside its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum import engine
from vellum.config import DEFAULT
from vellum.functions import markdown as md
from vellum.functions import text as tx
from vellum.operators import backlinks, chunking, ingest, judge, lifecycle, registry, vectors
from vellum.shared import materialise, shared_dir
from vellum.sources import store
from vellum.sources.notes import notes_from_documents, table
from vellum.streaming import edits

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function under its name, with its SQL."""

    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Vectors -------------------------------------------------------------------------------------------------------------

_PAIRS = """pairs AS (SELECT a.vec_id AS q, a.label AS ql, b.vec_id AS v, b.label AS vl,
  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM embeddings a JOIN embeddings b ON a.label <> b.label),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, v) AS k FROM pairs) WHERE k <= 8)"""


def _hits(spark: SparkSession, sf_dir: str, threshold: float | None) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))
    return vectors.knn(v, v, 8, threshold=threshold)


@query(f"WITH {_PAIRS} SELECT q AS query_id, CAST(k AS INTEGER) AS rank, v AS vec_id, round(s, 6) AS similarity FROM top")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, None).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_PAIRS} SELECT q AS query_id, CAST(k AS INTEGER) AS rank, v AS vec_id, round(s, 4) AS similarity FROM top WHERE s >= 0.3")
def knn_exclude_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir, 0.3).select("query_id", "rank", F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"))


@query("""WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id = 7),
t AS (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS s FROM embeddings, q WHERE vec_id <> 7 ORDER BY s DESC, vec_id LIMIT 5)
SELECT vec_id, round(s, 4) AS similarity FROM t WHERE s >= 0.1""")
def single_query_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    asked = v.filter("id = 7").first()["vec"]
    top = vectors.search(F.array(*[F.lit(float(x)) for x in asked]), v, 5, threshold=0.1, exclude=F.col("id") != 7)
    return top.select(F.col("id").alias("vec_id"), F.round("similarity", 4).alias("similarity"))


@query("""WITH n AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda y: y * y)))) AS u FROM embeddings)
SELECT vec_id, round(sqrt(list_sum(list_transform(u, lambda x: x * x))), 6) AS norm, round(list_sum(u), 6) AS total FROM n""")
def l2_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "embeddings").select("vec_id", vectors.unit(F.col("embedding")).alias("u"))
    return u.select("vec_id", F.round(vectors.norm(F.col("u")), 6).alias("norm"), F.round(F.aggregate("u", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


_BEST = f"""WITH {_PAIRS}, hits AS (SELECT ql AS src, vl AS target, q AS chunk, k AS rank, s AS sim FROM top WHERE s >= 0.3),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src, target ORDER BY round(sim, 4) DESC, chunk, rank) AS n FROM hits) WHERE n = 1)"""


def _label_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _hits(spark, sf_dir, 0.3)
    return h.select(F.col("query_grp").alias("src"), F.col("grp").alias("target"), F.col("query_id").alias("chunk"), "rank", F.col("similarity").alias("sim"))


@query(f"{_BEST} SELECT CAST(src AS BIGINT) AS src, CAST(target AS BIGINT) AS target, chunk, round(sim, 4) AS sim FROM best")
def best_hit_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlinks.best_hits(_label_hits(spark, sf_dir)).select("src", "target", "chunk", F.round("sim", 4).alias("sim"))


@query(f"""{_BEST}, f AS (SELECT src, target, min(struct_pack(chunk := chunk, rank := rank)) AS first FROM hits GROUP BY src, target)
SELECT CAST(src AS BIGINT) AS src, CAST(target AS BIGINT) AS target, CAST(row_number() OVER (PARTITION BY src ORDER BY first, target) - 1 AS INTEGER) AS candidate_id FROM f""")
def candidate_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backlinks.numbered(_label_hits(spark, sf_dir)).select("src", "target", F.col("candidate_id").cast("int").alias("candidate_id"))


@query(f"""{_BEST} SELECT CAST(src AS BIGINT) AS src, CAST(target AS BIGINT) AS target FROM best
WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 10 = src AND n_regionkey = target)""")
def drop_existing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "nation").select((F.col("n_nationkey") % 10).cast("bigint").alias("src"), F.col("n_regionkey").cast("string").alias("title"))
    best = backlinks.best_hits(_label_hits(spark, sf_dir)).withColumn("title", F.col("target").cast("string"))
    return backlinks.not_linked(best, links).select("src", "target")


@query(f"""{_BEST}, c AS (SELECT src, target, CAST(row_number() OVER (PARTITION BY src ORDER BY target) - 1 AS INTEGER) AS candidate_id, sim FROM best)
SELECT CAST(src AS BIGINT) AS src, string_agg('- [[' || target || ']] — ' || printf('%.3f', sim), chr(10) ORDER BY target) AS lines FROM c GROUP BY src""")
def backlink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = backlinks.best_hits(_label_hits(spark, sf_dir))
    links = best.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("target", F.col("target").cast("string").alias("title"), F.format_string("%.3f", "sim").alias("reason")))).alias("links"))
    return links.select("src", F.array_join(md.link_lines(F.col("links")), "\n").alias("lines"))


@query("""SELECT doc_id AS src, CAST(doc_id % 4 AS INTEGER) AS candidate_id FROM labels WHERE quality = 1 AND toxic = 0""")
def judge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    lab = table(spark, sf_dir, "labels")
    cand = lab.select(F.col("doc_id").alias("src"), (F.col("doc_id") % 4).cast("int").alias("candidate_id"))
    said = lab.select(F.col("doc_id").alias("src"), (F.col("doc_id") % 4).cast("int").alias("candidate_id"), (F.col("quality") == 1).alias("should_link"), F.when(F.col("toxic") == 1, "none").alias("link_type"), F.lit("").alias("reason"))
    return backlinks.decided(cand, said).select("src", "candidate_id")


# Text ----------------------------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT doc_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM documents)
SELECT doc_id, CAST(n AS INTEGER) AS n_words, CAST(greatest(1, n * 4 // 3) AS INTEGER) AS n_tokens FROM w""")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.words(F.col("text")).alias("n_words"), tx.tokens(tx.words(F.col("text"))).alias("n_tokens"))


@query("""WITH w AS (SELECT greatest(1, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 4 // 3) AS t FROM documents)
SELECT CASE WHEN t < 50 THEN 'small' WHEN t > 350 THEN 'large' ELSE 'fit' END AS size_class, count(*) AS n_docs FROM w GROUP BY 1""")
def size_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tx.tokens(tx.words(F.col("text")))
    kind = F.when(t < DEFAULT.min_tokens, "small").when(t > DEFAULT.max_tokens, "large").otherwise("fit")
    return table(spark, sf_dir, "documents").groupBy(kind.alias("size_class")).agg(F.count(F.lit(1)).alias("n_docs"))


@query("""SELECT doc_id, substr(text, 1, 300) AS e300, substr(text, 1, 1200) AS e1200, CAST(length(substr(text, 1, 1500)) AS INTEGER) AS n FROM documents""")
def doc_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.excerpt(F.col("text"), 300).alias("e300"), tx.excerpt(F.col("text"), 1200).alias("e1200"), F.length(tx.excerpt(F.col("text"), 1500)).alias("n"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))


_NOTES = """notes AS (SELECT doc_id, 'vault/' || source || '/' || doc_id || '.md' AS file_path, '---' || chr(10) || 'title: "' || doc_id || '"' || chr(10) || 'tags: [' || source || ', ' || lang || ']' || chr(10)
  || '---' || chr(10) || chr(10) || '# Note ' || doc_id || chr(10) || chr(10) || replace(text, chr(10), chr(10) || chr(10)) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Related Notes' || chr(10) || chr(10)
  || '- [[' || (doc_id + 1) || ']] — near' || chr(10) AS text FROM documents)"""


@query(f"""WITH {_NOTES}, b AS (SELECT doc_id, substr(text, 4) AS r FROM notes), c AS (SELECT doc_id, substr(r, strpos(r, '---') + 3) AS t FROM b),
s AS (SELECT doc_id, trim(regexp_extract(t, '(?s)^(.*?)\n## Related Notes\n', 1), chr(10) || ' ') AS body FROM c) SELECT doc_id, sha256(body) AS body_hash FROM s""")
def body_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(spark, sf_dir).select("doc_id", F.sha2(md.body(F.col("text")), 256).alias("body_hash"))


@query(f"""WITH {_NOTES} SELECT doc_id, regexp_extract(text, 'title: (.*)', 1) AS title,
array_to_string(list_transform(string_split(regexp_extract(text, 'tags: \\[(.*)\\]', 1), ','), lambda x: trim(x)), '|') AS tags FROM notes""")
def frontmatter_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes_from_documents(spark, sf_dir)
    return n.select("doc_id", md.field(F.col("text"), "title").alias("title"), F.array_join(md.field_list(F.col("text"), "tags"), "|").alias("tags"))


@query(f"""WITH {_NOTES} SELECT doc_id, array_to_string(regexp_extract_all(substr(text, strpos(text, '## Related Notes')), '\\[\\[([^\\]]+)\\]\\]', 1), '|') AS titles FROM notes""")
def wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(spark, sf_dir).select("doc_id", F.array_join(md.linked_titles(F.col("text")), "|").alias("titles"))


@query(f"""WITH {_NOTES} SELECT doc_id, sha256(replace(regexp_replace(text, 'tags: \\[.*\\]', 'tags: [' || lang2 || ', new]'), '— near' || chr(10), '— near' || chr(10) || '- [[x]] — y' || chr(10))) AS after
FROM (SELECT n.doc_id, n.text, d.lang AS lang2 FROM notes n JOIN documents d USING (doc_id))""")
def markdown_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = notes_from_documents(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    tagged = md.set_list(F.col("text"), "tags", F.array("lang", F.lit("new")))
    link = F.array(F.struct((F.col("doc_id") + 1).cast("string").alias("title"), F.lit("old").alias("reason")), F.struct(F.lit("x").alias("title"), F.lit("y").alias("reason")))
    return n.withColumn("text", tagged).select("doc_id", F.sha2(md.add_links(F.col("text"), link), 256).alias("after"))


@query(f"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'v/' || page_id || '.md' WHEN 1 THEN 'v/.' || page_id || '.md' WHEN 2 THEN 'v/~' || page_id || '.md'
  WHEN 3 THEN 'templates/' || page_id || '.md' WHEN 4 THEN 'v/_' || page_id || '.md' ELSE url END AS path FROM pages)
SELECT page_id, path FROM p WHERE path LIKE '%.md' AND NOT regexp_matches(path, '/[.~][^/]*$') AND NOT list_has_any(string_split(path, '/'), [{", ".join(f"'{d}'" for d in DEFAULT.ignored_dirs)}])""")
def path_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id").cast("string")
    made = [F.concat(F.lit(a), i, F.lit(".md")) for a in ("v/", "v/.", "v/~", "templates/", "v/_")]
    path = F.col("url")
    for k, m in enumerate(made):
        path = F.when(F.col("page_id") % 6 == k, m).otherwise(path)
    p = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return p.filter(tx.relevant_path(F.col("path"), DEFAULT.ignored_dirs))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("answer", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")))
    return e.select("event_id", F.from_json(tx.json_object(F.col("answer")), "k int")["k"].alias("k"))


@query("""SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(trim(p_name || ' ' || p_type)), '[^a-z0-9-]', '-', 'g'), '-+', '-', 'g'), '-') AS slug FROM part""")
def tag_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", tx.tag_slug(F.concat_ws(" ", "p_name", "p_type")).alias("slug"))


@query("""SELECT c_custkey, trim(regexp_replace(regexp_replace(lower(c_name || '. ' || c_mktsegment), '[^a-z0-9\\s]', '', 'g'), '\\s+', '-', 'g'), '-') AS slug FROM customer""")
def entity_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.entity_slug(F.concat(F.col("c_name"), F.lit(". "), F.col("c_mktsegment"))).alias("slug"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%y') || CASE WHEN o_orderkey % 5 = 0 THEN ' - Entry' ELSE ' - ' || replace(o_orderpriority || ': x', ':', '-') END AS page_id FROM orders""")
def page_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.concat(F.col("o_orderpriority"), F.lit(": x")))
    return table(spark, sf_dir, "orders").select("o_orderkey", tx.page_id(title, F.date_format("o_orderdate", "dd/MM/yy")).alias("page_id"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 50 + 2 AS DOUBLE) WHEN event_id % 3 = 1 THEN 10.0 END AS delay FROM events""")
def retry_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    message = F.when(i % 3 == 0, F.concat(F.lit('429 too many, retryDelay: "'), (i % 50).cast("string"), F.lit('s"'))).when(i % 3 == 1, "RESOURCE_EXHAUSTED").otherwise("500 server")
    return table(spark, sf_dir, "events").select("event_id", tx.retry_delay(message).alias("delay"))


# Chunks --------------------------------------------------------------------------------------------------------------

_LINES = """lines AS (SELECT doc_id, i AS pos, parts[i + 1] AS line, len(list_filter(string_split_regex(parts[i + 1], '\\s+'), lambda x: x <> '')) AS n_words
  FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)))"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("n_words", tx.words(F.col("line")))


_MIXED = """mixed AS (SELECT doc_id, i, CASE (doc_id + i) % 9 WHEN 0 THEN '## ' || line WHEN 1 THEN ' ---- ' WHEN 2 THEN '#one #two' WHEN 3 THEN '> ' || line WHEN 4 THEN '  - ' || line WHEN 5 THEN '12. ' || line WHEN 6 THEN '![[x.png]]' WHEN 7 THEN ' ' ELSE line END AS line
  FROM (SELECT doc_id, i, parts[i + 1] AS line FROM (SELECT doc_id, parts, unnest(range(len(parts))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))))"""


@query(f"""WITH {_MIXED} SELECT CASE WHEN regexp_matches(line, '^#{{1,6}}\\s+.+$') THEN 'heading' WHEN regexp_matches(trim(line), '^-{{3,}}$') THEN 'rule' WHEN regexp_matches(trim(line), '^#\\w+(\\s+#\\w+)*$') THEN 'tags' WHEN line LIKE '>%' THEN 'quote'
  WHEN regexp_matches(line, '^(\\s*[-*+]|\\s*\\d+\\.)\\s') THEN 'bullet' WHEN trim(line) LIKE '![[%' THEN 'image' WHEN trim(line) = '' THEN 'blank' ELSE 'text' END AS kind, count(*) AS n FROM mixed GROUP BY 1""")
def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with each line made into a kind of its own, by the operator's own test of lines."""
    lines = chunking.lines_of(table(spark, sf_dir, "documents"), "doc_id", "text")
    k, line = (F.col("doc_id") + F.col("pos")) % 9, F.col("line")
    made = [F.concat(F.lit("## "), line), F.lit(" ---- "), F.lit("#one #two"), F.concat(F.lit("> "), line), F.concat(F.lit("  - "), line), F.concat(F.lit("12. "), line), F.lit("![[x.png]]"), F.lit(" ")]
    mixed = line
    for i, m in enumerate(made):
        mixed = F.when(k == i, m).otherwise(mixed)
    return lines.groupBy(chunking.kind_of(mixed).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_LINES}, dated AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN 'date: ' || pos ELSE line END AS line FROM lines),
s AS (SELECT doc_id, pos, sum(CASE WHEN regexp_matches(line, '(?i)Date[_:]?\\s*\\d|\\d{{1,2}}[/-]\\d{{1,2}}') AND pos > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM dated)
SELECT doc_id, CAST(seg AS INTEGER) AS seg, count(*) AS n_lines FROM s GROUP BY ALL""")
def timestamp_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _lines(spark, sf_dir).withColumn("line", F.when(F.col("pos") % 4 == 1, F.concat(F.lit("date: "), F.col("pos").cast("string"))).otherwise(F.col("line")))
    return chunking.quote_segments(dated, "doc_id").groupBy("doc_id", "seg").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {_LINES}, g AS (SELECT *, sum(CASE WHEN n_words >= 38 OR pos = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM lines)
SELECT doc_id, CAST(g - 1 AS INTEGER) AS idx, CAST(min(pos) AS INTEGER) AS first_pos, CAST(count(*) AS INTEGER) AS n_parts, sha256(string_agg(line, chr(10) || chr(10) ORDER BY pos)) AS digest FROM g GROUP BY doc_id, g""")
def tiny_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.merge_small(_lines(spark, sf_dir), "doc_id").select("doc_id", "idx", "first_pos", "n_parts", F.sha2("text", 256).alias("digest"))


@query(f"""WITH RECURSIVE {_LINES}, p AS (SELECT doc_id, pos, n_words AS acc, 0 AS g FROM lines WHERE pos = 0
UNION ALL SELECT l.doc_id, l.pos, CASE WHEN greatest(1, (p.acc + l.n_words) * 4 // 3) > 350 THEN l.n_words ELSE p.acc + l.n_words END, CASE WHEN greatest(1, (p.acc + l.n_words) * 4 // 3) > 350 THEN p.g + 1 ELSE p.g END
FROM p JOIN lines l ON l.doc_id = p.doc_id AND l.pos = p.pos + 1)
SELECT doc_id, g AS pack, CAST(count(*) AS INTEGER) AS n_lines, CAST(max(acc) AS INTEGER) AS n_words FROM p GROUP BY doc_id, g HAVING max(acc) >= 38""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", "\n", -1), tx.words).alias("sizes"))
    packs = lines.select("doc_id", F.explode(F.arrays_zip(F.col("sizes").alias("n"), chunking.pack(F.col("sizes")).alias("g"))).alias("x")).groupBy("doc_id", F.col("x.g").alias("pack"))
    out = packs.agg(F.count(F.lit(1)).cast("int").alias("n_lines"), F.sum("x.n").cast("int").alias("n_words"))
    return out.filter(F.col("n_words") >= 38)


@query("""WITH t AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '## user' || chr(10) || chr(10) || text ELSE regexp_replace(text, '(?m)^', CASE role WHEN 'assistant' THEN '> ' ELSE '- ' END, 'g') END AS part FROM conversations)
SELECT conv_id, sha256(string_agg(part, chr(10) || chr(10) ORDER BY turn)) AS digest, CAST(count(*) AS INTEGER) AS n_turns FROM t GROUP BY conv_id""")
def conversation_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    marked = lambda mark: F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit(mark), x)), "\n")
    part = F.when(F.col("role") == "user", F.concat(F.lit("## user\n\n"), "text")).when(F.col("role") == "assistant", marked("> ")).otherwise(marked("- "))
    turns = c.withColumn("part", part).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "part"))).alias("t"))
    return turns.select("conv_id", F.sha2(F.array_join(F.transform("t", lambda x: x["part"]), "\n\n"), 256).alias("digest"), F.size("t").alias("n_turns"))


# Registries ----------------------------------------------------------------------------------------------------------

_TAGS = f"""tagged AS (SELECT DISTINCT doc_id AS doc, tag, first_at AS pos FROM (SELECT doc_id, trim(regexp_replace(lower(w), '[^a-z0-9-]+', '-', 'g'), '-') AS tag, min(i) AS first_at
  FROM (SELECT doc_id, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM (SELECT doc_id, string_split_regex(text, '\\s+') AS ws FROM documents)) GROUP BY ALL)
  WHERE tag <> '' AND tag NOT IN ({", ".join(f"'{t}'" for t in tx.GENERIC_TAGS)}) AND length(tag) >= 3)"""


def _tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc, tag, at (order of first use): slugs are made once a word and made distinct within the document, so that few rows come out of it."""
    slugs = F.filter(F.transform(F.split("text", r"\s+", -1), tx.tag_slug), lambda t: tx.accepted_tag(t) & (F.length(t) >= 3))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.array_distinct(slugs)).alias("at", "tag"))


@query(f"WITH {_TAGS} SELECT tag, count(DISTINCT doc) AS n_docs FROM tagged GROUP BY tag")
def tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.tag_counts(_tags(spark, sf_dir))


@query(f"WITH {_TAGS}, c AS (SELECT tag, count(DISTINCT doc) AS n FROM tagged GROUP BY tag HAVING count(DISTINCT doc) >= 2) SELECT doc, count(*) AS n_tags, sum(n)::BIGINT AS total FROM (SELECT DISTINCT doc, tag FROM tagged) JOIN c USING (tag) GROUP BY doc")
def tag_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.promoted(_tags(spark, sf_dir)).groupBy("doc").agg(F.count(F.lit(1)).alias("n_tags"), F.sum("n_docs").alias("total"))


@query(f"WITH {_TAGS}, f AS (SELECT doc, tag, min(pos) AS pos FROM tagged GROUP BY ALL) SELECT doc, tag, CAST(k AS INTEGER) AS k FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos, tag) AS k FROM f) WHERE k <= 8")
def tag_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.capped(_tags(spark, sf_dir), "at")


@query("""WITH t AS (SELECT DISTINCT source AS tag, doc_id AS doc FROM documents UNION SELECT lang, doc_id FROM documents), l AS (SELECT tag, count(*) AS n FROM t WHERE doc NOT IN (SELECT doc_id FROM documents WHERE source = 'src3') GROUP BY tag)
SELECT DISTINCT t.tag, coalesce(n, 0) AS n_docs FROM t LEFT JOIN l USING (tag)""")
def tag_remove_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    tagged = d.select(F.explode(F.array("source", "lang")).alias("tag"), F.col("doc_id").alias("doc"))
    return registry.without_documents(tagged, d.filter("source = 'src3'").select(F.col("doc_id").alias("doc")))


@query("""WITH a AS (SELECT lower(c_name) AS alias, max_by(c_mktsegment, c_custkey) AS canonical FROM customer GROUP BY 1),
m AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN upper('Customer#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')) ELSE s_name END AS surface, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS canonical FROM supplier)
SELECT s_suppkey, coalesce(a1.canonical, a2.canonical, nullif(m.canonical, ''), surface) AS entity FROM m LEFT JOIN a a1 ON lower(surface) = a1.alias LEFT JOIN a a2 ON lower(coalesce(nullif(m.canonical, ''), surface)) = a2.alias""")
def entity_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = table(spark, sf_dir, "customer").select(F.col("c_name").alias("alias"), F.col("c_mktsegment").alias("canonical"), F.col("c_custkey").alias("seq"))
    i = F.col("s_suppkey")
    surface = F.when(i % 2 == 0, F.upper(F.concat(F.lit("Customer#"), F.lpad(i.cast("string"), 9, "0")))).otherwise(F.col("s_name"))
    mentions = table(spark, sf_dir, "supplier").select("s_suppkey", surface.alias("surface"), F.when(i % 3 == 0, "").otherwise(F.col("s_name")).alias("canonical"))
    return registry.resolved(mentions, aliases).select("s_suppkey", "entity")


@query("""SELECT lower(c_mktsegment) AS alias, max_by(c_name, c_custkey) AS canonical FROM customer GROUP BY 1""")
def entity_alias_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.alias_map(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("alias"), F.col("c_name").alias("canonical"), F.col("c_custkey").alias("seq")))


@query("""SELECT source AS tag, 'set' AS kind, CAST(1 AS BIGINT) AS n FROM (SELECT source FROM documents UNION SELECT lang FROM documents)
UNION ALL SELECT source, 'all', count(*) FROM (SELECT source FROM documents UNION ALL SELECT lang FROM documents) GROUP BY source""")
def union_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    parts = d.select(F.col("source").alias("tag")), d.select(F.col("lang").alias("tag"))
    every = registry.union_all(*parts).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return registry.union_distinct(*parts).select("tag", F.lit("set").alias("kind"), F.lit(1).cast("bigint").alias("n")).unionAll(every.select("tag", F.lit("all").alias("kind"), "n"))


_REGISTRY = """t AS (SELECT 'd' || (doc_id % 50) AS doc, source AS tag FROM documents UNION SELECT 'd' || (doc_id % 50), lang FROM documents)"""


def _registry(spark: SparkSession, sf_dir: str, name: str = "tag") -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("doc", F.concat(F.lit("d"), (F.col("doc_id") % 50).cast("string")))
    return d.select("doc", F.explode(F.array("source", "lang")).alias(name)).distinct()


@query(f"""WITH {_REGISTRY}, q AS (SELECT unnest(['d1', 'd7', 'none']) AS doc) SELECT q.doc, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS names FROM q LEFT JOIN t ON q.doc = t.doc GROUP BY q.doc""")
def tags_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([("d1",), ("d7",), ("none",)], "doc string")
    return registry.of_documents(_registry(spark, sf_dir), asked).select("doc", F.array_join("names", "|").alias("names"))


@query(f"""WITH {_REGISTRY}, q AS (SELECT 'd' || (n_nationkey * 3) AS doc FROM nation) SELECT q.doc, coalesce(string_agg(tag, '|' ORDER BY tag), '') AS names FROM q LEFT JOIN t ON q.doc = t.doc GROUP BY q.doc""")
def entities_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "nation").select(F.concat(F.lit("d"), (F.col("n_nationkey") * 3).cast("string")).alias("doc"))
    return registry.of_documents(_registry(spark, sf_dir, "entity"), asked, "entity").select("doc", F.array_join("names", "|").alias("names"))


@query(f"""WITH {_REGISTRY}, left_ AS (SELECT tag, count(DISTINCT doc) AS n FROM t WHERE doc NOT IN (SELECT 'd' || doc_id FROM labels WHERE toxic = 1) GROUP BY tag) SELECT DISTINCT t.tag AS entity, coalesce(n, 0) AS n_docs FROM t LEFT JOIN left_ USING (tag)""")
def entity_remove_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("doc"))
    return registry.without_entity_documents(_registry(spark, sf_dir, "entity"), gone)


@query("""SELECT DISTINCT o_custkey AS doc, coalesce(nullif(c_mktsegment, ''), 'x') AS entity FROM orders JOIN customer ON o_custkey = c_custkey""")
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return registry.canonical_distinct(both.select(F.col("o_custkey").alias("doc"), F.col("c_mktsegment").alias("entity")))


@query("""WITH a AS (SELECT lower(n_name) AS alias, max_by(r_name, n_nationkey) AS canonical FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
SELECT '{' || string_agg('"' || alias || '":"' || canonical || '"', ',' ORDER BY alias) || '}' AS json FROM a""")
def entity_alias_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return registry.alias_json(both.select(F.col("n_name").alias("alias"), F.col("r_name").alias("canonical"), F.col("n_nationkey").alias("seq")))


@query("""SELECT n_name AS entity FROM nation WHERE n_nationkey % 2 = 0 AND n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3) AND n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_suppkey <= 3)""")
def entity_notes_to_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    flagged = n.select(F.col("n_name").alias("entity"), (F.col("n_nationkey") % 2 == 0).alias("create_note"))
    named = table(spark, sf_dir, "supplier").filter("s_suppkey <= 3").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("title"))
    return registry.notes_to_create(flagged, n.filter("n_regionkey < 3").select(F.col("n_name").alias("entity")), named).select("entity")


@query("""SELECT n_name, sha256('---' || chr(10) || 'tags: [person]' || chr(10) || 'entity_type: PERSON' || chr(10) || '---' || chr(10) || chr(10) || '# ' || n_name || chr(10) || chr(10) || '*Auto-generated entity note.*' || chr(10)) AS digest FROM nation""")
def entity_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_name", F.sha2(md.entity_note(F.col("n_name"), F.lit("PERSON")), 256).alias("digest"))


_STEP = """s AS (SELECT space, doc, seq, tag, min(pos) AS pos FROM (SELECT 's' || (event_id % 3) AS space, 'u' || user_id AS doc, event_id AS seq, unnest(['tag ' || (event_id % 40), event_type]) AS raw, unnest([0, 1]) AS pos FROM events) x, LATERAL (SELECT replace(raw, ' ', '-') AS tag) GROUP BY ALL)"""


@query(f"""WITH {_STEP}, d AS (SELECT space, tag, doc, min(seq) AS since FROM s GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY space, tag ORDER BY since) AS k FROM d),
f AS (SELECT space, tag, min(since) AS first, min(since) FILTER (k = 2) AS enough FROM n GROUP BY ALL), b AS (SELECT space, tag, pos AS born FROM s JOIN f USING (space, tag) WHERE seq = first),
g AS (SELECT s.space, s.seq, s.doc, s.tag, 0 AS part, NULL AS first, s.pos AS k FROM s JOIN f USING (space, tag) WHERE f.first < s.seq
  UNION ALL SELECT r.space, r.seq, r.doc, d.tag, 1, f.first, b.born FROM (SELECT DISTINCT space, seq, doc FROM s) r JOIN d USING (space, doc) JOIN f USING (space, tag) JOIN b USING (space, tag) WHERE d.since <= r.seq AND f.enough <= r.seq),
o AS (SELECT *, row_number() OVER (PARTITION BY space, seq, doc, tag ORDER BY part) AS once FROM g), l AS (SELECT *, row_number() OVER (PARTITION BY space, seq ORDER BY part, first, k, tag) AS i FROM o WHERE once = 1),
t AS (SELECT space, seq, string_agg(tag, '|' ORDER BY i) AS tags FROM l WHERE i <= 8 GROUP BY ALL)
SELECT r.space, r.seq, r.doc, coalesce(tags, '') AS tags FROM (SELECT DISTINCT space, seq, doc FROM s) r LEFT JOIN t USING (space, seq)""")
def tag_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags that three registries give to documents in the order of events."""
    e = table(spark, sf_dir, "events")
    named = F.transform(F.array(F.concat(F.lit("tag "), (F.col("event_id") % 40).cast("string")), F.col("event_type")), tx.tag_slug)
    docs = e.select(F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string")).alias("space"), F.col("event_id").alias("seq"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("doc"), named.alias("candidates"), F.array().cast("array<string>").alias("proposed"))
    return registry.replay_tags(docs).select("space", "seq", "doc", F.array_join("tags", "|").alias("tags"))


# State and storage ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS file_path, 'DIRTY' AS current_state, CAST(n_chars AS DOUBLE) AS last_edit_time FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def bootstrap_untracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path"), F.col("n_chars").cast("double").alias("mtime"))
    return lifecycle.bootstrap(files, table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_path")))


@query("SELECT doc_id, n_chars, 'old' AS version FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, CAST(quality AS BIGINT), 'new' FROM labels")
def upsert_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.lit("old").alias("version"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("n_chars"), F.lit("new").alias("version"))
    return store.upserted(base, new, ["doc_id"])


@query("SELECT source, count(*) AS n_left FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source")
def delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "labels").filter("toxic = 1")
    return store.deleted(table(spark, sf_dir, "documents").select("doc_id", "source"), gone, ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n_left"))


@query("""WITH a AS (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 <> 1), b AS (SELECT doc_id AS path, CASE WHEN doc_id % 3 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 5 <> 2)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'created' WHEN b.path IS NULL THEN 'deleted' ELSE 'modified' END AS event_type FROM a FULL JOIN b ON a.path = b.path WHERE a.h IS DISTINCT FROM b.h""")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text")
    before = d.filter("path % 5 <> 1").select("path", F.sha2("text", 256).alias("hash"))
    now = d.filter("path % 5 <> 2").select("path", F.sha2(F.when(F.col("path") % 3 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256).alias("hash"))
    return lifecycle.snapshot_diff(before, now)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts_s"), F.col("ts").cast("timestamp").alias("ts"))


def _debounce_sql(gap: int) -> str:
    return f"""WITH e AS (SELECT user_id AS key, epoch_us(ts) / 1e6 AS t FROM events), g AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY key ORDER BY t) < {gap} THEN 0 ELSE 1 END AS s FROM e),
n AS (SELECT *, sum(s) OVER (PARTITION BY key ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT key, session::BIGINT AS session, min(t) AS first, max(t) AS last, count(*) AS n_edits FROM n GROUP BY key, session"""


@query(_debounce_sql(200))
def debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.debounce(_edits(spark, sf_dir), "key", "ts_s", DEFAULT.stabilise_s)


@query(_debounce_sql(3600))
def debounce_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.debounce(_edits(spark, sf_dir), "key", "ts_s", 3600)


_STATE = "CASE event_type WHEN 'signup' THEN 'DIRTY' WHEN 'purchase' THEN 'STABILIZING' WHEN 'view' THEN 'INDEXED' WHEN 'click' THEN 'READY_FOR_REASONING' ELSE 'REASONED' END"


@query(f"""WITH s AS (SELECT user_id, {_STATE} AS state, lag({_STATE}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT before, state, count(*) AS n, before || '>' || state IN ({", ".join(f"'{a}>{b}'" for a, b in lifecycle.TRANSITIONS)}) AS ok FROM s WHERE before IS NOT NULL GROUP BY ALL""")
def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.expr(_STATE).alias("state"))
    return lifecycle.transitions(e, "user_id", ["ts", "event_id"]).groupBy("before", "state", "ok").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT d.doc_id AS file_path, CASE d.doc_id % 4 WHEN 0 THEN 'DIRTY' WHEN 1 THEN 'STABILIZING' WHEN 2 THEN 'INDEXED' ELSE 'REASONED' END AS st, CAST(d.n_chars AS DOUBLE) AS edit,
  CASE WHEN quality = 1 THEN sha256(text) END AS ch, CASE WHEN toxic = 1 THEN sha256(text) END AS rh, CASE WHEN d.doc_id % 7 = 0 THEN 1.0 END AS it, sha256(text) AS h, d.doc_id % 11 <> 0 AS present, length(text) // 500 AS chunks
  FROM documents d LEFT JOIN labels USING (doc_id)), t AS (SELECT *, st = 'STABILIZING' OR (st = 'DIRTY' AND 3000 - edit >= 200) AS turn, h IS NOT DISTINCT FROM rh AS as_r, coalesce(h = ch AND it IS NOT NULL, false) AS as_i FROM s)
SELECT file_path, st AS before, CASE WHEN NOT turn THEN st WHEN NOT present THEN NULL WHEN as_r THEN 'REASONED' ELSE 'INDEXED' END AS after, turn AND present AND NOT as_r AND NOT as_i AND chunks > 0 AS embed, turn AND NOT present AS removed FROM t""")
def index_tick(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i, h = F.col("doc_id"), F.sha2("text", 256)
    state = F.when(i % 4 == 0, "DIRTY").when(i % 4 == 1, "STABILIZING").when(i % 4 == 2, "INDEXED").otherwise("REASONED")
    states = d.select(i.alias("file_path"), state.alias("current_state"), F.col("n_chars").cast("double").alias("last_edit_time"), F.when(F.col("quality") == 1, h).alias("content_hash"),
                      F.when(F.col("toxic") == 1, h).alias("last_reasoned_hash"), F.lit(None).cast("string").alias("last_reasoned_body_hash"), F.when(i % 7 == 0, 1.0).alias("last_index_time"))
    files = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("file_path"), h.alias("hash"), F.lit("").alias("body_hash"), F.floor(F.length("text") / 500).alias("n_chunks"))
    return lifecycle.index_tick(states, files, F.lit(3000.0))


@query("""WITH s AS (SELECT user_id AS file_path, max(epoch_us(ts)) / 1e6 AS last_reason_time FROM events GROUP BY 1) SELECT file_path, last_reason_time FROM s WHERE 1706500000.0 - last_reason_time >= 600 ORDER BY file_path LIMIT 16""")
def cooldown_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _edits(spark, sf_dir).groupBy(F.col("key").alias("file_path")).agg(F.max("ts_s").alias("last_reason_time")).withColumn("current_state", F.lit("INDEXED"))
    return lifecycle.reason_tick(s, F.lit(1706500000.0)).select("file_path", "last_reason_time")


@query("""WITH e AS (SELECT event_id AS id, event_type AS provider, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT id, round(max(t - 12 * i) OVER (PARTITION BY provider ORDER BY t, id ROWS UNBOUNDED PRECEDING) + 12 * i, 3) AS slot FROM e""")
def rate_limit_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("provider"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return judge.slots(e, "provider", "t", 60 / DEFAULT.requests_per_minute).select("id", F.round("slot", 3).alias("slot"))


@query("""WITH m AS (SELECT n_name AS model, n_nationkey AS p FROM nation WHERE n_nationkey < 6), f AS (SELECT DISTINCT user_id, event_id % 6 AS p FROM events WHERE event_type = 'error'), r AS (SELECT DISTINCT user_id FROM events)
SELECT r.user_id AS request, (SELECT min_by(model, m.p) FROM m WHERE m.p NOT IN (SELECT f.p FROM f WHERE f.user_id = r.user_id)) AS model FROM r""")
def fallback_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "nation").filter("n_nationkey < 6").select(F.col("n_name").alias("model"), F.col("n_nationkey").alias("priority"))
    e = table(spark, sf_dir, "events")
    bad = e.filter("event_type = 'error'").select(F.col("user_id").alias("request"), (F.col("event_id") % 6).cast("int").alias("priority")).join(F.broadcast(models), "priority")
    return judge.route(e.select(F.col("user_id").alias("request")).distinct(), bad, models)


@query("""SELECT 'vault/' || source || '/' || doc_id || '.md' AS file, 'indexed' AS action, n_chars, lang FROM documents""")
def mutation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").withColumn("file_path", F.concat(F.lit("vault/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")))
    log = store.mutation_log(d, "indexed", ["n_chars", "lang"])
    return log.select("file", "action", F.from_json("detail", "n_chars bigint, lang string").alias("d")).select("file", "action", "d.*")


@query("""SELECT p_partkey, least(1.0, 2048.0 / (p_size * 100), 2048.0 / (p_partkey % 4000 + 1)) AS scale FROM part""")
def image_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", ingest.scale((F.col("p_size") * 100).cast("double"), (F.col("p_partkey") % 4000 + 1).cast("double")).alias("scale"))


# More text, pages and prompts -----------------------------------------------------------------------------------------


@query("""SELECT doc_id, sha256(trim(regexp_replace(text, '[^a-zA-Z]+$', ' ' || chr(10)), ' ' || chr(10) || chr(9))) AS stripped_digest FROM documents""")
def python_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.strip(F.regexp_replace("text", r"[^a-zA-Z]+\z", " \n")), 256).alias("stripped_digest"))


@query("""SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS stem FROM pages""")
def note_stem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.stem(F.col("url")).alias("stem"))


@query(f"""WITH {_NOTES} SELECT doc_id, sha256(regexp_replace(text, '(?s)\\A---\\s*\n(.*?)\n---\\s*\n', '')) AS digest FROM notes""")
def strip_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes_from_documents(spark, sf_dir).select("doc_id", F.sha2(md.without_frontmatter(F.col("text")), 256).alias("digest"))


@query("""SELECT doc_id, sha256(array_to_string(list_transform(string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)), lambda x: CASE WHEN trim(x) = '' THEN '>' ELSE '> ' || x END), chr(10))) AS digest FROM documents""")
def quote_wrapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(tx.quoted_lines(F.col("text")), 256).alias("digest"))


@query("""SELECT doc_id, length(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))[1:1500]) AS n_combined,
sha256(array_to_string(list_transform(string_split(text, chr(10))[1:2], lambda x: x[1:300]), chr(10) || chr(10))[1:600]) AS first_digest, sha256(array_to_string(string_split(text, chr(10)), chr(10) || chr(10))[1:1500]) AS combined_digest FROM documents""")
def combined_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines stand for chunks."""
    parts = F.split("text", "\n", -1)
    all_, first = tx.combined(parts), tx.first_chunks(parts)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(all_).cast("bigint").alias("n_combined"), F.sha2(first, 256).alias("first_digest"), F.sha2(all_, 256).alias("combined_digest"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN 0 ELSE 2 END::INTEGER AS n_items FROM events""")
def json_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pair = F.concat(F.lit("["), "props", F.lit(", "), "props", F.lit("]"))
    answer = F.when(F.col("event_id") % 4 == 3, "no list").when(F.col("event_id") % 4 == 2, F.concat(F.lit("Here: "), pair, F.lit(" done"))).otherwise(F.concat(F.lit("```json\n"), pair, F.lit("\n```")))
    return e.select("event_id", F.coalesce(F.size(F.from_json(tx.json_array(answer), "array<struct<k:int>>")), F.lit(0)).cast("int").alias("n_items"))


@query("""SELECT event_id, event_id % 7 IN (0, 1, 2, 3, 4) AS for_good FROM events""")
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = ("429 GenerateRequestsPerDay", "Quota exceeded", "model NOT_FOUND", "404 page", "INVALID_ARGUMENT", "429 slow down", "500 server")
    said = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", judge.failed_for_good(said).alias("for_good"))


@query("""WITH a AS (SELECT conv_id, quantile_cont(CAST(turn * 7 - 20 AS DOUBLE), 0.5) AS m FROM conversations GROUP BY conv_id) SELECT conv_id, CASE WHEN abs(m) < 45 THEN m ELSE 0.0 END AS angle FROM a""")
def median_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.col("turn") * F.lit(7.0) - 20).alias("angles"))
    return c.select("conv_id", ingest.rotation(F.col("angles")).alias("angle"))


@query("""WITH p AS (SELECT page_id, 'T' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN '04/03/26' END AS d, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'Short.' END AS summary FROM pages),
i AS (SELECT *, CASE WHEN d IS NULL THEN title ELSE '04-03-26 - ' || title END AS id FROM p)
SELECT page_id, sha256('---' || chr(10) || 'id: ' || id || chr(10) || 'title: "' || title || '"' || chr(10) || 'date: 2024-01-02T03:04:05.000000' || CASE WHEN d IS NULL THEN '' ELSE chr(10) || 'written_date: "' || d || '"' END || chr(10) || 'tags: []' || chr(10)
  || 'source_pages: ["[[' || id || ' - p1.png]]", "[[' || id || ' - p2.jpg]]"]' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || CASE WHEN summary = '' THEN '' ELSE '## 🧠 AI Summary' || chr(10) || chr(10) || summary || chr(10) END || chr(10) || '---' || chr(10) || chr(10) || '![[' || id || ' - p1.png]]' || chr(10) || '![[' || id || ' - p2.jpg]]' || chr(10) || chr(10) || '---' || chr(10) || chr(10)
  || '## Entry' || chr(10) || chr(10) || '> one two' || chr(10) || '>' || chr(10) || '> ' || title || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## Metadata' || chr(10) || chr(10) || '- **Word Count:** 3' || chr(10) || '- **Processing Date:** 2024-01-02 03:04:05' || chr(10)) AS digest FROM i""")
def page_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole notes of journal pages from a vision model's answers."""
    title = F.concat(F.lit("T"), F.col("page_id").cast("string"))
    said = F.to_json(F.struct(F.concat(F.lit("one two\n \n"), title).alias("text"), F.when(F.col("page_id") % 3 == 0, "").otherwise("Short.").alias("summary"), F.when(F.col("page_id") % 2 == 0, "04/03/26").alias("written_date"), title.alias("title")))
    answers = table(spark, sf_dir, "pages").select(F.col("page_id").alias("page"), F.concat(F.lit("```json\n"), said, F.lit("\n```")).alias("answer"), F.array(F.lit("a.png"), F.lit("b.jpg")).alias("files"))
    return ingest.pages(answers, F.to_timestamp(F.lit("2024-01-02 03:04:05"))).select(F.col("page").alias("page_id"), F.sha2("text", 256).alias("digest"))


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, role, text[1:40] AS e FROM conversations)
SELECT conv_id, sha256(string_agg('[' || i || '] t' || turn || ' / ' || role || ' (' || printf('%.3f', turn / 8.0) || ')' || chr(10) || e, chr(10) || chr(10) ORDER BY i)) AS block_digest, CASE WHEN conv_id % 2 = 0 THEN '(none)' ELSE 'x, y' END AS existing FROM c GROUP BY conv_id""")
def prompt_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns stand for candidates."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(F.lit("t"), F.col("turn").cast("string")).alias("title"), F.col("role").alias("heading"), F.substring("text", 1, 40).alias("excerpt"), (F.col("turn") / F.lit(8.0)).alias("sim"))
    items = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "title", "heading", "excerpt", "sim"))).alias("t"))
    numbered = F.transform("t", lambda x, i: F.struct(i.alias("candidate_id"), x["title"].alias("title"), x["heading"].alias("heading"), x["excerpt"].alias("excerpt"), x["sim"].alias("sim")))
    known = F.when(F.col("conv_id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("x"), F.lit("y")))
    return items.select("conv_id", F.sha2(backlinks.candidate_block(numbered), 256).alias("block_digest"), backlinks.existing_block(known).alias("existing"))


# More of chunks, tables and states --------------------------------------------------------------------------------------


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS "index", user_id || '__' || (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) AS chunk_id FROM events WHERE event_type <> 'view'""")
def segment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that are left stand for chunks that are left."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'view'").select(F.concat(F.lit("v/"), F.col("user_id").cast("string"), F.lit(".md")).alias("file_path"), "user_id", "event_id", F.col("event_id").alias("pos"))
    return chunking.segment_ids(e).select("user_id", "event_id", "index", "chunk_id")


@query("""SELECT d.doc_id AS file_path, l.doc_id IS NOT NULL AS indexed, (SELECT count(*) FROM labels) AS n_chunks, (SELECT count(DISTINCT doc_id) FROM labels) AS n_paths FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)""")
def store_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels stand for stored chunks: which documents have any, and how many there are."""
    chunks = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("file_path"))
    found = store.is_indexed(chunks, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_path")))
    n, paths = store.n_rows(chunks).first().n_chunks, store.indexed_paths(chunks).count()
    return found.select("file_path", "indexed", F.lit(n).cast("bigint").alias("n_chunks"), F.lit(paths).cast("bigint").alias("n_paths"))


@query("""SELECT doc_id AS file_path, 'vec' AS embedding, string_agg(DISTINCT tag, '|' ORDER BY tag) AS tags, coalesce(max(CASE WHEN quality = 1 THEN 'Q' END), '') AS entities FROM (SELECT doc_id, unnest([source, lang]) AS tag FROM documents) LEFT JOIN labels USING (doc_id) GROUP BY doc_id""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's tags and people on its chunks."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.col("doc_id").alias("file_path"), F.lit("vec").alias("embedding"))
    tagged = d.select(F.col("doc_id").alias("doc"), F.explode(F.array("source", "lang")).alias("tag"))
    people = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("doc"), F.lit("Q").alias("entity"))
    return registry.onto_chunks(chunks, tagged, people).select("file_path", "embedding", F.array_join("tags", "|").alias("tags"), F.array_join("entities", "|").alias("entities"))


_TICKED = """st AS (SELECT d.doc_id AS file_path, CASE d.doc_id % 4 WHEN 0 THEN 'DIRTY' WHEN 1 THEN 'STABILIZING' WHEN 2 THEN 'INDEXED' ELSE 'READY_FOR_REASONING' END AS st, CAST(n_chars AS DOUBLE) AS edit, CASE WHEN quality = 1 THEN sha256(text) END AS ch,
  CASE WHEN toxic = 1 THEN sha256(text) END AS rh, CASE WHEN d.doc_id % 7 = 0 THEN 1.0 END AS it, CASE WHEN d.doc_id % 5 = 0 THEN 2700.0 END AS rt, sha256(text) AS h, d.doc_id % 11 <> 0 AS present, length(text) // 500 AS chunks FROM documents d LEFT JOIN labels USING (doc_id))"""


def _states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """States and files as they might be in the middle of a day."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    i, h, nothing = F.col("doc_id"), F.sha2("text", 256), F.lit(None).cast("string")
    state = F.when(i % 4 == 0, "DIRTY").when(i % 4 == 1, "STABILIZING").when(i % 4 == 2, "INDEXED").otherwise("READY_FOR_REASONING")
    states = d.select(i.alias("file_path"), state.alias("current_state"), F.col("n_chars").cast("double").alias("last_edit_time"), F.when(i % 7 == 0, 1.0).alias("last_index_time"), F.when(i % 5 == 0, 2700.0).alias("last_reason_time"), F.when(F.col("quality") == 1, h).alias("content_hash"),
                      F.when(F.col("toxic") == 1, h).alias("last_reasoned_hash"), nothing.alias("last_reasoned_body_hash"), nothing.alias("embedding_version"), nothing.alias("reasoning_version"))
    files = table(spark, sf_dir, "documents").filter("doc_id % 11 <> 0").select(F.col("doc_id").alias("file_path"), h.alias("hash"), F.lit("").alias("body_hash"), F.floor(F.length("text") / 500).alias("n_chunks"))
    return states, files


@query(f"""WITH {_TICKED}, t AS (SELECT *, st = 'STABILIZING' OR (st = 'DIRTY' AND 3000 - edit >= 200) AS turn, h IS NOT DISTINCT FROM rh AS as_r, coalesce(h = ch AND it IS NOT NULL, false) AS as_i FROM st)
SELECT file_path, CASE WHEN NOT turn THEN st WHEN as_r THEN 'REASONED' ELSE 'INDEXED' END AS current_state, CAST(CASE WHEN turn AND NOT as_r THEN 3000.0 ELSE it END AS DOUBLE) AS last_index_time, CASE WHEN turn AND NOT as_r THEN h ELSE ch END AS content_hash,
  CASE WHEN turn AND NOT as_r AND NOT as_i AND chunks > 0 THEN 'v1' END AS embedding_version FROM t WHERE NOT (turn AND NOT present)""")
def mark_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after an index pass: hashes and times are committed, with or without new vectors."""
    states, files = _states(spark, sf_dir)
    now = F.lit(3000.0)
    done = lifecycle.indexed(states, lifecycle.index_tick(states, files, now), files, now, "v1")
    return done.select("file_path", "current_state", "last_index_time", "content_hash", "embedding_version")


@query(f"""WITH {_TICKED}, c AS (SELECT file_path FROM st WHERE st = 'INDEXED' AND 3000 - coalesce(rt, 0) >= 600 ORDER BY file_path LIMIT 16) SELECT file_path, CASE WHEN file_path IN (SELECT file_path FROM c) THEN 'READY_FOR_REASONING' ELSE st END AS current_state FROM st""")
def mark_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = _states(spark, sf_dir)
    return lifecycle.made_ready(states, lifecycle.reason_tick(states, F.lit(3000.0))).select("file_path", "current_state")


@query(f"""WITH {_TICKED} SELECT file_path, CASE WHEN st <> 'READY_FOR_REASONING' THEN st WHEN file_path % 3 = 0 THEN 'INDEXED' WHEN edit > 1000 THEN 'DIRTY' ELSE 'REASONED' END AS current_state, CAST(CASE WHEN st = 'READY_FOR_REASONING' AND file_path % 3 <> 0 THEN 3100.0 ELSE rt END AS DOUBLE) AS last_reason_time,
  CASE WHEN st = 'READY_FOR_REASONING' AND file_path % 3 <> 0 THEN 'h' || file_path ELSE rh END AS last_reasoned_hash, CASE WHEN st = 'READY_FOR_REASONING' AND file_path % 3 <> 0 THEN 'b' || file_path END AS last_reasoned_body_hash FROM st""")
def mark_reasoned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States after reasoning: back to INDEXED on failure, DIRTY if edited meanwhile, else REASONED with both hashes."""
    states, _ = _states(spark, sf_dir)
    i = F.col("file_path").cast("string")
    outcomes = states.select("file_path", (F.col("file_path") % 3 != 0).alias("ok"), F.lit(1000.0).alias("started_at"), F.lit(3100.0).alias("finished_at"), F.concat(F.lit("h"), i).alias("hash"), F.concat(F.lit("b"), i).alias("body_hash"))
    return lifecycle.after_reasoning(states, outcomes).select("file_path", "current_state", "last_reason_time", "last_reasoned_hash", "last_reasoned_body_hash")


@query(f"""WITH {_TICKED}, e AS (SELECT event_id % 2000 AS file_path, max(epoch_us(ts)) / 1e6 AS ts FROM events GROUP BY 1)
SELECT coalesce(st.file_path, e.file_path) AS file_path, CASE WHEN e.ts IS NOT NULL AND coalesce(st, 'NEW') <> 'READY_FOR_REASONING' THEN 'DIRTY' ELSE st END AS current_state, CASE WHEN e.ts IS NOT NULL THEN greatest(e.ts, edit) ELSE edit END AS last_edit_time FROM st FULL JOIN e ON st.file_path = e.file_path""")
def mark_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits register new notes and make known ones DIRTY."""
    states, _ = _states(spark, sf_dir)
    edits = table(spark, sf_dir, "events").select((F.col("event_id") % 2000).alias("file_path"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return lifecycle.edited(states, edits).select("file_path", "current_state", "last_edit_time")


@query(f"""WITH {_TICKED} SELECT file_path, st AS current_state, 'one' AS asked FROM st WHERE file_path IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT file_path, st, 'state' FROM st WHERE st IN ('DIRTY', 'INDEXED') UNION ALL SELECT file_path, st, 'all' FROM st""")
def state_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = _states(spark, sf_dir)
    asked = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_path"))
    parts = lifecycle.state_of(states, asked), lifecycle.in_state(states, "DIRTY", "INDEXED"), lifecycle.in_state(states)
    return registry.union_all(*[p.select("file_path", "current_state", F.lit(name).alias("asked")) for p, name in zip(parts, ("one", "state", "all"), strict=True)])


@query(f"""WITH {_TICKED}, a(action, wanted) AS (VALUES ('register_metadata', 'NEW'), ('update_timestamps', 'DIRTY'), ('compute_content_hash', 'STABILIZING'), ('embed', 'INDEXED'), ('markdown_mutation', 'READY_FOR_REASONING'))
SELECT file_path, action, st = wanted AS ok FROM st, a""")
def allowed_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    states, _ = _states(spark, sf_dir)
    actions = F.array(*map(F.lit, ("register_metadata", "update_timestamps", "compute_content_hash", "embed", "markdown_mutation")))
    each = states.select("file_path", "current_state", F.explode(actions).alias("action"))
    return each.select("file_path", "action", lifecycle.allowed(F.col("current_state"), F.col("action")).alias("ok"))


@query("""WITH e AS (SELECT 'p' || user_id AS path, CASE event_type WHEN 'signup' THEN 'created' WHEN 'error' THEN 'deleted' WHEN 'click' THEN 'moved' ELSE 'modified' END AS t, 'q' || user_id AS dest, 'h' || (event_id % 5) AS hash FROM events),
x AS (SELECT path, t AS event_type, hash FROM e WHERE t <> 'moved' UNION ALL SELECT path, 'deleted', hash FROM e WHERE t = 'moved' UNION ALL SELECT dest, 'created', hash FROM e WHERE t = 'moved')
SELECT path, event_type, count(*) AS n FROM x WHERE NOT (hash = 'h0' AND path IN ('p1', 'p2', 'q3')) GROUP BY ALL""")
def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves are a deletion and a creation; our own writes are left out."""
    e, u = table(spark, sf_dir, "events"), F.col("user_id").cast("string")
    kind = F.when(F.col("event_type") == "signup", "created").when(F.col("event_type") == "error", "deleted").when(F.col("event_type") == "click", "moved").otherwise("modified")
    events = e.select(F.concat(F.lit("p"), u).alias("path"), kind.alias("event_type"), F.col("ts"), F.concat(F.lit("q"), u).alias("dest"), F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("hash"))
    own = spark.createDataFrame([("p1", "h0"), ("p2", "h0"), ("q3", "h0")], "path string, hash string")
    return lifecycle.file_events(events, own).groupBy("path", "event_type").agg(F.count(F.lit(1)).alias("n"))


_GONE = """g AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1)"""


@query(f"""WITH {_GONE} SELECT 'chunks' AS part, CAST(doc_id AS VARCHAR) AS key, count(*) AS n FROM conversations c JOIN (SELECT doc_id FROM documents) d ON c.conv_id = d.doc_id WHERE doc_id NOT IN (FROM g) GROUP BY doc_id
UNION ALL SELECT 'states', CAST(doc_id AS VARCHAR), 1 FROM documents WHERE doc_id NOT IN (FROM g)
UNION ALL SELECT 'tagged', source, count(*) FILTER (doc_id NOT IN (FROM g)) FROM documents GROUP BY source
UNION ALL SELECT 'people', lang, count(*) FILTER (doc_id NOT IN (FROM g)) FROM documents GROUP BY lang
UNION ALL SELECT 'log', CAST(g.doc_id AS VARCHAR), count(c.conv_id) FROM g LEFT JOIN (SELECT conv_id FROM conversations JOIN documents ON conv_id = doc_id) c ON c.conv_id = g.doc_id GROUP BY g.doc_id""")
def delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes that are gone leave chunks, states, tags and people; a turn of a conversation stands for a chunk."""
    d = table(spark, sf_dir, "documents").withColumn("file_path", F.col("doc_id").cast("string"))
    chunks = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), "turn").join(d.select("file_path"), "file_path", "left_semi")
    gone = table(spark, sf_dir, "labels").filter("toxic = 1").select(F.col("doc_id").cast("string").alias("file_path"))
    named = lambda c, name: d.select(F.col(c).alias(name), F.col("file_path").alias("doc"))
    after = engine.cascade(gone, chunks=chunks, states=d.select("file_path"), tagged=named("source", "tag"), people=named("lang", "entity"))
    count = lambda df, part, key: df.groupBy(F.lit(part).alias("part"), F.col(key).alias("key")).agg(F.count(F.col("doc") if "doc" in df.columns else F.lit(1)).alias("n"))
    log = after["log"].select(F.lit("log").alias("part"), F.col("file").alias("key"), F.from_json("detail", "n_deleted bigint")["n_deleted"].alias("n"))
    return registry.union_all(count(after["chunks"], "chunks", "file_path"), count(after["states"], "states", "file_path"), count(after["tagged"], "tagged", "tag"), count(after["people"], "people", "entity"), log)


@query(f"""WITH {_PAIRS}, h AS (SELECT v, s FROM pairs WHERE q = 7 ORDER BY s DESC, v LIMIT 10)
SELECT CAST(row_number() OVER (ORDER BY s DESC, v) AS INTEGER) AS rank, v || '.md' AS file, printf('%.3f', s) AS similarity, 'L' || (v % 10) AS heading, CASE WHEN v % 2 = 0 THEN '—' ELSE 'a, b' END AS tags, '—' AS entities, 'one two ' || v AS excerpt FROM h""")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader sees of the best hits of one vector."""
    i = F.col("vec_id").cast("string")
    none = F.array().cast("array<string>")
    v = table(spark, sf_dir, "embeddings")
    asked = v.filter("vec_id = 7").first()
    rows = v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), F.concat(F.lit("v/"), i, F.lit(".md")).alias("file_path"), F.concat(F.lit("L"), (F.col("vec_id") % 10).cast("string")).alias("heading"), F.concat(F.lit("one\ntwo "), i).alias("text"),
                    F.when(F.col("vec_id") % 2 == 0, none).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("tags"), none.alias("entities"), "label")
    top = vectors.search(F.array(*[F.lit(float(x)) for x in asked.embedding]), rows, 10, exclude=F.col("label") != asked.label)
    return engine.search_rows(top.withColumn("rank", F.row_number().over(vectors.by_similarity())))


@query(_debounce_sql(200).replace("key, session::BIGINT AS session, min", "key, min"))
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The debounce of :func:`debounce` as a stream with a timer for each key, run over what is there.

    A session closes once time has passed it by, so an edit long after all others, of a key of its own, closes the last ones.
    """
    base = shared_dir(spark, "stream-debounce")
    e = _edits(spark, sf_dir)
    far = e.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select(F.lit(-1).cast("bigint").alias("key"), (F.unix_micros("ts") / 1e6).alias("ts_s"), "ts")
    e.select("key", "ts_s", "ts").repartition(1).write.parquet(f"{base}/in/a")
    for name in ("b", "c"):  # the watermark moves after a batch, and timers fire in the next
        far.withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {ord(name)} DAY")).write.parquet(f"{base}/in/{name}")
    stream = spark.readStream.schema(e.select("key", "ts_s", "ts").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{base}/in")
    conf = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = edits.debounced(stream, DEFAULT.stabilise_s, late="40 days").writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(conf, before)
    return spark.read.schema(edits.OUT).parquet(f"{base}/out").filter("key >= 0")


# Whole pipelines: rows only ------------------------------------------------------------------------------------------


@query()
def chunk_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_notes(notes_from_documents(spark, sf_dir)).drop("text")


@query()
def embed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of all notes' chunks for each turn of each conversation."""
    chunks = materialise(vectors.embed_passages(chunking.chunk_notes(notes_from_documents(spark, sf_dir))), "search-chunks")
    asked = materialise(vectors.embed_questions(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")), "search-questions")
    q = asked.select(F.xxhash64("conv_id", "turn").alias("id"), F.lit(-1).alias("grp"), F.col("embedding").alias("vec"))
    c = chunks.select(F.xxhash64("file_path", "index").alias("id"), F.lit(0).alias("grp"), F.col("embedding").alias("vec"))
    return vectors.knn(q, c, 3).select("query_id", "rank", F.round("similarity", 4).alias("similarity"))


@query()
def link_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, embeddings, candidates that aren't linked yet, the stub judge's verdicts, and each note's new links."""
    notes = notes_from_documents(spark, sf_dir)
    chunks = materialise(vectors.embed_passages(chunking.chunk_notes(notes)), "link-chunks")
    links = notes.select(F.col("file_path").alias("src"), F.explode(md.linked_titles(F.col("text"))).alias("title"))
    cand = materialise(engine.link_candidates(chunks, chunks, links), "link-candidates")
    parts = chunks.groupBy(F.col("file_path").alias("src")).agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "text"))), lambda x: x["text"]).alias("parts"))
    heads = parts.join(notes.select(F.col("file_path").alias("src"), md.linked_titles(F.col("text")).alias("titles")), "src").select("src", tx.first_chunks(F.col("parts")).alias("excerpt"), "titles")
    answers = judge.call(backlinks.prompts(cand, heads))
    return backlinks.decided(cand.select("src", "candidate_id", "title", F.round("sim", 4).alias("sim")), judge.verdicts(answers)).select(F.xxhash64("src").alias("src"), "title", "sim", "reason")


@query()
def reason_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags, people and links of all notes, and their new texts, as the engine's reasoning pass makes them with the stub models."""
    notes = materialise(notes_from_documents(spark, sf_dir).select("file_path", "text"), "reason-notes")
    corpus = materialise(vectors.embed_passages(chunking.chunk_notes(notes)), "reason-corpus")
    tagged = spark.createDataFrame([], "tag string, doc string")
    ran = engine.reason_run(notes, corpus, tagged, spark.createDataFrame([], "alias string, canonical string, seq bigint"))
    return ran["texts"].select("file_path", "ok", F.sha2("text", 256).alias("digest"))
