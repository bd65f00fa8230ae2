"""Registries of tags and of people.

The batch forms are aggregations over (tag, document) and (alias, entity) rows.  Where the outcome depends on the order of documents, the
replays take it from ``seq`` within a registry: keys of independent registries (``space``) run in parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import DEFAULT, Config
from vellum.functions.text import accepted_tag


def tag_counts(tagged: DataFrame) -> DataFrame:
    """Documents of each tag."""
    return tagged.dropDuplicates(["tag", "doc"]).groupBy("tag").agg(F.count(F.lit(1)).alias("n_docs"))


def promoted(tagged: DataFrame, least: int = DEFAULT.tag_min_documents) -> DataFrame:
    """(tag, doc) of the tags that enough documents have."""
    pairs = tagged.select("tag", "doc").distinct()
    return pairs.join(tag_counts(pairs).filter(F.col("n_docs") >= least), "tag").select("tag", "doc", "n_docs")


def capped(tagged: DataFrame, order: str, most: int = DEFAULT.max_tags) -> DataFrame:
    """The first ``most`` distinct tags of each document."""
    first = tagged.groupBy("doc", "tag").agg(F.min(order).alias("at"))
    return first.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("at", "tag"))).filter(F.col("k") <= most).select("doc", "tag", F.col("k").cast("int").alias("k"))


def without_documents(tagged: DataFrame, gone: DataFrame) -> DataFrame:
    """Counts after documents are removed; tags that no document has any more stay, with 0."""
    left = tag_counts(tagged.join(gone.select("doc"), "doc", "left_anti"))
    return tagged.select("tag").distinct().join(left, "tag", "left").select("tag", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def of_documents(named: DataFrame, docs: DataFrame, name: str = "tag") -> DataFrame:
    """What a registry (``name``, doc) holds for the documents asked for: doc and a sorted array, empty where it holds nothing."""
    own = named.join(docs.select("doc").distinct(), "doc", "left_semi").groupBy("doc").agg(F.array_sort(F.collect_set(name)).alias("names"))
    return docs.select("doc").distinct().join(own, "doc", "left").select("doc", F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def union_distinct(*sets: DataFrame) -> DataFrame:
    """Rows that any of the tables has, once."""
    return union_all(*sets).distinct()


def union_all(*bags: DataFrame) -> DataFrame:
    """Rows of all tables, as often as they have them."""
    out = bags[0]
    for b in bags[1:]:
        out = out.unionByName(b)
    return out


def canonical_distinct(resolved_mentions: DataFrame) -> DataFrame:
    """Each document's entities, once: doc, entity."""
    return resolved_mentions.filter(F.coalesce("entity", F.lit("")) != "").select("doc", "entity").distinct()


def onto_chunks(chunks: DataFrame, tagged: DataFrame, entities: DataFrame) -> DataFrame:
    """Chunks (file_path, ...) with their document's tags and entities as sorted arrays."""
    t = tagged.groupBy(F.col("doc").alias("file_path")).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    e = entities.groupBy(F.col("doc").alias("file_path")).agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    none = F.array().cast("array<string>")
    both = chunks.drop("tags", "entities").join(t, "file_path", "left").join(e, "file_path", "left")
    return both.withColumn("tags", F.coalesce("tags", none)).withColumn("entities", F.coalesce("entities", none))


def without_entity_documents(entity_docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Entities with the number of documents left after some are removed; an entity without any stays, with 0."""
    left = entity_docs.join(gone.select("doc"), "doc", "left_anti").dropDuplicates(["entity", "doc"]).groupBy("entity").agg(F.count(F.lit(1)).alias("n_docs"))
    return entity_docs.select("entity").distinct().join(left, "entity", "left").select("entity", F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


def alias_json(aliases: DataFrame) -> DataFrame:
    """The alias map as one compact JSON object, as prompts show it: a single row ``json``.  A prompt bounds what a registry may hold."""
    pairs = alias_map(aliases).filter("canonical IS NOT NULL").agg(F.array_sort(F.collect_list(F.struct("alias", "canonical"))).alias("p"))
    return pairs.select(F.to_json(F.map_from_entries("p")).alias("json"))


def counts_json(counts: DataFrame) -> DataFrame:
    """tag -> number of documents as one JSON object: a single row ``json``."""
    return counts.agg(F.array_sort(F.collect_list(F.struct("tag", "n_docs"))).alias("p")).select(F.to_json(F.map_from_entries("p")).alias("json"))


def replay_tags(docs: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(space, seq, doc, candidates array, proposed array), normalised slugs -> tags that each document gets, documents in order of ``seq``: space, seq, doc, tags.

    A registered tag is taken at once; a new one is registered, and taken if it was proposed and has three characters, or is named again; tags that the document
    has and enough documents have by then are taken too.  Distinct, then capped.

    Who came before is a matter of the first ``seq`` of a tag, and when enough documents have it of the n-th smallest first ``seq`` of its documents: both are
    aggregates, so nothing is replayed row by row and no registry is one task.
    """
    empty = F.array().cast("array<string>")
    named = docs.select("space", "seq", "doc", F.coalesce("candidates", empty).alias("c"), F.coalesce("proposed", empty).alias("p"))
    each = named.select("space", "seq", "doc", "p", F.posexplode(F.concat("c", "p")).alias("at", "tag")).filter(F.col("tag").isNotNull() & accepted_tag(F.col("tag")))
    items = each.groupBy("space", "seq", "doc", "tag").agg(F.array_sort(F.collect_list("at")).alias("at"), F.max(F.array_contains("p", F.col("tag"))).alias("proposed"))

    held = items.groupBy("space", "tag", "doc").agg(F.min("seq").alias("since"))
    place = F.row_number().over(Window.partitionBy("space", "tag").orderBy("since", "doc"))
    early = held.withColumn("i", place).filter(F.col("i") <= max(1, cfg.tag_min_documents))  # Spark cuts each task's rows to those before the shuffle
    tags = early.groupBy("space", "tag").agg(F.min("since").alias("first"), F.max(F.when(F.col("i") == cfg.tag_min_documents, F.col("since"))).alias("enough"))
    born = items.join(tags, ["space", "tag"]).filter(F.col("seq") == F.col("first")).groupBy("space", "tag").agg(F.min(F.col("at")[0]).alias("born"))

    known = items.join(tags, ["space", "tag"]).withColumn("old", F.col("first") < F.col("seq"))
    at_once = F.col("old") | (F.col("proposed") & (F.length("tag") >= 3))
    taken = known.withColumn("k", F.when(at_once, F.col("at")[0]).otherwise(F.get("at", F.lit(1)))).filter("k IS NOT NULL")
    own = held.join(tags, ["space", "tag"]).join(born, ["space", "tag"]).filter("enough IS NOT NULL")
    grown = named.select("space", "seq", "doc").join(own, ["space", "doc"]).filter((F.col("since") <= F.col("seq")) & (F.col("enough") <= F.col("seq")))
    # Tags taken at once come first, in the order of the note, then the others in the order in which they were registered.
    seq = docs.schema["seq"].dataType
    at_once = F.struct(F.lit(0).alias("part"), F.col("k").alias("k"), F.lit(None).cast(seq).alias("first"), "tag")
    later = F.struct(F.lit(1).alias("part"), F.col("born").alias("k"), F.col("first").alias("first"), "tag")
    order = lambda a, b: F.when(a["part"] != b["part"], a["part"] - b["part"]).when(a["first"] < b["first"], -1).when(a["first"] > b["first"], 1).when(a["k"] != b["k"], a["k"] - b["k"]).when(a["tag"] < b["tag"], -1).when(a["tag"] > b["tag"], 1).otherwise(0)
    got = taken.select("space", "seq", "doc", at_once.alias("r")).unionByName(grown.select("space", "seq", "doc", later.alias("r")))
    lists = got.groupBy("space", "seq", "doc").agg(F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list("r"), order), lambda x: x["tag"])), 1, cfg.max_tags).alias("tags"))
    return named.select("space", "seq", "doc").join(lists, ["space", "seq", "doc"], "left").select("space", "seq", "doc", F.coalesce("tags", empty).alias("tags"))


def alias_map(aliases: DataFrame) -> DataFrame:
    """(alias, canonical, seq) -> one canonical for each alias in lower case, the last one given."""
    return aliases.filter(F.coalesce("alias", F.lit("")) != "").groupBy(F.lower("alias").alias("alias")).agg(F.max_by("canonical", F.struct("seq", "canonical")).alias("canonical"))


def resolved(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Mentions (surface, canonical) with the entity they mean: by surface, else by canonical, else a new one; a blank canonical is the surface."""
    m = alias_map(aliases)
    name = F.coalesce(F.when(F.col("canonical") != "", F.col("canonical")), F.col("surface"))
    by_surface = m.select(F.col("alias").alias("a1"), F.col("canonical").alias("c1"))
    by_name = m.select(F.col("alias").alias("a2"), F.col("canonical").alias("c2"))
    both = mentions.withColumn("name", name).join(by_surface, F.lower("surface") == F.col("a1"), "left").join(by_name, F.lower("name") == F.col("a2"), "left")
    return both.withColumn("entity", F.coalesce("c1", "c2", "name")).withColumn("known", F.col("c1").isNotNull() | F.col("c2").isNotNull()).drop("name", "a1", "a2", "c1", "c2")


def replay_entities(items: DataFrame) -> DataFrame:
    """(space, seq, surface, canonical) in order -> entity and aliases of each registry."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        owner: dict[str, str] = {}
        aliases: dict[str, list[str]] = {}
        for r in pdf.sort_values("seq").itertuples():
            surface, canonical = r.surface or "", r.canonical or r.surface or ""
            if not canonical:
                continue
            entity = owner.get(surface.lower()) or owner.get(canonical.lower())
            if entity is None:
                entity = owner[canonical.lower()] = canonical
                aliases[entity] = []
            if surface and surface.lower() != entity.lower() and surface not in aliases[entity]:
                aliases[entity].append(surface)
                owner.setdefault(surface.lower(), entity)
        return pd.DataFrame([(pdf["space"].iloc[0], e, a) for e, a in aliases.items()], columns=["space", "entity", "aliases"])

    return items.groupBy("space").applyInPandas(run, "space string, entity string, aliases array<string>")


def notes_to_create(entities: DataFrame, entity_docs: DataFrame, existing: DataFrame) -> DataFrame:
    """Flagged entities (entity, create_note) that a document has and no note is called after."""
    return entities.filter("create_note").join(entity_docs.select("entity").distinct(), "entity", "left_semi").join(existing.select(F.col("title").alias("entity")), "entity", "left_anti")


