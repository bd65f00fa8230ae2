"""The life of a note: states, guarded transitions, index and reasoning passes as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.config import DEFAULT, Config

# States, what may be done in them, and how they follow each other (fixed values).
STATES = ("NEW", "DIRTY", "STABILIZING", "INDEXED", "READY_FOR_REASONING", "REASONED")
ACTIONS = {
    "NEW": ("register_metadata",),
    "DIRTY": ("update_timestamps",),
    "STABILIZING": ("compute_content_hash",),
    "INDEXED": ("chunk", "embed", "vector_upsert"),
    "READY_FOR_REASONING": ("similarity_search", "rag_reasoning", "tag_entity_inference", "markdown_mutation"),
    "REASONED": (),
}
TRANSITIONS = (
    ("NEW", "DIRTY"), ("NEW", "INDEXED"), ("DIRTY", "DIRTY"), ("DIRTY", "STABILIZING"), ("STABILIZING", "DIRTY"), ("STABILIZING", "INDEXED"),
    ("STABILIZING", "REASONED"), ("INDEXED", "DIRTY"), ("INDEXED", "READY_FOR_REASONING"), ("READY_FOR_REASONING", "DIRTY"), ("READY_FOR_REASONING", "REASONED"), ("REASONED", "DIRTY"),
)
#: Beside them, a failed reasoning pass goes back.
ROLLBACK = ("READY_FOR_REASONING", "INDEXED")


#: A note's row in the state table.
STATE = (
    "file_path string, current_state string, last_edit_time double, last_index_time double, last_reason_time double, content_hash string, "
    "last_reasoned_hash string, last_reasoned_body_hash string, embedding_version string, reasoning_version string"
)


def legal(before: Column, after: Column) -> Column:
    return F.concat(before, F.lit(">"), after).isin(*[f"{a}>{b}" for a, b in TRANSITIONS])


def allowed(state: Column, action: Column) -> Column:
    return F.concat(state, F.lit(":"), action).isin(*[f"{s}:{a}" for s, acts in ACTIONS.items() for a in acts])


def transitions(events: DataFrame, key: str, order: list[str], state: str = "state") -> DataFrame:
    """Successive states of each key with ``ok``: whether the second may follow the first."""
    before = F.lag(state).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).filter(F.col("before").isNotNull()).withColumn("ok", legal(F.col("before"), F.col(state)))


def bootstrap(files: DataFrame, states: DataFrame) -> DataFrame:
    """Rows for files without a state: DIRTY since they were last changed."""
    return files.join(states.select("file_path"), "file_path", "left_anti").select("file_path", F.lit("DIRTY").alias("current_state"), F.col("mtime").alias("last_edit_time"))


def edited(states: DataFrame, edits: DataFrame) -> DataFrame:
    """States after edits (file_path, ts): DIRTY, but for a note that is being reasoned about, which only gets the time; new notes are registered."""
    last = edits.groupBy("file_path").agg(F.max("ts").alias("ts"))
    both = states.join(last, "file_path", "full")
    touched = F.col("ts").isNotNull()
    state = F.when(touched & (F.coalesce("current_state", F.lit("NEW")) != "READY_FOR_REASONING"), "DIRTY").otherwise(F.col("current_state"))
    return both.withColumn("current_state", state).withColumn("last_edit_time", F.when(touched, F.greatest("ts", F.coalesce("last_edit_time", "ts"))).otherwise(F.col("last_edit_time"))).drop("ts")


def index_tick(states: DataFrame, files: DataFrame, now: Column, cfg: Config = DEFAULT) -> DataFrame:
    """One index pass over states joined with what the files are now.

    ``files``: file_path, hash, body_hash, n_chunks.  Notes that have been quiet long enough are decided upon: what was reasoned about in this very form is
    REASONED again, what is indexed in this form stays so, the rest is to be embedded.  Rows of vanished files get no state; their vectors are to be deleted.
    """
    both = states.join(files.withColumn("present", F.lit(True)), "file_path", "left")
    quiet = now - F.coalesce("last_edit_time", F.lit(0.0)) >= cfg.stabilise_s
    turn = (F.col("current_state") == "STABILIZING") | ((F.col("current_state") == "DIRTY") & quiet)
    gone = F.col("present").isNull()
    as_reasoned = F.col("hash").eqNullSafe(F.col("last_reasoned_hash")) | (F.col("last_reasoned_body_hash").isNotNull() & (F.col("body_hash") == F.col("last_reasoned_body_hash")))
    as_indexed = (F.col("hash") == F.col("content_hash")) & F.col("last_index_time").isNotNull()
    new = F.when(~turn, F.col("current_state")).when(gone, F.lit(None)).when(as_reasoned, "REASONED").otherwise("INDEXED")
    embed = turn & ~gone & ~as_reasoned & ~F.coalesce(as_indexed, F.lit(False)) & (F.coalesce("n_chunks", F.lit(0)) > 0)
    return both.select("file_path", F.col("current_state").alias("before"), new.alias("after"), embed.alias("embed"), (turn & gone).alias("removed"))


def indexed(states: DataFrame, ticks: DataFrame, files: DataFrame, now: Column, version: str) -> DataFrame:
    """States after an index pass whose vectors are stored: the next pass finds the hashes that are written here.

    An embedded note gets its hash, the time and the encoder's ``version``; one that is INDEXED without embedding gets hash and time; one that is
    REASONED again only the state; rows of vanished files go.
    """
    both = states.join(ticks.select("file_path", "before", "after", "embed", "removed"), "file_path").join(files.select("file_path", "hash"), "file_path", "left").filter(~F.col("removed"))
    turned = (F.col("before").isin("DIRTY", "STABILIZING")) & (F.col("after") == "INDEXED")
    return (
        both.withColumn("current_state", F.col("after"))
        .withColumn("last_index_time", F.when(turned, now).otherwise(F.col("last_index_time")))
        .withColumn("content_hash", F.when(turned, F.col("hash")).otherwise(F.col("content_hash")))
        .withColumn("embedding_version", F.when(F.col("embed"), F.lit(version)).otherwise(F.col("embedding_version")))
        .select(*states.columns)
    )


def reason_tick(states: DataFrame, now: Column, cfg: Config = DEFAULT) -> DataFrame:
    """Indexed notes whose last reasoning is long enough ago, as many as the budget takes, in order of path; none while they are fewer than a batch."""
    ready = states.filter((F.col("current_state") == "INDEXED") & (now - F.coalesce("last_reason_time", F.lit(0.0)) >= cfg.cooldown_s))
    chosen = ready.orderBy("file_path").limit(max(cfg.notes_per_pass, cfg.least_per_pass))
    if cfg.least_per_pass > 1:  # at most that many rows
        chosen = chosen.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))).filter(F.col("__n") >= cfg.least_per_pass).drop("__n")
    return chosen.orderBy("file_path").limit(cfg.notes_per_pass)


def made_ready(states: DataFrame, chosen: DataFrame) -> DataFrame:
    """Chosen INDEXED notes become READY_FOR_REASONING."""
    mark = chosen.select("file_path", F.lit(True).alias("__chosen"))
    state = F.when(F.col("__chosen") & (F.col("current_state") == "INDEXED"), "READY_FOR_REASONING").otherwise(F.col("current_state"))
    return states.join(mark, "file_path", "left").withColumn("current_state", state).drop("__chosen")


def after_reasoning(states: DataFrame, outcomes: DataFrame) -> DataFrame:
    """States after outcomes (file_path, ok, started_at, finished_at; also hash, body_hash and model of what was written): back to INDEXED on failure, DIRTY if edited meanwhile, else REASONED.

    A REASONED note gets both hashes and the model's name, so that its own new text, or one with the same body, isn't reasoned about again.
    """
    extra = {"hash": "last_reasoned_hash", "body_hash": "last_reasoned_body_hash", "model": "reasoning_version"}
    own = outcomes.select("file_path", "ok", "started_at", "finished_at", *[(F.col(c) if c in outcomes.columns else F.lit(None).cast("string")).alias(f"__{c}") for c in extra])
    both = states.join(own, "file_path", "left")
    ours = F.col("ok").isNotNull() & (F.col("current_state") == "READY_FOR_REASONING")
    new = F.when(~ours, F.col("current_state")).when(~F.col("ok"), "INDEXED").when(F.coalesce("last_edit_time", F.lit(0.0)) > F.col("started_at"), "DIRTY").otherwise("REASONED")
    done = ours & F.col("ok")
    columns = {"current_state": new, "last_reason_time": F.when(done, F.col("finished_at")).otherwise(F.col("last_reason_time"))}
    columns |= {name: F.when(done, F.coalesce(f"__{c}", name)).otherwise(F.col(name)) for c, name in extra.items() if name in states.columns}
    return both.withColumns(columns).select(*states.columns)


def state_of(states: DataFrame, paths: DataFrame) -> DataFrame:
    """The rows of the paths asked for."""
    return states.join(paths.select("file_path").distinct(), "file_path", "left_semi")


def in_state(states: DataFrame, *wanted: str) -> DataFrame:
    """All notes in one of the states (every note, if none is named), in order of path."""
    return (states.filter(F.col("current_state").isin(*wanted)) if wanted else states).orderBy("file_path")


def debounce(edits: DataFrame, key: str, ts: str, gap_s: float) -> DataFrame:
    """Edit sessions: a gap of ``gap_s`` or more splits.  Returns key, session, first, last, n_edits."""
    order = Window.partitionBy(key).orderBy(ts)
    starts = F.coalesce((F.col(ts) - F.lag(ts).over(order)) >= gap_s, F.lit(True))
    numbered = edits.withColumn("session", F.sum(starts.cast("int")).over(order))
    return numbered.groupBy(key, "session").agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count(F.lit(1)).alias("n_edits"))


def snapshot_diff(before: DataFrame, now: DataFrame) -> DataFrame:
    """Changes between two listings (path, hash): created, modified, deleted."""
    both = before.select("path", F.col("hash").alias("h0")).join(now.select("path", F.col("hash").alias("h1")), "path", "full")
    change = F.when(F.col("h0").isNull(), "created").when(F.col("h1").isNull(), "deleted").when(F.col("h0") != F.col("h1"), "modified")
    return both.withColumn("event_type", change).filter("event_type IS NOT NULL").select("path", "event_type")


def file_events(events: DataFrame, own_writes: DataFrame | None = None) -> DataFrame:
    """Events (path, event_type, ts, dest) as changes of single paths: a move deletes one and creates another; our own writes (path, hash) are left out."""
    parts = F.when(F.col("event_type") == "moved", F.array(F.struct(F.col("path").alias("path"), F.lit("deleted").alias("event_type")), F.struct(F.col("dest").alias("path"), F.lit("created").alias("event_type"))))
    each = events.select("ts", "hash", F.explode(parts.otherwise(F.array(F.struct("path", "event_type")))).alias("e")).select("e.path", "e.event_type", "ts", "hash")
    return each if own_writes is None else each.join(own_writes, ["path", "hash"], "left_anti")
