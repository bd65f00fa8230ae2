"""Chunks, registries, links, life cycle, sources and streams."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from vellum.config import Config
from vellum.functions.text import GENERIC_TAGS
from vellum.operators import backlinks, chunking, judge, lifecycle, registry, vectors
from vellum.sources import notes, store


def W(n):  # noqa: N802
    return " ".join(["w"] * n)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (f"# A\n\n{W(40)}\n\n---\n\n{W(40)}", [("heading", "A", 42), ("heading", "A", 40)]),
        (f"{W(10)}\n\n# B\n{W(60)}", [("paragraph", "preamble", 10), ("heading", "B", 62)]),
        (f"# C\n- {W(20)}\n- {W(20)}\n- {W(20)}", [("heading", "C", 2), ("bullets", "C", 63)]),
        (f"> {W(10)}", []),
        (f"> Date_1 {W(39)}\n>\n\n> 2/3 {W(40)}", [("blockquote", "preamble", 40), ("blockquote", "preamble", 41)]),
        ("\n\n".join(map(W, (100, 100, 100, 300, 10, 60))), [("paragraph", "preamble", n) for n in (200, 100, 300, 70)]),
        ("\n\n".join(map(W, (250, 20, 250))), [("paragraph", "preamble", 250)] * 2),
        (f"#tag1 #tag2\n![[img.png]]\n{W(40)}", [("paragraph", "preamble", 40)]),
        (f"{W(40)}\n\n# D\n\n- x", [("paragraph", "preamble", 44)]),
        (f"- {W(30)}\n\n- {W(30)}", [("bullets", "preamble", 62)]),
        (f"- {W(60)}\n\n  {W(60)}", [("bullets", "preamble", 61), ("paragraph", "preamble", 60)]),
        (f"- {W(60)}\n  ---\n  {W(10)}", [("bullets", "preamble", 72)]),
        (f"- {W(60)}\n  #tag\n  {W(10)}", [("bullets", "preamble", 72)]),
        ("\n".join([W(200), "   ", W(200)]), [("paragraph", "preamble", 400)]),
        ("", []), ("\n \n---\n#tag\n", []),
        ("\n\n".join([W(30)] * 12), [("paragraph", "preamble", 240), ("paragraph", "preamble", 120)]),
    ],
)
def test_chunks(text, want):
    got = [(p.kind, p.heading, len(p.text.split())) for p in chunking.chunks_of(text)]
    assert got == want
    assert [(p.kind, p.heading, len(p.text.split())) for p in chunking.chunks_of(text.replace("\n", "\r\n"))] == want


def test_chunk_rows(spark):
    df = spark.createDataFrame([("v/a.md", f"{W(60)}\n\n# B\n\n{W(60)}"), ("v/b.md", None)], "file_path string, text string")
    rows = chunking.chunk_notes(df).orderBy("index").collect()
    assert [(r.chunk_id, r["index"], r.token_estimate) for r in rows] == [("a__0", 0, 80), ("a__1", 1, 82)]


def test_packing_matches_the_machine(spark):
    sizes = [100, 100, 100, 300, 10, 60]
    assert spark.range(1).select(chunking.pack(F.array(*map(F.lit, sizes))).alias("g")).first().g == [0, 0, 1, 2, 3, 3]


def test_tags_replayed(spark):
    rows = [(0, 1, "d1", ["mind-fulness"], []), (0, 2, "d2", ["mind-fulness"], []), (0, 3, "d1", [], []), (0, 4, "d3", [], ["ai"]), (0, 5, "d3", ["yoga"], ["yoga"])]
    schema = "space int, seq int, doc string, candidates array<string>, proposed array<string>"
    for n, want in enumerate([[], ["mind-fulness"], ["mind-fulness"], [], ["yoga"]], 1):
        got = registry.replay_tags(spark.createDataFrame(rows[:n], schema).withColumn("space", F.col("space").cast("string"))).orderBy("seq").collect()
        assert got[-1].tags == want


def brute_tags(rows, least=2, most=8):
    """Documents one after the other."""
    holders, out = {}, []
    for _, seq, doc, candidates, proposed in rows:
        got = []
        for tag in [*candidates, *proposed]:
            if tag and tag not in GENERIC_TAGS:
                known = tag in holders
                holders.setdefault(tag, set()).add(doc)
                if known or (tag in proposed and len(tag) >= 3):
                    got.append(tag)
        got += [t for t, d in holders.items() if doc in d and len(d) >= least]
        out.append((seq, list(dict.fromkeys(got))[:most]))
    return out


@pytest.mark.parametrize("least", [1, 2, 3])
def test_tags_against_a_replay(spark, least):
    rng = random.Random(least)
    names = [f"t{i}" for i in range(12)] + ["ai", "xy", "life", ""]
    rows = [("s", i, f"d{rng.randrange(25)}", rng.choices(names, k=rng.randrange(6)), rng.choices(names, k=rng.randrange(4))) for i in range(60)]
    df = spark.createDataFrame(rows, "space string, seq int, doc string, candidates array<string>, proposed array<string>")
    got = registry.replay_tags(df, Config(tag_min_documents=least)).orderBy("seq").collect()
    assert [(r.seq, r.tags) for r in got] == brute_tags(rows, least)


def test_entities_replayed(spark):
    rows = [("s", 1, "rohit", "Rohit Sharma"), ("s", 2, "ROHIT", "R. Sharma"), ("s", 3, "X", ""), ("s", 4, "", "Y"), ("s", 5, "", "")]
    got = {r.entity: r.aliases for r in registry.replay_entities(spark.createDataFrame(rows, "space string, seq int, surface string, canonical string")).collect()}
    assert got == {"Rohit Sharma": ["rohit", "ROHIT"], "X": [], "Y": []}


def test_candidates(spark):
    hits = spark.createDataFrame([("s", 0, 1, "t1", 0.80), ("s", 0, 2, "t2", 0.75), ("s", 1, 1, "t3", 0.90), ("s", 1, 2, "t1", 0.85), ("s", 2, 1, "t2", 0.75)], "src string, chunk int, rank int, target string, sim double")
    assert {r.target: (r.sim, r.chunk) for r in backlinks.best_hits(hits).collect()} == {"t1": (0.85, 1), "t2": (0.75, 0), "t3": (0.9, 1)}
    assert {r.target: r.candidate_id for r in backlinks.numbered(hits).collect()} == {"t1": 0, "t2": 1, "t3": 2}
    left = backlinks.not_linked(hits.withColumn("title", F.col("target")), spark.createDataFrame([("s", "T2")], "src string, title string"))
    assert {r.target: r.candidate_id for r in backlinks.numbered(left).collect()} == {"t1": 0, "t3": 1}
    said = spark.createDataFrame([("s", 0, True, "concept", ""), ("s", 1, True, "none", ""), ("s", 2, False, "x", ""), ("s", 7, True, "x", ""), ("s", -1, True, "x", "")], "src string, candidate_id int, should_link boolean, link_type string, reason string")
    assert [r.candidate_id for r in backlinks.decided(backlinks.numbered(hits), said).collect()] == [0]


def test_judge_records_errors(spark):
    def fails(prompt):
        raise RuntimeError("429")

    prompts = spark.createDataFrame([(1, "[0] t / h (0.900)\nx\n[1] u / h (0.100)")], "src int, prompt string")
    assert judge.call(prompts, fails).first().error == "429"
    assert [(v.candidate_id, v.should_link) for v in judge.verdicts(judge.call(prompts)).orderBy("candidate_id").collect()] == [(0, True), (1, False)]


def test_slots(spark):
    rows = spark.createDataFrame([("m", i, float(t)) for i, t in enumerate((0, 1, 2, 40))], "model string, id int, t double")
    assert [r.slot for r in judge.slots(rows, "model", "t", 12.0).orderBy("id").collect()] == [0, 12, 24, 40]


def test_transitions_and_actions(spark):
    pairs = spark.createDataFrame([(a, b) for a in lifecycle.STATES for b in lifecycle.STATES], "a string, b string")
    good = {(r.a, r.b) for r in pairs.filter(lifecycle.legal(F.col("a"), F.col("b"))).collect()}
    assert good == set(lifecycle.TRANSITIONS) and len(good) == 12
    assert spark.range(1).select(lifecycle.allowed(F.lit("INDEXED"), F.lit("embed")).alias("x"), lifecycle.allowed(F.lit("NEW"), F.lit("embed")).alias("y")).first() == (True, False)


STATES = "file_path string, current_state string, last_edit_time double, content_hash string, last_reasoned_hash string, last_reasoned_body_hash string, last_index_time double, last_reason_time double"


def test_index_pass(spark):
    rows = [
        ("1", "DIRTY", 900.0, None, None, None, None, None), ("2", "DIRTY", 800.0, None, None, None, None, None), ("3", "DIRTY", None, None, None, None, None, None),
        ("4", "STABILIZING", None, None, "h", None, None, None), ("5", "STABILIZING", None, None, "other", "b", None, None), ("6", "STABILIZING", None, "h", None, None, 1.0, None),
        ("7", "STABILIZING", None, "h", None, None, None, None), ("8", "STABILIZING", None, None, None, None, None, None), ("9", "STABILIZING", None, None, None, None, None, None), ("10", "REASONED", 0.0, None, None, None, None, None),
    ]
    files = spark.createDataFrame([(str(i), "h", "b", 0 if i == 9 else 2) for i in range(1, 11) if i != 8], "file_path string, hash string, body_hash string, n_chunks int")
    got = {r.file_path: (r.after, r.embed, r.removed) for r in lifecycle.index_tick(spark.createDataFrame(rows, STATES), files, F.lit(1000.0)).collect()}
    assert got == {
        "1": ("DIRTY", False, False), "2": ("INDEXED", True, False), "3": ("INDEXED", True, False), "4": ("REASONED", False, False), "5": ("REASONED", False, False),
        "6": ("INDEXED", False, False), "7": ("INDEXED", True, False), "8": (None, False, True), "9": ("INDEXED", False, False), "10": ("REASONED", False, False),
    }


def test_reasoning_pass(spark):
    rows = [(f"{i:02d}", "INDEXED", 0.0, None, None, None, None, t) for i, t in enumerate([400.0, 401.0, None] + [0.0] * 20)]
    got = [r.file_path for r in lifecycle.reason_tick(spark.createDataFrame(rows, STATES), F.lit(1000.0)).collect()]
    assert len(got) == 16 and "00" in got and "01" not in got and "02" in got
    held = [("a", "READY_FOR_REASONING", 5.0, None, None, None, None, None), ("b", "READY_FOR_REASONING", 50.0, None, None, None, None, None), ("c", "READY_FOR_REASONING", 5.0, None, None, None, None, None)]
    out = spark.createDataFrame([("a", True, 10.0, 20.0), ("b", True, 10.0, 20.0), ("c", False, 10.0, 20.0)], "file_path string, ok boolean, started_at double, finished_at double")
    assert {r.file_path: r.current_state for r in lifecycle.after_reasoning(spark.createDataFrame(held, STATES), out).collect()} == {"a": "REASONED", "b": "DIRTY", "c": "INDEXED"}


def test_edits(spark):
    rows = [(s, s, 1.0, None, None, None, None, None) for s in lifecycle.STATES]
    edits = spark.createDataFrame([(s, 9.0) for s in lifecycle.STATES] + [("new", 3.0)], "file_path string, ts double")
    got = {r.file_path: (r.current_state, r.last_edit_time) for r in lifecycle.edited(spark.createDataFrame(rows, STATES), edits).collect()}
    assert got == {s: ("DIRTY" if s != "READY_FOR_REASONING" else s, 9.0) for s in lifecycle.STATES} | {"new": ("DIRTY", 3.0)}


EDITS = [(1, t) for t in (0.0, 199.0, 399.0, 600.0)] + [(2, 5.0)]


def test_debounce(spark):
    got = sorted((r.key, r.first, r.last, r.n_edits) for r in lifecycle.debounce(spark.createDataFrame(EDITS, "key bigint, ts double"), "key", "ts", 200.0).collect())
    assert got == [(1, 0.0, 199.0, 2), (1, 399.0, 399.0, 1), (1, 600.0, 600.0, 1), (2, 5.0, 5.0, 1)]


def test_stream_is_batch(spark, tmp_path):
    from vellum.streaming.edits import debounced, each_batch

    base = datetime.datetime(2024, 1, 1)
    rows = [(k, base + datetime.timedelta(seconds=t), t) for k, t in EDITS]
    late = [(9, base + datetime.timedelta(seconds=90_000), 90_000.0)]
    for i, part in enumerate((rows[:2], rows[2:], late, [(9, base + datetime.timedelta(seconds=180_000), 180_000.0)])):
        spark.createDataFrame(part, "key bigint, ts timestamp, ts_s double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        os.sync() if i < 0 else None
    stream = spark.readStream.schema("key bigint, ts timestamp, ts_s double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    each_batch(debounced(stream, 200.0, "1 hour"), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "check")).awaitTermination(120)
    got = sorted((r.key, r["first"], r["last"], r.n_edits) for r in spark.read.parquet(out).collect())
    assert [g for g in got if g[0] < 9] == [(1, 0.0, 199.0, 2), (1, 399.0, 399.0, 1), (1, 600.0, 600.0, 1), (2, 5.0, 5.0, 1)]


def test_vault(spark, tmp_path):
    for name in ("a.md", "_u.md", ".h.md", "~c.md", "templates/t.md", "sub/b.md", "x.txt"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_bytes(b"one\r\ntwo")
    got = {os.path.basename(r.file_path): r.text for r in notes.vault(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "one\ntwo", "_u.md": "one\ntwo", "b.md": "one\ntwo"}
    with pytest.raises(FileNotFoundError):
        notes.vault(spark, str(tmp_path / "none"))


def test_store(spark, tmp_path):
    t = store.Versioned(spark, str(tmp_path / "t"))
    assert t.read() is None
    t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), ["k"])
    t.upsert(spark.createDataFrame([(2, "c", 5)], "k int, v string, w int"), ["k"])
    assert sorted(tuple(r) for r in t.read().select("k", "v", "w").collect()) == [(1, "a", None), (2, "c", 5)]
    t.delete(spark.createDataFrame([(1,)], "k int"), ["k"])
    assert [r.k for r in t.read().collect()] == [2]


def test_events_and_snapshots(spark):
    before, now = (spark.createDataFrame(x, "path string, hash string") for x in ([("a", "1"), ("b", "1"), ("c", "1")], [("a", "1"), ("b", "2"), ("d", "1")]))
    assert {(r.path, r.event_type) for r in lifecycle.snapshot_diff(before, now).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "created")}
    moved = spark.createDataFrame([("a", "moved", 1.0, "b", "h"), ("c", "modified", 2.0, None, "own")], "path string, event_type string, ts double, dest string, hash string")
    got = {(r.path, r.event_type) for r in lifecycle.file_events(moved, spark.createDataFrame([("c", "own")], "path string, hash string")).collect()}
    assert got == {("a", "deleted"), ("b", "created")}


def test_vectors(spark):
    df = vectors.embed(spark.createDataFrame([(1, "a b c"), (2, "c b a"), (3, None)], "id int, text string"))
    rows = {r.id: r.embedding for r in df.collect()}
    assert rows[1] == rows[2] and set(rows[3]) == {0.0}
    v = spark.createDataFrame([(i, i % 2, [1.0, float(i)]) for i in range(40)], "id int, grp int, vec array<double>")
    for block in (4, 1000):
        got = vectors.knn(v, v, 3, block=block, parts=3).collect()
        assert len(got) == 120 and all(r.query_grp != r.grp for r in got)
    assert [r.id for r in vectors.knn(v.filter("id = 39"), v, 2).orderBy("rank").collect()] == [38, 36]
    assert vectors.lsh_join(v, 0.999).count() > 0


def test_all_notes_are_linked(spark, sf):
    from vellum.plans import catalogue

    paths = notes.notes_from_documents(spark, sf).select("doc_id", F.xxhash64("file_path").alias("src"), F.regexp_extract("file_path", r"([^/]+)\.md$", 1).alias("title")).collect()
    got = catalogue.queries()["link_pipeline"](spark, sf).collect()
    for column in ("src", "title"):
        found = {r[column] for r in got}
        assert {r.doc_id % 10 for r in paths if r[column] in found} == set(range(10))


def test_long_texts_and_all_turns_are_embedded(spark, sf):
    from vellum.plans import catalogue

    long = W(512)
    assert (vectors.hashed_words([long]) != vectors.hashed_words([long + " end" * 300])).any()
    turns = {r[0] for r in spark.read.parquet(f"{sf}/conversations.parquet").select(F.xxhash64("conv_id", "turn")).collect()}
    assert {r.query_id for r in catalogue.queries()["embed_search"](spark, sf).collect()} == turns


def test_vectors_are_packed_once_and_words_hashed_once(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(i, None if i % 11 == 0 else i % 5, (rng.integers(-3, 4, 6 if i % 4 else 3) + 0.5).tolist()) for i in range(300)] + [(None, 1, [1.0] * 6), (900, 1, None), (901, 1, [])]
    v = spark.createDataFrame(rows, "id int, grp int, vec array<double>").repartition(3)
    kept = [(i, g, np.array(x) / np.linalg.norm(x)) for i, g, x in rows if i is not None and x]
    want = set()
    for i, g, x in kept:
        near = sorted((-round(float(x @ y), 12), j) for j, h, y in kept if len(y) == len(x) and (g is None or g != h))
        want |= {(i, r + 1, j) for r, (s, j) in enumerate(near[:4]) if -s >= 0.6}
    monkeypatch.setattr(vectors, "AT_ONCE", 3000)
    found = vectors.knn(v, v, 4, threshold=0.6, block=40, parts=3, stream=16)
    assert {(r.query_id, r["rank"], r.id) for r in found.collect()} == want
    assert vectors.knn(v.limit(0), v, 4).count() == 0 and vectors.knn(v, v.limit(0), 4).count() == 0
    assert vectors.blocks_of(v, 40).agg(F.sum("n")).first()[0] == len(kept)  # each vector lies there once, however many blocks it meets
    vectors._hashes.clear()
    made = []
    monkeypatch.setattr(vectors.hashlib, "blake2b", lambda w, digest_size, own=vectors.hashlib.blake2b: made.append(w) or own(w, digest_size=digest_size))
    assert vectors.hashed_words(["one two one", "two"]).shape == (2, 64) and sorted(made) == [b"one", b"two"]


def test_best_are_those_of_double_precision(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    c = rng.normal(size=(900, 24)) + 2
    c[1::3] = c[::3] + rng.normal(size=(300, 24)) * 1e-9  # apart by less than single precision tells
    c[2::30] = c[::30]
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    q, ids, groups = c[:200], np.arange(900) * 7 % 900, np.arange(900) % 4
    taken = []
    own = vectors.Best.take
    monkeypatch.setattr(vectors.Best, "take", lambda self, r, *x: taken.append(len(r)) or own(self, r, *x))
    for threshold in (None, 0.9):
        best = vectors.Best(200, 5, threshold)
        for at in range(0, 900, 90):
            part = slice(at, at + 90)
            best.meet(q, c[part], ids[part], groups[part], lambda rows, part=part: groups[rows, None] == groups[None, part])
        want = set()
        for i in range(200):
            score = np.einsum("ij,ij->i", np.broadcast_to(q[i], c.shape), c).round(12)
            near = sorted((-s, j) for s, j, g in zip(score, ids, groups, strict=True) if g != groups[i] and s >= (threshold or -1))
            want |= {(i, j, -s) for s, j in near[:5]}
        assert set(zip(best.rows, best.ids, best.scores, strict=True)) == want
    assert sum(taken) < 2 * 200 * 900 / 4
