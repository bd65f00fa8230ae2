"""The engine's passes over a small vault, from first sight to deletion."""

import json
import os

import pytest
from pyspark.sql import functions as F

from vellum.config import Config
from vellum.engine import Engine, search_rows
from vellum.operators import judge, lifecycle
from vellum.sources import notes as sources
from vellum.sources import store

WORDS = "quiet morning river walking slowly thinking about gardens and stones while autumn leaves drift along the water below old bridges where swallows nest every spring"


def note(extra, front="---\ntitle: x\n---\n"):
    return f"{front}# {extra}\n\n" + " ".join([WORDS] * 3) + f"\n\n{extra} " + " ".join([WORDS] * 3) + "\n"


def classify(system, user):
    if "broken" in user:
        raise RuntimeError("500 server")
    return json.dumps({"tags": ["River Walks"], "new_tags_proposed": ["river-walks"], "people": [{"surface": "Rohit", "canonical": "Rohit Sharma"}]})


@pytest.fixture
def engine(spark, tmp_path):
    vault = tmp_path / "vault"
    (vault / "sub").mkdir(parents=True)
    (vault / "a.md").write_text(note("alpha"))
    (vault / "sub" / "b.md").write_text(note("beta"))
    (vault / "c.md").write_text(note("broken"))
    (vault / "bad.md").write_bytes(b"caf\xe9 " * 60)
    (vault / ".hidden.md").write_text(note("no"))
    clock = [10_000.0]
    cfg = Config(stabilise_s=0.0, cooldown_s=0.0, threshold=0.5, reason_every_s=0.0)
    own = Engine(spark, str(vault), f"file://{tmp_path}/store", cfg=cfg, classifier=judge.chain_of(classify), clock=lambda: clock[0])
    own.moment = clock
    return own


def test_from_first_sight_to_deletion(engine):
    e = engine
    e.bootstrap()
    e.poll()
    e.moment[0] = 4e9  # long after the files were written
    first = e.index_pass()
    name = lambda r: os.path.basename(r.file_path)
    assert {name(r) for r in first["ticks"].filter("embed").collect()} == {"a.md", "b.md", "c.md"}
    states = {name(r): r for r in e.table("states").collect()}
    assert {r.current_state for r in states.values()} == {"INDEXED"} and all(r.content_hash and r.last_index_time for r in states.values())
    assert states["a.md"].embedding_version == "hashed-words" and states["bad.md"].embedding_version is None
    assert e.index_pass()["ticks"].filter("embed").count() == 0  # nothing has changed

    e.reason_pass()
    states = {name(r): r.current_state for r in e.table("states").collect()}
    assert states == {"a.md": "REASONED", "b.md": "REASONED", "c.md": "INDEXED", "bad.md": "INDEXED"}
    text = (lambda p: open(os.path.join(e.vault, p)).read())  # noqa: E731, SIM115
    assert "tags: [river-walks" in text("a.md") and "entities: [Rohit Sharma]" in text("a.md") and "[[b]]" in text("a.md") and "[[a]]" in text("sub/b.md") and "tags" not in text("c.md")
    assert os.path.exists(os.path.join(e.vault, "entities", "Rohit Sharma.md"))
    assert {r.tag for r in e.table("tags").collect()} >= {"river-walks"} and e.table("aliases").filter("alias = 'Rohit'").first().canonical == "Rohit Sharma"

    e.poll()  # our own writes are no edits, the new stub is one
    changed = {name(r): r.current_state for r in e.table("states").collect()}
    assert changed["a.md"] == "REASONED" and changed["Rohit Sharma.md"] == "DIRTY"
    with open(os.path.join(e.vault, "a.md"), "a") as f:
        f.write("\nmore words\n")
    e.poll()
    assert {name(r): r.current_state for r in e.table("states").collect()}["a.md"] == "DIRTY"

    hits = search_rows(e.search(WORDS, 3)).collect()
    assert hits and hits[0].rank == 1 and hits[0].file.endswith(".md") and any(h.tags.startswith("river-walks") for h in hits)
    os.remove(os.path.join(e.vault, "sub", "b.md"))
    e.poll()
    assert e.table("chunks").filter("file_path LIKE '%b.md'").count() == 0 and e.table("tags").filter("doc LIKE '%/b.md'").count() == 0 and e.table("states").filter("file_path LIKE '%/b.md'").count() == 0
    log = [r.action for r in e.spark.read.json(f"{e.root}/log").collect()]
    assert {"indexed", "tags_assigned", "entities_linked", "backlinks_added", "deleted"} <= set(log)


def test_same_body_is_not_reasoned_about_again(spark):
    states = spark.createDataFrame([("a", "READY_FOR_REASONING", 1.0, None, None, "h", None, None, None, None)], lifecycle.STATE)
    done = lifecycle.after_reasoning(states, spark.createDataFrame([("a", True, 2.0, 3.0, "h2", "b2", "m")], "file_path string, ok boolean, started_at double, finished_at double, hash string, body_hash string, model string"))
    row = done.first()
    assert (row.current_state, row.last_reasoned_hash, row.last_reasoned_body_hash, row.reasoning_version) == ("REASONED", "h2", "b2", "m")
    files = spark.createDataFrame([("a", "h3", "b2", 2)], "file_path string, hash string, body_hash string, n_chunks int")
    tick = lifecycle.index_tick(done.withColumn("current_state", F.lit("DIRTY")), files, F.lit(1000.0)).first()
    assert (tick.after, tick.embed) == ("REASONED", False)


def test_session_waits_for_a_vault(spark, tmp_path):
    slept = []
    own = Engine(spark, str(tmp_path / "none"), f"file://{tmp_path}/store")
    assert own.session(3, sleep=slept.append) == 3 and slept == [5.0, 5.0]


def test_damaged_notes_are_set_aside(spark, tmp_path):
    (tmp_path / "ok.md").write_text("fine\r\nline")
    (tmp_path / "bad.md").write_bytes(b"caf\xe9 x")
    got = {os.path.basename(r.file_path): (r.text, r.body_text) for r in sources.vault(spark, str(tmp_path)).collect()}
    assert got == {"ok.md": ("fine\nline", "fine\nline"), "bad.md": (None, "caf x")}
    assert [os.path.basename(r.file_path) for r in sources.quarantined(sources.vault(spark, str(tmp_path))).collect()] == ["bad.md"]


def test_versions_have_one_writer_each(spark, tmp_path):
    t = store.Versioned(spark, f"file://{tmp_path}/t")
    for i in range(4):
        t.publish(spark.range(i + 1))
    assert t.read().count() == 4 and len(os.listdir(tmp_path / "t")) <= 8
    with pytest.raises(RuntimeError):
        t.publish(spark.range(9), over=3)
    assert t.read().count() == 4


def test_registries_survive_a_file(spark, tmp_path):
    rows = spark.createDataFrame([("x", "d1"), ("x", "d2"), ("y", None)], "tag string, doc string")
    path = f"file://{tmp_path}/tags"
    store.save_registry(rows, path)
    with open(tmp_path / "tags" / "part-broken.json", "w") as f:
        f.write("{not json\n")
    assert sorted(map(tuple, store.load_registry(spark, path).collect()), key=repr) == [("x", "d1"), ("x", "d2"), ("y", None)]
    assert store.load_registry(spark, path + "-none").count() == 0


def test_chains_fall_back():
    asked, slept = [], []

    def provider(name):
        def model(system, user):
            asked.append((name, system))
            if name == "a":
                raise RuntimeError("429 quota PerDay")
            if name == "b" and sum(n == "b" for n, _ in asked) < 2:
                raise RuntimeError('429 retryDelay: "20s"')
            return " yes "

        return model

    c = judge.Chain([("p", "a"), ("p", "b")], {"p": provider}, sleep=slept.append)
    assert c.ask("s", "u") == ("yes", "b") and slept == [22.0] and c.done == {("p", "a")}
    assert c.ask("s", "u") == ("yes", "b") and [n for n, _ in asked] == ["a", "b", "b", "b"]
    folded = judge.Chain([("p", "gemma-x")], {"p": lambda _: lambda s, u: f"{s}|{u}"})
    assert folded.ask("s", "u") == ("|s\n\nu", "gemma-x")
    with pytest.raises(judge.Exhausted):
        judge.Chain([("p", "a")], {"p": provider}).ask("", "")
    with pytest.raises(ValueError, match="unknown"):
        judge.Chain([("q", "a")], {})
    now = [0.0]
    s = judge.Spacing(5, clock=lambda: now[0], sleep=lambda t: now.__setitem__(0, now[0] + t))
    for _ in range(3):
        s.wait()
    assert now[0] == 24.0
