"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from vellum.config import DEFAULT
from vellum.functions import markdown as md
from vellum.functions import text as tx
from vellum.operators import ingest, judge


def values(spark, f, inputs, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_words_and_tokens(spark):
    texts = ["", " ", "a", "a b c d\x1ce", "a\tb\n c", "w " * 37, "w " * 38, "w " * 263, "w " * 264]
    assert values(spark, tx.words, texts) == [0, 0, 1, 5, 3, 37, 38, 263, 264]
    assert values(spark, lambda c: tx.tokens(tx.words(c)), texts) == [1, 1, 1, 6, 4, 49, 50, 350, 352]


def test_slugs(spark):
    assert values(spark, tx.tag_slug, ["Second Brain", "C++", "  --A__b-- ", "!!!", "O'Brien", " x "]) == ["second-brain", "c", "a-b", "", "o-brien", "x"]
    assert values(spark, tx.entity_slug, ["Rohit Sharma", "O'Brien", "J. R.  Doe"]) == ["rohit-sharma", "obrien", "j-r-doe"]
    assert values(spark, tx.accepted_tag, ["journal", "", "yoga"]) == [False, False, True]


def test_paths(spark):
    paths = ["v/a.md", "v/_a.md", "v/.a.md", "v/~a.md", "v/a.txt", "v/templates/a.md", "templates/v/a.md"]
    assert values(spark, lambda c: tx.relevant_path(c, DEFAULT.ignored_dirs), paths) == [True, True, False, False, False, False, False]
    assert values(spark, tx.stem, ["v/a.b.md", "x", ".md", "v/y.md"]) == ["a.b", "x", ".md", "y"]


def test_strip_is_python_strip(spark):
    cases = ["  a ", " a　", "\x1ca\x1f", "\na b\n", ""]
    assert values(spark, tx.strip, cases) == [c.strip() for c in cases]


def test_json_answers(spark):
    texts = ['```json\n{"a": 1}\n```', 'x {"a":1} y', "nope"]
    assert values(spark, tx.json_object, texts) == ['{"a": 1}', '{"a":1}', None]
    assert judge.whole_json('{"a":1} {"b":2}', "object") is None and judge.whole_json("[1,", "array") is None and judge.whole_json('x [{"x":1}] y', "array") == '[{"x":1}]'


def test_retry_delay(spark):
    assert values(spark, tx.retry_delay, ['429 slow down retryDelay: "7s"', "RESOURCE_EXHAUSTED", "500"]) == [9.0, 10.0, None]


def test_page_id(spark):
    rows = spark.createDataFrame([(0, "Morning", "04/03/26"), (1, "Morning", None), (2, " ", None), (3, None, "1:2")], "i int, t string, d string")
    assert [r.y for r in rows.select("i", tx.page_id(F.col("t"), F.col("d")).alias("y")).orderBy("i").collect()] == ["04-03-26 - Morning", "Morning", "Entry", "1-2 - Entry"]


def test_frontmatter(spark):
    texts = ["---\na: 1\n---\nbody", "---\nno end", "---\n---\nx\n---\ny", "plain"]
    assert values(spark, md.without_frontmatter, texts) == ["body", "---\nno end", "y", "plain"]
    lists = [f"---\ntags: {x}\n---\nb" for x in ('[a, "b"]', "[]", "x")] + ["---\ntags:\n- a\n---\nb", "b"]
    assert values(spark, lambda c: md.field_list(c, "tags"), lists) == [["a", "b"], [], ["x"], [], []]


def links(*titles):
    return F.array(*[F.struct(F.lit(t).alias("title"), F.lit("r").alias("reason")) for t in titles])


def test_links_are_added_once(spark):
    plain, have = "text \n\n", "text\n\n## Related Notes\n\n- [[t1]] — r\n\n## Next\nx"
    once = values(spark, lambda c: md.add_links(c, links("t1")), [plain])[0]
    assert once == "text\n\n## Related Notes\n\n- [[t1]] — r\n"
    assert values(spark, lambda c: md.add_links(c, links("t1")), [once]) == [once]
    grown = values(spark, lambda c: md.add_links(c, links("t1", "t3", "t3")), [have])[0]
    assert grown.count("[[t1]]") == 1 and grown.count("[[t3]]") == 1 and grown.index("[[t3]]") < grown.index("## Next")


def test_lists_are_set_once(spark):
    items = F.array(F.lit("a$1"), F.lit("b\\"))
    for text in ("---\ntags: [x]\ntitle: t\n---\n\nbody", "---\ntitle: t\n---\nbody", "body"):
        once = values(spark, lambda c: md.set_list(c, "tags", items), [text])[0]
        assert "tags: [a$1, b\\]" in once and once.endswith("body")
        assert values(spark, lambda c: md.set_list(c, "tags", items), [once]) == [once]
    assert values(spark, lambda c: md.set_list(c, "tags", F.array().cast("array<string>")), ["body"]) == ["body"]


def test_body(spark):
    text = "---\na: 1\n---\n\nsays\n\n## Related Notes\n\n- [[x]] — y\n"
    assert values(spark, md.body, [text, "plain"]) == ["says", "plain"]


def test_pages(spark):
    rows = spark.createDataFrame([("p1", '```json\n{"text": "a\\nb", "summary": "s", "written_date": "04/03/26", "title": "Day"}\n```', ["x.jpg", "y.png"]), ("p2", "just words", ["z.jpg"])], "page string, answer string, files array<string>")
    got = {r.page: r for r in ingest.pages(rows).collect()}
    assert got["p1"].page_id == "04-03-26 - Day" and "> a\n> b" in got["p1"].text and "![[04-03-26 - Day - p2.png]]" in got["p1"].text
    assert got["p2"].page_id == "Untitled Entry" and "> just words" in got["p2"].text and "![[Untitled Entry.jpg]]" in got["p2"].text


def test_rotation(spark):
    assert values(spark, ingest.rotation, [[1.0, 3.0, 2.0], [1.0, 2.0], [50.0], []], "array<double>") == [pytest.approx(2), pytest.approx(1.5), 0, 0]
