"""Scalar column functions on note text.  All are built-in expressions, so they stay in generated code.

White space is Unicode's plus the four separators U+001C to U+001F, as Python strings see it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\p{IsWhite_Space}\x1c-\x1f]"
#: Tags that say nothing (fixed values).
GENERIC_TAGS = ("thoughts", "life", "general", "misc", "journal", "entry", "note", "notes", "today", "day")


def strip(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def words(c: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.array_remove(F.split(c, f"{WS}+"), ""))


def tokens(n_words: Column) -> Column:
    """Estimated tokens of so many words: four thirds, rounded down, 1 at least."""
    return F.greatest(F.lit(1), F.floor(n_words * 4 / 3).cast("int"))


def normal_newlines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


def tag_slug(c: Column) -> Column:
    """Lower case; runs of other characters than a-z, 0-9 become one hyphen, none at the ends.  One pattern: columns derived from it may be computed more than once."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def accepted_tag(slug: Column) -> Column:
    return (slug != "") & ~slug.isin(*GENERIC_TAGS)


def entity_slug(c: Column) -> Column:
    """Lower case; other characters than a-z, 0-9 and white space go, white space becomes one hyphen."""
    kept = F.regexp_replace(strip(F.lower(c)), rf"[^a-z0-9\p{{IsWhite_Space}}]", "")
    return F.regexp_replace(F.regexp_replace(kept, f"{WS}+", "-"), r"^-+|-+$", "")


def stem(path: Column) -> Column:
    """File name without directories and last suffix: a note's title."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(?<=.)\.[^.]*$", "")


def relevant_path(path: Column, ignored: tuple[str, ...]) -> Column:
    """Markdown files that are neither hidden nor temporary nor below an ignored directory."""
    name = F.element_at(F.split(path, "/"), -1)
    return path.endswith(".md") & ~name.rlike("^[.~]") & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, ignored)))


def excerpt(c: Column, n: int) -> Column:
    return F.substring(c, 1, n)


def page_id(title: Column, date: Column) -> Column:
    """``<date> - <title>`` with slashes and colons as hyphens; ``Entry`` without a title."""
    safe = lambda x: F.translate(strip(x), "/:", "--")
    plain = F.when(safe(title) == "", "Entry").otherwise(F.coalesce(safe(title), F.lit("Entry")))
    return F.when(F.coalesce(safe(date), F.lit("")) == "", plain).otherwise(F.concat(safe(date), F.lit(" - "), plain))


def unfenced(c: Column) -> Column:
    """Model output without code fences."""
    return strip(F.regexp_replace(c, r"```(?:json)?", ""))


def json_object(c: Column) -> Column:
    """The text from the first ``{`` to the last ``}``, null without one; parse it with from_json."""
    found = F.regexp_extract(unfenced(c), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def json_array(c: Column) -> Column:
    found = F.regexp_extract(unfenced(c), r"(?s)\[.*\]", 0)
    return F.when(found != "", found)


def retry_delay(message: Column, default: float = 10.0) -> Column:
    """Seconds to wait after an error that says so (2 more than asked), null if the error isn't about rates."""
    asked = F.regexp_extract(message, r"retryDelay[\"']?\s*[:=]\s*[\"']?(\d+(?:\.\d+)?)", 1)
    known = F.when(asked != "", asked.cast("double") + 2).otherwise(F.lit(default))
    return F.when(message.contains("429") | message.contains("RESOURCE_EXHAUSTED"), known)


def quoted_lines(c: Column) -> Column:
    """Each line behind a quote mark, blank ones as the mark alone; an end of line at the end makes no line."""
    lines = F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
    lines = F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.array_join(F.transform(lines, lambda x: F.when(strip(x) == "", F.lit(">")).otherwise(F.concat(F.lit("> "), x))), "\n")


def combined(texts: Column, n: int = 1500) -> Column:
    """A note's chunks in order (an array) as one text of ``n`` characters at most."""
    return F.substring(F.array_join(texts, "\n\n"), 1, n)


def first_chunks(texts: Column, each: int = 300, n: int = 600) -> Column:
    """The beginnings of the first two chunks, as much of them as a prompt takes."""
    return F.substring(F.array_join(F.transform(F.slice(texts, 1, 2), lambda t: F.substring(t, 1, each)), "\n\n"), 1, n)
