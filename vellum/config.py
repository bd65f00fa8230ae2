"""Settings of the note engine; every operator also takes them as arguments."""

from __future__ import annotations

from dataclasses import dataclass


# What an encoder of the usual kind wants before a passage and before a question, and folders that hold no notes.
PASSAGE_PREFIX = "Represent this sentence for searching relevant passages: "
QUERY_PREFIX = "Represent this question for searching relevant passages: "
IGNORED_DIRS = (".obsidian", "attachments", "templates", "_templates", ".trash")


@dataclass(frozen=True)
class Config:
    """Sizes, thresholds and times (defaults: fixed values)."""

    min_tokens: int = 50
    max_tokens: int = 350
    top_k: int = 8
    threshold: float = 0.72
    tag_min_documents: int = 2
    max_tags: int = 8
    stabilise_s: float = 200.0
    cooldown_s: float = 600.0
    notes_per_pass: int = 16
    least_per_pass: int = 1
    backlinks_heading: str = "## Related Notes"
    ignored_dirs: tuple[str, ...] = IGNORED_DIRS
    requests_per_minute: float = 5.0
    index_every_s: float = 30.0
    reason_every_s: float = 120.0
    entity_notes: bool = True


DEFAULT = Config()
