"""``python -m vellum``: watch, reindex, embed, query, page."""

from __future__ import annotations

import argparse
import os
import sys

from vellum.engine import Engine, search_rows
from vellum.operators import ingest
from vellum.session import session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="vellum", description="Chunks, vectors, tags, people and links of a folder of Markdown notes")
    p.add_argument("--vault", default=os.environ.get("VELLUM_VAULT", "vault"), help="folder of the notes")
    p.add_argument("--store", default=os.environ.get("VELLUM_STORE", "vellum-store"), help="folder of the tables")
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command")
    sub.add_parser("watch", help="keep the tables in step with the notes (the default)").add_argument("--rounds", type=int, default=None)
    sub.add_parser("reindex", help="embed all notes and reason about them")
    sub.add_parser("embed", help="embed all notes; no model is asked and no note written")
    q = sub.add_parser("query", help="find chunks")
    q.add_argument("question", nargs="+")
    q.add_argument("--top-k", type=int, default=5, dest="top_k")
    sub.add_parser("page", help="one entry from page images").add_argument("images", nargs="+")
    return p


def main(argv: list[str] | None = None, spark=None, **engine: object) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    spark = spark or session("vellum", args.master)
    if args.command not in (None, "watch") and not os.path.isdir(args.vault):
        print(f"no vault at {args.vault}", file=sys.stderr)
        return 2
    if args.command == "page":
        if missing := [i for i in args.images if not os.path.exists(i)]:
            print(f"not found: {', '.join(missing)}", file=sys.stderr)
            return 2
        made = ingest.entry(spark, [os.path.abspath(i) for i in args.images], os.path.abspath(args.vault)).first()
        print(f"{made.file_path} ({made.n_words} words)")
        return 0
    own = Engine(spark, os.path.abspath(args.vault), os.path.abspath(args.store), **engine)
    if args.command == "reindex":
        print(f"{own.reindex()} notes")
    elif args.command == "embed":
        print(f"{own.embed_vault()} chunks")
    elif args.command == "query":
        found = search_rows(own.search(" ".join(args.question), args.top_k)).orderBy("rank").collect()
        for r in found:
            print(f"\n[{r.rank}] {r.file} ({r.similarity})\n    heading: {r.heading}\n    tags: {r.tags}\n    people: {r.entities}\n    {r.excerpt}")
        if not found:
            print("nothing found above the threshold")
    else:
        own.session(getattr(args, "rounds", None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
