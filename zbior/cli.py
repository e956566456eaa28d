"""Command line: sources, analyzers, configuration, offline analysis, queries, status."""

from __future__ import annotations

import argparse
from pathlib import Path

from zbior.analyzers import list_analyzers, load_config, save_config
from zbior.analyzers.config import select
from zbior.session import local_session
from zbior.sources.seeds import FORUMS, WEEKLIES


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="zbior", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list-sources", help="boards and weeklies")
    commands.add_parser("list-analyzers", help="names of analyzers")
    config = commands.add_parser("config", help="write an analysis configuration")
    config.add_argument("kinds", nargs="+", choices=["none", "basic_tokens", "tokens", "spacy", "urls", "domains", "all"])
    config.add_argument("-o", "--output", default="analysis.yaml")
    config.add_argument("--min-length", type=int, default=2)
    config.add_argument("--no-sentiment", action="store_true")
    analyze = commands.add_parser("analyze", help="analyse a JSON lines file")
    analyze.add_argument("-c", "--config", required=True)
    analyze.add_argument("-i", "--input", required=True)
    analyze.add_argument("-o", "--output")
    query = commands.add_parser("query", help="run a named query over a folder of tables")
    query.add_argument("name")
    query.add_argument("folder")
    query.add_argument("-n", type=int, default=50, help="rows to show")
    commands.add_parser("status", help="what a folder of tables holds").add_argument("folder")
    a = parser.parse_args(args)
    if a.command == "list-sources":
        print("\n".join(f"{name}\t{title}\t{style}" for name, title, style in FORUMS))
        print("\n".join(f"{name}\t{url}" for name, url in WEEKLIES))
    elif a.command == "list-analyzers":
        print("\n".join(list_analyzers()))
    elif a.command == "config":
        save_config(select(a.kinds, a.min_length, not a.no_sentiment), a.output)
        print(a.output)
    elif a.command == "analyze":
        from zbior.pipeline import analyze_jsonl

        target = a.output or str(Path(a.input).with_suffix(".analyzed.jsonl"))
        analyze_jsonl(local_session(), a.input, target, load_config(a.config))
        print(target)
    elif a.command == "query":
        from zbior.plans import QUERIES

        QUERIES[a.name](local_session(), a.folder).show(a.n, truncate=80)
    elif a.command == "status":
        from zbior.pipeline import status

        for name, df in status(local_session(), a.folder).items():
            print(name)
            df.show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
