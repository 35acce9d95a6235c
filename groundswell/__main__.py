"""python -m groundswell config FILE | params TABLE FRAME | run QUERY TABLES OUT"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from groundswell import frames


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="groundswell")
    commands = parser.add_subparsers(dest="command", required=True)
    config = commands.add_parser("config", help="write a file with all parameters at their defaults")
    config.add_argument("file", type=Path)
    params = commands.add_parser("params", help="print a frame's parameters")
    params.add_argument("table", type=Path)
    params.add_argument("frame", type=int)
    run = commands.add_parser("run", help="run a registered query on a folder of tables and write its result as Parquet")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--master", default="local[*]")
    args = parser.parse_args(argv)
    if args.command == "config":
        args.file.write_text(json.dumps(frames.DEFAULTS, indent=2) + "\n")
    elif args.command == "params":
        print(json.dumps(frames.FrameTable.load(args.table).params(args.frame), indent=2))
    else:
        from groundswell.plans import catalogue, queries
        from groundswell.session import session

        found = queries.queries() | catalogue.queries()
        if args.query not in found:
            print(f"unknown query {args.query}; known: {', '.join(found)}", file=sys.stderr)
            return 2
        found[args.query](session(args.master), args.tables).write.mode("errorifexists").parquet(args.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
