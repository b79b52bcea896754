"""python -m lumigraph index|serve|watch|call|TOOL [ARGUMENTS] [--root FOLDER] [--state FOLDER] [--full] [--json]

index brings the index up to date and prints its report; serve answers requests on stdin; watch looks at the
repository every few seconds and indexes what has changed; call TOOL JSON prints a tool's answer. A tool's own name
with NAME=VALUE arguments prints its answer as text, a row to a line, or with --json as JSON.
"""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from lumigraph.protocol import Tools, serve
from lumigraph.sources.repo import find_root
from lumigraph.streaming.watch import LEAST_DEBOUNCE_MS


def shown(value, name: str = "") -> str:
    """A cell of text output: scores with two digits, similarities with three."""
    if isinstance(value, float):
        return f"{value:.3f}" if "similarity" in name else f"{value:.2f}"
    return " ".join(map(str, value)) if isinstance(value, list) else str(value)


def as_text(found: dict) -> str:
    """Lists of rows as tab-separated lines under their name, all else as name: value."""
    out = []
    for name, value in found.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            out += [f"{name}:", *["\t".join(shown(v, k) for k, v in row.items()) for row in value]]
        elif isinstance(value, dict):
            out.append(f"{name}: " + ", ".join(f"{k}={shown(v, k)}" for k, v in value.items()))
        else:
            out.append(f"{name}: {shown(value, name)}")
    return "\n".join(out)


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main() -> None:
    parser = argparse.ArgumentParser(prog="lumigraph", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command")
    parser.add_argument("arguments", nargs="*")
    parser.add_argument("--root", default=".")
    parser.add_argument("--state")
    parser.add_argument("--full", action="store_true")
    parser.add_argument("--json", action="store_true")
    parser.add_argument("--debounce-ms", type=int, default=300)
    args = parser.parse_args()
    tools = Tools(SparkSession.builder.appName("lumigraph").getOrCreate(), find_root(args.root), args.state)
    show = (lambda found: print(json.dumps(found, indent=2, ensure_ascii=False))) if args.json or args.command == "call" else (lambda found: print(as_text(found)))
    if args.command == "serve":
        serve(tools, sys.stdin.buffer, sys.stdout.buffer)
    elif args.command == "index":
        show(tools.call("index_repository", {"full": args.full}))
    elif args.command == "watch":
        while True:  # the listing tells what has changed, so nothing is lost between two looks
            found = tools.call("index_repository", {})
            if found["indexed_files"] or found["removed_files"]:
                show(found)
            time.sleep(max(LEAST_DEBOUNCE_MS, args.debounce_ms) / 1000)
    elif args.command == "call":
        show(tools.call(args.arguments[0], json.loads(args.arguments[1]) if args.arguments[1:] else {}))
    elif args.command in tools.tools:
        show(tools.call(args.command, {k: _value(v) for k, _, v in (a.partition("=") for a in args.arguments)}))
    else:
        parser.error(f"unknown command {args.command}")


if __name__ == "__main__":
    main()
