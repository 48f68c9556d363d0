"""Command line: the files of one entity in, its record as JSON out."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession

from attestra.plans.engine import run
from attestra.sources.files import ADAPTERS, read_config

#: Flag and what ``argparse`` is told of it, beside one flag a source.
OPTIONS = {
    ("--config",): {"metavar": "JSON", "help": "shape of the output; the whole record without it"},
    ("--explain",): {"action": "store_true", "help": "confidence and provenance of each field, and the check's result"},
    ("--out",): {"metavar": "PATH", "help": "file for the output"},
    ("-v", "--verbose"): {"action": "store_true", "help": "say what each source gives"},
}


def command_line() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="attestra", description=__doc__)
    files = parser.add_argument_group("sources, one or more")
    for source in ADAPTERS:
        files.add_argument(f"--{source}", metavar="FILE")
    for flags, told in OPTIONS.items():
        parser.add_argument(*flags, **told)
    return parser


def document(row: Row, explain: bool) -> str:
    """The record as indented JSON; ``explain`` puts it beside what it rests on."""
    record = json.loads(row["profile"])
    if explain:
        record = dict(profile=record, explain=json.loads(row["explain"]), valid=row["valid"], problems=list(row["problems"]))
    return json.dumps(record, indent=2, ensure_ascii=False)


def complaints(row: Row) -> Iterator[str]:
    if row["problems"]:
        yield f"\n[validation] {len(row['problems'])} problem(s):"
        yield from (f"  - {told}" for told in row["problems"])


def main(argv: list[str] | None = None) -> int:
    """Exit code 0, also where the check finds problems; 2 without a source."""
    parser = command_line()
    given = vars(parser.parse_args(argv))
    sources = {name: path for name in ADAPTERS if (path := given[name])}
    if not sources:
        parser.print_usage(sys.stderr)
        return 2
    logging.basicConfig(level="INFO" if given["verbose"] else "WARNING")
    row = run(SparkSession.builder.appName("attestra").getOrCreate(), sources, read_config(given["config"]) if given["config"] else None).first()
    if given["out"]:
        with open(given["out"], "w", encoding="utf-8") as sink:
            sink.write(document(row, given["explain"]))
        print("wrote", given["out"])
    else:
        print(document(row, given["explain"]))
    print(*complaints(row), sep="\n", end="\n" if row["problems"] else "", file=sys.stderr)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
