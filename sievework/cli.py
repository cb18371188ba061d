"""Scans of a text from the command line: `validate-input` and `detect-injection` print JSON; the status is 1 if there is something to review."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from sievework.operators.inputs import detect_injection, validate_input
from sievework.sources.rulesets import load_rules


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sievework")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate-input", "detect-injection"):
        own = commands.add_parser(name)
        given = own.add_mutually_exclusive_group()
        given.add_argument("--text")
        given.add_argument("--file")
        if name == "validate-input":
            own.add_argument("--max-length", type=int, default=10_000)
            own.add_argument("--risk-threshold", type=float, default=0.7)
            own.add_argument("--rules")
        else:
            own.add_argument("--source-type", choices=("direct", "indirect", "tool_output"), default="direct")
            own.add_argument("--no-template-checks", action="store_true")
    given = parser.parse_args(args)
    text = given.text if given.text is not None else Path(given.file).read_text(encoding="utf-8") if given.file else sys.stdin.read()
    spark = spark or SparkSession.builder.appName("sievework").getOrCreate()
    df = spark.createDataFrame([(text,)], "text string")
    if given.command == "validate-input":
        row = validate_input(df, max_length=given.max_length, threshold=given.risk_threshold, custom=load_rules(given.rules) if given.rules else ()).first()
        out = {k: row[k] for k in ("decision", "risk_score", "risk_flags", "reason", "original_length")}
        bad = row["decision"] in ("SEND_TO_REVIEW", "BLOCK")
    else:
        row = detect_injection(df, source_type=given.source_type, templates=not given.no_template_checks).first()
        out = {"risk_level": row["risk_level"], "source_type": given.source_type, "signals": [s.asDict() for s in row["signals"]]}
        bad = bool(row["signals"])
    print(json.dumps(out, sort_keys=True, ensure_ascii=False))
    return int(bad)


if __name__ == "__main__":
    sys.exit(main())
