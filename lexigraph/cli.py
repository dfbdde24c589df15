"""Command line: one request, a text, or a loop over requests on standard input.

    python -m lexigraph.cli --ontology FILE [--format F] [--text TEXT | --request JSON | --snapshot FILE | --serve] [--pretty]
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .engine import Engine


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexigraph")
    p.add_argument("--ontology")
    p.add_argument("--format")
    p.add_argument("--interface", default="json")
    p.add_argument("--text")
    p.add_argument("--request")
    p.add_argument("--snapshot", metavar="FILE")
    p.add_argument("--serve", action="store_true")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--line-breaks", default="ignore", choices=("ignore", "boundary"))
    a = p.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("lexigraph").getOrCreate()
    engine, status = Engine(spark), 0

    def answer(out: dict) -> int:
        print(json.dumps(out, ensure_ascii=False, indent=2 if a.pretty else None), flush=True)
        return 0 if out["ok"] else 1

    if a.ontology:
        out = engine.request({"op": "load", "path": a.ontology, "interface": a.interface} | ({"format": a.format} if a.format else {}))
        if not out["ok"]:
            return answer(out)
    if a.snapshot:
        engine.current().write_snapshot(a.snapshot)
    if a.request:
        status |= answer(engine.request(a.request))
    if a.text is not None:
        status |= answer(engine.request({"op": "parse", "text": a.text, "line_breaks": a.line_breaks}))
    if a.serve:
        for line in sys.stdin:
            if line.strip():
                answer(engine.request(line))
    return status


if __name__ == "__main__":
    sys.exit(main())
