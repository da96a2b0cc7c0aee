"""Command line: python -m plumbline ask|compare|cohort|eval|grid|serve|mock-ehr."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from .engine import Engine
from .operators.chunks import chunk_records
from .plans import evaluate, grid
from .plans.batched import Batch
from .service import record_service, server, workspace
from .sources.records import Settings, load_records


def _ask(engine: Engine, a: argparse.Namespace):
    return engine.query(a.question, a.patient, a.k, strategy=a.strategy, redact=a.redact)


def _compare(engine: Engine, a: argparse.Namespace):
    return engine.compare(a.question, a.patient, k=a.k)


def _eval(engine: Engine, a: argparse.Namespace):
    out = engine.benchmark(path=a.save, strategies=a.strategy)
    if a.save and not a.strategy:
        evaluate.save(out, a.save, engine.n_patients)
    return evaluate.table(out) if a.table else out


def _grid(engine: Engine, a: argparse.Namespace):
    """A row for each strategy and suite, at full sizes unless --n bounds the sampled suites."""
    sizes = {k: min(v, a.n or v) for k, v in evaluate.SIZES.items()}
    rows = grid.grid(engine.records, Batch(chunk_records(engine.records)), a.strategy, sizes)
    return [r.asDict() for r in rows.orderBy("suite", "strategy").collect()]  # one row a strategy and suite


def _run(service, a: argparse.Namespace) -> str:
    with server(service, a.host, a.port) as s:
        print(f"listening on {a.host}:{s.server_port}", flush=True)
        s.serve_forever()
    return "stopped"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="plumbline")
    sub = p.add_subparsers(dest="what", required=True)
    for name, does in (("ask", _ask), ("compare", _compare)):
        a = sub.add_parser(name)
        a.add_argument("question")
        a.add_argument("--patient")
        a.add_argument("--k", type=int)
        a.set_defaults(does=does)
    sub.choices["ask"].add_argument("--strategy")
    sub.choices["ask"].add_argument("--redact", action="store_true")
    sub.add_parser("cohort").set_defaults(does=lambda engine, a: engine.cohort())
    e = sub.add_parser("eval", help="run the evaluation's suites")
    e.add_argument("--strategy", action="append")
    e.add_argument("--save")
    e.add_argument("--table", action="store_true")
    e.set_defaults(does=_eval)
    g = sub.add_parser("grid", help="run the evaluation over tables of questions")
    g.add_argument("--strategy", action="append", choices=list(grid.STRATEGIES))
    g.add_argument("--n", type=int)
    g.set_defaults(does=_grid)
    for name, port in (("serve", 8000), ("mock-ehr", 8100)):
        s = sub.add_parser(name, help="run the workspace" if name == "serve" else "run a service of made-up records")
        s.add_argument("--host", default="127.0.0.1")
        s.add_argument("--port", type=int, default=port)
    sub.choices["serve"].add_argument("--ui")
    sub.choices["serve"].set_defaults(does=lambda engine, a: _run(workspace(engine, a.ui), a))
    return p


def main() -> None:
    args = parser().parse_args()
    spark = SparkSession.builder.appName("plumbline").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if args.what == "mock-ehr":
        made = load_records(spark, Settings(ehr_url=None)).persist()
        out = _run(record_service(made, os.getenv("PLUMBLINE_EHR_TOKEN", "")), args)
    else:
        out = args.does(Engine(spark), args)
    print(out if isinstance(out, str) else json.dumps(out, indent=1, ensure_ascii=False, default=str))


if __name__ == "__main__":
    main()
