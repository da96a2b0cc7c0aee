"""Configuration, logging and sessions of the jobs."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession


def config(name: str, path: str | None = None) -> dict:
    """The job's settings: those of its config file, with what another file says put over them."""
    own = json.loads((Path(__file__).parent / f"{name}.json").read_text())
    more = json.loads(Path(path).read_text()) if path else {}
    if unknown := set(more) - set(own):
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    return own | more


def main(name: str, run: Callable[..., object], paths: dict[str, str], argv: list[str] | None = None) -> None:
    """Command line of a job: one option for each path, and --config. It makes and stops the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=run.__doc__)
    for option, said in paths.items():
        parser.add_argument(f"--{option}", required=True, help=said)
    parser.add_argument("--config", help="a JSON file with settings that differ from the job's own")
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    settings = config(name, args.pop("config"))
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(spark, settings=settings, **args)
    finally:
        spark.stop()
