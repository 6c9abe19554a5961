"""What the jobs' command lines share."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession


@contextmanager
def kept_setting(spark: SparkSession, name: str) -> Iterator[None]:
    """A setting of the session is afterwards what it was before."""
    before = spark.conf.get(name, None)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def main(name: str, job: Callable[..., None], doc: str | None, argv: list[str] | None = None) -> None:
    """Run a job with the settings of its config file; ``--set key=value`` replaces one.  The session ends with the job."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=doc, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("--config", default=str(Path(__file__).with_name(f"{name}.json")), help="JSON file of settings")
    parser.add_argument("--set", action="append", default=[], metavar="KEY=VALUE", help="replace a setting; the value is JSON or a plain text")
    given = parser.parse_args(argv)
    settings = json.loads(Path(given.config).read_text())
    for item in given.set:
        key, _, value = item.partition("=")
        try:
            settings[key] = json.loads(value)
        except ValueError:
            settings[key] = value
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    spark = SparkSession.builder.appName(name).getOrCreate()
    try:
        job(spark, **settings)
    finally:
        spark.stop()
