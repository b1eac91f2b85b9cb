"""What both jobs share: settings from a small file, a log, and a session for the command line."""

from __future__ import annotations

import json
import logging
from argparse import ArgumentParser
from collections.abc import Callable
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from groundline.session import prepare

log = logging.getLogger("groundline.jobs")


def settings(kind: type, file: str | None = None):
    """Settings of a dataclass from a JSON file, by default the one beside the job; a
    name that the job doesn't know is an error."""
    held = json.loads(Path(file).read_text()) if file else {}
    if unknown := set(held) - {f.name for f in fields(kind)}:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    return kind(**held)


def command(parser: ArgumentParser, kind: type, default: Path, work: Callable) -> None:
    """Parse, start a session, work, stop it."""
    parser.add_argument("--config", default=str(default), help="JSON file of settings")
    args = vars(parser.parse_args())
    cfg = settings(kind, args.pop("config"))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = prepare(SparkSession.builder.appName(parser.prog or "job").getOrCreate())
    try:
        work(spark, cfg=cfg, **args)
    finally:
        spark.stop()
