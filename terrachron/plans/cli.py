"""``python -m terrachron.plans.cli``: runs a project's stages and prints what they found.

Each command is a function of its words and options; ``COMMANDS`` lists them with the words they take. Results come as
lines of ``name.field = value``; a failure is one line on the error stream and a status of 1.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession

from terrachron.plans import stages
from terrachron.plans.config import load_config


def lines(value: Any, name: str = "") -> Iterator[str]:
    """A nested summary, one line for each leaf."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from lines(inner, f"{name}.{key}" if name else str(key))
    else:
        yield f"{name} = {value}"


def session() -> SparkSession:
    return SparkSession.builder.appName("terrachron").getOrCreate()


def run(config: str, start: str | None = None, stop: str | None = None, only: str | None = None) -> Iterator[str]:
    yield from lines(stages.run_pipeline(session(), load_config(config), start, stop, only))


def stage(config: str, name: str) -> Iterator[str]:
    yield from lines({name: stages.run_stage(session(), load_config(config), name)})


def plot(config: str, name: str = "all") -> Iterator[str]:
    """The first rows behind each figure; with ``all``, of every stage that has written its tables."""
    spark, cfg = session(), load_config(config)
    for one in stages.FIGURES if name == "all" else [name]:
        try:
            tables = stages.plot_data(spark, cfg, one)
        except stages.NOT_RUN:
            if name != "all":
                raise
            yield f"{one} has not run"
            continue
        for title, table in tables.items():
            yield f"{one} {title}: {', '.join(table.columns)}"
            yield from ("  " + ", ".join(map(str, row)) for row in table.limit(10).collect())


def list_stages() -> Iterator[str]:
    for title, names in (("core", stages.CORE), ("optional", stages.OPTIONAL)):
        yield f"{title}: {', '.join(names)}"


#: Command: its function, and for each argument its flag or name, its parameter and what it may be.
COMMANDS: dict[str, tuple[Any, list[tuple[str, str, list[str] | None]]]] = {
    "run": (run, [("config", "config", None), ("--from", "start", list(stages.CORE)), ("--to", "stop", list(stages.CORE)), ("--only", "only", list(stages.CORE))]),
    "stage": (stage, [("config", "config", None), ("stage", "name", list(stages.STAGES))]),
    "plot": (plot, [("config", "config", None), ("--stage", "name", ["all", *stages.FIGURES])]),
    "list-stages": (list_stages, []),
}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="terrachron", description="Stages from rasters and wells to storage budgets.")
    choices = parser.add_subparsers(dest="command", required=True)
    for name, (_, arguments) in COMMANDS.items():
        sub = choices.add_parser(name)
        for flag, parameter, allowed in arguments:
            if flag.startswith("--"):
                sub.add_argument(flag, dest=parameter, choices=allowed)
            else:
                sub.add_argument(parameter, metavar=flag, choices=allowed)
    options = {k: v for k, v in vars(parser.parse_args(argv)).items() if v is not None}
    work = COMMANDS[options.pop("command")][0]
    try:
        for line in work(**options):
            print(line)
    except Exception as e:  # a command's contract: any failure is a status
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
