"""`spark-submit` entry points: one result table, or one load.

    python -m ticklens --db fx --table prices --frames 1,2,5 [--points ohlc] [--price bid]
    python -m ticklens load-ticks --source EURUSD=/raw/eurusd --target /lake/ticks
    python -m ticklens load-releases --source /raw/releases --target /lake/releases
    python -m ticklens load-gaps --source /raw/gaps --target /lake/gaps --rejects /lake/rejects
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ticklens.functions.frames import BOUNDS
from ticklens.plans import load
from ticklens.plans.reaction import POINTS, run_reaction_job
from ticklens.session import build_session


def react(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="ticklens")
    parser.add_argument("--frames", required=True, help="minutes after the release, as 1,2,5")
    parser.add_argument("--db", required=True)
    parser.add_argument("--table", required=True, help="table to create")
    parser.add_argument("--ticks", default="tick_data", help="table of quotes")
    parser.add_argument("--releases", default="releases", help="table of releases")
    parser.add_argument("--mode", default="errorifexists", help="save mode")
    parser.add_argument("--files", type=int, help="number of output files")
    parser.add_argument("--price", default="ask", choices=["ask", "bid"])
    parser.add_argument("--points", default="open_close", choices=[*POINTS, "summary"])
    parser.add_argument("--bounds", choices=BOUNDS, help="open, for the summary half_open")
    options = parser.parse_args(argv)
    run_reaction_job(
        build_session(),
        options.db,
        options.table,
        [int(n) for n in options.frames.split(",")],
        options.ticks,
        options.releases,
        options.mode,
        options.files,
        options.price,
        options.points,
        options.bounds,
    )


def _source(values: list[str]) -> str | dict[str, str]:
    """One directory with `curr_pair=` directories below, or PAIR=DIRECTORY for each pair."""
    if len(values) == 1 and "=" not in values[0].split("/")[0]:
        return values[0]
    return dict(value.split("=", 1) for value in values)


def _load_ticks(spark: SparkSession, options: argparse.Namespace) -> None:
    load.load_ticks(spark, _source(options.source), options.target, rejects=options.rejects)


def _load_releases(spark: SparkSession, options: argparse.Namespace) -> None:
    load.load_releases(spark, options.source[0], options.target, options.rejects)


def _load_gaps(spark: SparkSession, options: argparse.Namespace) -> None:
    load.load_gap_table(spark, _source(options.source), options.target, options.rejects)


LOADS = {"load-ticks": _load_ticks, "load-releases": _load_releases, "load-gaps": _load_gaps}


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv[0] not in LOADS:
        react(argv)
        return
    parser = argparse.ArgumentParser(prog=f"ticklens {argv[0]}")
    parser.add_argument("--source", required=True, nargs="+", help="directory, or PAIR=DIRECTORY ...")
    parser.add_argument("--target", required=True, help="directory of the typed table")
    needed = argv[0] == "load-gaps"
    parser.add_argument("--rejects", required=needed, help="directory of the table of rejected lines")
    LOADS[argv[0]](build_session(), parser.parse_args(argv[1:]))


if __name__ == "__main__":
    main()
