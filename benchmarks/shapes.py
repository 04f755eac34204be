"""Compare ways to build the wide table on many more quotes than the test data has.

    python -m benchmarks.shapes make DIR [COPIES]   # copies of the sf0.1 events, shifted in time
    python -m benchmarks.shapes run DIR             # medians of three runs, in seconds

Next to the even copy there is a skewed one: a third of it is one pair on one day.
"""

from __future__ import annotations

import statistics
import sys
import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticklens.functions.frames import in_frame, with_frame_ends
from ticklens.operators.clean import clean_releases
from ticklens.operators.join import join_releases
from ticklens.plans import reaction
from ticklens.schemas import GROUP, RELEASE_FACTS, RELEASE_TIME
from ticklens.session import build_session
from ticklens.sources import from_events

EVENTS = "/root/testdata/sf0.1"


def make(spark: SparkSession, path: str, copies: int) -> None:
    events = from_events.events(spark, EVENTS).repartition(32)
    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    many = events.withColumn("copy", copy)
    shifted = F.expr("ts + make_dt_interval(0, 0, 0, copy * 0.037013)")
    hot = F.expr("timestamp_ntz'2024-01-10' + (ts - date_trunc('day', ts))")
    ticks = from_events.ticks_of(many.withColumn("ts", shifted))
    is_hot = F.col("event_id") % 3 == 0
    skewed = from_events.ticks_of(
        many.withColumn("ts", F.when(is_hot, hot.cast("timestamp_ntz")).otherwise(shifted)).withColumn(
            "user_id", F.when(is_hot, F.lit(0)).otherwise(F.col("user_id"))
        )
    )
    for name, df in (("even", ticks), ("skewed", skewed)):
        df.drop("trade_dt").write.mode("overwrite").parquet(f"{path}/{name}")
    raw = from_events.raw_releases_of(from_events.events(spark, EVENTS))
    clean_releases(raw).write.mode("overwrite").parquet(f"{path}/releases")


def one_struct_aggregation(ticks: DataFrame, releases: DataFrame, frames: list[int]) -> DataFrame:
    joined = join_releases(
        ticks, with_frame_ends(releases.select(*RELEASE_TIME, *RELEASE_FACTS), frames)
    )
    quote = F.struct("ts", "ask")
    return joined.groupBy(*GROUP, *RELEASE_FACTS).agg(
        *[f(F.when(in_frame(n), quote)).alias(f"{f.__name__}_{n}") for n in frames for f in (F.min, F.max)]
    )


def aggregation_per_frame(ticks: DataFrame, releases: DataFrame, frames: list[int]) -> DataFrame:
    """One aggregation for every frame and one join for each: the traditional plan."""
    joined = join_releases(
        ticks, with_frame_ends(releases.select(*RELEASE_TIME, *RELEASE_FACTS), frames)
    )
    quote = F.struct("ts", "ask")
    tables = [
        joined.groupBy(*GROUP).agg(
            F.min(F.when(in_frame(n), quote)).alias(f"open_{n}"),
            F.max(F.when(in_frame(n), quote)).alias(f"close_{n}"),
        )
        for n in frames
    ]
    facts = joined.select(*GROUP, *RELEASE_FACTS).distinct()
    return reduce(lambda left, right: left.join(right, GROUP), tables, facts)


def run(spark: SparkSession, path: str) -> None:
    releases = spark.read.parquet(f"{path}/releases")
    shapes = {
        "segments (the library)": reaction.reaction_wide,
        "one aggregation, structs": one_struct_aggregation,
        "one aggregation per frame, joined": aggregation_per_frame,
    }
    for data in ("even", "skewed"):
        ticks = spark.read.parquet(f"{path}/{data}")
        for frames in ([1, 2, 3, 4, 5], [1, 5, 15, 60]):
            for name, shape in shapes.items():
                times = []
                for _ in range(4):
                    start = time.perf_counter()
                    shape(ticks, releases, frames).write.format("noop").mode("overwrite").save()
                    times.append(time.perf_counter() - start)
                median = statistics.median(times[1:])
                print(f"{data} {frames} {name}: {median:.2f}", flush=True)


def main() -> None:
    spark = build_session(
        "shapes",
        **{
            "spark.master": "local[8]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    command, path, *rest = sys.argv[1:]
    if command == "make":
        make(spark, path, int(rest[0]) if rest else 200)
    else:
        run(spark, path)


if __name__ == "__main__":
    main()
