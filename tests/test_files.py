"""Raw feeds in, typed tables out."""

from pathlib import Path

import cases
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ticklens.__main__ import main
from ticklens.functions import text
from ticklens.operators import clean
from ticklens.plans import load, reaction
from ticklens.schemas import RELEASES, TICKS
from ticklens.session import new_dir, shared_dir
from ticklens.sinks import tables as sinks
from ticklens.sources import files, tables


def write(path: Path, content: str) -> str:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content)
    return str(path.parent)


def feed(pair: str) -> str:
    """The hand-made quotes of a pair as the feed has them: time, bid, ask, volume."""
    lines = [line.split(",") for line in cases.TICKS.splitlines()]
    return "".join(f"{t},{p},{float(p) + 0.0002:.6f},0\n" for t, name, p in lines if name == pair)


def test_raw_releases(spark, tmp_path):
    path = write(tmp_path / "r" / "a.txt", 'Jan 04, 2008|08:30|"18K||\\N\nFeb 01, 2008\n|Time|||\n')
    rows = [tuple(r) for r in files.read_raw_releases(spark, path).collect()]
    assert rows == [
        ("Jan 04, 2008", "08:30", '"18K', "", None),
        ("Feb 01, 2008", None, None, None, None),
        ("", "Time", "", "", ""),
    ]


def test_load_releases(spark, tmp_path):
    source = write(tmp_path / "in" / "a.txt", cases.RELEASES)
    target = str(tmp_path / "out")
    for _ in range(2):  # the second run overwrites
        load.load_releases(spark, source, target)
    got = tables.read_releases(spark, target)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, cases.releases(spark).collect()))


def test_raw_ticks_by_partition_and_by_directory(spark, tmp_path):
    write(tmp_path / "curr_pair=EURUSD" / "a.csv", feed("EURUSD"))
    write(tmp_path / "curr_pair=GBPUSD" / "a.csv", feed("GBPUSD"))
    found = files.read_raw_ticks(spark, str(tmp_path))
    named = files.read_raw_ticks_from(
        spark, {p: str(tmp_path / f"curr_pair={p}") for p in ("EURUSD", "GBPUSD")}
    )
    assert found.schema == named.schema or found.dtypes == named.dtypes
    assert sorted(map(repr, found.collect())) == sorted(map(repr, named.collect()))
    assert found.count() == 16
    assert {r.vol for r in found.collect()} == {0}


def test_bad_fields_become_null(spark, tmp_path):
    path = write(tmp_path / "curr_pair=X" / "a.csv", "20080104 083000000,x,1.23456789,999\n")
    row = files.read_raw_ticks(spark, str(Path(path).parent)).first()
    assert (row.bid, str(row.ask), row.vol) == (None, "1.234568", None)


@pytest.mark.parametrize("layout,rebalance", [(("curr_pair",), False), (("curr_pair", "day"), True)])
def test_load_ticks_replaces_only_its_partitions(spark, tmp_path, layout, rebalance):
    eur = write(tmp_path / "eur" / "a.csv", feed("EURUSD"))
    gbp = write(tmp_path / "gbp" / "a.csv", feed("GBPUSD"))
    target = str(tmp_path / "out")
    load.load_ticks(spark, {"EURUSD": eur, "GBPUSD": gbp}, target, layout, rebalance)
    load.load_ticks(spark, {"EURUSD": eur}, target, layout, rebalance)
    ticks = tables.read_ticks(spark, target)
    assert {r.curr_pair: r.n for r in ticks.groupBy("curr_pair").agg(F.count("*").alias("n")).collect()} == {
        "EURUSD": 15,
        "GBPUSD": 1,
    }
    assert ticks.where("ask <= bid").count() == 0  # by name, not swapped
    result = reaction.reaction(ticks, cases.releases(spark), 5).where("day = '20080404'")
    assert [str(r.open_price) for r in result.orderBy("trading_hour").collect()] == [
        *("1.570200", "1.580200"),
    ]


def test_gap_feeds(spark, tmp_path):
    paths = {p: write(tmp_path / p / "g.txt", cases.GAPS) for p in ("EURUSD", "GBPUSD", "USDJPY")}
    rows = load.load_gaps(spark, paths).collect()
    assert len(rows) == 6
    assert {r.curr_pair for r in rows} == set(paths)


def test_job_and_command_line(spark, tmp_path):
    db = "fx_" + tmp_path.name.replace("-", "_")
    sinks.create_database(spark, db, str(tmp_path / "db"))
    # Without `ts`, as a table that another loader wrote.
    sinks.save_table(cases.ticks(spark).drop("ts"), f"{db}.tick_data")
    sinks.save_table(cases.releases(spark), f"{db}.releases")
    main(["--frames", "5,1", "--db", db, "--table", "prices", "--files", "1"])
    saved = spark.table(f"{db}.prices")
    wide = reaction.reaction_wide(cases.ticks(spark), cases.releases(spark), [1, 5])
    assert saved.columns == wide.columns
    assert sorted(map(repr, saved.collect())) == sorted(map(repr, wide.collect()))
    assert len(saved.inputFiles()) == 1
    with pytest.raises(AnalysisException):
        main(["--frames", "1", "--db", db, "--table", "prices"])
    main(["--frames", "1", "--db", db, "--table", "prices", "--mode", "overwrite"])
    assert len(spark.table(f"{db}.prices").columns) == 11


def test_loaded_files_as_catalog_tables(spark, tmp_path):
    db = "fx_" + tmp_path.name.replace("-", "_")
    sinks.create_database(spark, db, str(tmp_path / "db"))
    ticks, releases = str(tmp_path / "ticks"), str(tmp_path / "releases")
    sinks.write_ticks(cases.ticks(spark), ticks, ("curr_pair", "day"))
    sinks.write_releases(cases.releases(spark), releases)
    sinks.register_table(spark, f"{db}.tick_data", ticks, TICKS, ("curr_pair", "day"))
    sinks.register_table(spark, f"{db}.releases", releases, RELEASES)
    stored = tables.read_table(spark, f"{db}.tick_data", ["day", "ask", "curr_pair"])
    assert dict(stored.dtypes)["day"] == "string"
    assert stored.count() == 16
    name = reaction.run_reaction_job(spark, db, "prices", [1, 5])
    wide = reaction.reaction_wide(cases.ticks(spark), cases.releases(spark), [1, 5])
    assert sorted(map(repr, spark.table(name).collect())) == sorted(map(repr, wide.collect()))


def test_text_that_names_no_time(spark):
    rows = [("20080230 083000000",), ("20080104 253000000",), ("junk",), ("",), (None,)]
    df = spark.createDataFrame(rows, "trade_dt string")
    assert df.where(text.tick_timestamp(F.col("trade_dt")).isNotNull()).count() == 0
    raw = df.select("trade_dt", F.lit(1).alias("bid"), F.lit(1).alias("ask"), F.lit("X").alias("curr_pair"))
    assert clean.clean_ticks(raw).count() == 5  # kept, with NULL parts


def test_times_do_not_move_with_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([("20080309 023000001",)], "trade_dt string")
        stamp = df.select(text.tick_timestamp(F.col("trade_dt")).cast("string").alias("t")).first().t
        assert stamp == "2008-03-09 02:30:00.001"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_shared_folder_is_the_configured_one(spark):
    assert new_dir(spark, "x").startswith(shared_dir(spark) + "/ticklens/x-")
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
