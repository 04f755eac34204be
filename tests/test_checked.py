"""Bad lines go to the reject table, neighbours are found across ranges, names are quoted."""

import random
from datetime import datetime, timedelta

import cases
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ticklens.__main__ import main
from ticklens.operators.checked import checked_gaps, checked_releases, checked_ticks
from ticklens.operators.clean import release_history
from ticklens.operators.neighbours import with_next
from ticklens.plans import load
from ticklens.sinks import tables as sinks
from ticklens.sources import files, from_events, tables

TICKS = {
    "20080104 083000000,1.5,1.6,0": None,
    "20080104 083000000,,,": None,
    "20080104 083000000,1.5,1.6": "fields",
    "20080104 083000000,1.5,1.6,0,9": "fields",
    "": "fields",
    "20081304 083000000,1.5,1.6,0": "time",
    "20080104 253000000,1.5,1.6,0": "time",
    "2008010x 083000000,1.5,1.6,0": "time",
    "20080104 0830,1.5,1.6,0": "time",
    ",1.5,1.6,0": "time",
    "20080104 083000000,x,1.6,0": "bid",
    "20080104 083000000,1.5,1234567.5,0": "ask",
    "20080104 083000000,1.5,NaN,0": "ask",
    "20080104 083000000,1.5,1.6,999": "vol",
}
RELEASES = {
    "Jan 04, 2008|08:30|18K|70K|115K": None,
    "Jan 04, 2008|08:30|-17.5K||": None,
    "Xyz 04, 2008|08:30|1K|1K|1K": None,
    "Jan 04, 2008|08:30|18K|70K": "fields",
    "Jan 04, 2008||18K|70K|1K": "time",
    "Jan 04, 2008|ab:cd|18K|70K|1K": "time",
    "Jan 04, 2008|08:30|9999999999K|70K|1K": "actual",
    "Jan 04, 2008|08:30|1K|n/a|1K": "forecast",
    "Jan 04, 2008|08:30|1K|1K|?": "previous",
}
GAPS = {
    "Gap of 61s found between 20080104083000 and 20080104083101.": None,
    "Gap of 0s found between 20080104083000 and 20080104083000.": "no gap",
    "Gap of 99999999999s found between 20080104083000 and 20080104083101.": "gap too long",
    f"Gap of {'9' * 50}s found between 1 and 2.": "gap too long",
    "xx Gap of 61s found between 20080104083000 and 20080104083101.": "no gap report",
    "": "no gap report",
}


@pytest.mark.parametrize(
    "check,lines", [(checked_ticks, TICKS), (checked_releases, RELEASES), (checked_gaps, GAPS)]
)
def test_every_line_is_typed_or_rejected(spark, check, lines):
    rows = [("EURUSD", "f", line) for line in lines]
    checked = check(spark.createDataFrame(rows, "curr_pair string, file string, line string"))
    assert {r.line: r.reason for r in checked.collect()} == lines


def write(path, lines):
    path.mkdir(parents=True)
    (path / "a.txt").write_text("\n".join(lines) + "\n")


def test_loads_keep_going_and_account_for_every_line(spark, tmp_path):
    write(tmp_path / "ticks" / "curr_pair=EURUSD", TICKS)
    write(tmp_path / "gbp", TICKS)
    write(tmp_path / "releases", ["Release Date|Time|Actual|Forecast|Previous", *RELEASES])
    write(tmp_path / "gaps" / "curr_pair=EURUSD", GAPS)
    rejects, good = str(tmp_path / "rejects"), {}
    load.load_ticks(spark, str(tmp_path / "ticks"), str(tmp_path / "t"), rejects=rejects)
    load.load_ticks(spark, {"GBPUSD": str(tmp_path / "gbp")}, str(tmp_path / "t"), rejects=rejects)
    load.load_releases(spark, str(tmp_path / "releases"), str(tmp_path / "r"), rejects)
    load.load_gap_table(spark, str(tmp_path / "gaps"), str(tmp_path / "g"), rejects)
    good["ticks"] = tables.read_ticks(spark, str(tmp_path / "t"))
    good["releases"] = tables.read_releases(spark, str(tmp_path / "r"))
    good["gaps"] = tables.read_gaps(spark, str(tmp_path / "g"))
    bad = tables.read_rejects(spark, rejects)
    for feed, read in (("ticks", 2 * len(TICKS)), ("releases", len(RELEASES)), ("gaps", len(GAPS))):
        assert good[feed].count() + bad.where(F.col("feed") == feed).count() == read
    assert {r.curr_pair for r in good["ticks"].collect()} == {"EURUSD", "GBPUSD"}
    one = bad.where("feed = 'ticks' AND curr_pair = 'GBPUSD' AND reason = 'vol'").first()
    assert one.file.endswith("gbp/a.txt") and one.line.endswith(",999")


def test_checked_lines_equal_the_plain_readers(spark, tmp_path):
    """Where no line is bad, the two ways of loading give the same tables."""
    write(tmp_path / "releases", cases.RELEASES.splitlines())
    lines = [line.split(",") for line in cases.TICKS.splitlines()]
    write(tmp_path / "ticks" / "curr_pair=EURUSD", [f"{t},{p},{p},0" for t, _, p in lines])
    for name in ("plain", "checked"):
        rejects = str(tmp_path / "rejects") if name == "checked" else None
        load.load_ticks(spark, str(tmp_path / "ticks"), f"{tmp_path}/{name}_t", rejects=rejects)
        load.load_releases(spark, str(tmp_path / "releases"), f"{tmp_path}/{name}_r", rejects)
    for read, kind in ((tables.read_ticks, "t"), (tables.read_releases, "r")):
        plain, checked = (
            sorted(map(repr, read(spark, f"{tmp_path}/{name}_{kind}").collect()))
            for name in ("plain", "checked")
        )
        assert plain == checked and plain


def test_commands(spark, tmp_path):
    write(tmp_path / "eur", TICKS)
    write(tmp_path / "r", RELEASES)
    write(tmp_path / "g" / "curr_pair=EURUSD", GAPS)
    rejects = str(tmp_path / "rejects")
    main(["load-ticks", "--source", f"EURUSD={tmp_path}/eur", "--target", f"{tmp_path}/t", "--rejects", rejects])
    main(["load-releases", "--source", f"{tmp_path}/r", "--target", f"{tmp_path}/rel", "--rejects", rejects])
    main(["load-gaps", "--source", f"{tmp_path}/g", "--target", f"{tmp_path}/gt", "--rejects", rejects])
    assert tables.read_ticks(spark, f"{tmp_path}/t").count() == 2
    assert tables.read_gaps(spark, f"{tmp_path}/gt").count() == 1
    assert tables.read_rejects(spark, rejects).select("feed").distinct().count() == 3
    with pytest.raises(SystemExit):
        main(["load-gaps", "--source", "x", "--target", "y"])


@pytest.mark.parametrize("points,extra", [("ohlc", 3 * 8), ("high_low", 3 * 4), ("summary", 3 * 8)])
def test_job_options(spark, tmp_path, points, extra):
    db = f"job_{points}"
    sinks.create_database(spark, db, str(tmp_path / "db"))
    sinks.save_table(cases.ticks(spark), f"{db}.tick_data")
    sinks.save_table(cases.releases(spark), f"{db}.releases")
    main(["--db", db, "--table", "out", "--frames", "1,5,60", "--points", points, "--price", "bid"])
    assert len(spark.table(f"{db}.out").columns) == 7 + extra
    spark.sql(f"DROP DATABASE {db} CASCADE")


def test_stored_view_follows_its_table_and_names_are_quoted(spark, tmp_path):
    db = "fx_view"
    sinks.create_database(spark, db, str(tmp_path / "it's here"))
    sinks.save_table(cases.releases(spark), f"{db}.all_releases")
    sinks.create_release_view(spark, f"{db}.v_history", f"{db}.all_releases")
    other = spark.newSession()

    def shown(session):
        return sorted(map(repr, tables.read_current(session, f"{db}.v_history").collect()))

    want = release_history(cases.releases(spark))
    assert shown(other) == sorted(map(repr, want.collect()))
    assert other.table(sinks.quoted(f"{db}.v_history")).dtypes == want.dtypes
    more = cases.releases(spark).limit(1).withColumn("actual", F.lit(77))
    sinks.save_table(more, f"{db}.all_releases", "append")
    assert len(shown(other)) == want.count() + 1
    path = str(tmp_path / "it's a table")
    more.write.partitionBy("trading_day").parquet(path)
    schema = more.select(*[c for c in more.columns if c != "trading_day"], "trading_day").schema
    sinks.register_table(spark, f"{db}.by_day", path, schema, ("trading_day",))
    assert spark.table(sinks.quoted(f"{db}.by_day")).count() == 1
    spark.sql(f"DROP DATABASE {sinks.quoted(db)} CASCADE")
    with pytest.raises(AnalysisException):
        sinks.create_database(spark, "x` LOCATION 'y")


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_next_in_order(spark, parts):
    drawn = random.Random(parts)
    start = datetime(2024, 1, 1)
    keys = ["hot"] * 300 + ["a", "b"] * 40 + ["only once", None, None]
    rows = [(k, start + timedelta(seconds=s)) for s, k in enumerate(drawn.sample(keys, len(keys)))]
    want = []
    for key in set(keys):
        own = sorted(t for k, t in rows if k == key)
        want += [(key, t, n) for t, n in zip(own, [*own[1:], None])]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        df = spark.createDataFrame(rows, "k string, t timestamp_ntz").repartition(5)
        got = [tuple(r) for r in with_next(df, "k", "t", "nx").collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert with_next(df.limit(0), "k", "t", "nx").collect() == []
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gap_feed_has_no_window_over_a_pair(spark):
    lines = from_events.gap_lines_of(from_events.events(spark, "/root/testdata/sf0.001"))
    text = lines._jdf.queryExecution().executedPlan().toString()
    assert "Window" in text
    windows = [line for line in text.splitlines() if "Window [" in line]
    assert windows and all("place#" in line.split("windowspecdefinition(")[1].split(",")[0] for line in windows)


def test_reader_of_lines_names_the_file(spark, tmp_path):
    write(tmp_path / "a b", ["x", "y"])
    rows = files.read_lines(spark, str(tmp_path / "a b"), "P").collect()
    assert {(r.curr_pair, r.line) for r in rows} == {("P", "x"), ("P", "y")}
    assert all(r.file.endswith("a.txt") for r in rows)
