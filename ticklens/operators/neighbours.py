"""The next row of a key, without gathering the rows of a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticklens.session import new_dir


def with_next(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """Add `name`: the value of `order` in the next row of the same key, NULL in its last.

    Rows are dealt into ranges by key and order, which are balanced whatever share one key holds, and stored. In a
    range the next row is looked up; the last row of a range takes the first value of the key in
    the range after it. Only these first values cross ranges: one for each range and key in it, and since ranges are
    in order, no more than there are ranges and keys. Of rows that tie, any is next to another.
    """
    spark = rows.sparkSession
    path = new_dir(spark, "ranges")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, key, order).withColumn("range", F.spark_partition_id())
    ranged.write.parquet(path)
    ranged = spark.read.schema(ranged.schema).parquet(path)
    # Ranges without rows are left out of the count; there are as many ranges as shuffle partitions at most.
    used = sorted(r["range"] for r in ranged.select("range").distinct().collect())
    places = spark.createDataFrame(list(zip(used, range(len(used)))), "range int, place int")
    ranged = ranged.join(F.broadcast(places), "range").drop("range")
    firsts = (
        ranged.groupBy("place", key)
        .agg(F.min(order).alias("next_first"))
        .select((F.col("place") - 1).alias("place_before"), F.col(key).alias("next_key"), "next_first")
    )
    in_range = Window.partitionBy("place", key).orderBy(order)
    after = [F.col("place") == F.col("place_before"), F.col(key).eqNullSafe(F.col("next_key"))]
    return (
        ranged.withColumn("in_range", F.lead(order).over(in_range))
        .join(firsts, after, "left")
        .select(*rows.columns, F.coalesce("in_range", "next_first").alias(name))
    )
