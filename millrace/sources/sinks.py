"""Sinks: snapshots that readers never see half written, event lines, rendered results."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(df: DataFrame, folder: str) -> str:
    """Writes a new version beside the old ones, then one pointer row that names it."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{version}")
    pointers = df.sparkSession.createDataFrame([(version,)], "version string").withColumn("at", F.current_timestamp())
    pointers.coalesce(1).write.mode("append").parquet(f"{folder}/pointers")
    return version


def load_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    newest = spark.read.parquet(f"{folder}/pointers").orderBy(F.desc("at")).first()
    return spark.read.parquet(f"{folder}/versions/{newest['version']}")


def as_markdown(results: DataFrame, key: str) -> DataFrame:
    """One text for each key: a numbered section for each of its (pos, agent_id, data) rows."""
    section = F.format_string("## %d. %s\n\n%s", F.col("pos").cast("int"), F.col("agent_id"), F.col("data"))
    g = results.select(key, "pos", section.alias("s")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("s"))
    return g.select(key, F.array_join(F.col("s.s"), "\n\n").alias("text"))


def network_links(results: DataFrame, key: str) -> DataFrame:
    """Consecutive links of a key's rows, for drawing."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("pos")
    return results.select(key, F.col("agent_id").alias("source"), F.lead("agent_id").over(w).alias("target"), F.col("pos")).where("target is not null")
