"""Operators over ordered results: pairs, gaps, runs, merges and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def collaboration_pairs(log: DataFrame, floor: float = 0.0) -> DataFrame:
    """All pairs i < j of a workflow's successful results; sequential if they are neighbours among the successes.

    The join is on the workflow, so it grows with the square of a workflow's length, not of the log.
    """
    ok = log.where("success").withColumn("nth", F.row_number().over(Window.partitionBy("workflow_id").orderBy("pos"))).where(F.col("confidence") >= floor)
    a, b = ok.alias("a"), ok.alias("b")
    pairs = a.join(b, (F.col("a.workflow_id") == F.col("b.workflow_id")) & (F.col("a.nth") < F.col("b.nth")))
    return pairs.select("a.workflow_id", F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), F.round((F.col("a.confidence") + F.col("b.confidence")) / 2, 6).alias("confidence"), F.when(F.col("b.nth") - F.col("a.nth") == 1, "sequential").otherwise("parallel").alias("kind"))


def precedes(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("workflow_id").orderBy("pos")
    return log.select("workflow_id", "pos", "agent_id", F.lead("agent_id").over(w).alias("next_agent")).where("next_agent is not null")


def temporal_gap(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("workflow_id").orderBy("created_at", "event_id")
    return log.select("workflow_id", "event_id", F.round((F.unix_micros("created_at") - F.lag(F.unix_micros("created_at")).over(w)) / 1e6, 3).alias("gap")).where("gap is not null")


def previous_results(log: DataFrame, n: int = 3) -> DataFrame:
    """Up to n results of other agents just before each result, oldest first."""
    w = Window.partitionBy("workflow_id").orderBy("pos").rowsBetween(-n, -1)
    return log.select("workflow_id", "pos", F.array_join(F.filter(F.collect_list("agent_id").over(w), lambda x: x != F.col("agent_id")), ",").alias("previous"))


def chunk_groups(log: DataFrame, n: int = 3) -> DataFrame:
    return log.select("workflow_id", "pos", F.floor((F.col("pos") - 1) / n).alias("chunk"))


def recent(log: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return log.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).select("agent_id", "event_id", "nth")


def stage_merge(tasks: DataFrame) -> DataFrame:
    """Runs of adjacent stages of one independent task each become one parallel stage; stages are renumbered."""
    stages = tasks.groupBy("plan_id", "stage_id").agg(F.array_sort(F.collect_list(F.struct("pos", "agent_id"))).alias("a"), F.sum(F.size("input_from")).alias("inputs"), F.first("execution_type").alias("execution_type"))
    free = (F.size("a") == 1) & (F.col("inputs") == 0)
    w = Window.partitionBy("plan_id").orderBy("stage_id")
    starts = F.when(free & F.coalesce(F.lag(free).over(w), F.lit(False)), 0).otherwise(1)
    runs = stages.withColumn("new", starts).withColumn("stage", F.sum("new").over(w))
    g = runs.groupBy("plan_id", "stage").agg(F.array_sort(F.collect_list(F.struct("stage_id", "a"))).alias("s"), F.count("*").alias("merged"), F.first("execution_type").alias("x"))
    names = F.array_join(F.flatten(F.transform("s", lambda x: x["a"]["agent_id"])), ",")
    return g.select("plan_id", "stage", names.alias("agents"), F.when(F.col("merged") > 1, "parallel").otherwise(F.col("x")).alias("execution_type"))


def duplicate_runs(log: DataFrame) -> DataFrame:
    """Runs of one agent in a row become one row with their number and longest time."""
    w = Window.partitionBy("workflow_id").orderBy("pos")
    new = F.when(F.lag("agent_id").over(w) == F.col("agent_id"), 0).otherwise(1)
    runs = log.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("workflow_id", "run").agg(F.min("agent_id").alias("agent_id"), F.count("*").alias("n"), F.max("execution_time").alias("longest"))


def source_merge(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer merge on id; the first non-empty value wins, sources tells where a row was seen."""
    a, b = first.select("id", F.col("name").alias("a"), F.lit(True).alias("in_a")), second.select("id", F.col("name").alias("b"), F.lit(True).alias("in_b"))
    m = a.join(b, "id", "full_outer")
    return m.select("id", F.coalesce(F.nullif("a", F.lit("")), "b").alias("name"), F.concat_ws("+", F.when(F.col("in_a"), "first"), F.when(F.col("in_b"), "second")).alias("sources"))


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and modified ids of two snapshots, by a hash of their content."""
    o, n = old.select("id", F.md5(F.col("content").cast("binary")).alias("o")), new.select("id", F.md5(F.col("content").cast("binary")).alias("n"))
    kind = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "modified")
    return o.join(n, "id", "full_outer").select("id", kind.alias("change")).where("change is not null")
