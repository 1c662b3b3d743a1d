"""Metrics over the execution log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate(hits, of):
    return F.coalesce(F.try_divide(hits.cast("double") * 100, of), F.lit(0.0))


def agent_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("agent_id").agg(F.count("*").alias("executions"), F.count_if("success").alias("successes"), F.round(F.sum("execution_time"), 4).alias("total_time"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).withColumn("success_rate", F.round(rate(F.col("successes"), F.col("executions")), 4))


def top_agents(log: DataFrame, k: int = 10) -> DataFrame:
    g = log.groupBy("agent_id").agg(F.round(rate(F.count_if("success"), F.count("*")), 4).alias("success_rate"), F.round(F.avg("execution_time"), 6).alias("avg_time"))
    return g.orderBy(F.desc("success_rate"), "avg_time", "agent_id").limit(k)


def operation_stats(log: DataFrame) -> DataFrame:
    """Count, mean, least, greatest and total time by operation, and over all."""
    return log.rollup("agent_id").agg(F.count("*").alias("n"), F.round(F.avg("execution_time"), 6).alias("mean"), F.min("execution_time").alias("least"), F.max("execution_time").alias("greatest"), F.round(F.sum("execution_time"), 4).alias("total")).withColumn("agent_id", F.coalesce("agent_id", F.lit("all")))


def system_rates(log: DataFrame) -> DataFrame:
    """One row of counters, rates and the efficiency score of the whole log; high confidence stands for a cache hit."""
    g = log.agg(F.count("*").alias("n"), F.count_if("success").alias("ok"), F.count_if(F.col("confidence") >= 0.8).alias("hits"), F.avg("execution_time").alias("avg_time"), F.count_if(F.col("pos") > 1).alias("parallel"))
    g = g.withColumns({"success_rate": rate(F.col("ok"), F.col("n")), "hit_rate": rate(F.col("hits"), F.col("n"))})
    score = 0.4 * F.col("success_rate") + 0.2 * F.col("hit_rate") + 0.2 * F.greatest(F.lit(0.0), 100 - 2 * F.col("avg_time")) + 0.2 * F.least(F.lit(100.0), F.coalesce(F.try_divide(200.0 * F.col("parallel"), F.col("n")), F.lit(0.0)))
    health = F.when(F.col("success_rate") > 80, "healthy").when(F.col("success_rate") > 50, "warning").otherwise("critical")
    return g.select("n", "ok", "hits", F.round("avg_time", 6).alias("avg_time"), F.round("success_rate", 4).alias("success_rate"), F.round("hit_rate", 4).alias("hit_rate"), F.round(score, 1).alias("efficiency"), health.alias("health"))


def recent_mean(log: DataFrame, n: int = 10) -> DataFrame:
    """Mean time of each agent's last n executions and the last time stamp."""
    w = Window.partitionBy("agent_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return log.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n).groupBy("agent_id").agg(F.round(F.avg("execution_time"), 6).alias("recent_mean"), F.max("event_id").alias("newest"))


def workflow_totals(log: DataFrame) -> DataFrame:
    """Success: no failures, or some successes with an output."""
    g = log.groupBy("workflow_id").agg(F.count("*").alias("agents"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.max_by("agent_id", "pos").alias("final_output"))
    return g.withColumn("success", (F.col("failed") == 0) | ((F.col("ok") > 0) & F.col("final_output").isNotNull()))


def workflow_performance(log: DataFrame) -> DataFrame:
    g = log.groupBy("workflow_id").agg(F.round(F.sum("execution_time"), 4).alias("total_time"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("success").cast("double")), 6).alias("success_rate"), F.count("*").alias("n"))
    return g.withColumn("tier", F.when(F.col("success_rate") > 0.8, "high").when(F.col("success_rate") > 0.5, "medium").otherwise("low"))


def integration(log: DataFrame) -> DataFrame:
    """Totals over all results, confidence over the successes only."""
    return log.groupBy("workflow_id").agg(F.count("*").alias("agents"), F.count_if("success").alias("ok"), F.round(F.sum("execution_time"), 4).alias("total_time"), F.round(F.coalesce(F.avg(F.when(F.col("success"), F.col("confidence"))), F.lit(0.0)), 6).alias("mean_confidence"))


def pattern_rows(log: DataFrame) -> DataFrame:
    """Ordered agents of each workflow, their number of kinds and its success rate."""
    g = log.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.struct("pos", "agent_id"))).alias("a"), F.count_distinct("agent_id").alias("kinds"), F.round(F.avg(F.col("success").cast("double")), 6).alias("rate"))
    return g.select("workflow_id", F.array_join(F.col("a.agent_id"), ",").alias("agents"), "kinds", "rate")


def strategy_usage(log: DataFrame) -> DataFrame:
    """How many workflows would run single, sequential, parallel or hybrid by their number of results."""
    n = log.groupBy("workflow_id").agg(F.count("*").alias("n"), F.bool_or(~F.col("success")).alias("any_failed"))
    s = F.when(F.col("n") <= 1, "single").when(F.col("any_failed"), "sequential").when(F.col("n") <= 3, "parallel").otherwise("hybrid")
    return n.groupBy(s.alias("strategy")).agg(F.count("*").alias("workflows"), F.sum("n").alias("results"))


def progress(log: DataFrame) -> DataFrame:
    """Share of a workflow's results that are complete after each of them."""
    w = Window.partitionBy("workflow_id")
    done = F.count_if("success").over(w.orderBy("pos"))
    return log.select("workflow_id", "pos", F.round(100.0 * done / F.count("*").over(w), 4).alias("percent"))


def strategy_time(log: DataFrame) -> DataFrame:
    """Estimated time by strategy: single sum, sequential sum x 1.1, parallel maximum, hybrid sum x 0.7."""
    g = log.groupBy("workflow_id").agg(F.sum("execution_time").alias("s"), F.max("execution_time").alias("m"))
    return g.select("workflow_id", F.round("s", 4).alias("single"), F.round(F.col("s") * 1.1, 4).alias("sequential"), F.round("m", 4).alias("parallel"), F.round(F.col("s") * 0.7, 4).alias("hybrid"))
