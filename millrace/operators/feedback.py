"""Ranking that learns from feedback: decayed pattern scores, recommendations, moving averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_decay(last_used: Column, as_of: Column) -> Column:
    """Half every 30 days, never below 0.1; today or later is 1, unknown 0.1, a year or more 0.1."""
    days = F.datediff(as_of, last_used)
    return F.when(last_used.isNull(), 0.1).when(days <= 0, 1.0).when(days >= 365, 0.1).otherwise(F.greatest(F.lit(0.1), F.pow(F.lit(0.5), days / 30.0)))


def pattern_scores(asked: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """Every match of a query with a learned row: match x success rate x decay, rounded half even to three places.

    Queries are few and broadcast; learned rows are scanned once.
    """
    same = (F.col("pattern") == F.col("q_pattern")) | (F.col("category") == F.col("q_category"))
    m = F.broadcast(asked).join(mappings, same)
    overlap = lambda a, b, each, most: F.least(F.size(F.array_intersect(a, b)) * each, F.lit(most))
    match = F.when(F.col("pattern") == F.col("q_pattern"), 1.0).otherwise(0.7) + overlap("keywords", "q_keywords", 0.2, 0.5) + overlap("entities", "q_entities", 0.1, 0.3)
    return m.withColumn("final_score", F.bround(match * F.col("success_rate") * time_decay(F.col("last_used"), as_of), 3))


def top_patterns(scores: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("qid").orderBy(F.desc("final_score"), "selected_agent", "category", "pattern")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recommend(scores: DataFrame, k: int = 3) -> DataFrame:
    """The k agents with the highest sum of the best patterns' scores."""
    sums = top_patterns(scores).groupBy("qid", "selected_agent").agg(F.round(F.sum("final_score"), 3).alias("score")).where("score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "selected_agent")
    return sums.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ema(log: DataFrame, key: str, order: list[str], value: Column, weight: float, prior: float | None = None) -> DataFrame:
    """Exponential moving average of value by key in closed form: no list of a key's rows is ever built.

    The first value counts in full, or a prior takes its place.
    """
    w = Window.partitionBy(key).orderBy(*order)
    n = F.count("*").over(Window.partitionBy(key))
    rows = log.select(key, value.cast("double").alias("x"), (n - F.row_number().over(w)).alias("age"), F.row_number().over(w).alias("nth"))
    keep = 1.0 - weight
    first = F.lit(weight) if prior is not None else F.when(F.col("nth") == 1, 1.0).otherwise(weight)
    total = F.sum(first * F.pow(F.lit(keep), F.col("age")) * F.col("x"))
    if prior is not None:
        total = total + F.pow(F.lit(keep), F.count("*")) * prior
    return rows.groupBy(key).agg(F.round(total, 6).alias("ema"), F.count("*").alias("n"))


def confidence(best: Column, has_recommendations: Column, n_concepts: Column, has_entities: Column) -> Column:
    """Confidence of the selector from its insights, 1 at most."""
    return F.least(F.lit(1.0), F.coalesce(best, F.lit(0.0)) * 0.3 + F.when(has_recommendations, 0.3).otherwise(0.0) + F.when(n_concepts > 5, 0.2).otherwise(0.0) + F.when(has_entities, 0.2).otherwise(0.0))
