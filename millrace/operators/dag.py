"""Dependency graphs: levels, cycles, reductions and estimates; all graphs of a table at once.

Levels go by rounds until no task is new: a task's number of open dependencies falls by those that the round before
settled, counted by aggregation, and the round's state is checkpointed, so that a lost executor costs one round and
no plan grows. Reachability doubles its paths each round. Neither has a bound on depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoints

KEY = ["dag_id", "task_id"]


def edges(dag: DataFrame) -> DataFrame:
    """(dag_id, task_id, dep) for dependencies on known tasks."""
    e = dag.select(*KEY, F.explode(F.array_distinct("depends_on")).alias("dep"))
    return e.join(dag.select("dag_id", F.col("task_id").alias("dep")).distinct(), ["dag_id", "dep"], "left_semi").select(*KEY, "dep")


def settled(dag: DataFrame, rounds: int = 2) -> DataFrame:
    """(dag_id, task_id, level): longest path from a root; null on or behind a cycle. `rounds` go into one job."""
    checkpoints(dag.sparkSession)
    e = edges(dag).checkpoint()
    state = dag.select(*KEY).distinct().join(e.groupBy(*KEY).agg(F.count("*").alias("n")), KEY, "left")
    state = state.select(*KEY, F.coalesce("n", F.lit(0)).alias("open"), F.when(F.col("n").isNull(), 0).alias("level")).checkpoint()
    depth = 0
    while not state.where(F.col("level") == depth).isEmpty():
        for _ in range(rounds):
            done = state.where(F.col("level") == depth).select("dag_id", F.col("task_id").alias("dep"))
            told = e.join(done, ["dag_id", "dep"], "left_semi").groupBy(*KEY).agg(F.count("*").alias("n"))
            left = F.col("open") - F.coalesce("n", F.lit(0))
            depth += 1
            state = state.join(told, KEY, "left").select(*KEY, left.alias("open"), F.coalesce("level", F.when(left == 0, depth)).alias("level"))
        state = state.checkpoint()
    return state.select(*KEY, "level")


def levels(dag: DataFrame) -> DataFrame:
    """(dag_id, task_id, level): longest path from a root; tasks on or behind a cycle share the level after the last."""
    s = settled(dag)
    last = s.groupBy("dag_id").agg(F.coalesce(F.max("level") + 1, F.lit(0)).alias("last"))
    return s.join(last, "dag_id").select(*KEY, F.coalesce("level", "last").alias("level"))


def time_estimate(dag: DataFrame) -> DataFrame:
    """Sequential time is the sum, parallel time the sum over levels of the longest task."""
    per = dag.join(levels(dag), KEY).groupBy("dag_id", "level").agg(F.max("est_time").alias("m"), F.sum("est_time").alias("s"))
    return per.groupBy("dag_id").agg(F.round(F.sum("s"), 4).alias("sequential"), F.round(F.sum("m"), 4).alias("parallel"))


def reachable(dag: DataFrame) -> DataFrame:
    """(dag_id, task_id, dep): which tasks on or behind a cycle depend on which, directly or not; no others can close one."""
    stuck = settled(dag).where("level is null").select(*KEY)
    found = edges(dag).join(stuck, KEY, "left_semi").join(stuck.withColumnRenamed("task_id", "dep"), ["dag_id", "dep"], "left_semi").select(*KEY, "dep").checkpoint()
    size = found.count()
    while size:
        more = found.alias("f").join(found.alias("g"), (F.col("f.dag_id") == F.col("g.dag_id")) & (F.col("f.dep") == F.col("g.task_id"))).select("f.dag_id", "f.task_id", "g.dep")
        found = found.unionByName(more).distinct().checkpoint()
        before, size = size, found.count()
        if size == before:
            break
    return found


def cycles(dag: DataFrame) -> DataFrame:
    """Tasks that depend on themselves, directly or not."""
    return reachable(dag).where("task_id = dep").select(*KEY)


def remove_back_edges(dag: DataFrame) -> DataFrame:
    """Edges without those that close a cycle: between tasks that reach each other, the one from the later to the earlier id stays."""
    back = reachable(dag).where("task_id >= dep").select("dag_id", F.col("task_id").alias("dep"), F.col("dep").alias("task_id"))
    return edges(dag).join(back, [*KEY, "dep"], "left_anti").select(*KEY, "dep")


def transitive_reduction(dag: DataFrame) -> DataFrame:
    """Edges without those that two other edges imply."""
    e = edges(dag)
    implied = e.alias("x").join(e.alias("y"), (F.col("x.dag_id") == F.col("y.dag_id")) & (F.col("x.dep") == F.col("y.task_id"))).select("x.dag_id", "x.task_id", "y.dep")
    return e.join(implied.distinct(), [*KEY, "dep"], "left_anti")


def same_dependencies(dag: DataFrame) -> DataFrame:
    """Groups of more than one task with the same set of dependencies."""
    g = dag.groupBy("dag_id", F.array_join(F.array_sort("depends_on"), ",").alias("deps")).agg(F.array_join(F.array_sort(F.collect_list("task_id")), ",").alias("tasks"), F.count("*").alias("n"))
    return g.where("n > 1")


def problems(dag: DataFrame) -> DataFrame:
    """Dependencies on unknown tasks or on the task itself."""
    e = dag.select(*KEY, F.explode("depends_on").alias("dep"))
    known = dag.select("dag_id", F.col("task_id").alias("dep")).distinct()
    dangling = e.join(known, ["dag_id", "dep"], "left_anti").select(*KEY, "dep", F.lit("dangling").alias("problem"))
    return dangling.unionByName(e.where("task_id = dep").select(*KEY, "dep", F.lit("self").alias("problem")))
