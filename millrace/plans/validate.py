"""Validation of execution plans: one row for each finding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of output and input types that fit besides equal ones and any.
COMPATIBLE = [("text", "query"), ("text", "structured_data"), ("json", "query"), ("json", "structured_data"), ("structured_data", "query")]


def compatible(out, into):
    fits = (out == into) | (out == "any") | (into == "any")
    for a, b in COMPATIBLE:
        fits = fits | ((out == a) & (into == b))
    return fits


def unknown_agents(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    return tasks.join(F.broadcast(agents.select("agent_id")), "agent_id", "left_anti").select("plan_id", "stage_id", "agent_id")


def references(tasks: DataFrame) -> DataFrame:
    return tasks.select("plan_id", "stage_id", "agent_id", F.explode("input_from").alias("ref"))


def bad_references(tasks: DataFrame) -> DataFrame:
    """References to the same or a later stage, to outputs that no task has, or of no known form."""
    outputs = tasks.select("plan_id", F.concat(F.lit("stage_"), "stage_id", F.lit("."), "agent_id").alias("ref")).distinct()
    missing = references(tasks).join(outputs, ["plan_id", "ref"], "left_anti").where("ref <> 'final'")
    stage = F.try_to_number(F.regexp_extract("ref", r"^stage_(\d+)$", 1), F.lit("999")).cast("int")
    code = F.when(~F.col("ref").startswith("stage_"), "format").when(F.contains("ref", F.lit(".")), "output").when(stage >= F.col("stage_id"), "future")
    return missing.select("plan_id", "stage_id", "agent_id", "ref", code.alias("code")).where("code is not null")


def schema_errors(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """Plan edges whose source's output does not fit the target's input."""
    small = F.broadcast(agents.select("agent_id", "input_type", "output_type"))
    e = references(tasks).select("*", F.regexp_extract("ref", r"^stage_\d+\.(.*)$", 1).alias("source"))
    both = e.join(small.select("agent_id", "input_type"), "agent_id").join(small.select(F.col("agent_id").alias("source"), "output_type"), "source")
    return both.where(~compatible(F.col("output_type"), F.col("input_type"))).select("plan_id", "source", "agent_id", "output_type", "input_type")


def errors(tasks: DataFrame, agents: DataFrame) -> DataFrame:
    """(plan_id, code, n): all findings of a plan by kind."""
    row = lambda df, code: df.select("plan_id", code.alias("code"))
    first = tasks.join(tasks.groupBy("plan_id").agg(F.min("stage_id").alias("stage_id")), ["plan_id", "stage_id"]).where(F.size("input_from") > 0)
    busy = tasks.groupBy("plan_id").agg(F.count("*").alias("n")).where("n > 5")
    own = F.exists("input_from", lambda r: r.startswith(F.concat(F.lit("stage_"), F.col("stage_id").cast("string"), F.lit("."))))
    idle = tasks.where("execution_type = 'sequential'").groupBy("plan_id", "stage_id").agg(F.count("*").alias("n"), F.bool_or(own).alias("own")).where("n > 1 and not own")
    out = row(unknown_agents(tasks, agents), F.lit("unknown_agent"))
    for df, code in ((bad_references(tasks), F.concat(F.lit("reference_"), F.col("code"))), (schema_errors(tasks, agents), F.lit("schema")), (first, F.lit("first_stage_input")), (busy, F.lit("warning_many_agents")), (idle, F.lit("warning_could_be_parallel"))):
        out = out.unionByName(row(df, code))
    return out.groupBy("plan_id", "code").agg(F.count("*").alias("n"))


def sizes(tasks: DataFrame) -> DataFrame:
    return tasks.groupBy("plan_id").agg(F.count_distinct("stage_id").alias("stages"), F.count("*").alias("agents"))
