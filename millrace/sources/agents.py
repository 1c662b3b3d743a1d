"""Agents from source files and JSON: scan, parse, load, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_agent_files(spark: SparkSession, folder: str) -> DataFrame:
    """(agent_id, class_name, description, capabilities, tags) of each *_agent.py that is no test and not private."""
    files = spark.read.option("pathGlobFilter", "*_agent.py").text(folder, wholetext=True).select("value", "_metadata.file_name")
    return parse_agents(files.where(~F.col("file_name").startswith("test_") & ~F.col("file_name").startswith("_")))


def _list(text: Column, name: str) -> Column:
    inner = F.regexp_extract(text, rf"{name}\s*[=:]\s*\[([^\]]+)\]", 1)
    items = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), "^[\"']+|[\"']+$", ""))
    return F.filter(items, lambda x: F.trim(x) != "")


def parse_agents(files: DataFrame) -> DataFrame:
    """Metadata of source texts (file_name, value) by patterns; the class's docstring stands in for a description."""
    v = F.col("value")
    agent = F.regexp_replace("file_name", r"\.py$", "")
    named = F.nullif(F.regexp_extract(v, r"class\s+(\w+Agent)\s*[:(]", 1), F.lit(""))
    given = F.nullif(F.regexp_extract(v, r"description\s*[=:]\s*[\"']([^\"']+)[\"']", 1), F.lit(""))
    doc = F.trim(F.regexp_extract(v, r'(?s)class\s+\w+.*?:\s*"""([^"]+)"""', 1))
    return files.select(
        agent.alias("agent_id"),
        F.coalesce(named, F.concat(F.initcap(F.replace(agent, F.lit("_"), F.lit(" "))), F.lit("Agent"))).alias("class_name"),
        F.left(F.coalesce(given, doc), F.lit(200)).alias("description"),
        _list(v, "capabilities").alias("capabilities"),
        _list(v, "tags").alias("tags"),
    )


def load_metadata(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object keyed by agent name, one row for each; ids end in _agent, the version defaults to 1.0.0."""
    text = spark.read.text(path, wholetext=True)
    kind = "map<string, struct<description: string, version: string, capabilities: array<string>, tags: array<string>>>"
    rows = text.select(F.explode(F.from_json("value", kind)))
    key = F.col("key")
    return rows.select(F.when(key.endswith("_agent"), key).otherwise(F.concat(key, F.lit("_agent"))).alias("agent_id"), "value.description", F.coalesce("value.version", F.lit("1.0.0")).alias("version"), "value.capabilities", "value.tags")


def merge_agents(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full outer merge on agent_id: the first non-empty value wins."""
    a, b = first.alias("a"), second.alias("b")
    some = lambda c: F.coalesce(F.nullif(f"a.{c}", F.lit("")), f"b.{c}").alias(c)
    many = lambda c: F.when(F.size(f"a.{c}") > 0, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c)
    m = a.join(b, F.col("a.agent_id") == F.col("b.agent_id"), "full_outer")
    seen = F.concat_ws("+", F.when(F.col("a.agent_id").isNotNull(), "files"), F.when(F.col("b.agent_id").isNotNull(), "metadata"))
    return m.select(F.coalesce("a.agent_id", "b.agent_id").alias("agent_id"), some("description"), many("capabilities"), many("tags"), seen.alias("sources"))


def upsert_registry(registry: DataFrame, config: DataFrame) -> DataFrame:
    """Known ids take the config's non-empty description and tags, unknown ids are added; change tells which."""
    r, c = registry.alias("r"), config.alias("c")
    m = r.join(c, F.col("r.agent_id") == F.col("c.agent_id"), "full_outer")
    change = F.when(F.col("r.agent_id").isNull(), "added").when(F.col("c.agent_id").isNull(), "kept").otherwise("updated")
    return m.select(
        F.coalesce("r.agent_id", "c.agent_id").alias("agent_id"),
        F.coalesce(F.nullif("c.description", F.lit("")), "r.description").alias("description"),
        F.when(F.size("c.tags") > 0, F.col("c.tags")).otherwise(F.col("r.tags")).alias("tags"),
        change.alias("change"),
    )
