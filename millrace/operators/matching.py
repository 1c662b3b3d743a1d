"""Which agent serves a kind of work: cascades of rules, the first pass that finds one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_agent_id

#: Fixed values, by kind of agent: preferred names, name prefixes, words.
PREFERRED = {"research": ["internet_agent", "weather_agent"], "analysis": ["analysis_agent", "finance_agent"], "technical": ["calculator_agent"], "creative": ["chart_agent"], "general": ["memo_agent"]}
PREFIXES = {
    "research": ["internet_agent", "search_agent", "weather_agent", "restaurant_finder_agent", "shopping_agent"],
    "analysis": ["analysis_agent", "finance_agent", "currency_agent", "exchange_agent"],
    "technical": ["calculator_agent", "translate_agent", "file_agent", "document_agent", "content_formatter_agent"],
    "creative": ["chart_agent", "image_agent", "audio_agent", "data_visualization_agent", "brick_game_agent", "tetris_game_agent", "mahjong_game_agent", "sudoku_game_agent", "road_runner_game_agent", "super_mario_game_agent"],
    "general": ["memo_agent", "note_agent", "scheduler_agent", "general_agent"],
}
WORDS = {
    "research": ["internet", "search", "weather", "restaurant", "shopping", "find"],
    "analysis": ["analysis", "finance", "currency", "exchange", "analyze"],
    "technical": ["calculator", "calculate", "math", "translate", "file", "document", "format"],
    "creative": ["chart", "image", "audio", "visual", "game", "creative"],
    "general": ["memo", "note", "schedule", "general", "research", "creative", "technical"],
}


def rule_rows() -> list[tuple[str, int, int, str]]:
    """(kind, pass, place, word) of the three passes that look at names."""
    return [(kind, p, i, w) for p, table in ((1, PREFERRED), (2, PREFIXES), (3, WORDS)) for kind, words in table.items() for i, w in enumerate(words)]


def by_kind(agents: DataFrame) -> DataFrame:
    """(kind, agent_id, pass): preferred name, then prefix in order of the agents, then word, then the first agent.

    The rules are a fixed table of under a hundred rows and are broadcast.
    """
    spark = agents.sparkSession
    rules = F.broadcast(spark.createDataFrame(rule_rows(), "kind string, pass int, place int, word string"))
    named = agents.select("seq", "agent_id", normalise_agent_id(F.col("agent_id")).alias("name"))
    fits = ((F.col("pass") == 1) & (F.col("name") == F.col("word"))) | ((F.col("pass") == 2) & F.startswith("name", F.col("word"))) | ((F.col("pass") == 3) & F.contains("name", F.col("word")))
    order = F.struct("pass", F.when(F.col("pass") == 1, F.col("place")).otherwise(0).alias("p"), "seq", "place")
    found = named.join(rules, fits).groupBy("kind").agg(F.min_by("agent_id", order).alias("agent_id"), F.min("pass").alias("pass"))
    kinds = spark.createDataFrame([(k,) for k in PREFERRED], "kind string")
    first = agents.agg(F.min_by("agent_id", "seq").alias("first"))
    return kinds.join(found, "kind", "left").join(F.broadcast(first), F.lit(True), "left").select("kind", F.coalesce("agent_id", "first").alias("agent_id"), F.coalesce("pass", F.lit(4)).alias("pass"))


def earlier_of(log: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(workflow_id, pos, depends_on): for (agent, needs) rules the first earlier result of the agent that is needed."""
    r = F.broadcast(log.sparkSession.createDataFrame(rules, "agent_id string, needs string"))
    a = log.select("workflow_id", "pos", "agent_id").join(r, "agent_id")
    first = log.groupBy("workflow_id", F.col("agent_id").alias("needs")).agg(F.min("pos").alias("depends_on"))
    return a.join(first, ["workflow_id", "needs"]).where("depends_on < pos").select("workflow_id", "pos", "needs", "depends_on")
