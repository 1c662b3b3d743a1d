"""Queries on users' queries: routing, entities, complexity; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import D, S, _any, query
from .functions import queries as fq
from .session import small
from .sources import relations as rel


def _first(table, other: str, t: str = "lower(text)") -> str:
    quoted = lambda k: f"'{k}'" if isinstance(k, str) else str(k)
    return "CASE " + " ".join(f"WHEN {_any(words, t)} THEN {quoted(k)}" for k, words in table) + f" ELSE {other} END"


@query("SELECT qid, (" + " OR ".join(f"regexp_matches(text, '{p}')" for p in fq.COMPOUND) + " OR " + " + ".join(f"{_any(w)}::INT" for w in fq.DOMAINS.values()) + " >= 2) AS compound FROM q_texts", rel.Q_TEXTS)
def compound_queries(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", fq.is_compound(F.col("text")).alias("compound"))


@query("SELECT qid, " + _first(fq.DRAWINGS, "'generic'") + " AS kind, (" + _any(fq.DRAWING) + " OR qid % 5 > 2 OR qid % 7 = 0) AS wanted FROM q_texts", rel.Q_TEXTS)
def drawings(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", fq.drawing(F.col("text")).alias("kind"), fq.wants_drawing(F.col("text"), F.col("qid") % 5, F.col("qid") % 7 == 0).alias("wanted"))


@query(
    r"SELECT qid, array_to_string(list_sort(list_distinct(list_concat(list_transform(regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)?'), lambda x: 'number_' || x), list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN 'time_{w}' END" for w in fq.TIMES) + "], lambda x: x IS NOT NULL)))), ' ') AS entities, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{c}' END" for w, c in fq.CONCEPTS.items()) + "], lambda x: x IS NOT NULL), ' ') AS concepts, array_to_string(list_filter([CASE WHEN contains(text, '그리고') OR contains(text, ',') THEN 'sequential_execution' END, CASE WHEN contains(text, '비교') THEN 'comparison' END], lambda x: x IS NOT NULL), ' ') AS relations FROM q_texts",
    rel.Q_TEXTS,
)
def query_entities(spark: S, d: str) -> D:
    t = F.col("text")
    return rel.q_texts(spark, d).select("qid", *(F.array_join(f(t), " ").alias(n) for n, f in (("entities", fq.entities), ("concepts", fq.concepts), ("relations", fq.relations))))


@query("SELECT qid, array_to_string(list_sort(list_distinct(list_concat(list_concat(" + ", ".join(f"regexp_extract_all(text, '{p}')" for p in fq.ENTITY_PATTERNS[:2]) + f"), regexp_extract_all(text, '{fq.ENTITY_PATTERNS[2]}')))), ' ') AS entities FROM q_texts", rel.Q_TEXTS)
def selector_entities(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", F.array_join(fq.named_entities(F.col("text")), " ").alias("entities"))


@query("SELECT DISTINCT o_orderkey AS qid, 'p:' || l_partkey AS entity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_partkey IN (SELECT p_partkey FROM part)")
def entities_in_graph(spark: S, d: str) -> D:
    words = rel.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.concat_ws(" ", F.collect_set(F.concat(F.lit("p:"), "l_partkey"))).alias("text"))
    split = words.join(rel.read(spark, d, "orders").select(F.col("o_orderkey").alias("qid")), "qid", "left_semi").select("qid", F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("entity"))
    return split.join(rel.kg_nodes(spark, d).select(F.col("id").alias("entity")), "entity", "left_semi").select("qid", "entity")


@query("SELECT qid, round(c, 6) AS overall, round(c * 0.9, 6) AS cognitive_load, greatest(1, CAST(floor(round(c * 5, 9)) AS BIGINT)) AS steps, CASE WHEN c > 0.6 THEN 'moderate' ELSE 'low' END AS resources FROM (SELECT qid, CAST(greatest(0.1, least(0.9, " + _first(fq.TIERS, "0.5") + " + CASE WHEN length(text) > 100 THEN 0.1 WHEN length(text) < 20 THEN -0.1 ELSE 0.0 END)) AS DOUBLE) AS c FROM q_texts) AS t", rel.Q_TEXTS)
def fallback_complexity(spark: S, d: str) -> D:
    c = F.round(fq.default_complexity(F.col("text")), 9)
    t = rel.q_texts(spark, d).select("qid", c.alias("c"))
    return t.select("qid", F.round("c", 6).alias("overall"), F.round(F.col("c") * 0.9, 6).alias("cognitive_load"), F.greatest(F.lit(1).cast("long"), F.floor(F.round(F.col("c") * 5, 9))).alias("steps"), F.when(F.col("c") > 0.6, "moderate").otherwise("low").alias("resources"))


@query("SELECT qid, " + _first(fq.AIMS, "CASE WHEN qid % 7 <= 2 THEN 'speed_first' WHEN qid % 7 >= 5 THEN 'quality_first' ELSE 'balanced' END") + " AS aim, CASE WHEN qid % 4 >= 2 THEN 'speed_first' WHEN qid % 3 >= (qid % 7) * 0.5 THEN 'quality_first' ELSE 'balanced' END AS again FROM q_texts", rel.Q_TEXTS)
def optimisation_aims(spark: S, d: str) -> D:
    q = F.col("qid")
    return rel.q_texts(spark, d).select("qid", fq.aim(F.col("text"), q % 7).alias("aim"), fq.aim_again(q % 4, q % 3, q % 7).alias("again"))


@query(
    "SELECT qid, agent_id, CASE agent_id " + " ".join(f"WHEN '{a}' THEN 20 * (" + " + ".join(f"contains(text, '{w}')::INT" for w in ws) + ")" for a, ws in fq.AGENT_WORDS.items()) + " ELSE 0 END + " + " + ".join(f"CASE WHEN {_any(w, 'text')} AND {_any(i, 'agent_id')} THEN 25 ELSE 0 END" for w, i in fq.BONUS) + " AS score, array_to_string(list_filter([" + ", ".join(f"CASE WHEN contains(text, '{w}') THEN '{w}' END" for w in fq.SEGMENT_WORDS) + "], lambda x: x IS NOT NULL), ' ') AS words FROM q_texts, agents",
    rel.Q_TEXTS, rel.AGENTS_SQL,
)
def segment_scores(spark: S, d: str) -> D:
    t = F.col("text")
    return rel.q_texts(spark, d).join(small(rel.agents(spark)), F.lit(True)).select("qid", "agent_id", fq.segment_score(t, F.col("agent_id")).alias("score"), F.array_join(fq.segment_words(t), " ").alias("words"))
