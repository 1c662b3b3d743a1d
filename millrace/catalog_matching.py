"""Queries on agent matching, ontology ingestion and classification; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import DEGREE, D, S, query
from .functions import json as js
from .functions import text as tx
from .operators import graph as gr
from .operators import matching as mc
from .sources import relations as rel

_RULES = "rules(kind, pass, place, word) AS (VALUES " + ", ".join(f"('{k}', {p}, {i}, '{w}')" for k, p, i, w in mc.rule_rows()) + ")"


@query(
    "SELECT k.kind, coalesce(f.agent_id, 'internet_agent') AS agent_id, coalesce(f.pass, 4) AS pass FROM (SELECT DISTINCT kind FROM rules) AS k LEFT JOIN (SELECT * FROM (SELECT kind, agent_id, pass, row_number() OVER (PARTITION BY kind ORDER BY pass, CASE WHEN pass = 1 THEN place ELSE 0 END, seq, place) AS nth FROM agents JOIN rules ON (pass = 1 AND agent_id = word) OR (pass = 2 AND starts_with(agent_id, word)) OR (pass = 3 AND contains(agent_id, word))) AS a WHERE nth = 1) AS f ON f.kind = k.kind",
    rel.AGENTS_SQL, _RULES,
)
def agent_by_kind(spark: S, d: str) -> D:
    return mc.by_kind(rel.agents(spark))


@query("SELECT a.workflow_id, a.pos, f.needs, f.first AS depends_on FROM exec_log a JOIN (SELECT workflow_id, agent_id AS needs, min(pos) AS first FROM exec_log GROUP BY 1, 2) AS f ON a.workflow_id = f.workflow_id AND ((a.agent_id = 'purchase' AND f.needs IN ('view', 'click')) OR (a.agent_id = 'click' AND f.needs = 'view')) AND f.first < a.pos", rel.EXEC_LOG)
def rule_dependencies(spark: S, d: str) -> D:
    return mc.earlier_of(rel.exec_log(spark, d), [("purchase", "view"), ("purchase", "click"), ("click", "view")])


@query("SELECT kind, CASE WHEN n <= 10 THEN 'circular' WHEN n <= 30 THEN 'hierarchical' WHEN e * 1.0 / n > 2 THEN 'force_directed' ELSE 'grid' END AS layout FROM (SELECT predicate AS kind, count(*) AS e, count(DISTINCT src) + count(DISTINCT dst) AS n FROM kg_edges GROUP BY 1) AS t", rel.KG_EDGES)
def graph_layouts(spark: S, d: str) -> D:
    g = rel.kg_edges(spark, d).groupBy(F.col("predicate").alias("kind")).agg(F.count("*").alias("e"), F.count_distinct("src").alias("s"), F.count_distinct("dst").alias("t"))
    return g.select("kind", gr.layout(F.col("s") + F.col("t"), F.col("e"), F.lit(True)).alias("layout"))


@query("SELECT type, max(degree) AS max_degree, round(avg(degree), 6) AS avg_degree, count(*) AS n FROM kg_nodes JOIN deg USING (id) GROUP BY type", rel.KG_NODES, rel.KG_EDGES, DEGREE)
def degree_by_type(spark: S, d: str) -> D:
    j = rel.kg_nodes(spark, d).join(gr.degrees(rel.kg_edges(spark, d)), "id")
    return j.groupBy("type").agg(F.max("degree").alias("max_degree"), F.round(F.avg("degree"), 6).alias("avg_degree"), F.count("*").alias("n"))


@query("SELECT 'query:' || qid AS src, 'mentions' AS predicate, 'agent:' || agent_id || ':' || tag AS dst FROM q_texts, (SELECT agent_id, unnest(tags) AS tag FROM agents) AS t WHERE contains(lower(text), lower(tag))", rel.Q_TEXTS, rel.AGENTS_SQL)
def ingest_queries(spark: S, d: str) -> D:
    tags = F.broadcast(rel.agents(spark).select("agent_id", F.explode("tags").alias("tag")))
    j = rel.q_texts(spark, d).join(tags, F.contains(F.lower("text"), F.lower("tag")))
    return j.select(F.concat(F.lit("query:"), "qid").alias("src"), F.lit("mentions").alias("predicate"), F.concat_ws(":", F.lit("agent"), "agent_id", "tag").alias("dst"))


@query("SELECT id, max(type) AS type FROM (SELECT 'agent:' || agent_id AS id, 'agent' AS type FROM agents UNION ALL SELECT 'type:' || input_type, 'schema' FROM agents UNION ALL SELECT 'type:' || output_type, 'schema' FROM agents UNION ALL SELECT 'capability_' || unnest(tags), 'capability' FROM agents) AS t GROUP BY id", rel.AGENTS_SQL)
def seed_ontology(spark: S, d: str) -> D:
    a = rel.agents(spark)
    own = F.array(F.struct(F.concat(F.lit("agent:"), "agent_id").alias("id"), F.lit("agent").alias("type")), F.struct(F.concat(F.lit("type:"), "input_type").alias("id"), F.lit("schema").alias("type")), F.struct(F.concat(F.lit("type:"), "output_type").alias("id"), F.lit("schema").alias("type")))
    caps = F.transform("tags", lambda t: F.struct(F.concat(F.lit("capability_"), t).alias("id"), F.lit("capability").alias("type")))
    return a.select(F.explode(F.concat(own, caps)).alias("x")).groupBy("x.id").agg(F.max("x.type").alias("type"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'visualization' WHEN 1 THEN 'analysis' WHEN 2 THEN 'information' ELSE 'general' END AS kind FROM events")
def result_types(spark: S, d: str) -> D:
    k = F.col("event_id") % 4
    data = F.when(k == 0, '{"chart": 1, "data": 2}').when(k == 1, '{"insights": "x"}').when(k == 2, '{"facts": []}').otherwise(F.col("props"))
    return rel.read(spark, d, "events").select("event_id", js.result_type(data).alias("kind"))


@query(r"SELECT qid, CASE WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 'en' WHEN len(regexp_extract_all(text, '[가-힣ㄱ-ㆎ]')) * 1.0 / len(regexp_extract_all(text, '\p{L}')) >= 0.3 THEN 'ko' ELSE 'en' END AS language FROM q_texts", rel.Q_TEXTS)
def language_share(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", tx.language_share(F.col("text")).alias("language"))


@query("SELECT n, strategy FROM (SELECT o_orderkey % 7 AS n, CASE WHEN o_orderkey % 7 <= 1 THEN 'single' WHEN bool_or(o_orderstatus = 'F') AND o_orderkey % 7 = 5 THEN 'sequential' WHEN o_orderkey % 7 <= 3 THEN 'parallel' ELSE 'hybrid' END AS strategy FROM orders GROUP BY o_orderkey % 7) AS t")
def strategy_by_tasks(spark: S, d: str) -> D:
    g = rel.read(spark, d, "orders").groupBy((F.col("o_orderkey") % 7).alias("n")).agg(F.bool_or(F.col("o_orderstatus") == "F").alias("f"))
    return g.select("n", tx.task_strategy(F.col("n"), F.col("f") & (F.col("n") == 5)).alias("strategy"))


@query("SELECT user_id, round(least(0.95, 0.7 + 0.05 * count(*)), 4) AS quality, round(count(*) FILTER (WHERE value > 50) * 1.0 / greatest(count(*), 1), 6) AS assisted FROM events GROUP BY user_id")
def plan_quality(spark: S, d: str) -> D:
    g = rel.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("a"))
    return g.select("user_id", F.round(F.least(F.lit(0.95), 0.7 + 0.05 * F.col("n")), 4).alias("quality"), F.round(F.col("a") / F.greatest("n", F.lit(1)), 6).alias("assisted"))


@query("SELECT user_id, count(*) AS entries, count(*) FILTER (WHERE age_s > 3600 * 24 * 7) AS expired, arg_min(event_id, ts) AS victim FROM (SELECT *, epoch(TIMESTAMP '2024-06-01' - ts) AS age_s FROM events) AS t GROUP BY user_id")
def cache_expiry(spark: S, d: str) -> D:
    age = F.unix_seconds(F.lit("2024-06-01").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return rel.read(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("entries"), F.count_if(age > 3600 * 24 * 7).alias("expired"), F.min_by("event_id", "ts").alias("victim"))
