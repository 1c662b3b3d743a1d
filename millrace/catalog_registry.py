"""Queries on the registry of agents and on counters; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import D, S, _any, query
from .operators import registry as rg
from .sources import relations as rel


def _cases(table, hay: str, other: str) -> str:
    return "CASE " + " ".join(f"WHEN {_any(words, hay)} THEN '{k}'" for k, words in table) + f" ELSE {other} END"


@query("SELECT agent_id, priority FROM registry WHERE list_contains(list_transform(capabilities, lambda c: lower(c)), 'currency_conversion')", rel.REGISTRY_SQL)
def agents_by_capability(spark: S, d: str) -> D:
    return rg.with_item(rel.registry(spark), "capabilities", "Currency_Conversion").select("agent_id", "priority")


@query("SELECT agent_id, is_available FROM registry WHERE is_available", rel.REGISTRY_SQL)
def available_agents(spark: S, d: str) -> D:
    return rg.available(rel.registry(spark)).select("agent_id", "is_available")


@query("SELECT e.agent_id, r.priority, r.agent_id IS NOT NULL AS found FROM (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN 'weather_agent' WHEN event_id % 3 = 1 THEN 'rag_search_agent' ELSE event_type END AS agent_id FROM events) AS e LEFT JOIN registry r ON e.agent_id = r.agent_id", rel.REGISTRY_SQL)
def agent_lookup(spark: S, d: str) -> D:
    k = F.col("event_id") % 3
    ids = rel.read(spark, d, "events").select(F.when(k == 0, "weather_agent").when(k == 1, "rag_search_agent").otherwise(F.col("event_type")).alias("agent_id")).distinct()
    return rg.lookup(rel.registry(spark), ids)


@query(" UNION ALL ".join(f"SELECT '{k}' AS capability, agent_id FROM registry WHERE {_any(words, 'hay')}" for k, words in rg.CAPABILITY_WORDS.items()), rel.REGISTRY_SQL.replace("registry(", "reg(", 1), "registry AS (SELECT agent_id, lower(agent_id || ' ' || array_to_string(capabilities, ' ') || ' ' || array_to_string(tags, ' ')) AS hay FROM reg)")
def agents_with_capability(spark: S, d: str) -> D:
    out = None
    for k in rg.CAPABILITY_WORDS:
        one = rg.detects(rel.registry(spark), k).select(F.lit(k).alias("capability"), "agent_id")
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT 'concept' AS kind, id, label FROM kg_nodes WHERE contains(lower(id), 'nation_1') OR contains(lower(label), 'nation_1') UNION ALL SELECT 'relation', src, predicate || ' ' || dst FROM kg_edges WHERE contains(predicate, 'nation_1')", rel.KG_NODES, rel.KG_EDGES)
def graph_text_search(spark: S, d: str) -> D:
    return rg.search_graph(rel.kg_nodes(spark, d), rel.kg_edges(spark, d), "NATION_1")


@query("SELECT agent_id, c AS capability, " + _cases(rg.CAPABILITY_KINDS, "lower(c)", "'general'") + " AS kind FROM (SELECT agent_id, unnest(capabilities) AS c FROM registry) AS u", rel.REGISTRY_SQL)
def capability_kinds(spark: S, d: str) -> D:
    return rel.registry(spark).select("agent_id", F.explode("capabilities").alias("capability")).withColumn("kind", rg.kind_of_capability(F.col("capability")))


@query("SELECT agent_id, t AS tag, CASE " + " ".join(f"WHEN t IN ({', '.join(map(repr, w))}) THEN '{k}'" for k, w in rg.TAG_KINDS) + " END AS kind FROM (SELECT agent_id, unnest(tags) AS t FROM registry) AS u", rel.REGISTRY_SQL)
def tag_kinds(spark: S, d: str) -> D:
    return rel.registry(spark).select("agent_id", F.explode("tags").alias("tag")).withColumn("kind", rg.kind_of_tag(F.col("tag")))


@query("SELECT agent_id, CASE WHEN len(f) > 0 THEN array_to_string(f, ',') ELSE 'general' END AS domains FROM (SELECT agent_id, list_filter([" + ", ".join(f"CASE WHEN {_any(w, 'h')} THEN '{k}' END" for k, w in rg.DOMAIN_WORDS) + "], lambda x: x IS NOT NULL) AS f FROM (SELECT agent_id, lower(agent_id || ' ' || array_to_string(tags, ' ')) AS h FROM registry) AS t) AS u", rel.REGISTRY_SQL)
def agent_domain_words(spark: S, d: str) -> D:
    return rel.registry(spark).select("agent_id", F.array_join(rg.domains(F.concat_ws(" ", "agent_id", F.array_join("tags", " "))), ",").alias("domains"))


@query("SELECT agent_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_concat(tags, ['  WEATHER ', '']), lambda t: trim(lower(t))), lambda t: t <> ''))), ',') AS tags FROM registry", rel.REGISTRY_SQL)
def normalised_tags(spark: S, d: str) -> D:
    return rel.registry(spark).select("agent_id", F.array_join(rg.plain_tags(F.concat("tags", F.array(F.lit("  WEATHER "), F.lit("")))), ",").alias("tags"))


_KINDS = [*rg.NEEDED, "other"]


@query("SELECT event_id, array_to_string(list_sort(list_distinct(list_concat(CASE event_id % 7 " + " ".join(f"WHEN {i} THEN {rg.NEEDED[k]}" for i, k in enumerate(_KINDS) if k in rg.NEEDED) + " ELSE CAST([] AS VARCHAR[]) END, [lower(event_type), 'analyze']))), ',') AS capabilities FROM events")
def required_capabilities(spark: S, d: str) -> D:
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % 7).cast("int"))
    return rel.read(spark, d, "events").select("event_id", F.array_join(rg.needed(kind, F.array(F.upper("event_type")), F.array(F.lit("Analyze"), F.lit(""))), ",").alias("capabilities"))


@query("SELECT dag_id AS plan_id, count(*) FILTER (WHERE known IS NULL) = 0 AND bool_and(has_task) AS valid FROM (SELECT a.dag_id, b.task_id AS known, true AS has_task FROM (SELECT dag_id, task_id FROM dag UNION SELECT dag_id, unnest(depends_on) FROM dag) AS a LEFT JOIN dag b ON a.dag_id = b.dag_id AND a.task_id = b.task_id) AS t GROUP BY 1", rel.DAG_SQL)
def plans_with_known_steps(spark: S, d: str) -> D:
    dag = rel.dag(spark, d)
    steps = dag.select(F.col("dag_id").alias("plan_id"), F.col("task_id").alias("id"))
    return rg.same_steps(steps, steps.unionByName(dag.select(F.col("dag_id").alias("plan_id"), F.explode("depends_on").alias("id"))))


# ---------------------------------------------------------------- counters


@query("SELECT round(count(*) / (greatest(epoch(max(ts)) - epoch(min(ts)), 1) / 60.0), 6) AS per_minute, round((count(*) + count(*) FILTER (WHERE value > 50)) * 1.0 / count(*), 6) AS agents_per_workflow, round(100.0 * count(*) FILTER (WHERE event_type = 'view') / count(*), 1) AS llm_share FROM events")
def throughput(spark: S, d: str) -> D:
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    g = rel.read(spark, d, "events").agg(F.count("*").alias("n"), F.greatest(F.max(t) - F.min(t), F.lit(1.0)).alias("s"), F.count_if(F.col("value") > 50).alias("p"), F.count_if(F.col("event_type") == "view").alias("v"))
    return g.select(F.round(F.try_divide(F.col("n"), F.col("s") / 60.0), 6).alias("per_minute"), F.round(F.coalesce(F.try_divide(F.col("n") + F.col("p"), F.col("n")), F.lit(1.0)), 6).alias("agents_per_workflow"), F.round(F.coalesce(F.try_divide(100.0 * F.col("v"), F.col("n")), F.lit(0.0)), 1).alias("llm_share"))


@query("SELECT event_type AS kind, count(*) AS total_calls, count(*) FILTER (WHERE value > 10) AS successful_calls, count(*) FILTER (WHERE value <= 10) AS failed_calls, round(sum(value), 4) AS total_time, round(avg(value), 6) AS average_time, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_call FROM events GROUP BY 1")
def calls_by_kind(spark: S, d: str) -> D:
    ok = F.col("value") > 10
    g = rel.read(spark, d, "events").groupBy(F.col("event_type").alias("kind"))
    return g.agg(F.count("*").alias("total_calls"), F.count_if(ok).alias("successful_calls"), F.count_if(~ok).alias("failed_calls"), F.round(F.sum("value"), 4).alias("total_time"), F.round(F.avg("value"), 6).alias("average_time"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_call"))


@query("SELECT dag_id, round(avg(CASE CAST(est_time AS BIGINT) % 5 WHEN 0 THEN 0.7 WHEN 1 THEN 0.8 WHEN 2 THEN 0.9 WHEN 3 THEN 0.95 ELSE 0.8 END), 6) AS quality, round(sum(est_time) * CASE WHEN count(*) FILTER (WHERE len(depends_on) = 0) > 1 THEN 0.7 ELSE 1.0 END, 6) AS seconds FROM dag GROUP BY 1", rel.DAG_SQL)
def workflow_estimates(spark: S, d: str) -> D:
    k = F.col("est_time").cast("long") % 5
    hundredths = F.when(k == 0, 70).when(k == 1, 80).when(k == 2, 90).when(k == 3, 95).otherwise(80)  # summed exactly: means of 64 tasks often tie at the sixth place
    g = rel.dag(spark, d).groupBy("dag_id").agg((F.sum(hundredths) / (100 * F.count("*"))).alias("q"), F.sum("est_time").alias("s"), F.count_if(F.size("depends_on") == 0).alias("free"))
    return g.select("dag_id", F.round("q", 6).alias("quality"), F.round(F.col("s") * F.when(F.col("free") > 1, 0.7).otherwise(1.0), 6).alias("seconds"))


@query("SELECT workflow_id, round(coalesce(avg(confidence), 0), 6) AS confidence FROM exec_log GROUP BY 1", rel.EXEC_LOG)
def overall_confidence(spark: S, d: str) -> D:
    return rel.exec_log(spark, d).groupBy("workflow_id").agg(F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 6).alias("confidence"))


@query("SELECT user_id, count(DISTINCT event_type) AS cache_size, round(1 - count(DISTINCT event_type) * 1.0 / count(*), 6) AS hit_rate, count(*) AS total_requests, greatest(count(DISTINCT event_type) - 3, 0) AS evictions FROM events GROUP BY 1")
def cache_statistics(spark: S, d: str) -> D:
    g = rel.read(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("cache_size"), F.count("*").alias("total_requests"))
    return g.select("user_id", "cache_size", F.round(F.try_divide(F.col("total_requests") - F.col("cache_size"), F.col("total_requests")), 6).alias("hit_rate"), "total_requests", F.greatest(F.col("cache_size") - 3, F.lit(0)).alias("evictions"))
