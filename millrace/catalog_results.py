"""Queries on results, registries, ingestion and conversations; added to the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import D, S, query
from .functions import json as js
from .functions import text as tx
from .operators import results as rs
from .sources import agents as ag
from .sources import relations as rel
from .sources import sinks


@query("SELECT agent_id, 'capability_' || unnest(tags) AS dst, 'has_capability' AS predicate FROM agents", rel.AGENTS_SQL)
def capability_edges(spark: S, d: str) -> D:
    return rel.agents(spark).select("agent_id", F.explode("tags").alias("tag")).select("agent_id", F.concat(F.lit("capability_"), "tag").alias("dst"), F.lit("has_capability").alias("predicate"))


@query("SELECT count(*) AS agents, count(*) FILTER (WHERE output_type = 'json') AS json_out, count(*) FILTER (WHERE len(tags) > 4) AS well_tagged, arg_max(agent_id, priority) AS top FROM agents", rel.AGENTS_SQL)
def capability_counts(spark: S, d: str) -> D:
    return rel.agents(spark).agg(F.count("*").alias("agents"), F.count_if(F.col("output_type") == "json").alias("json_out"), F.count_if(F.size("tags") > 4).alias("well_tagged"), F.max_by("agent_id", "priority").alias("top"))


@query("SELECT agent_id, CASE WHEN s = 0 THEN 1.0 ELSE s END AS score FROM (SELECT agent_id, CASE " + " ".join(f"WHEN contains(agent_id, '{w}') THEN {p}" for w, p in rs.VISUAL_NAMES) + " ELSE 0.0 END + 2.0 * len(list_filter(tags, lambda t: contains(lower(t), 'visual') OR contains(lower(t), 'chart') OR contains(lower(t), 'graph'))) AS s FROM agents) AS t", rel.AGENTS_SQL)
def visual_scores(spark: S, d: str) -> D:
    return rel.agents(spark).select("agent_id", rs.visual_score(F.col("agent_id"), F.col("tags")).alias("score"))


@query("SELECT a.agent_id AS first, b.agent_id AS second, round(len(list_intersect(a.tags, b.tags)) * 1.0 / greatest(len(a.tags), len(b.tags)), 6) AS overlap FROM agents a JOIN agents b ON a.seq < b.seq WHERE len(list_intersect(a.tags, b.tags)) > 0", rel.AGENTS_SQL)
def tag_overlap(spark: S, d: str) -> D:
    return rs.tag_overlap(rel.agents(spark))


@query("SELECT agent_id, CASE WHEN agent_id = 'new_agent' THEN 'n' WHEN agent_id = 'weather_agent' THEN 'better' ELSE output_type END AS description, CASE WHEN agent_id = 'new_agent' THEN 0 WHEN agent_id = 'weather_agent' THEN 1 ELSE len(tags) END AS n_tags, CASE WHEN agent_id = 'new_agent' THEN 'added' WHEN agent_id = 'weather_agent' THEN 'updated' ELSE 'kept' END AS change FROM (SELECT agent_id, output_type, tags FROM agents UNION ALL SELECT 'new_agent', '', []::VARCHAR[]) AS t", rel.AGENTS_SQL)
def registry_upsert(spark: S, d: str) -> D:
    config = spark.createDataFrame([("weather_agent", "better", ["sun"]), ("new_agent", "n", [])], "agent_id string, description string, tags array<string>")
    out = ag.upsert_registry(rel.agents(spark).withColumn("description", F.col("output_type")), config)
    return out.select("agent_id", "description", F.coalesce(F.size("tags"), F.lit(0)).alias("n_tags"), "change")


_BUCKET = "CASE " + " ".join("WHEN " + " OR ".join(f"contains({{x}}, '{w}')" for w in words) + f" THEN '{name}'" for name, words in rs.BUCKETS) + " ELSE 'general' END"


@query("SELECT agent_id, " + _BUCKET.format(x="agent_id") + " AS bucket FROM agents", rel.AGENTS_SQL)
def result_buckets(spark: S, d: str) -> D:
    return rel.agents(spark).select("agent_id", rs.bucket(F.col("agent_id")).alias("bucket"))


@query("SELECT kind, sum(s) AS sequential, max(s) AS parallel FROM (SELECT p_size % 5 AS kind, CASE p_brand WHEN 'Brand#11' THEN 6.0 WHEN 'Brand#12' THEN 8.0 ELSE 3.0 END AS s FROM part) AS t GROUP BY kind")
def task_type_time(spark: S, d: str) -> D:
    kind = F.when(F.col("p_brand") == "Brand#11", "analysis").when(F.col("p_brand") == "Brand#12", "image_generation").otherwise("else")
    return rel.read(spark, d, "part").groupBy((F.col("p_size") % 5).alias("kind")).agg(F.sum(rs.task_seconds(kind)).alias("sequential"), F.max(rs.task_seconds(kind)).alias("parallel"))


@query("SELECT a.dag_id, a.task_id, string_agg(b.task_id || '=' || printf('%.1f', b.est_time), '; ' ORDER BY b.seq) AS context FROM (SELECT dag_id, task_id, unnest(depends_on) AS dep FROM dag) AS a JOIN dag b ON a.dag_id = b.dag_id AND a.dep = b.task_id GROUP BY 1, 2", rel.DAG_SQL)
def dependency_context(spark: S, d: str) -> D:
    return rs.dependency_context(rel.dag(spark, d))


@query("SELECT dag_id, task_id, array_to_string(list_sort(list_distinct(depends_on)), ',') AS sources, len(depends_on) > 0 AS needs_context FROM dag", rel.DAG_SQL)
def query_chains(spark: S, d: str) -> D:
    return rs.query_chains(rel.dag(spark, d))


@query("SELECT workflow_id, CAST(floor((pos - 1) / 3.0) AS BIGINT) AS stage, string_agg(agent_id, '|' ORDER BY pos) FILTER (WHERE success) AS output, bool_and(success) AS all_ok FROM exec_log GROUP BY 1, 2", rel.EXEC_LOG)
def stage_output(spark: S, d: str) -> D:
    return rs.stage_output(rel.exec_log(spark, d))


@query("SELECT l.workflow_id, (SELECT e.agent_id FROM exec_log e WHERE e.workflow_id = l.workflow_id AND floor((e.pos - 1) / 3.0) = l.stage AND e.success ORDER BY e.pos DESC LIMIT 1) AS output FROM (SELECT workflow_id, max(floor((pos - 1) / 3.0)) AS stage FROM exec_log GROUP BY 1) AS l", rel.EXEC_LOG)
def last_success(spark: S, d: str) -> D:
    return rs.last_success(rel.exec_log(spark, d))


@query("SELECT workflow_id, count(*) FILTER (WHERE success) AS items, coalesce(string_agg(agent_id, ',' ORDER BY pos) FILTER (WHERE success), '') AS output FROM exec_log GROUP BY 1", rel.EXEC_LOG)
def combined_output(spark: S, d: str) -> D:
    return rs.combined(rel.exec_log(spark, d))


@query("SELECT workflow_id, agent_id, arg_max(previous, pos) AS depends_on FROM (SELECT *, lag(agent_id) OVER (PARTITION BY workflow_id ORDER BY pos) AS previous FROM exec_log) AS t WHERE previous IS NOT NULL GROUP BY 1, 2", rel.EXEC_LOG)
def sequential_dependencies(spark: S, d: str) -> D:
    return rs.sequential_dependencies(rel.exec_log(spark, d))


@query("SELECT qid, agent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, seq) AS nth FROM (SELECT qid, seq, agent_id, 20 * len(list_filter(tags, lambda t: contains(lower(text), lower(t)))) AS score FROM q_texts, agents) AS a WHERE score > 0) AS b WHERE nth = 1", rel.Q_TEXTS, rel.AGENTS_SQL)
def segment_agent(spark: S, d: str) -> D:
    return rs.best_agent(rel.q_texts(spark, d), rel.agents(spark))


@query("SELECT workflow_id, round((max(epoch_us(created_at)) - min(epoch_us(created_at))) / 1e6, 3) AS duration, round(avg(execution_time), 6) AS mean_step FROM exec_log GROUP BY 1", rel.EXEC_LOG)
def execution_metrics(spark: S, d: str) -> D:
    return rs.stage_times(rel.exec_log(spark, d))


@query("SELECT agent_id, event_id, round(avg(execution_time) OVER (PARTITION BY agent_id ORDER BY created_at, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS mean FROM exec_log", rel.EXEC_LOG)
def running_mean(spark: S, d: str) -> D:
    return rs.running_mean(rel.exec_log(spark, d))


@query("SELECT workflow_id, string_agg('## ' || pos || '. ' || agent_id || chr(10) || chr(10) || props, chr(10) || chr(10) ORDER BY pos) AS text FROM exec_log JOIN (SELECT event_id AS e, props FROM events) AS v ON e = event_id GROUP BY workflow_id", rel.EXEC_LOG)
def results_markdown(spark: S, d: str) -> D:
    data = rel.read(spark, d, "events").select("event_id", F.col("props").alias("data"))
    return sinks.as_markdown(rel.exec_log(spark, d).join(data, "event_id"), "workflow_id")


@query("SELECT * FROM (SELECT workflow_id, agent_id AS source, lead(agent_id) OVER (PARTITION BY workflow_id ORDER BY pos) AS target, pos FROM exec_log) AS t WHERE target IS NOT NULL", rel.EXEC_LOG)
def network_links(spark: S, d: str) -> D:
    return sinks.network_links(rel.exec_log(spark, d), "workflow_id")


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, string_agg(role, '>' ORDER BY turn) AS flow, sum(length(text)) AS characters FROM conversations GROUP BY conv_id")
def session_summary(spark: S, d: str) -> D:
    g = rel.read(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("f"), F.sum(F.length("text")).alias("characters"))
    return g.select("conv_id", "turns", "roles", F.array_join(F.col("f.role"), ">").alias("flow"), "characters")


@query("SELECT qid, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '그리고|또한|, then | and then | and |,'), lambda x: trim(x)), lambda x: length(x) > 2), '|') AS parts FROM q_texts", rel.Q_TEXTS)
def split_query(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", F.array_join(tx.split_connectors(F.col("text")), "|").alias("parts"))


@query(r"SELECT qid, array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: length(w) > 1 AND lower(w) NOT IN ('the', 'and', 'of', 'is', 'to'))[1:5], ' ') AS words FROM q_texts", rel.Q_TEXTS)
def simple_keywords(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", F.array_join(tx.keywords(F.col("text"), ["the", "and", "of", "is", "to"]), " ").alias("words"))


@query("SELECT qid, md5(text) AS query_hash, 'query_' || substring(md5(text), 1, 12) AS cache_key FROM q_texts", rel.Q_TEXTS)
def query_hashes(spark: S, d: str) -> D:
    h = F.md5(F.col("text").cast("binary"))
    return rel.q_texts(spark, d).select("qid", h.alias("query_hash"), F.concat(F.lit("query_"), F.substring(h, 1, 12)).alias("cache_key"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE props END AS out FROM events")
def transform_by_type(spark: S, d: str) -> D:
    e, k = rel.read(spark, d, "events"), F.col("event_id") % 4
    src = F.when(k == 0, "json").when(k == 1, "html").when(k == 2, "html").otherwise("json")
    dst = F.when(k == 0, "query").when(k == 1, "text").when(k == 2, "query").otherwise("any")
    data = F.when(k == 0, F.to_json(F.struct(F.col("event_type").alias("question")))).when(k == 1, F.concat(F.lit("<b> "), "event_type", F.lit(" </b>"))).otherwise(F.col("props"))
    return e.select("event_id", js.transform_by_type(src, dst, data).alias("out"))


@query("SELECT workflow_id || '/' || event_id AS id, 'result' AS type, NULL AS dst FROM exec_log UNION ALL SELECT workflow_id, 'produces', workflow_id || '/' || event_id FROM exec_log UNION ALL SELECT 'agent:' || agent_id, 'executes', workflow_id || '/' || event_id FROM exec_log", rel.EXEC_LOG)
def ingest_results(spark: S, d: str) -> D:
    r = F.concat_ws("/", "workflow_id", "event_id")
    rows = F.array(F.struct(r.alias("id"), F.lit("result").alias("type"), F.lit(None).cast("string").alias("dst")), F.struct(F.col("workflow_id").alias("id"), F.lit("produces").alias("type"), r.alias("dst")), F.struct(F.concat(F.lit("agent:"), "agent_id").alias("id"), F.lit("executes").alias("type"), r.alias("dst")))
    return rel.exec_log(spark, d).select(F.explode(rows).alias("x")).select("x.*")


@query("SELECT user_id, event_id, n FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) AS t WHERE n <= 100")
def replay_buffer(spark: S, d: str) -> D:
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return rel.read(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).alias("n")).where("n <= 100")


@query("SELECT a.workflow_id, a.event_id AS started, min(b.pos) - a.pos AS steps_to_completion FROM exec_log a JOIN exec_log b ON a.workflow_id = b.workflow_id AND b.pos > a.pos AND b.agent_id = 'purchase' WHERE a.agent_id = 'click' GROUP BY a.workflow_id, a.event_id, a.pos", rel.EXEC_LOG)
def lifecycle(spark: S, d: str) -> D:
    w = Window.partitionBy("workflow_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.min(F.when(F.col("agent_id") == "purchase", F.col("pos"))).over(w)
    return rel.exec_log(spark, d).withColumn("done", nxt).where("agent_id = 'click' and done is not null").select("workflow_id", F.col("event_id").alias("started"), (F.col("done") - F.col("pos")).alias("steps_to_completion"))


@query("SELECT agent_id, count(*) AS calls, count(*) FILTER (WHERE NOT success AND prev_ok) AS first_failures, count(*) FILTER (WHERE success AND NOT coalesce(prev_ok, true)) AS recovered FROM (SELECT *, lag(success) OVER (PARTITION BY workflow_id ORDER BY pos) AS prev_ok FROM exec_log) AS t GROUP BY agent_id", rel.EXEC_LOG)
def retry_analysis(spark: S, d: str) -> D:
    w = Window.partitionBy("workflow_id").orderBy("pos")
    r = rel.exec_log(spark, d).withColumn("prev_ok", F.lag("success").over(w))
    return r.groupBy("agent_id").agg(F.count("*").alias("calls"), F.count_if(~F.col("success") & F.col("prev_ok")).alias("first_failures"), F.count_if(F.col("success") & ~F.coalesce("prev_ok", F.lit(True))).alias("recovered"))
