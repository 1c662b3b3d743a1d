"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import json as js
from .functions import text as tx
from .operators import dag as dg
from .operators import feedback as fb
from .operators import graph as gr
from .operators import metrics as mt
from .operators import sequence as sq
from .plans import validate as pv
from .sources import relations as rel
from .streaming import events as ev

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name, with the SQL of the same result."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH RECURSIVE {', '.join(ctes)} " if ctes else "") + sql
        return f

    return add


S, D = SparkSession, DataFrame
DEGREE = "deg AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM kg_edges UNION ALL SELECT dst FROM kg_edges) AS u GROUP BY id)"
TODAY = f"DATE '{rel.AS_OF}'"
OK_RATE = "100.0 * count(*) FILTER (WHERE success) / count(*)"

# ---------------------------------------------------------------- graph


@query("SELECT id, degree FROM deg ORDER BY degree DESC, id LIMIT 25", rel.KG_EDGES, DEGREE)
def kg_degree_topk(spark: S, d: str) -> D:
    return gr.degree_topk(rel.kg_edges(spark, d), 25)


@query("SELECT type, count(*) AS n FROM kg_nodes GROUP BY type", rel.KG_NODES)
def kg_type_distribution(spark: S, d: str) -> D:
    return gr.type_distribution(rel.kg_nodes(spark, d))


@query("SELECT n AS n_nodes, e AS n_edges, m AS max_degree, 2.0 * e / n AS avg_degree, CAST(e AS DOUBLE) / (n * (n - 1)) AS density FROM (SELECT (SELECT count(*) FROM kg_nodes) AS n, (SELECT count(*) FROM kg_edges) AS e, (SELECT max(degree) FROM deg) AS m) AS t", rel.KG_NODES, rel.KG_EDGES, DEGREE)
def kg_density(spark: S, d: str) -> D:
    return gr.density(rel.kg_nodes(spark, d), rel.kg_edges(spark, d))


@query("SELECT DISTINCT start, id FROM (SELECT a.src AS start, a.dst AS id FROM kg_edges a WHERE a.src LIKE 'r:%' UNION SELECT a.src, b.dst FROM kg_edges a JOIN kg_edges b ON a.dst = b.src WHERE a.src LIKE 'r:%') AS t WHERE start <> id", rel.KG_EDGES)
def kg_two_hop(spark: S, d: str) -> D:
    return gr.within_two(rel.kg_edges(spark, d), rel.kg_nodes(spark, d).where("type = 'region'"))


@query("SELECT e.src, predicate, dst FROM kg_edges e WHERE src IN (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 60) AND dst IN (SELECT id FROM deg ORDER BY degree DESC, id LIMIT 60)", rel.KG_EDGES, DEGREE)
def kg_induced_subgraph(spark: S, d: str) -> D:
    return gr.induced_subgraph(rel.kg_edges(spark, d), 60)


@query("SELECT start, id AS goal, min(hops) AS hops FROM (SELECT 'r:0' AS start, 'r:0' AS id, 0 AS hops UNION ALL SELECT a.src, a.dst, 1 FROM kg_edges a WHERE a.src = 'r:0' UNION ALL SELECT a.src, b.dst, 2 FROM kg_edges a JOIN kg_edges b ON a.dst = b.src WHERE a.src = 'r:0' UNION ALL SELECT DISTINCT a.src, c.dst, 3 FROM kg_edges a JOIN kg_edges b ON a.dst = b.src JOIN kg_edges c ON b.dst = c.src WHERE a.src = 'r:0') AS t WHERE id LIKE 'p:%' GROUP BY start, id", rel.KG_EDGES)
def kg_shortest_path(spark: S, d: str) -> D:
    nodes = rel.kg_nodes(spark, d)
    return gr.shortest_paths(rel.kg_edges(spark, d), nodes.where("id = 'r:0'"), nodes.where("type = 'part'"))


@query()
def kg_components(spark: S, d: str) -> D:
    return gr.components(rel.kg_edges(spark, d), rel.kg_nodes(spark, d))


@query("SELECT DISTINCT id, 'auto_created' AS type FROM (SELECT src AS id FROM kg_edges UNION SELECT dst FROM kg_edges) AS u WHERE id NOT IN (SELECT id FROM kg_nodes WHERE type <> 'part')", rel.KG_NODES, rel.KG_EDGES)
def kg_missing_endpoints(spark: S, d: str) -> D:
    return gr.missing_endpoints(rel.kg_nodes(spark, d).where("type <> 'part'"), rel.kg_edges(spark, d))


@query("SELECT coalesce(n.id, c.id) AS id, coalesce(c.type, n.type) AS type, coalesce(c.label, n.label) AS label FROM kg_nodes n FULL JOIN (SELECT 's:' || s_suppkey AS id, CASE WHEN s_acctbal < 0 THEN 'debtor' END AS type, upper(s_name) AS label FROM supplier UNION ALL SELECT 'x:0', 'extra', 'new') AS c ON n.id = c.id", rel.KG_NODES)
def kg_upsert(spark: S, d: str) -> D:
    changes = rel.read(spark, d, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "debtor").alias("type"), F.upper("s_name").alias("label"))
    return gr.upsert(rel.kg_nodes(spark, d), changes.unionByName(spark.createDataFrame([("x:0", "extra", "new")], "id string, type string, label string")))


@query("SELECT predicate, weight, count(*) AS n FROM (SELECT p AS predicate, CASE p WHEN 'is_a' THEN 0.9 WHEN 'part_of' THEN 0.8 WHEN 'depends_on' THEN 0.7 ELSE 1.0 END AS weight FROM (SELECT CASE predicate WHEN 'has_nation' THEN 'part_of' WHEN 'supplies' THEN 'depends_on' ELSE predicate END AS p FROM kg_edges) AS a) AS b GROUP BY 1, 2", rel.KG_EDGES)
def kg_relation_weight(spark: S, d: str) -> D:
    p = F.when(F.col("predicate") == "has_nation", "part_of").when(F.col("predicate") == "supplies", "depends_on").otherwise(F.col("predicate"))
    e = rel.kg_edges(spark, d).select(p.alias("predicate"))
    return e.groupBy("predicate", gr.relation_weight(F.col("predicate")).alias("weight")).agg(F.count("*").alias("n"))


@query("SELECT id, type, label FROM kg_nodes WHERE contains(lower(id || ' ' || type || ' ' || label), 'asia') OR contains(lower(id || ' ' || type || ' ' || label), 'supplier#000000001')", rel.KG_NODES)
def kg_search(spark: S, d: str) -> D:
    return gr.search(rel.kg_nodes(spark, d), "asia Supplier#000000001")


@query("SELECT id, degree, least(10 + 3 * degree, 40) AS size FROM deg WHERE id LIKE 'n:%'", rel.KG_EDGES, DEGREE)
def kg_node_size(spark: S, d: str) -> D:
    return gr.degrees(rel.kg_edges(spark, d)).where("id like 'n:%'").withColumn("size", gr.node_size(F.col("degree")))


@query("SELECT src, dst, nth FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS nth FROM (SELECT DISTINCT src, dst FROM kg_edges) AS u) AS t WHERE nth <= 3", rel.KG_EDGES)
def kg_first_neighbours(spark: S, d: str) -> D:
    return gr.neighbours_ranked(rel.kg_edges(spark, d), 3)


# ---------------------------------------------------------------- metrics


@query(f"SELECT agent_id, count(*) AS executions, count(*) FILTER (WHERE success) AS successes, round(sum(execution_time), 4) AS total_time, round(avg(confidence), 6) AS mean_confidence, round({OK_RATE}, 4) AS success_rate FROM exec_log GROUP BY agent_id", rel.EXEC_LOG)
def agent_stats(spark: S, d: str) -> D:
    return mt.agent_stats(rel.exec_log(spark, d))


@query(f"SELECT agent_id, round({OK_RATE}, 4) AS success_rate, round(avg(execution_time), 6) AS avg_time FROM exec_log GROUP BY agent_id ORDER BY success_rate DESC, avg_time, agent_id LIMIT 10", rel.EXEC_LOG)
def top_agents(spark: S, d: str) -> D:
    return mt.top_agents(rel.exec_log(spark, d))


@query("SELECT coalesce(agent_id, 'all') AS agent_id, count(*) AS n, round(avg(execution_time), 6) AS mean, min(execution_time) AS least, max(execution_time) AS greatest, round(sum(execution_time), 4) AS total FROM exec_log GROUP BY ROLLUP (agent_id)", rel.EXEC_LOG)
def operation_stats(spark: S, d: str) -> D:
    return mt.operation_stats(rel.exec_log(spark, d))


@query(
    "SELECT n, ok, hits, round(a, 6) AS avg_time, round(s, 4) AS success_rate, round(h, 4) AS hit_rate, round(0.4 * s + 0.2 * h + 0.2 * greatest(0.0, 100 - 2 * a) + 0.2 * least(100.0, 200.0 * p / n), 1) AS efficiency, CASE WHEN s > 80 THEN 'healthy' WHEN s > 50 THEN 'warning' ELSE 'critical' END AS health "
    f"FROM (SELECT count(*) AS n, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE confidence >= 0.8) AS hits, avg(execution_time) AS a, {OK_RATE} AS s, 100.0 * count(*) FILTER (WHERE confidence >= 0.8) / count(*) AS h, count(*) FILTER (WHERE pos > 1) AS p FROM exec_log) AS t",
    rel.EXEC_LOG,
)
def system_rates(spark: S, d: str) -> D:
    return mt.system_rates(rel.exec_log(spark, d))


@query("SELECT agent_id, round(avg(execution_time), 6) AS recent_mean, max(event_id) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, event_id DESC) AS nth FROM exec_log) AS t WHERE nth <= 10 GROUP BY agent_id", rel.EXEC_LOG)
def recent_n_mean(spark: S, d: str) -> D:
    return mt.recent_mean(rel.exec_log(spark, d))


@query("SELECT *, failed = 0 OR ok > 0 AS success FROM (SELECT workflow_id, count(*) AS agents, count(*) FILTER (WHERE success) AS ok, count(*) FILTER (WHERE NOT success) AS failed, arg_max(agent_id, pos) AS final_output FROM exec_log GROUP BY workflow_id) AS t", rel.EXEC_LOG)
def workflow_totals(spark: S, d: str) -> D:
    return mt.workflow_totals(rel.exec_log(spark, d))


@query("SELECT *, CASE WHEN success_rate > 0.8 THEN 'high' WHEN success_rate > 0.5 THEN 'medium' ELSE 'low' END AS tier FROM (SELECT workflow_id, round(sum(execution_time), 4) AS total_time, round(avg(confidence), 6) AS mean_confidence, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate, count(*) AS n FROM exec_log GROUP BY workflow_id) AS t", rel.EXEC_LOG)
def workflow_performance(spark: S, d: str) -> D:
    return mt.workflow_performance(rel.exec_log(spark, d))


@query("SELECT workflow_id, count(*) AS agents, count(*) FILTER (WHERE success) AS ok, round(sum(execution_time), 4) AS total_time, round(coalesce(avg(confidence) FILTER (WHERE success), 0.0), 6) AS mean_confidence FROM exec_log GROUP BY workflow_id", rel.EXEC_LOG)
def integration_totals(spark: S, d: str) -> D:
    return mt.integration(rel.exec_log(spark, d))


@query("SELECT workflow_id, string_agg(agent_id, ',' ORDER BY pos) AS agents, count(DISTINCT agent_id) AS kinds, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS rate FROM exec_log GROUP BY workflow_id", rel.EXEC_LOG)
def knowledge_patterns(spark: S, d: str) -> D:
    return mt.pattern_rows(rel.exec_log(spark, d))


@query("SELECT strategy, count(*) AS workflows, sum(n) AS results FROM (SELECT count(*) AS n, CASE WHEN count(*) <= 1 THEN 'single' WHEN bool_or(NOT success) THEN 'sequential' WHEN count(*) <= 3 THEN 'parallel' ELSE 'hybrid' END AS strategy FROM exec_log GROUP BY workflow_id) AS t GROUP BY strategy", rel.EXEC_LOG)
def strategy_usage(spark: S, d: str) -> D:
    return mt.strategy_usage(rel.exec_log(spark, d))


@query("SELECT workflow_id, pos, round(100.0 * sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY workflow_id ORDER BY pos) / count(*) OVER (PARTITION BY workflow_id), 4) AS percent FROM exec_log", rel.EXEC_LOG)
def progress_percent(spark: S, d: str) -> D:
    return mt.progress(rel.exec_log(spark, d))


@query("SELECT workflow_id, round(s, 4) AS single, round(s * 1.1, 4) AS sequential, round(m, 4) AS parallel, round(s * 0.7, 4) AS hybrid FROM (SELECT workflow_id, sum(execution_time) AS s, max(execution_time) AS m FROM exec_log GROUP BY workflow_id) AS t", rel.EXEC_LOG)
def strategy_time(spark: S, d: str) -> D:
    return mt.strategy_time(rel.exec_log(spark, d))


# ---------------------------------------------------------------- feedback

_EMA = "(SELECT agent_id, {x} AS x, count(*) OVER (PARTITION BY agent_id) - row_number() OVER (PARTITION BY agent_id ORDER BY created_at, event_id) AS age, row_number() OVER (PARTITION BY agent_id ORDER BY created_at, event_id) AS nth FROM exec_log) AS t GROUP BY agent_id"
DECAY = f"CASE WHEN last_used IS NULL THEN 0.1 WHEN {TODAY} - last_used <= 0 THEN 1.0 WHEN {TODAY} - last_used >= 365 THEN 0.1 ELSE greatest(0.1, pow(0.5, ({TODAY} - last_used) / 30.0)) END"
SCORES = (
    "scores AS (SELECT *, round_even((CASE WHEN pattern = q_pattern THEN 1.0 ELSE 0.7 END + least(len(list_intersect(keywords, q_keywords)) * 0.2, 0.5) + least(len(list_intersect(entities, q_entities)) * 0.1, 0.3)) "
    f"* success_rate * {DECAY}, 3) AS final_score FROM asked JOIN mappings ON pattern = q_pattern OR category = q_category), "
    "top5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, selected_agent, category, pattern) AS rank FROM scores) AS s WHERE rank <= 5)"
)


@query("SELECT agent_id, round(sum(CASE WHEN nth = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, age) * x), 6) AS ema, count(*) AS n FROM " + _EMA.format(x="CASE WHEN success THEN 1.0 ELSE 0.0 END"), rel.EXEC_LOG)
def ema_success(spark: S, d: str) -> D:
    return fb.ema(rel.exec_log(spark, d), "agent_id", ["created_at", "event_id"], F.col("success"), 0.3)


@query("SELECT agent_id, round(sum(0.1 * pow(0.9, age) * x) + pow(0.9, count(*)) * 25.0, 6) AS ema, count(*) AS n FROM " + _EMA.format(x="execution_time"), rel.EXEC_LOG)
def strategy_ema(spark: S, d: str) -> D:
    return fb.ema(rel.exec_log(spark, d), "agent_id", ["created_at", "event_id"], F.col("execution_time"), 0.1, prior=25.0)


@query(f"SELECT selected_agent, pattern, round({DECAY}, 6) AS weight FROM mappings", rel.MAPPINGS)
def time_decay(spark: S, d: str) -> D:
    return rel.mappings(spark, d).select("selected_agent", "pattern", F.round(fb.time_decay(F.col("last_used"), F.lit(rel.AS_OF)), 6).alias("weight"))


def _scores(spark: S, d: str) -> D:
    return fb.pattern_scores(rel.asked(spark), rel.mappings(spark, d), F.lit(rel.AS_OF))


@query("SELECT qid, selected_agent, pattern, final_score FROM scores", rel.ASKED_SQL, rel.MAPPINGS, SCORES)
def pattern_score(spark: S, d: str) -> D:
    return _scores(spark, d).select("qid", "selected_agent", "pattern", "final_score")


@query("SELECT qid, rank, selected_agent, pattern, final_score FROM top5", rel.ASKED_SQL, rel.MAPPINGS, SCORES)
def past_patterns(spark: S, d: str) -> D:
    return fb.top_patterns(_scores(spark, d)).select("qid", "rank", "selected_agent", "pattern", "final_score")


@query("SELECT * FROM (SELECT qid, selected_agent, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, selected_agent) AS rank FROM (SELECT qid, selected_agent, round(sum(final_score), 3) AS score FROM top5 GROUP BY 1, 2) AS a WHERE score > 0) AS b WHERE rank <= 3", rel.ASKED_SQL, rel.MAPPINGS, SCORES)
def agent_recommendation(spark: S, d: str) -> D:
    return fb.recommend(_scores(spark, d))


@query("SELECT qid, round(least(1.0, coalesce(best, 0.0) * 0.3 + CASE WHEN n > 0 THEN 0.3 ELSE 0.0 END + CASE WHEN len(q_keywords) > 2 THEN 0.2 ELSE 0.0 END + CASE WHEN len(q_entities) > 0 THEN 0.2 ELSE 0.0 END), 6) AS confidence FROM asked LEFT JOIN (SELECT qid AS q, max(success_rate) AS best, count(*) FILTER (WHERE final_score > 0) AS n FROM top5 GROUP BY 1) AS t ON q = qid", rel.ASKED_SQL, rel.MAPPINGS, SCORES)
def selector_confidence(spark: S, d: str) -> D:
    best = fb.top_patterns(_scores(spark, d)).groupBy("qid").agg(F.max("success_rate").alias("best"), F.count_if(F.col("final_score") > 0).alias("n"))
    j = rel.asked(spark).join(best, "qid", "left")
    c = fb.confidence(F.col("best"), F.coalesce(F.col("n"), F.lit(0)) > 0, F.size("q_keywords") + 3, F.size("q_entities") > 0)
    return j.select("qid", F.round(c, 6).alias("confidence"))


# ---------------------------------------------------------------- sequence

_PAIRS = "SELECT a.workflow_id, a.pos AS pos_a, b.pos AS pos_b, round((a.confidence + b.confidence) / 2, 6) AS confidence, CASE WHEN b.nth - a.nth = 1 THEN 'sequential' ELSE 'parallel' END AS kind FROM ok a JOIN ok b ON a.workflow_id = b.workflow_id AND a.nth < b.nth"
_OK = "ok AS (SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY pos) AS nth FROM exec_log WHERE success)"


@query(_PAIRS, rel.EXEC_LOG, _OK)
def collaboration_pairs(spark: S, d: str) -> D:
    return sq.collaboration_pairs(rel.exec_log(spark, d))


@query(_PAIRS + " WHERE a.confidence >= 0.8 AND b.confidence >= 0.8", rel.EXEC_LOG, _OK)
def confident_pairs(spark: S, d: str) -> D:
    return sq.collaboration_pairs(rel.exec_log(spark, d), 0.8)


@query("SELECT * FROM (SELECT workflow_id, pos, agent_id, lead(agent_id) OVER (PARTITION BY workflow_id ORDER BY pos) AS next_agent FROM exec_log) AS t WHERE next_agent IS NOT NULL", rel.EXEC_LOG)
def precedes(spark: S, d: str) -> D:
    return sq.precedes(rel.exec_log(spark, d))


@query("SELECT workflow_id, event_id, round((epoch_us(created_at) - prev) / 1e6, 3) AS gap FROM (SELECT *, lag(epoch_us(created_at)) OVER (PARTITION BY workflow_id ORDER BY created_at, event_id) AS prev FROM exec_log) AS t WHERE prev IS NOT NULL", rel.EXEC_LOG)
def temporal_gap(spark: S, d: str) -> D:
    return sq.temporal_gap(rel.exec_log(spark, d))


@query("SELECT a.workflow_id, a.pos, coalesce(string_agg(b.agent_id, ',' ORDER BY b.pos), '') AS previous FROM exec_log a LEFT JOIN exec_log b ON a.workflow_id = b.workflow_id AND b.pos BETWEEN a.pos - 3 AND a.pos - 1 AND a.agent_id <> b.agent_id GROUP BY a.workflow_id, a.pos", rel.EXEC_LOG)
def previous_three(spark: S, d: str) -> D:
    return sq.previous_results(rel.exec_log(spark, d))


@query("SELECT workflow_id, pos, (pos - 1) // 3 AS chunk FROM exec_log", rel.EXEC_LOG)
def chunk_groups(spark: S, d: str) -> D:
    return sq.chunk_groups(rel.exec_log(spark, d))


@query("SELECT * FROM (SELECT agent_id, event_id, row_number() OVER (PARTITION BY agent_id ORDER BY created_at DESC, event_id DESC) AS nth FROM exec_log) AS t WHERE nth <= 200", rel.EXEC_LOG)
def bounded_history(spark: S, d: str) -> D:
    return sq.recent(rel.exec_log(spark, d), 200)


@query("SELECT workflow_id, run, min(agent_id) AS agent_id, count(*) AS n, max(execution_time) AS longest FROM (SELECT *, sum(new) OVER (PARTITION BY workflow_id ORDER BY pos) AS run FROM (SELECT *, CASE WHEN lag(agent_id) OVER (PARTITION BY workflow_id ORDER BY pos) = agent_id THEN 0 ELSE 1 END AS new FROM exec_log) AS a) AS b GROUP BY workflow_id, run", rel.EXEC_LOG)
def duplicate_steps(spark: S, d: str) -> D:
    return sq.duplicate_runs(rel.exec_log(spark, d))


@query(
    "SELECT plan_id, stage, string_agg(agents, ',' ORDER BY stage_id) AS agents, CASE WHEN count(*) > 1 THEN 'parallel' ELSE min(x) END AS execution_type FROM (SELECT *, sum(CASE WHEN free AND coalesce(prev, false) THEN 0 ELSE 1 END) OVER (PARTITION BY plan_id ORDER BY stage_id) AS stage FROM (SELECT *, lag(free) OVER (PARTITION BY plan_id ORDER BY stage_id) AS prev FROM "
    "(SELECT plan_id, stage_id, string_agg(agent_id, ',' ORDER BY pos) AS agents, count(*) = 1 AND sum(len(input_from)) = 0 AS free, min(execution_type) AS x FROM plan_tasks GROUP BY plan_id, stage_id) AS a) AS b) AS c GROUP BY plan_id, stage",
    rel.PLAN_TASKS_SQL,
)
def stage_merge(spark: S, d: str) -> D:
    return sq.stage_merge(rel.plan_tasks(spark))


@query("SELECT coalesce(a.id, b.id) AS id, coalesce(nullif(a.name, ''), b.name) AS name, CASE WHEN a.id IS NULL THEN 'second' WHEN b.id IS NULL THEN 'first' ELSE 'first+second' END AS sources FROM (SELECT c_nationkey AS id, CASE WHEN min(c_acctbal) < -900 THEN '' ELSE min(c_name) END AS name FROM customer WHERE c_nationkey < 18 GROUP BY 1) AS a FULL JOIN (SELECT s_nationkey AS id, min(s_name) AS name FROM supplier WHERE s_nationkey > 6 GROUP BY 1) AS b ON a.id = b.id")
def source_merge(spark: S, d: str) -> D:
    a = rel.read(spark, d, "customer").where("c_nationkey < 18").groupBy(F.col("c_nationkey").alias("id")).agg(F.when(F.min("c_acctbal") < -900, "").otherwise(F.min("c_name")).alias("name"))
    b = rel.read(spark, d, "supplier").where("s_nationkey > 6").groupBy(F.col("s_nationkey").alias("id")).agg(F.min("s_name").alias("name"))
    return sq.source_merge(a, b)


@query("SELECT * FROM (SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN md5(o.c) <> md5(n.c) THEN 'modified' END AS change FROM (SELECT p_partkey AS id, p_name AS c FROM part WHERE p_size < 30) AS o FULL JOIN (SELECT p_partkey AS id, CASE WHEN p_retailprice > 1500 THEN p_brand ELSE p_name END AS c FROM part WHERE p_size > 10) AS n ON o.id = n.id) AS t WHERE change IS NOT NULL")
def snapshot_diff(spark: S, d: str) -> D:
    part = rel.read(spark, d, "part")
    return sq.snapshot_diff(part.where("p_size < 30").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("content")), part.where("p_size > 10").select(F.col("p_partkey").alias("id"), F.when(F.col("p_retailprice") > 1500, F.col("p_brand")).otherwise(F.col("p_name")).alias("content")))


# ---------------------------------------------------------------- dependency graphs and plans

_DEPS = "deps AS (SELECT DISTINCT a.dag_id, a.task_id, a.dep FROM (SELECT dag_id, task_id, unnest(depends_on) AS dep FROM dag) AS a JOIN dag b ON a.dag_id = b.dag_id AND a.dep = b.task_id)"
_REACH = "reach AS (SELECT dag_id, task_id, dep FROM deps UNION SELECT r.dag_id, r.task_id, e.dep FROM reach r JOIN deps e ON r.dag_id = e.dag_id AND r.dep = e.task_id)"
_LEVELS = (
    "stuck AS (SELECT dag_id, task_id FROM reach WHERE task_id = dep UNION SELECT r.dag_id, r.task_id FROM reach r JOIN (SELECT dag_id, task_id FROM reach WHERE task_id = dep) AS c ON r.dag_id = c.dag_id AND r.dep = c.task_id), "
    "free AS (SELECT d.* FROM deps d LEFT JOIN stuck s ON d.dag_id = s.dag_id AND d.task_id = s.task_id WHERE s.dag_id IS NULL), "
    "walk AS (SELECT dag_id, task_id, 0 AS level FROM dag UNION SELECT e.dag_id, e.task_id, w.level + 1 FROM walk w JOIN free e ON w.dag_id = e.dag_id AND w.task_id = e.dep), "
    "sound AS (SELECT w.dag_id, w.task_id, max(level) AS level FROM walk w LEFT JOIN stuck s ON w.dag_id = s.dag_id AND w.task_id = s.task_id WHERE s.dag_id IS NULL GROUP BY 1, 2), "
    "lv AS (SELECT * FROM sound UNION ALL SELECT s.dag_id, s.task_id, coalesce(m.last, 0) FROM stuck s LEFT JOIN (SELECT dag_id, max(level) + 1 AS last FROM sound GROUP BY 1) AS m ON s.dag_id = m.dag_id)"
)


@query("SELECT dag_id, task_id, level FROM lv", rel.DAG_SQL, _DEPS, _REACH, _LEVELS)
def dag_levels(spark: S, d: str) -> D:
    return dg.levels(rel.dag(spark, d))


@query("SELECT dag_id, round(sum(s), 4) AS sequential, round(sum(m), 4) AS parallel FROM (SELECT dag.dag_id, level, max(est_time) AS m, sum(est_time) AS s FROM dag JOIN lv ON dag.dag_id = lv.dag_id AND dag.task_id = lv.task_id GROUP BY 1, 2) AS t GROUP BY dag_id", rel.DAG_SQL, _DEPS, _REACH, _LEVELS)
def dag_time_estimate(spark: S, d: str) -> D:
    return dg.time_estimate(rel.dag(spark, d))


@query("SELECT dag_id, task_id FROM reach WHERE task_id = dep", rel.DAG_SQL, _DEPS, _REACH)
def dag_cycles(spark: S, d: str) -> D:
    return dg.cycles(rel.dag(spark, d))


@query("SELECT e.dag_id, e.task_id, e.dep FROM deps e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.dag_id = e.dag_id AND r.task_id = e.dep AND r.dep = e.task_id AND e.task_id <= e.dep)", rel.DAG_SQL, _DEPS, _REACH)
def dag_without_cycles(spark: S, d: str) -> D:
    return dg.remove_back_edges(rel.dag(spark, d))


@query("SELECT * FROM deps e WHERE NOT EXISTS (SELECT 1 FROM deps x JOIN deps y ON x.dag_id = y.dag_id AND x.dep = y.task_id WHERE x.dag_id = e.dag_id AND x.task_id = e.task_id AND y.dep = e.dep)", rel.DAG_SQL, _DEPS)
def transitive_reduction(spark: S, d: str) -> D:
    return dg.transitive_reduction(rel.dag(spark, d))


@query("SELECT dag_id, array_to_string(list_sort(depends_on), ',') AS deps, string_agg(task_id, ',' ORDER BY task_id) AS tasks, count(*) AS n FROM dag GROUP BY 1, 2 HAVING count(*) > 1", rel.DAG_SQL)
def same_dependencies(spark: S, d: str) -> D:
    return dg.same_dependencies(rel.dag(spark, d))


@query("SELECT dag_id, task_id, dep, 'dangling' AS problem FROM a WHERE NOT EXISTS (SELECT 1 FROM dag b WHERE b.dag_id = a.dag_id AND b.task_id = a.dep) UNION ALL SELECT dag_id, task_id, dep, 'self' FROM a WHERE dep = task_id", rel.DAG_SQL, "a AS (SELECT dag_id, task_id, unnest(depends_on) AS dep FROM dag)")
def dependency_problems(spark: S, d: str) -> D:
    return dg.problems(rel.dag(spark, d))


_FITS = "(o.output_type = i.input_type OR o.output_type = 'any' OR i.input_type = 'any' OR (o.output_type, i.input_type) IN (" + ", ".join(f"('{a}', '{b}')" for a, b in pv.COMPATIBLE) + "))"
_REFS = "refs AS (SELECT plan_id, stage_id, agent_id, unnest(input_from) AS ref FROM plan_tasks)"
_BAD = "bad AS (SELECT * FROM (SELECT *, CASE WHEN NOT starts_with(ref, 'stage_') THEN 'format' WHEN contains(ref, '.') THEN 'output' WHEN CAST(replace(ref, 'stage_', '') AS INT) >= stage_id THEN 'future' END AS code FROM refs r WHERE ref <> 'final' AND NOT EXISTS (SELECT 1 FROM plan_tasks t WHERE t.plan_id = r.plan_id AND 'stage_' || t.stage_id || '.' || t.agent_id = r.ref)) AS x WHERE code IS NOT NULL)"
_SCHEMA = f"sch AS (SELECT r.plan_id, o.agent_id AS source, r.agent_id, o.output_type, i.input_type FROM (SELECT *, regexp_extract(ref, '^stage_[0-9]+[.](.*)$', 1) AS src FROM refs) AS r JOIN agents i ON i.agent_id = r.agent_id JOIN agents o ON o.agent_id = r.src WHERE NOT {_FITS})"


@query("SELECT plan_id, stage_id, agent_id FROM plan_tasks WHERE agent_id NOT IN (SELECT agent_id FROM agents)", rel.PLAN_TASKS_SQL, rel.AGENTS_SQL)
def unknown_agents(spark: S, d: str) -> D:
    return pv.unknown_agents(rel.plan_tasks(spark), rel.agents(spark))


@query("SELECT plan_id, stage_id, agent_id, ref, code FROM bad", rel.PLAN_TASKS_SQL, _REFS, _BAD)
def bad_references(spark: S, d: str) -> D:
    return pv.bad_references(rel.plan_tasks(spark))


@query("SELECT plan_id, source, agent_id, output_type, input_type FROM sch", rel.PLAN_TASKS_SQL, rel.AGENTS_SQL, _REFS, _SCHEMA)
def schema_compat(spark: S, d: str) -> D:
    return pv.schema_errors(rel.plan_tasks(spark), rel.agents(spark))


@query(
    "SELECT plan_id, code, count(*) AS n FROM (SELECT plan_id, 'unknown_agent' AS code FROM plan_tasks WHERE agent_id NOT IN (SELECT agent_id FROM agents) UNION ALL SELECT plan_id, 'reference_' || code FROM bad UNION ALL SELECT plan_id, 'schema' FROM sch "
    "UNION ALL SELECT t.plan_id, 'first_stage_input' FROM plan_tasks t WHERE stage_id = (SELECT min(stage_id) FROM plan_tasks u WHERE u.plan_id = t.plan_id) AND len(input_from) > 0 UNION ALL SELECT plan_id, 'warning_many_agents' FROM plan_tasks GROUP BY plan_id HAVING count(*) > 5 "
    "UNION ALL SELECT plan_id, 'warning_could_be_parallel' FROM plan_tasks t WHERE execution_type = 'sequential' GROUP BY plan_id, stage_id HAVING count(*) > 1 AND NOT bool_or(len(list_filter(input_from, lambda r: starts_with(r, 'stage_' || stage_id || '.'))) > 0)) AS x GROUP BY plan_id, code",
    rel.PLAN_TASKS_SQL, rel.AGENTS_SQL, _REFS, _BAD, _SCHEMA,
)
def plan_errors(spark: S, d: str) -> D:
    return pv.errors(rel.plan_tasks(spark), rel.agents(spark))


@query("SELECT plan_id, count(DISTINCT stage_id) AS stages, count(*) AS agents FROM plan_tasks GROUP BY plan_id", rel.PLAN_TASKS_SQL)
def plan_sizes(spark: S, d: str) -> D:
    return pv.sizes(rel.plan_tasks(spark))


# ---------------------------------------------------------------- registry


@query("SELECT agent_id, priority FROM agents WHERE len(list_filter(tags, lambda t: lower(t) = 'nand' OR lower(t) = 'weather')) > 0", rel.AGENTS_SQL)
def agents_by_tag(spark: S, d: str) -> D:
    return rel.agents(spark).where(F.exists("tags", lambda t: F.lower(t).isin("nand", "weather"))).select("agent_id", "priority")


@query("SELECT seq, agent_id, priority, row_number() OVER (ORDER BY priority DESC, seq) AS nth FROM agents", rel.AGENTS_SQL)
def agents_by_priority(spark: S, d: str) -> D:
    from pyspark.sql import Window

    return rel.agents(spark).select("seq", "agent_id", "priority", F.row_number().over(Window.orderBy(F.desc("priority"), "seq")).alias("nth"))


@query("SELECT o.agent_id AS source, i.agent_id AS target FROM agents o, agents i WHERE o.agent_id <> i.agent_id AND " + _FITS, rel.AGENTS_SQL)
def compatible_agents(spark: S, d: str) -> D:
    a = rel.agents(spark)
    o, i = a.select(F.col("agent_id").alias("source"), "output_type"), a.select(F.col("agent_id").alias("target"), "input_type")
    return o.join(F.broadcast(i), (F.col("source") != F.col("target")) & pv.compatible(F.col("output_type"), F.col("input_type"))).select("source", "target")


@query("SELECT agent_id, CASE " + " ".join(f"WHEN contains(agent_id, '{k}') THEN '{v}'" for k, v in tx.AGENT_TYPES) + " ELSE 'GENERAL' END AS kind FROM agents", rel.AGENTS_SQL)
def agent_types(spark: S, d: str) -> D:
    return rel.agents(spark).select("agent_id", tx.agent_type(F.col("agent_id")).alias("kind"))


# ---------------------------------------------------------------- text


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_to_text(spark: S, d: str) -> D:
    return rel.read(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


@query(r"SELECT qid, round(coalesce(list_sum(list_filter(list_transform(regexp_extract_all(text, '[0-9,]+\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)), 0), 4) AS total, len(list_filter(list_transform(regexp_extract_all(text, '[0-9,]+\.?[0-9]*'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x IS NOT NULL)) AS n FROM q_texts", rel.Q_TEXTS)
def extract_numbers(spark: S, d: str) -> D:
    n = tx.numbers(F.col("text"))
    return rel.q_texts(spark, d).select("qid", F.round(F.aggregate(n, F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size(n).alias("n"))


@query(r"SELECT qid, array_to_string(list_concat(regexp_extract_all(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}'), regexp_extract_all(text, '[0-9]{4}/[0-9]{2}/[0-9]{2}')), ' ') AS dates FROM q_texts", rel.Q_TEXTS)
def extract_dates(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", F.array_join(tx.dates(F.col("text")), " ").alias("dates"))


@query("SELECT qid, length(text) AS length, len(string_split(text, chr(10))) AS lines FROM q_texts", rel.Q_TEXTS)
def text_structured(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", F.length("text").alias("length"), F.size(F.split("text", "\n")).alias("lines"))


@query("SELECT qid, CASE WHEN len(regexp_extract_all(text, '[가-힣]')) > len(regexp_extract_all(text, '[a-zA-Z]')) THEN 'ko' ELSE 'en' END AS language FROM q_texts", rel.Q_TEXTS)
def language_detect(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", tx.language(F.col("text")).alias("language"))


def _any(words: list[str], t: str = "lower(text)") -> str:
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


@query("SELECT qid, CASE " + " ".join(f"WHEN {_any(w)} THEN '{c}'" for c, w in tx.CATEGORIES) + " ELSE 'general' END AS category, " + _any(tx.CREATE_AGENT) + " AS wants_agent, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(trim(text)) < 2 THEN 'too_short' ELSE 'ok' END AS precheck FROM q_texts", rel.Q_TEXTS)
def query_intent(spark: S, d: str) -> D:
    t = F.col("text")
    return rel.q_texts(spark, d).select("qid", tx.category(t).alias("category"), tx.wants_agent(t).alias("wants_agent"), tx.precheck(t).alias("precheck"))


_W = lambda words, w: f"CASE WHEN {_any(words)} THEN {w} ELSE 0.0 END"
_WORDS = f"({_W(['그리고', '또한', ',', '다음'], 0.2)} + {_W(tx.COMPARISON, 0.3)} + {_W(tx.ANALYSIS, 0.2)} + {_W(['계산', '산출', '구하'], 0.1)} + {_W(['차트', '그래프', '표', '그림'], 0.1)} + {_W(tx.TIME, 0.2)} + least(len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) / 50.0, 0.3))"


@query(f"SELECT qid, round(least(1.0, 0.5 + CASE WHEN length(text) > 200 THEN 0.2 WHEN length(text) > 100 THEN 0.1 ELSE 0.0 END + 0.2), 6) AS by_length, round(5.3 + {_W(tx.COMPARISON, 3.0)} + {_W(tx.ANALYSIS, 2.0)} + {_W(['그리고', '또한', ','], 2.0)} + {_W(tx.TIME, 3.0)} + {_W(['계산', '차트', '그래프', '표'], 2.0)}, 6) AS additive, round(least({_WORDS}, 1.0), 6) AS by_words FROM q_texts", rel.Q_TEXTS)
def complexity(spark: S, d: str) -> D:
    t = F.col("text")
    return rel.q_texts(spark, d).select("qid", F.round(tx.complexity_length(t, F.lit(2)), 6).alias("by_length"), F.round(tx.complexity_additive(t, F.lit(2), F.lit(2), F.lit(1)), 6).alias("additive"), F.round(F.least(tx.complexity_words(t), F.lit(1.0)), 6).alias("by_words"))


@query("SELECT qid, regexp_replace(id, '_[a-z0-9]{25,}$', '') AS agent FROM (SELECT qid, CASE WHEN qid % 2 = 0 THEN 'weather_agent_' || md5(text) ELSE 'memo_agent' END AS id FROM q_texts) AS t", rel.Q_TEXTS)
def normalize_agent_id(spark: S, d: str) -> D:
    a = F.when(F.col("qid") % 2 == 0, F.concat(F.lit("Weather_Agent_"), F.md5(F.col("text").cast("binary")))).otherwise("note_agent")
    return rel.q_texts(spark, d).select("qid", tx.normalise_agent_id(a).alias("agent"))


@query("SELECT o_orderkey, CASE WHEN d > 0 THEN d || 'd ' || h || 'h ' || m || 'm' WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS uptime FROM (SELECT o_orderkey, x // 86400 AS d, x % 86400 // 3600 AS h, x % 3600 // 60 AS m, x % 60 AS s FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS x FROM orders) AS a) AS b")
def uptime_text(spark: S, d: str) -> D:
    return rel.read(spark, d, "orders").select("o_orderkey", tx.uptime(F.floor("o_totalprice")).alias("uptime"))


@query("SELECT qid, CASE WHEN length(text) > 40 THEN 'q' || chr(10) || chr(10) || text[1:40] || '... (truncated)' ELSE 'q' || chr(10) || chr(10) || text END AS enriched FROM q_texts", rel.Q_TEXTS)
def enriched_query(spark: S, d: str) -> D:
    return rel.q_texts(spark, d).select("qid", tx.enrich(F.lit("q"), F.col("text"), 40).alias("enriched"))


# ---------------------------------------------------------------- JSON


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark: S, d: str) -> D:
    return rel.read(spark, d, "events").select("event_id", js.field(F.col("props"), "k", "bigint").alias("k"))


_CORE = [  # a result as JSON, with {t} for the event's type and {u} for its user, and what its core is
    ('{{"answer": "{t}", "text": "x"}}', "{t}"),
    ('{{"result": "", "text": "{t}"}}', ""),
    ('{{"result": {{"answer": ""}}, "text": "{t}"}}', "{t}"),
    ('{{"data": [{{"content": {{"answer": "{t}"}}}}]}}', "{t}"),
    ('{{"answer": {u}}}', "{u}"),
    ('{{"data": {{"data": {{"data": {{"data": {{"data": {{"answer": "{t}"}}}}}}}}}}}}', "{t}"),
    ('{{"data": {{"data": {{"data": {{"data": {{"data": {{"data": {{"answer": "{t}"}}}}}}}}}}}}, "text": "up"}}', '{{\n  "data": {{\n    "answer": "{t}"\n  }}\n}}'),
    ('{{"k": {u}}}', '{{\n  "k": {u}\n}}'),
    ("null", ""),
    ('"{t}"', "{t}"),
    ("no json {t}", "no json {t}"),
]


@query("SELECT event_id, CASE event_id % " + str(len(_CORE)) + " " + " ".join(f"WHEN {i} THEN " + "'" + want.replace("{{", "{").replace("}}", "}").replace("{t}", "' || event_type || '").replace("{u}", "' || user_id || '").replace("\n", "' || chr(10) || '") + "'" for i, (_, want) in enumerate(_CORE)) + " END AS core FROM events")
def core_result(spark: S, d: str) -> D:
    shapes = F.array(*(F.lit(j.replace("{{", "{").replace("}}", "}")) for j, _ in _CORE))
    shape = F.get(shapes, (F.col("event_id") % len(_CORE)).cast("int"))
    data = F.replace(F.replace(shape, F.lit("{t}"), F.col("event_type")), F.lit("{u}"), F.col("user_id").cast("string"))
    return rel.read(spark, d, "events").select("event_id", js.core_result(data).alias("core"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def tolerant_json(spark: S, d: str) -> D:
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n``` done"))
    return rel.read(spark, d, "events").select("event_id", js.field(js.clean_json(raw), "k", "bigint").alias("k"))


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'error' AND value >= 1")
def truthy_results(spark: S, d: str) -> D:
    e = rel.read(spark, d, "events").withColumn("data", F.when(F.col("value") < 1, F.lit("0")).otherwise(F.col("props")))
    return e.where((F.col("event_type") != "error") & js.truthy(F.col("data"))).select("event_id", "event_type")


@query("SELECT event_id, 'data: {\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def event_lines(spark: S, d: str) -> D:
    return rel.read(spark, d, "events").select("event_id", js.event_line(["event_id", "event_type"]).alias("line"))


# ---------------------------------------------------------------- streaming


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream_counts(spark: S, d: str) -> D:
    return ev.drain(ev.counts_by_type(ev.event_stream(spark, d)), "complete")


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: S, d: str) -> D:
    return ev.drain(ev.window_counts(ev.event_stream(spark, d)), "complete")


@query("SELECT event_type, round(sum(CASE WHEN nth = 1 THEN 1.0 ELSE 0.3 END * pow(0.7, age) * x), 6) AS ema, count(*) AS n FROM (SELECT event_type, CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END AS x, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS age, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS nth FROM events) AS t GROUP BY event_type")
def stream_ema(spark: S, d: str) -> D:
    return ev.drain(ev.ema_state(ev.event_stream(spark, d)), "update")


from . import catalog_matching, catalog_registry, catalog_results, catalog_selection, catalog_texts  # noqa: E402, F401
