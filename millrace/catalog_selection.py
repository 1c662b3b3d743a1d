"""Queries that choose agents; added to the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import D, S, query
from .operators import feedback as fb
from .operators import selection as sel
from .sources import relations as rel

#: What was asked for: target, reason, query.
TARGETS = [("Weather_Agent", None, None), ("visualization", None, None), ("tour_guide", None, None), ("fast_food", None, "x"), ("zzz", "통계 분석이 필요", None), ("zzz", None, "제주 어디"), ("zzz", None, None), ("", "여행", "여행"), ("currency-expert", None, None), ("st_ock", "food please", None), ("webs", None, None)]
_TARGETS = "targets(id, target, reason, query) AS (SELECT * FROM (VALUES " + ", ".join("(CAST(" + str(-1 - i) + " AS BIGINT), " + ", ".join("NULL" if x is None else f"'{x}'" for x in t) + ")" for i, t in enumerate(TARGETS)) + ") AS f UNION ALL SELECT qid, lower(regexp_extract(text, '[a-zA-Z]+', 0)), NULL, text FROM q_texts)"


def _table(name: str, step: int, table: dict[str, list[str]]) -> str:
    return f"{name}(step, word, i, name, j) AS (VALUES " + ", ".join(f"({step}, '{w}', {i}, '{n}', {j})" for i, (w, ns) in enumerate(table.items()) for j, n in enumerate(ns)) + ")"


_RULES = ", ".join((_table("r4", 4, sel.DOMAINS), _table("r5", 5, sel.REASONS), _table("r6", 6, sel.ASKED_FOR), _table("r7", 7, {n: [n] for n in sel.GENERAL})))
_PAIRS = (
    "pairs AS (SELECT t.id, a.seq, a.agent_id, lower(trim(t.target)) AS t, lower(coalesce(t.reason, '')) AS r, lower(coalesce(t.query, '')) AS q, lower(a.agent_id) AS a FROM targets t, agents a WHERE t.target <> ''), "
    "found AS (SELECT id, seq, agent_id, 1 AS step, 0 AS i, 0 AS j FROM pairs WHERE a = t UNION ALL SELECT id, seq, agent_id, 2, 0, 0 FROM pairs WHERE contains(a, t) OR contains(t, a) "
    "UNION ALL SELECT id, seq, agent_id, 3, 0, 0 FROM pairs WHERE len(list_filter(string_split(replace(replace(t, '_', ' '), '-', ' '), ' '), lambda w: length(w) > 2 AND contains(a, w))) > 0 "
    "UNION ALL SELECT id, seq, agent_id, 4, i, j FROM pairs JOIN r4 ON contains(t, word) AND (contains(a, name) OR contains(name, a)) "
    "UNION ALL SELECT id, seq, agent_id, 5, i, j FROM pairs JOIN r5 ON contains(r, word) AND contains(a, name) UNION ALL SELECT id, seq, agent_id, 6, i, j FROM pairs JOIN r6 ON contains(q, word) AND contains(a, name) "
    "UNION ALL SELECT id, seq, agent_id, 7, i, j FROM pairs JOIN r7 ON contains(a, name)), "
    "firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY step, i, j, seq) AS nth FROM found) AS f WHERE nth = 1)"
)


@query("SELECT t.id, t.target, f.agent_id, f.step FROM targets t LEFT JOIN firsts f ON t.id = f.id", rel.Q_TEXTS, rel.AGENTS_SQL, _TARGETS, _RULES, _PAIRS)
def replace_unknown_agents(spark: S, d: str) -> D:
    fixed = spark.createDataFrame([(-1 - i, *t) for i, t in enumerate(TARGETS)], "id long, target string, reason string, query string")
    asked = rel.q_texts(spark, d).select(F.col("qid").alias("id"), F.lower(F.regexp_extract("text", "[a-zA-Z]+", 0)).alias("target"), F.lit(None).cast("string").alias("reason"), F.col("text").alias("query"))
    return sel.replace_unknown(fixed.unionByName(asked), rel.agents(spark))


REQUIRED = ["data_analysis", "currency_conversion", "web_search"]
_TYPES = ["search", "analysis", "calc", "weather", "none"]


@query(
    "SELECT id, agent_id, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, seq) AS nth FROM (SELECT q.qid AS id, seq, agent_id, CASE WHEN contains(agent_id, type) THEN 3 ELSE 0 END + 2 * len(list_intersect(capabilities, " + str(REQUIRED) + ")) + len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: length(w) > 3 AND contains(agent_id || ' ' || lower(array_to_string(tags, ' ')), w))) AS score FROM (SELECT qid, text, (" + str(_TYPES) + ")[qid % 5 + 1] AS type FROM q_texts) AS q, registry) AS s WHERE score > 0) AS t WHERE nth = 1",
    rel.Q_TEXTS, rel.REGISTRY_SQL,
)
def best_agent_for_task(spark: S, d: str) -> D:
    kind = F.get(F.array(*map(F.lit, _TYPES)), (F.col("qid") % 5).cast("int"))
    return sel.best_for_task(rel.q_texts(spark, d).select(F.col("qid").alias("id"), kind.alias("type"), F.col("text").alias("description")), rel.registry(spark), REQUIRED)


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(q, '{w}')" for w in words) + ")"


_FALLBACK = "CASE agent_id " + " ".join(f"WHEN '{a}' THEN 10 * (" + " + ".join(f"contains(q, '{w}')::INT" for w in words) + ")" for a, words in sel.PATTERNS.items()) + " ELSE CASE WHEN contains(q, replace(agent_id, '_agent', '')) THEN 5 ELSE 0 END END"


@query(
    f"SELECT qid, agent_id, greatest(score, 0) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY greatest(score, 0) DESC, CASE WHEN score <= 0 AND contains(agent_id, 'calc') THEN 1 ELSE 0 END, seq) AS nth FROM (SELECT qid, seq, agent_id, {_FALLBACK} + CASE WHEN (contains(agent_id, 'chart') OR contains(agent_id, 'visual')) AND {_has(sel.DRAW)} THEN 15 ELSE 0 END + CASE WHEN (contains(agent_id, 'travel') OR contains(agent_id, 'plan')) AND {_has(sel.TRAVEL)} THEN 12 ELSE 0 END - CASE WHEN contains(agent_id, 'calc') AND NOT {_has(sel.COUNT)} AND {_has(sel.NO_COUNT)} THEN 10 ELSE 0 END AS score FROM (SELECT qid, lower(text) AS q FROM q_texts) AS t, agents) AS s) AS r WHERE nth = 1",
    rel.Q_TEXTS, rel.AGENTS_SQL,
)
def fallback_agents(spark: S, d: str) -> D:
    return sel.fallback_agent(rel.q_texts(spark, d), rel.agents(spark))


_ALIKE = "(length(k) >= 3 AND length(w) >= 3 AND abs(length(k) - length(w)) <= 1 AND (k[1:3] = w[1:3] OR right(k, 3) = right(w, 3)))"
_KEYWORDS = (
    r"toks AS (SELECT qid, lower(text) AS t, length(text) AS n, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS tokens FROM q_texts), "
    "keyed AS (SELECT qid, seq, agent_id, n, len(tags) AS total, CASE WHEN list_contains(tokens, k) THEN 2.0 WHEN contains(t, k) THEN 1.0 WHEN len(list_filter(tokens, lambda w: " + _ALIKE + ")) > 0 THEN 0.5 ELSE 0.0 END AS p FROM (SELECT *, lower(unnest(tags)) AS k FROM toks, agents) AS u), "
    "scores AS (SELECT qid, seq, agent_id, round(sum(p) / (any_value(total) * 2) + least(0.3, 0.1 * count(*) FILTER (WHERE p > 0)) + greatest(0.0, (50 - any_value(n)) / 100.0 * 0.2), 9) AS s FROM keyed GROUP BY 1, 2, 3 HAVING max(p) > 0), "
    "tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, seq) AS nth FROM scores) AS x WHERE nth = 1)"
)


@query("SELECT q.qid, agent_id, round(CASE WHEN s IS NULL THEN 0.0 ELSE least(0.9, 0.4 + 0.6 * s) END, 6) AS confidence FROM q_texts q LEFT JOIN tops ON q.qid = tops.qid", rel.Q_TEXTS, rel.AGENTS_SQL, _KEYWORDS)
def keyword_agents(spark: S, d: str) -> D:
    return sel.by_keywords(rel.q_texts(spark, d), rel.agents(spark))


@query("SELECT event_id AS step_id, CASE event_id % 4 WHEN 0 THEN 'weather_agent' WHEN 1 THEN 'calculator_agent' WHEN 2 THEN NULL ELSE 'internet_agent' END AS agent_id FROM events")
def installed_agents(spark: S, d: str) -> D:
    k = F.col("event_id") % 4
    agent = F.when(k == 0, F.concat(F.lit("weather_agent_"), F.md5(F.col("event_type").cast("binary")))).when(k == 1, "Calculate_Agent").when(k == 2, "nobody").otherwise("internet_agent")
    return sel.installed_for(rel.read(spark, d, "events").select(F.col("event_id").alias("step_id"), agent.alias("agent")), rel.agents(spark))


#: Queries to the graph: id, category, keywords, entities, concepts.
GRAPH_ASKED = [(1, "nation_1", ["_2"], ["p:1", "p:2", "p:3", "p:4", "p:5"], ["p:6", "p:7"]), (2, "nothing", ["nation_3"], ["p:10"], ["p:11", "p:12", "p:13", "p:10"]), (3, "none", [], [], [])]
_GRAPH_ASKED = "gasked(qid, category, keywords, entities, concepts) AS (VALUES " + ", ".join(f"({q}, '{c}', {k}::VARCHAR[], {e}::VARCHAR[], {n}::VARCHAR[])" for q, c, k, e, n in GRAPH_ASKED) + ")"


def graph_asked(spark: S) -> D:
    return spark.createDataFrame(GRAPH_ASKED, "qid int, category string, keywords array<string>, entities array<string>, concepts array<string>")


_DOMAINS = "doms AS (SELECT qid, 's:' || s_suppkey AS agent, n_name AS domain, 0.3 AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey, gasked WHERE contains(lower(n_name), category) OR len(list_filter(keywords, lambda k: contains(lower(n_name), k))) > 0)"
_OVERLAPS = "laps AS (SELECT qid, src AS agent, round(0.3 * count(DISTINCT dst) FILTER (WHERE list_contains(entities, dst)) + 0.1 * count(DISTINCT dst) FILTER (WHERE list_contains(concepts, dst)), 6) AS score FROM kg_edges, gasked WHERE list_contains(entities, dst) OR list_contains(concepts, dst) GROUP BY 1, 2)"


@query("SELECT qid, agent, domain, CAST(score AS DOUBLE) AS score FROM doms", _GRAPH_ASKED, _DOMAINS)
def agent_domains(spark: S, d: str) -> D:
    edges = rel.kg_edges(spark, d).where("predicate = 'has_supplier'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return sel.domain_matches(edges, rel.kg_nodes(spark, d).where("type = 'nation'"), graph_asked(spark))


@query("SELECT qid, agent, CAST(score AS DOUBLE) AS score FROM laps", rel.KG_EDGES, _GRAPH_ASKED, _OVERLAPS)
def neighbour_overlaps(spark: S, d: str) -> D:
    return sel.neighbour_overlap(rel.kg_edges(spark, d), graph_asked(spark))


@query(
    "SELECT qid, agent, graph_score, patterns, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY graph_score DESC, agent) AS rank FROM (SELECT qid, agent, CAST(round_even(sum(score), 3) AS DOUBLE) AS graph_score, sum(p) AS patterns FROM (SELECT qid, agent, CAST(score AS DOUBLE) AS score, 1 AS p FROM doms UNION ALL SELECT qid, agent, score, 0 FROM laps) AS u WHERE agent IN (SELECT 's:' || s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2) AS g WHERE graph_score > 0) AS r WHERE rank <= 3",
    rel.KG_EDGES, _GRAPH_ASKED, _DOMAINS, _OVERLAPS,
)
def graph_recommendation(spark: S, d: str) -> D:
    able = rel.read(spark, d, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s:"), "s_suppkey").alias("agent_id"))
    return sel.graph_recommendations(agent_domains(spark, d).select("qid", "agent", "score"), neighbour_overlaps(spark, d), able)


_NEED = "needed(id, agents) AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey % 2 = 0 THEN 'internet_agent' END, CASE WHEN o_orderkey % 3 = 0 THEN 'finance_agent' END, CASE WHEN o_orderkey % 5 < 2 THEN 'calculate_agent' END, CASE WHEN o_custkey % 2 = 0 THEN 'chart_agent' END, CASE WHEN o_custkey % 3 = 0 THEN 'unheard_agent' END], lambda x: x IS NOT NULL) FROM orders)"
_WAITS = "CASE a " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sel.WAITS.items() if v) + " ELSE CAST([] AS VARCHAR[]) END"


@query(f"SELECT id, array_to_string(list_filter(agents, lambda a: len({_WAITS}) = 0), ',') AS independent, len(list_filter(agents, lambda a: len(list_filter({_WAITS}, lambda b: list_contains(agents, b))) > 0)) AS sequential_depth, array_to_string(list_transform(list_filter(agents, lambda a: len(list_filter({_WAITS}, lambda b: list_contains(agents, b))) > 0), lambda a: a || '<' || array_to_string(list_filter({_WAITS}, lambda b: list_contains(agents, b)), '+')), ';') AS chains FROM needed", _NEED)
def parallel_potential(spark: S, d: str) -> D:
    o, k, c = rel.read(spark, d, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    agents = F.array_compact(F.array(F.when(k % 2 == 0, "internet_agent"), F.when(k % 3 == 0, "finance_agent"), F.when(k % 5 < 2, "calculate_agent"), F.when(c % 2 == 0, "chart_agent"), F.when(c % 3 == 0, "unheard_agent")))
    return sel.parallel_potential(o.select(k.alias("id"), agents.alias("agents")))


@query(
    "SELECT qid, agent_id, (" + " OR ".join(f"(kind = '{k}' AND type IN ({', '.join(map(repr, v))}))" for k, v in sel.SERVES.items()) + " OR contains(lower(text), kind) OR contains(agent_id, type)) AS fits FROM (SELECT qid, text, (['search', 'chart', 'math', 'find'])[qid % 4 + 1] AS type FROM q_texts) AS q, (SELECT agent_id, CASE WHEN contains(agent_id, 'search') OR contains(agent_id, 'internet') THEN 'search' WHEN contains(agent_id, 'analysis') THEN 'analysis' WHEN contains(agent_id, 'visual') THEN 'visualization' WHEN contains(agent_id, 'calc') THEN 'calculation' ELSE 'storage' END AS kind FROM agents) AS a",
    rel.Q_TEXTS, rel.AGENTS_SQL,
)
def agents_for_subtasks(spark: S, d: str) -> D:
    from .session import small

    a = F.col("agent_id")
    kind = F.when(a.contains("search") | a.contains("internet"), "search").when(a.contains("analysis"), "analysis").when(a.contains("visual"), "visualization").when(a.contains("calc"), "calculation").otherwise("storage")
    agents = rel.agents(spark).select("agent_id", kind.alias("kind"))
    tasks = rel.q_texts(spark, d).select("qid", "text", F.get(F.array(*map(F.lit, ["search", "chart", "math", "find"])), (F.col("qid") % 4).cast("int")).alias("type"))
    return tasks.join(small(agents), F.lit(True)).select("qid", "agent_id", sel.serves(F.col("kind"), a, F.col("type"), F.col("text")).alias("fits"))
