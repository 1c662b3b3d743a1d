"""Choosing agents for texts and tasks: scores and cascades over a registry.

Registries are small tables; `small` checks that before one is broadcast beside the texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of, normalise_agent_id
from ..session import small

#: Words in an unknown agent's name, in order, and the agents that then serve, in order.
DOMAINS = {
    "travel": ["internet_agent", "llm_search_agent", "search_agent", "tour_agent"], "tour": ["internet_agent", "llm_search_agent", "search_agent", "travel_agent"], "trip": ["internet_agent", "llm_search_agent", "search_agent"],
    "food": ["restaurant_agent", "matzip_agent", "shopping_agent", "internet_agent", "llm_search_agent"], "restaurant": ["matzip_agent", "food_agent", "shopping_agent", "internet_agent", "llm_search_agent"], "matzip": ["restaurant_agent", "food_agent", "shopping_agent", "internet_agent"],
    "search": ["internet_agent", "llm_search_agent", "search_agent"], "info": ["internet_agent", "llm_search_agent", "search_agent"], "internet": ["llm_search_agent", "search_agent", "web_agent"], "web": ["internet_agent", "llm_search_agent", "search_agent"],
    "recommend": ["internet_agent", "llm_search_agent", "recommendation_agent"], "recommendation": ["internet_agent", "llm_search_agent", "recommend_agent"], "analysis": ["analysis_agent", "data_agent", "analytics_agent"], "data": ["analysis_agent", "data_analysis_agent", "analytics_agent"],
    "weather": ["weather_agent", "internet_agent", "llm_search_agent"], "shopping": ["shopping_agent", "matzip_agent", "internet_agent"], "stock": ["stock_agent", "finance_agent", "internet_agent"], "finance": ["stock_agent", "finance_agent", "analysis_agent"],
}
#: The same for words in the reason given for the choice, and in the query.
REASONS = {
    "여행": ["internet_agent", "llm_search_agent", "search_agent"], "관광": ["internet_agent", "llm_search_agent", "search_agent"], "맛집": ["restaurant_agent", "matzip_agent", "internet_agent", "llm_search_agent"], "음식": ["restaurant_agent", "matzip_agent", "internet_agent", "llm_search_agent"],
    "추천": ["internet_agent", "llm_search_agent"], "검색": ["internet_agent", "llm_search_agent", "search_agent"], "정보": ["internet_agent", "llm_search_agent", "search_agent"], "분석": ["analysis_agent", "data_agent"], "날씨": ["weather_agent", "internet_agent"], "주식": ["stock_agent", "finance_agent"], "쇼핑": ["shopping_agent"],
    "travel": ["internet_agent", "llm_search_agent"], "food": ["restaurant_agent", "matzip_agent", "internet_agent", "llm_search_agent"], "search": ["internet_agent", "llm_search_agent"], "recommend": ["internet_agent", "llm_search_agent"],
}
ASKED_FOR = {"여행": ["internet_agent", "llm_search_agent"], "제주": ["internet_agent", "llm_search_agent"], "관광": ["internet_agent", "llm_search_agent"], "맛집": ["restaurant_agent", "matzip_agent", "internet_agent", "llm_search_agent"], "추천": ["internet_agent", "llm_search_agent"], "어디": ["internet_agent", "llm_search_agent"], "뭐": ["internet_agent", "llm_search_agent"]}
GENERAL = ["internet_agent", "llm_search_agent", "search_agent", "general_agent"]
#: Words that speak for an agent when the chosen one fails; those that speak for drawing, travel and counting.
PATTERNS = {
    "chart_agent": ["플로우차트", "차트", "그래프", "표", "다이어그램", "flowchart", "chart", "graph", "diagram"], "travel_agent": ["여행", "일정", "계획", "travel", "trip", "schedule", "plan"], "weather_agent": ["날씨", "기상", "온도", "weather", "temperature"],
    "finance_agent": ["주식", "환율", "금융", "stock", "finance", "currency"], "calculator_agent": ["계산", "수식", "덧셈", "뺄셈", "calculate", "math", "compute"], "internet_agent": ["검색", "조회", "찾아", "search", "find", "lookup"], "analysis_agent": ["분석", "비교", "평가", "analysis", "analyze", "compare"],
}
DRAW, TRAVEL, COUNT, NO_COUNT = ["플로우차트", "차트", "시각화", "flowchart", "visual"], ["여행", "일정", "계획", "travel", "plan"], ["계산", "수식", "calculate", "math"], ["플로우차트", "여행", "일정", "flowchart", "travel"]
#: Types of subtasks that a type of agent serves.
SERVES = {"search": ["search", "retrieve", "find", "query"], "analysis": ["analyze", "process", "evaluate", "research"], "visualization": ["chart", "graph", "visualize", "plot"], "storage": ["save", "store", "memo", "record"], "calculation": ["calculate", "compute", "math"]}
#: Which agents an agent waits for.
WAITS = {"internet_agent": [], "finance_agent": [], "weather_agent": [], "calculate_agent": ["finance_agent", "internet_agent"], "chart_agent": ["internet_agent", "finance_agent", "calculate_agent"], "memo_agent": ["internet_agent", "analysis_agent", "chart_agent"], "analysis_agent": ["internet_agent"]}


def least(*ranks: Column) -> Column:
    return reduce(F.least, ranks) if len(ranks) > 1 else ranks[0]


def _by_table(table: dict[str, list[str]], step: int, text: Column, fits) -> Column:
    """step and the places of the first word in the text and of its first agent that fits, as one number; null for none."""
    return least(*(F.when(text.contains(word) & fits(name), step * 1_000_000 + i * 1000 + j) for i, (word, names) in enumerate(table.items()) for j, name in enumerate(names)))


def replace_unknown(targets: DataFrame, agents: DataFrame) -> DataFrame:
    """targets (id, target, reason, query) with the agent that serves and the step that found it: the same name, a name
    within the other, a word of more than two letters, then the tables of domains, reasons and query words, then a
    general agent. Null where nothing fits or no target is named."""
    t, a = F.lower(F.trim("target")), F.lower("agent_id")
    words = F.filter(F.split(F.translate(t, "_-", "  "), r"\s+"), lambda w: F.length(w) > 2)
    rank = F.coalesce(
        F.when(a == t, 1_000_000),
        F.when(a.contains(t) | t.contains(a), 2_000_000),
        F.when(F.exists(words, lambda w: F.contains(a, w)), 3_000_000),
        _by_table(DOMAINS, 4, t, lambda n: a.contains(n) | F.lit(n).contains(a)),
        _by_table(REASONS, 5, F.lower(F.coalesce("reason", F.lit(""))), a.contains),
        _by_table(ASKED_FOR, 6, F.lower(F.coalesce("query", F.lit(""))), a.contains),
        least(*(F.when(a.contains(n), 7_000_000 + i * 1000) for i, n in enumerate(GENERAL))),
    )
    named = targets.where("target <> ''")
    pairs = named.join(small(agents.select("seq", "agent_id")), F.lit(True)).select("id", "seq", "agent_id", rank.alias("rank")).where("rank is not null")
    best = pairs.groupBy("id").agg(F.min(F.struct("rank", "seq", "agent_id")).alias("b"))
    return targets.join(best, "id", "left").select("id", "target", F.col("b.agent_id").alias("agent_id"), F.floor(F.col("b.rank") / 1_000_000).alias("step"))


def best_for_task(tasks: DataFrame, agents: DataFrame, required: list[str]) -> DataFrame:
    """(id, agent_id, score): three points for the task's type in the agent's id, two for each required capability, one for
    each longer word of the description that its id or its tags hold; the first best agent, none without a point."""
    hay = F.concat_ws(" ", F.lower("agent_id"), F.lower(F.array_join("tags", " ")))
    words = F.filter(F.split(F.lower("description"), r"\s+"), lambda w: F.length(w) > 3)
    score = F.when(F.contains(F.lower("agent_id"), F.lower("type")), 3).otherwise(0) + 2 * F.size(F.array_intersect("capabilities", F.array(*map(F.lit, required)))) + F.size(F.filter(words, lambda w: F.contains(hay, w)))
    pairs = tasks.join(small(agents.select("seq", "agent_id", "tags", "capabilities")), F.lit(True)).select("id", "seq", "agent_id", score.alias("score")).where("score > 0")
    return pairs.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "seq", "agent_id")).alias("b")).select("id", "b.agent_id", (-F.col("b.s")).alias("score"))


def fallback_agent(texts: DataFrame, agents: DataFrame) -> DataFrame:
    """(qid, agent_id, score): the agent that the words of a text speak for; else the first that does not calculate."""
    q, a = F.lower("text"), F.col("agent_id")
    counted = lambda words: reduce(lambda x, y: x + y, (F.when(q.contains(w), 10).otherwise(0) for w in words))
    score = reduce(lambda c, kv: c.when(a == kv[0], counted(kv[1])), list(PATTERNS.items())[1:], F.when(a == "chart_agent", counted(PATTERNS["chart_agent"]))).otherwise(F.when(F.contains(q, F.replace(a, F.lit("_agent"), F.lit(""))), 5).otherwise(0))
    score = score + F.when((a.contains("chart") | a.contains("visual")) & any_of(q, DRAW), 15).otherwise(0) + F.when((a.contains("travel") | a.contains("plan")) & any_of(q, TRAVEL), 12).otherwise(0)
    score = score - F.when(a.contains("calc") & ~any_of(q, COUNT) & any_of(q, NO_COUNT), 10).otherwise(0)
    pairs = texts.join(small(agents.select("seq", "agent_id")), F.lit(True)).select("qid", "seq", "agent_id", score.alias("score"))
    rank = F.struct(F.when(F.col("score") > 0, -F.col("score")).otherwise(0).alias("s"), F.when((F.col("score") <= 0) & F.contains("agent_id", F.lit("calc")), 1).otherwise(0).alias("c"), "seq", "agent_id")
    return pairs.groupBy("qid").agg(F.min(rank).alias("b")).select("qid", "b.agent_id", (-F.col("b.s")).alias("score"))


def similar(a: Column, b: Column) -> Column:
    """Words of three letters or more, of nearly one length, that begin or end alike."""
    long = (F.length(a) >= 3) & (F.length(b) >= 3) & (F.abs(F.length(a) - F.length(b)) <= 1)
    return long & ((F.left(a, F.lit(3)) == F.left(b, F.lit(3))) | (F.right(a, F.lit(3)) == F.right(b, F.lit(3))))


def by_keywords(texts: DataFrame, agents: DataFrame) -> DataFrame:
    """(qid, agent_id, confidence): keywords as words count 2, as parts 1, as similar words a half; more and shorter is surer."""
    tokens = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))
    rows = texts.select("qid", F.lower("text").alias("t"), F.length("text").alias("n"), tokens.alias("tokens"))
    point = lambda k: F.when(F.array_contains("tokens", k), 2.0).when(F.contains("t", k), 1.0).when(F.exists("tokens", lambda w: similar(k, w)), 0.5).otherwise(0.0)
    points = F.transform("tags", lambda k: point(F.lower(k)))
    scored = rows.join(small(agents.select("seq", "agent_id", "tags")), F.lit(True)).select("qid", "seq", "agent_id", "n", points.alias("p"))
    hits = F.size(F.filter("p", lambda x: x > 0))
    score = F.aggregate("p", F.lit(0.0), lambda x, y: x + y) / (F.size("p") * 2) + F.least(F.lit(0.3), hits * 0.1) + F.greatest(F.lit(0.0), (50 - F.col("n")) / 100 * 0.2)
    best = scored.withColumn("hits", hits).where("hits > 0").groupBy("qid").agg(F.min(F.struct((-F.round(score, 9)).alias("s"), "seq", "agent_id")).alias("b"))
    out = texts.select("qid").join(best, "qid", "left")
    return out.select("qid", F.col("b.agent_id").alias("agent_id"), F.round(F.when(F.col("b.s").isNull(), 0.0).otherwise(F.least(F.lit(0.9), 0.4 - F.col("b.s") * 0.6)), 6).alias("confidence"))


def installed_for(steps: DataFrame, installed: DataFrame) -> DataFrame:
    """steps (step_id, agent) with the first installed agent of the same id, or of the same id once normalised."""
    s = steps.withColumn("name", normalise_agent_id(F.col("agent")))
    i = installed.select("seq", "agent_id").withColumn("name", normalise_agent_id(F.col("agent_id")))
    first = i.groupBy("name").agg(F.min_by("agent_id", "seq").alias("alike"))
    same = installed.groupBy(F.col("agent_id").alias("agent")).agg(F.first("agent_id").alias("same"))
    return s.join(same, "agent", "left").join(first, "name", "left").select("step_id", F.coalesce("same", "alike").alias("agent_id"))


def domain_matches(edges: DataFrame, domains: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, agent, domain, score): agents beside a domain whose name holds the query's category or one of its keywords."""
    near = edges.select(F.col("src").alias("agent"), "dst").join(domains.select(F.col("id").alias("dst"), "label"), "dst")
    hit = F.contains(F.lower("label"), F.col("category")) | F.exists("keywords", lambda k: F.contains(F.lower("label"), k))
    return near.join(small(asked), hit).select("qid", "agent", F.col("label").alias("domain"), F.lit(0.3).alias("score"))


def neighbour_overlap(edges: DataFrame, asked: DataFrame) -> DataFrame:
    """(qid, agent, score): 0.3 for each distinct neighbour among the query's entities, 0.1 for each among its concepts."""
    near = edges.select(F.col("src").alias("agent"), "dst").distinct()
    wanted = asked.select("qid", F.explode(F.concat(F.transform(F.array_distinct("entities"), lambda x: F.struct(x.alias("dst"), F.lit(0.3).alias("w"))), F.transform(F.array_distinct("concepts"), lambda x: F.struct(x.alias("dst"), F.lit(0.1).alias("w"))))).alias("x")).select("qid", "x.*")
    return near.join(wanted, "dst").groupBy("qid", "agent").agg(F.round(F.sum("w"), 6).alias("score"))


def graph_recommendations(patterns: DataFrame, overlaps: DataFrame, available: DataFrame, k: int = 3) -> DataFrame:
    """(qid, agent, graph_score, patterns, rank): the k available agents with the highest sum of (qid, agent, score) rows."""
    from pyspark.sql import Window

    both = patterns.withColumn("p", F.lit(1)).unionByName(overlaps.withColumn("p", F.lit(0))).join(available.select(F.col("agent_id").alias("agent")), "agent", "left_semi")
    g = both.groupBy("qid", "agent").agg(F.bround(F.sum("score"), 3).alias("graph_score"), F.sum("p").alias("patterns")).where("graph_score > 0")
    w = Window.partitionBy("qid").orderBy(F.desc("graph_score"), "agent")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parallel_potential(required: DataFrame) -> DataFrame:
    """required (id, agents): those that wait for nobody, how many wait for others that are required, and for whom."""
    waits = F.create_map(*(x for k, v in WAITS.items() for x in (F.lit(k), F.array(*map(F.lit, v)) if v else F.array().cast("array<string>"))))
    of = lambda a: F.coalesce(F.element_at(waits, a), F.array().cast("array<string>"))
    free = F.filter("agents", lambda a: F.size(of(a)) == 0)
    chains = F.filter(F.transform("agents", lambda a: F.struct(a.alias("agent"), F.array_intersect(of(a), F.col("agents")).alias("needs"))), lambda x: F.size(x["needs"]) > 0)
    return required.select("id", F.array_join(free, ",").alias("independent"), F.size(chains).alias("sequential_depth"), F.array_join(F.transform(chains, lambda x: F.concat(x["agent"], F.lit("<"), F.array_join(x["needs"], "+"))), ";").alias("chains"))


def serves(kind: Column, agent_id: Column, task_type: Column, description: Column) -> Column:
    """Whether an agent of a kind fits a subtask: by the table, by its kind in the description or the task's type in its id."""
    table = reduce(lambda a, b: a | b, ((kind == k) & task_type.isin(*v) for k, v in SERVES.items()))
    return table | F.contains(F.lower(description), kind) | F.contains(F.lower(agent_id), task_type)
