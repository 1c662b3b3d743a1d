"""Relations derived from the parquet tables, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AS_OF = datetime.date(1998, 8, 1)

#: Id, input type, output type, priority and tags of the built-in agents.
AGENTS = [
    ("internet_agent", "query", "text", 5, ["검색", "실시간", "인터넷", "데이터수집"]),
    ("weather_agent", "query", "json", 50, ["날씨", "기온", "온도", "미세먼지", "예보", "weather"]),
    ("analysis_agent", "structured_data", "json", 10, ["분석", "데이터", "통계", "구조화"]),
    ("data_visualization_agent", "json", "html", 15, ["시각화", "차트", "그래프", "SVG"]),
    ("llm_search_agent", "query", "text", 8, ["LLM", "질문답변", "설명", "요약"]),
    ("samsung_gateway_agent", "query", "json", 100, ["삼성", "반도체", "내부데이터", "Samsung", "NAND"]),
    ("shopping_agent", "query", "json", 7, ["쇼핑", "가격비교", "상품검색", "최저가"]),
    ("scheduler_agent", "query", "json", 50, ["일정", "스케줄", "캘린더", "약속", "schedule"]),
    ("calculator_agent", "query", "json", 40, ["계산", "수학", "단위변환", "환율", "calculator"]),
    ("code_generation_agent", "query", "text", 6, ["코드", "프로그래밍", "개발", "코딩"]),
    ("rag_search_agent", "query", "text", 9, ["RAG", "문서검색", "벡터검색", "문서"]),
    ("currency_exchange_agent", "query", "json", 45, ["환율", "통화", "달러", "엔화", "유로", "exchange", "currency", "USD", "EUR", "JPY"]),
]

#: Capabilities of the built-in agents.
CAPABILITIES = {
    "internet_agent": ["web_search", "real_time_data", "news_search", "price_lookup"],
    "weather_agent": ["weather_forecast", "current_weather", "temperature", "humidity", "air_quality", "weekly_forecast"],
    "analysis_agent": ["data_analysis", "number_extraction", "trend_analysis", "statistical_calculation", "data_structuring"],
    "data_visualization_agent": ["chart_generation", "graph_creation", "table_creation", "svg_generation", "data_visualization"],
    "llm_search_agent": ["question_answering", "explanation", "summarization", "concept_explanation", "comparison_analysis"],
    "samsung_gateway_agent": ["samsung_data_access", "semiconductor_analysis", "internal_data_query", "fab_data", "yield_analysis"],
    "shopping_agent": ["product_search", "price_comparison", "shopping_recommendation", "deal_finder"],
    "scheduler_agent": ["schedule_management", "calendar_access", "event_creation", "event_query", "reminder_setting"],
    "calculator_agent": ["math_calculation", "unit_conversion", "currency_conversion", "percentage_calculation"],
    "code_generation_agent": ["code_generation", "code_analysis", "bug_fixing", "code_explanation", "optimization", "algorithm_implementation"],
    "rag_search_agent": ["document_search", "vector_search", "context_retrieval", "document_qa"],
    "currency_exchange_agent": ["exchange_rate", "currency_conversion", "real_time_rate", "rate_history", "multi_currency"],
}

#: plan, stage, place in the stage, agent, input_from, stage's execution type
PLAN_TASKS = [
    ("ok", 1, 0, "internet_agent", [], "parallel"),
    ("ok", 1, 1, "weather_agent", [], "parallel"),
    ("ok", 2, 0, "analysis_agent", ["stage_1.internet_agent"], "sequential"),
    ("ok", 3, 0, "data_visualization_agent", ["stage_2"], "sequential"),
    ("singles", 1, 0, "internet_agent", [], "sequential"),
    ("singles", 2, 0, "weather_agent", [], "sequential"),
    ("singles", 3, 0, "calculator_agent", [], "sequential"),
    ("singles", 4, 0, "analysis_agent", ["stage_1.internet_agent"], "sequential"),
    ("singles", 5, 0, "rag_search_agent", [], "sequential"),
    ("unknown", 1, 0, "missing_agent", [], "sequential"),
    ("first_input", 1, 0, "analysis_agent", ["stage_1.internet_agent"], "sequential"),
    ("forward", 1, 0, "internet_agent", [], "sequential"),
    ("forward", 2, 0, "analysis_agent", ["stage_3"], "sequential"),
    ("forward", 3, 0, "shopping_agent", ["nowhere"], "sequential"),
    ("cycle", 1, 0, "internet_agent", ["stage_2.analysis_agent"], "sequential"),
    ("cycle", 2, 0, "analysis_agent", ["stage_1.internet_agent"], "sequential"),
    ("mismatch", 1, 0, "data_visualization_agent", [], "sequential"),
    ("mismatch", 2, 0, "analysis_agent", ["stage_1.data_visualization_agent"], "sequential"),
    ("busy", 1, 0, "internet_agent", [], "sequential"),
    ("busy", 1, 1, "weather_agent", [], "sequential"),
    ("busy", 1, 2, "shopping_agent", [], "sequential"),
    ("busy", 1, 3, "scheduler_agent", [], "sequential"),
    ("busy", 1, 4, "calculator_agent", [], "sequential"),
    ("busy", 1, 5, "rag_search_agent", [], "sequential"),
]

#: dag, task, depends_on, estimated seconds
DAG = [
    ("chain", "a", [], 10.0), ("chain", "b", ["a"], 20.0), ("chain", "c", ["b"], 5.0),
    ("reverse", "c", ["b"], 5.0), ("reverse", "b", ["a"], 20.0), ("reverse", "a", [], 10.0),
    ("diamond", "s", [], 1.0), ("diamond", "l", ["s"], 7.0), ("diamond", "r", ["s"], 3.0), ("diamond", "t", ["l", "r", "s"], 2.0),
    ("loop", "x", ["y"], 4.0), ("loop", "y", ["x"], 6.0), ("loop", "z", [], 1.0),
    ("dangling", "m", ["nobody"], 2.0), ("dangling", "n", ["m"], 2.0), ("dangling", "o", ["o"], 1.0),
]

#: Queries in two languages; those of the conversations follow.
TEXTS = [
    "서울 날씨 알려줘", "삼성전자 주가와 환율 비교 분석해줘", "build an agent for me", "Compare weather in Paris vs London, then chart it",
    "먼저 환율을 계산하고 다음 차트를 그려줘", "", "a", "create me an agent that books flights", "what is 1,234.5 plus 2024-01-15 and 2024/02/03?",
    "코드 버그 고쳐줘 그리고 쇼핑 가격 알려줘", "ㅋㅋ what ok", "ㅎㅎ été naïve", "주가 차트를 빠르게 보여줘", "여행 일정과 맛집을 추천해줘, 날씨도 알려줘", "12 + 30.5 계산해줘, 지금", "first search the web then create a flowchart of the process",
]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    """(id, type, label): regions, nations, customers, suppliers and parts."""
    kinds = (("region", "r", "r_regionkey", "r_name"), ("nation", "n", "n_nationkey", "n_name"), ("customer", "c", "c_custkey", "c_name"), ("supplier", "s", "s_suppkey", "s_name"), ("part", "p", "p_partkey", "p_name"))
    out = None
    for table, letter, key, name in kinds:
        rows = read(spark, d, table).select(F.concat(F.lit(letter + ":"), key).alias("id"), F.lit(table).alias("type"), F.col(name).alias("label"))
        out = rows if out is None else out.unionByName(rows)
    return out


KG_NODES = """kg_nodes AS (
    SELECT 'r:' || r_regionkey AS id, 'region' AS type, r_name AS label FROM region
    UNION ALL SELECT 'n:' || n_nationkey, 'nation', n_name FROM nation
    UNION ALL SELECT 'c:' || c_custkey, 'customer', c_name FROM customer
    UNION ALL SELECT 's:' || s_suppkey, 'supplier', s_name FROM supplier
    UNION ALL SELECT 'p:' || p_partkey, 'part', p_name FROM part)"""


def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, predicate, dst)."""
    edge = lambda df, a, ka, word, b, kb: df.select(F.concat(F.lit(a), ka).alias("src"), F.lit(word).alias("predicate"), F.concat(F.lit(b), kb).alias("dst"))
    return (
        edge(read(spark, d, "nation"), "r:", "n_regionkey", "has_nation", "n:", "n_nationkey")
        .unionByName(edge(read(spark, d, "customer"), "n:", "c_nationkey", "has_customer", "c:", "c_custkey"))
        .unionByName(edge(read(spark, d, "supplier"), "n:", "s_nationkey", "has_supplier", "s:", "s_suppkey"))
        .unionByName(edge(read(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct(), "s:", "l_suppkey", "supplies", "p:", "l_partkey"))
    )


KG_EDGES = """kg_edges AS (
    SELECT 'r:' || n_regionkey AS src, 'has_nation' AS predicate, 'n:' || n_nationkey AS dst FROM nation
    UNION ALL SELECT 'n:' || c_nationkey, 'has_customer', 'c:' || c_custkey FROM customer
    UNION ALL SELECT 'n:' || s_nationkey, 'has_supplier', 's:' || s_suppkey FROM supplier
    UNION ALL SELECT DISTINCT 's:' || l_suppkey, 'supplies', 'p:' || l_partkey FROM lineitem)"""


def exec_log(spark: SparkSession, d: str) -> DataFrame:
    """A workflow is a user's day; its results are numbered in order of time."""
    e = read(spark, d, "events").select(
        F.concat_ws("-", "user_id", F.date_format("ts", "yyyyMMdd")).alias("workflow_id"),
        "event_id",
        F.col("event_type").alias("agent_id"),
        (F.col("event_type") != "error").alias("success"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("confidence"),
        F.col("value").alias("execution_time"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )
    return e.withColumn("pos", F.row_number().over(Window.partitionBy("workflow_id").orderBy("created_at", "event_id")))


EXEC_LOG = """exec_log AS (
    SELECT *, row_number() OVER (PARTITION BY workflow_id ORDER BY created_at, event_id) AS pos FROM (
        SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS workflow_id, event_id, event_type AS agent_id, event_type <> 'error' AS success,
               CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 AS confidence, value AS execution_time, ts AS created_at
        FROM events) AS e)"""


def mappings(spark: SparkSession, d: str) -> DataFrame:
    """Learned rows: an order priority stands for an agent, a market segment for a category."""
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = o.groupBy(F.col("o_orderpriority").alias("selected_agent"), F.col("c_mktsegment").alias("category"), F.concat_ws("_", "c_mktsegment", F.floor(F.col("c_nationkey") / 5)).alias("pattern"))
    rows = g.agg(F.avg((F.col("o_orderstatus") == "F").cast("double")).alias("success_rate"), F.count("*").alias("usage_count"), F.max(F.col("o_orderdate").cast("date")).alias("last_used"))
    return rows.withColumns({"keywords": F.array(F.lower("category"), F.lower("selected_agent"), F.lower("pattern")), "entities": F.array(F.substring("selected_agent", 1, 1), F.lower("category"))})


MAPPINGS = """mappings AS (
    SELECT *, [lower(category), lower(selected_agent), lower(pattern)] AS keywords, [substring(selected_agent, 1, 1), lower(category)] AS entities FROM (
        SELECT o_orderpriority AS selected_agent, c_mktsegment AS category, c_mktsegment || '_' || CAST(floor(c_nationkey / 5.0) AS BIGINT) AS pattern,
               avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS success_rate, count(*) AS usage_count, max(CAST(o_orderdate AS DATE)) AS last_used
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) AS m)"""


def asked(spark: SparkSession) -> DataFrame:
    """Queries put to the recommender: id, category, pattern, keywords, entities."""
    return spark.createDataFrame(ASKED, "qid int, q_category string, q_pattern string, q_keywords array<string>, q_entities array<string>")


ASKED = [
    (1, "BUILDING", "BUILDING_2", ["building", "1-urgent"], ["1"]),
    (2, "MACHINERY", "MACHINERY_0", ["machinery"], ["machinery", "5"]),
    (3, "AUTOMOBILE", "none", ["3-medium"], []),
    (4, "nothing", "FURNITURE_4", ["furniture", "furniture_4", "2-high"], ["furniture", "2"]),
]
ASKED_SQL = "asked(qid, q_category, q_pattern, q_keywords, q_entities) AS (VALUES " + ", ".join(f"({q}, '{c}', '{p}', {k}::VARCHAR[], {e}::VARCHAR[])" for q, c, p, k, e in ASKED) + ")"


def agents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *a) for i, a in enumerate(AGENTS)], "seq int, agent_id string, input_type string, output_type string, priority int, tags array<string>")


AGENTS_SQL = "agents(seq, agent_id, input_type, output_type, priority, tags) AS (VALUES " + ", ".join(f"({i}, '{a}', '{x}', '{y}', {p}, {t})" for i, (a, x, y, p, t) in enumerate(AGENTS)) + ")"


def registry(spark: SparkSession) -> DataFrame:
    """The agents with their capabilities and whether they are available (the built-in ones all are, but for one here)."""
    rows = [(i, a[0], a[3], a[4], CAPABILITIES[a[0]], a[0] != "shopping_agent") for i, a in enumerate(AGENTS)]
    return spark.createDataFrame(rows, "seq int, agent_id string, priority int, tags array<string>, capabilities array<string>, is_available boolean")


REGISTRY_SQL = "registry(seq, agent_id, priority, tags, capabilities, is_available) AS (VALUES " + ", ".join(f"({i}, '{a[0]}', {a[3]}, {a[4]}, {CAPABILITIES[a[0]]}, {a[0] != 'shopping_agent'})" for i, a in enumerate(AGENTS)) + ")"


def plan_tasks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLAN_TASKS, "plan_id string, stage_id int, pos int, agent_id string, input_from array<string>, execution_type string")


PLAN_TASKS_SQL = "plan_tasks(plan_id, stage_id, pos, agent_id, input_from, execution_type) AS (VALUES " + ", ".join(f"('{p}', {s}, {k}, '{a}', {i}::VARCHAR[], '{x}')" for p, s, k, a, i, x in PLAN_TASKS) + ")"


def dag(spark: SparkSession, d: str) -> DataFrame:
    """Fixed graphs, then one for each user of the events: most events depend on the one before, some on the one before
    that, some on the next (cycles), on themselves or on nobody's."""
    fixed = spark.createDataFrame([(i, *r) for i, r in enumerate(DAG)], "seq long, dag_id string, task_id string, depends_on array<string>, est_time double")
    e = read(spark, d, "events").withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    i, pos = F.col("event_id"), F.col("pos")
    task = lambda n: F.concat(F.lit("t"), n.cast("string"))
    deps = F.array_compact(F.array(
        F.when((i % 3 != 0) & (pos > 1), task(pos - 1)), F.when((F.col("event_type") == "click") & (pos > 2), task(pos - 2)),
        F.when(i % 17 == 0, task(pos + 1)), F.when(i % 23 == 0, F.lit("nobody")), F.when(i % 41 == 0, task(pos)),
    ))
    return fixed.unionByName(e.select((100 + i).alias("seq"), F.concat(F.lit("u"), "user_id").alias("dag_id"), task(pos).alias("task_id"), deps.alias("depends_on"), (1.0 + i % 30).alias("est_time")))


DAG_SQL = (
    "dag(seq, dag_id, task_id, depends_on, est_time) AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{g}', '{t}', {x}::VARCHAR[], CAST({s} AS DOUBLE))" for i, (g, t, x, s) in enumerate(DAG)) + ") AS f "
    "UNION ALL SELECT 100 + event_id, 'u' || user_id, 't' || pos, list_filter([CASE WHEN event_id % 3 <> 0 AND pos > 1 THEN 't' || (pos - 1) END, CASE WHEN event_type = 'click' AND pos > 2 THEN 't' || (pos - 2) END, "
    "CASE WHEN event_id % 17 = 0 THEN 't' || (pos + 1) END, CASE WHEN event_id % 23 = 0 THEN 'nobody' END, CASE WHEN event_id % 41 = 0 THEN 't' || pos END], lambda x: x IS NOT NULL), 1.0 + event_id % 30 "
    "FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) AS e)"
)


def q_texts(spark: SparkSession, d: str) -> DataFrame:
    """(qid, text): fixed queries, then the users' turns."""
    fixed = spark.createDataFrame(list(enumerate(TEXTS)), "qid long, text string")
    turns = read(spark, d, "conversations").where("role = 'user'").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")
    return fixed.unionByName(turns)


Q_TEXTS = "q_texts(qid, text) AS (SELECT * FROM (VALUES " + ", ".join(f"(CAST({i} AS BIGINT), '{t}')" for i, t in enumerate(TEXTS)) + ") AS f(qid, text) UNION ALL SELECT 1000 + conv_id * 1000 + turn, text FROM conversations WHERE role = 'user')"
