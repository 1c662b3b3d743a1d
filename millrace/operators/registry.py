"""Access to a registry of agents: lookups, capabilities, tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that tell a capability.
CAPABILITY_WORDS = {
    "visualization": ["visual", "chart", "graph", "plot", "diagram", "mermaid", "svg", "d3", "flowchart", "timeline", "mindmap", "시각화", "차트", "그래프", "플로우차트", "다이어그램"],
    "analysis": ["analy", "analyze", "report", "insight", "statistic", "분석", "통계", "리포트", "인사이트"],
    "calculation": ["calc", "compute", "math", "formula", "calculate", "계산", "수식", "수학", "연산"],
    "search": ["search", "find", "lookup", "query", "retrieve", "검색", "조회", "찾기", "탐색"],
    "generation": ["generate", "create", "build", "make", "produce", "생성", "제작", "만들기", "구축"],
}
#: Categories of capabilities by words, in order.
CAPABILITY_KINDS = [("search", ["검색", "search", "조회", "find"]), ("analysis", ["분석", "analysis", "analyze"]), ("calculation", ["계산", "calculate", "compute"]), ("visualization", ["시각화", "visual", "chart", "graph"]), ("generation", ["생성", "create", "generate"])]
#: Categories of tags, domains by words.
TAG_KINDS = [("domain", ["여행", "금융", "날씨", "travel", "finance", "weather"]), ("function", ["검색", "분석", "계산", "search", "analysis", "calculation"]), ("data_type", ["텍스트", "숫자", "이미지", "text", "number", "image"]), ("output_format", ["표", "차트", "플로우차트", "table", "chart", "flowchart"])]
DOMAIN_WORDS = [("travel", ["여행", "관광", "travel", "tour"]), ("finance", ["금융", "주식", "환율", "finance", "stock", "currency"]), ("weather", ["날씨", "기상", "weather", "climate"]), ("technology", ["기술", "IT", "tech", "AI"]), ("data", ["데이터", "정보", "data", "information"])]
#: Capabilities that a category of queries needs.
NEEDED = {"information_retrieval": ["search", "retrieve", "query"], "data_analysis": ["analyze", "calculate", "process"], "content_generation": ["generate", "create", "write"], "task_automation": ["automate", "execute", "schedule"], "conversation": ["chat", "discuss", "respond"], "compound_task": ["coordinate", "integrate", "manage"]}


def with_item(agents: DataFrame, column: str, wanted: str) -> DataFrame:
    """Agents with a capability or tag, whatever its case."""
    return agents.where(F.exists(column, lambda x: F.lower(x) == wanted.lower()))


def available(agents: DataFrame) -> DataFrame:
    return agents.where("is_available")


def lookup(agents: DataFrame, ids: DataFrame, strict: bool = False) -> DataFrame:
    """ids (agent_id) with the agent's priority and whether it exists; if strict, an unknown id is an error that names the known ones."""
    known = agents.select("agent_id", "priority", F.lit(True).alias("found"))
    out = ids.join(known, "agent_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
    if strict:
        names = agents.agg(F.array_join(F.array_sort(F.collect_list("agent_id")), ", ").alias("names"))
        missing = F.concat(F.lit("unknown agent "), "agent_id", F.lit("; known: "), "names")
        out = out.join(F.broadcast(names), F.lit(True)).withColumn("found", F.when(F.col("found"), True).otherwise(F.raise_error(missing).cast("boolean"))).drop("names")
    return out


def detects(agents: DataFrame, capability: str) -> DataFrame:
    """Agents whose capabilities, tags or id hold one of a capability's words; an unknown capability is its own word."""
    hay = F.lower(F.concat_ws("\n", "agent_id", F.array_join("capabilities", "\n"), F.array_join("tags", "\n")))
    return agents.where(reduce(lambda a, b: a | b, (hay.contains(w) for w in CAPABILITY_WORDS.get(capability, [capability])))).select("agent_id")


def kind_of_capability(name: Column) -> Column:
    out = F.lit("general")
    for kind, words in reversed(CAPABILITY_KINDS):
        out = F.when(F.lower(name).rlike("|".join(words)), kind).otherwise(out)
    return out


def kind_of_tag(tag: Column) -> Column:
    """The category of a tag, null for none."""
    return F.coalesce(*(F.when(tag.isin(*words), kind) for kind, words in TAG_KINDS))


def domains(text: Column) -> Column:
    """Domains whose words a text holds, else general. The text is lower-cased, the words are not."""
    found = F.array_compact(F.array(*(F.when(F.lower(text).rlike("|".join(words)), kind) for kind, words in DOMAIN_WORDS)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("general")))


def plain_tags(tags: Column) -> Column:
    """Tags trimmed, in lower case, each once, none empty, in order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(tags, lambda t: F.trim(F.lower(t))), lambda t: t != "")))


def needed(category: Column, verbs: Column, types: Column) -> Column:
    """The union of the capabilities that a query's category, its verbs and its subtasks' types ask for, in order."""
    table = F.create_map(*(x for k, v in NEEDED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    by = F.coalesce(F.element_at(table, category), F.array().cast("array<string>"))
    rest = F.filter(F.transform(F.concat(verbs, types), F.lower), lambda x: x != "")
    return F.array_sort(F.array_union(by, rest))


def search_graph(nodes: DataFrame, edges: DataFrame, word: str) -> DataFrame:
    """One list of the nodes whose id or name and of the edges whose predicate hold a word."""
    hit = lambda *c: reduce(lambda a, b: a | b, (F.contains(F.lower(x), F.lit(word.lower())) for x in c))
    found = nodes.where(hit("id", "label")).select(F.lit("concept").alias("kind"), "id", "label")
    return found.unionByName(edges.where(hit("predicate")).select(F.lit("relation").alias("kind"), F.col("src").alias("id"), F.concat_ws(" ", "predicate", "dst").alias("label")))


def same_steps(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """(plan_id, valid): whether the steps' ids and the nodes' ids (plan_id, id) are the same set."""
    s, n = steps.select("plan_id", "id").distinct(), nodes.select("plan_id", "id").distinct()
    odd = s.join(n, ["plan_id", "id"], "left_anti").unionByName(n.join(s, ["plan_id", "id"], "left_anti")).select("plan_id").distinct().withColumn("odd", F.lit(True))
    return s.select("plan_id").union(n.select("plan_id")).distinct().join(odd, "plan_id", "left").select("plan_id", F.col("odd").isNull().alias("valid"))
