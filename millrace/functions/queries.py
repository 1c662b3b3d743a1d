"""Functions on users' queries: routing, entities, complexity, kinds of drawings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import any_of

#: Patterns of compound queries, and words by domain, two of which make a query compound.
COMPOUND = ["(하고|그리고|또|랑|이랑|과|와)", "(해주고|알려주고|보여주고).+(도|그리고|또)", r".+(도\s*)(해줘|알려줘|보여줘|해주세요)", r",\s*[\p{L}\p{N}_]+"]
DOMAINS = {"weather": ["날씨", "기온", "예보", "기상"], "currency": ["환율", "달러", "유로", "엔"], "stock": ["주가", "주식", "삼성전자", "코스피"], "search": ["검색", "찾아", "알아봐", "정보"], "schedule": ["일정", "스케줄", "약속", "캘린더"], "restaurant": ["맛집", "음식점", "레스토랑"]}
#: Words that ask for a drawing, and kinds of drawings by words, in order.
DRAWING = ["시각화", "차트", "그래프", "플로우차트", "순서도", "다이어그램", "visualization", "chart", "graph", "flowchart", "diagram", "mermaid"]
DRAWINGS = [("flowchart", ["플로우차트", "순서도", "과정", "단계", "절차", "flowchart", "process", "workflow"]), ("timeline", ["타임라인", "일정", "스케줄", "시간순", "timeline", "schedule"]), ("mindmap", ["마인드맵", "아이디어", "구조", "mindmap", "mind map", "idea"]), ("chart", ["차트", "그래프", "통계", "데이터", "chart", "graph", "data"])]
#: Entities, concepts and relations by words.
TIMES = ["오늘", "내일", "어제", "지금", "현재"]
CONCEPTS = {"날씨": "weather_domain", "환율": "finance_domain", "계산": "calculation_domain", "정보": "information_domain"}
ENTITY_PATTERNS = ["삼성전자|삼성|애플|구글|테슬라|마이크로소프트", "주가|환율|날씨|뉴스|가격|실적|매출", r"[0-9]+원|[0-9]+달러|[0-9]+%"]
#: Tiers of complexity by words, and strategies of optimisation by words.
TIERS = [(0.8, ["분석", "compare", "비교", "complex", "복잡", "detailed", "상세", "comprehensive"]), (0.6, ["explain", "설명", "describe", "묘사", "summarize", "요약", "calculate"]), (0.4, ["what", "무엇", "who", "누구", "when", "언제", "where", "어디"])]
AIMS = [("speed_first", ["빠르게", "즉시", "급하게", "신속"]), ("quality_first", ["정확하게", "자세히", "완벽하게", "정밀"]), ("resource_efficient", ["효율적", "절약", "최소"])]
#: Words that speak for an agent in a part of a query; extra points by a word in its id.
AGENT_WORDS = {"weather_agent": ["날씨", "기온", "온도"], "currency_exchange_agent": ["환율", "달러", "원"], "crawler_agent": ["주가", "주식", "삼성전자"], "internet_agent": ["검색", "정보", "알려줘"], "calendar_agent": ["일정", "스케줄", "약속", "캘린더", "추가", "등록", "알려줘"], "scheduler_agent": ["일정", "스케줄", "약속", "캘린더", "추가", "등록", "알려줘"], "schedule_agent": ["일정", "스케줄", "약속", "캘린더", "추가", "등록", "알려줘"]}
BONUS = [(["날씨"], ["weather"]), (["환율"], ["currency"]), (["주가", "주식", "삼성전자"], ["crawler"]), (["일정", "스케줄", "약속", "캘린더"], ["calendar", "scheduler", "schedule"])]
SEGMENT_WORDS = ["오늘", "정보", "알려줘", "확인", "검색", "날씨", "환율", "주가", "삼성전자", "달러", "원"]


def first_of(text: Column, table, other: Column) -> Column:
    """The key of the first row of (key, words) with a word in the text."""
    return reduce(lambda out, kv: F.when(any_of(text, kv[1]), kv[0]).otherwise(out), reversed(table), other)


def is_compound(text: Column) -> Column:
    hits = reduce(lambda a, b: a + b, (any_of(F.lower(text), words).cast("int") for words in DOMAINS.values()))
    return reduce(lambda a, b: a | b, (text.rlike(p) for p in COMPOUND)) | (hits >= 2)


def drawing(text: Column) -> Column:
    return first_of(F.lower(text), DRAWINGS, F.lit("generic"))


def wants_drawing(text: Column, n_results: Column, drawable: Column) -> Column:
    """A word for it, a result that can be drawn, or more than two results."""
    return any_of(F.lower(text), DRAWING) | drawable | (n_results > 2)


def entities(text: Column) -> Column:
    """Numbers and words of time, each once, in order."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda x: F.concat(F.lit("number_"), x))
    return F.array_sort(F.array_distinct(F.concat(numbers, F.array_compact(F.array(*(F.when(text.contains(w), f"time_{w}") for w in TIMES))))))


def concepts(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.contains(w), c) for w, c in CONCEPTS.items())))


def relations(text: Column) -> Column:
    return F.array_compact(F.array(F.when(text.contains("그리고") | text.contains(","), "sequential_execution"), F.when(text.contains("비교"), "comparison")))


def named_entities(text: Column) -> Column:
    """Names, domain words and amounts by pattern, each once, in order."""
    return F.array_sort(F.array_distinct(F.concat(*(F.regexp_extract_all(text, F.lit(f"({p})"), F.lit(1)) for p in ENTITY_PATTERNS))))


def default_complexity(text: Column) -> Column:
    """By tiers of words, a tenth more for long and less for short queries, from 0.1 to 0.9."""
    n = F.length(text)
    score = first_of(F.lower(text), TIERS, F.lit(0.5)) + F.when(n > 100, 0.1).when(n < 20, -0.1).otherwise(0.0)
    return F.greatest(F.lit(0.1), F.least(F.lit(0.9), score))


def aim(text: Column, n_steps: Column) -> Column:
    return first_of(F.lower(text), AIMS, F.when(n_steps <= 2, "speed_first").when(n_steps >= 5, "quality_first").otherwise("balanced"))


def aim_again(n_groups: Column, n_complex: Column, n_steps: Column) -> Column:
    """The aim once steps are grouped."""
    return F.when(n_groups >= 2, "speed_first").when(n_complex >= n_steps * 0.5, "quality_first").otherwise("balanced")


def segment_score(segment: Column, agent_id: Column) -> Column:
    """Twenty points for each word that speaks for the agent, 25 for each pair of words that meet."""
    own = reduce(lambda out, kv: F.when(agent_id == kv[0], reduce(lambda a, b: a + b, (F.when(segment.contains(w), 20).otherwise(0) for w in kv[1]))).otherwise(out), AGENT_WORDS.items(), F.lit(0))
    return reduce(lambda a, b: a + b, (F.when(any_of(segment, words) & any_of(agent_id, ids), 25).otherwise(0) for words, ids in BONUS), own)


def segment_words(segment: Column) -> Column:
    return F.array_compact(F.array(*(F.when(segment.contains(w), w) for w in SEGMENT_WORDS)))
