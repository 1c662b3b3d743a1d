"""Scalar functions on text: extraction, language, intents, complexity. All are column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
CREATE_AGENT = ["에이전트 만들", "에이전트를 만들", "에이전트 생성", "에이전트를 생성", "에이전트 추가", "에이전트를 추가", "에이전트 만들어", "agent 만들", "build agent", "create agent", "make agent", "build an agent", "create an agent", "make an agent", "build me an agent", "create me an agent"]
CATEGORIES = [("finance", ["주가", "환율", "주식", "펀드", "투자"]), ("weather", ["날씨", "기온", "비", "눈"]), ("shopping", ["가격", "구매", "쇼핑", "상품"]), ("coding", ["코드", "프로그래밍", "개발", "버그"])]
COMPARISON, ANALYSIS, TIME = ["비교", "차이", "대비", "vs"], ["분석", "평가", "검토", "조사"], ["먼저", "다음", "그 후", "이후"]
AGENT_TYPES = [("weather", "WEATHER"), ("currency", "CURRENCY"), ("calculator", "CALCULATOR"), ("crawler", "CRAWLER"), ("internet", "INTERNET_SEARCH"), ("analysis", "ANALYSIS"), ("llm", "LLM_SEARCH"), ("search", "SEARCH"), ("math", "MATH"), ("fortune", "FORECASTING"), ("restaurant", "RESTAURANT_FINDER"), ("scheduler", "SCHEDULER"), ("game", "GAME"), ("shopping", "SHOPPING"), ("memo", "MEMO"), ("document", "DOCUMENT_PROCESSING")]
ALIASES = {"calculate_agent": "calculator_agent", "search_agent": "internet_agent", "web_agent": "internet_agent", "currency_agent": "finance_agent", "exchange_agent": "finance_agent", "visualization_agent": "chart_agent", "note_agent": "memo_agent", "analyze_agent": "analysis_agent"}


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def html_to_text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", ""), r"\s+", " "))


def numbers(text: Column) -> Column:
    """All numbers in a text; commas are dropped."""
    found = F.regexp_extract_all(text, F.lit(r"[0-9,]+\.?[0-9]*"), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def dates(text: Column) -> Column:
    """Dates by pattern, one pattern after another."""
    patterns = (r"[0-9]{4}-[0-9]{2}-[0-9]{2}", r"[0-9]{4}/[0-9]{2}/[0-9]{2}", r"[0-9]{4}년\s*[0-9]{1,2}월\s*[0-9]{1,2}일", r"[0-9]{1,2}월\s*[0-9]{1,2}일")
    return F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in patterns))


def language(text: Column) -> Column:
    return F.when(F.regexp_count(text, F.lit("[가-힣]")) > F.regexp_count(text, F.lit("[a-zA-Z]")), "ko").otherwise("en")


def category(text: Column) -> Column:
    t = F.lower(text)
    return reduce(lambda c, kv: c.when(any_of(t, kv[1]), kv[0]), CATEGORIES[1:], F.when(any_of(t, CATEGORIES[0][1]), CATEGORIES[0][0])).otherwise("general")


def precheck(text: Column) -> Column:
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(n == 0, "empty").when(n < 2, "too_short").otherwise("ok")


def wants_agent(text: Column) -> Column:
    return any_of(F.lower(text), CREATE_AGENT)


def complexity_length(text: Column, n_agents: Column) -> Column:
    """From a base of one half, by length and number of agents, 1 at most."""
    n = F.length(text)
    return F.least(F.lit(1.0), F.lit(0.5) + F.when(n > 200, 0.2).when(n > 100, 0.1).otherwise(0.0) + F.least(n_agents * 0.1, F.lit(0.3)))


def complexity_additive(text: Column, n_agents: Column, n_concepts: Column, n_entities: Column) -> Column:
    t = F.lower(text)
    flag = lambda words, w: F.when(any_of(t, words), w).otherwise(0.0)
    return n_agents * 2.0 + n_concepts * 0.5 + n_entities * 0.3 + flag(COMPARISON, 3.0) + flag(ANALYSIS, 2.0) + flag(["그리고", "또한", ","], 2.0) + flag(TIME, 3.0) + flag(["계산", "차트", "그래프", "표"], 2.0)


def complexity_words(text: Column) -> Column:
    t = F.lower(text)
    flag = lambda words, w: F.when(any_of(t, words), w).otherwise(0.0)
    words = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != ""))
    return flag(["그리고", "또한", ",", "다음"], 0.2) + flag(COMPARISON, 0.3) + flag(ANALYSIS, 0.2) + flag(["계산", "산출", "구하"], 0.1) + flag(["차트", "그래프", "표", "그림"], 0.1) + flag(TIME, 0.2) + F.least(words / 50.0, F.lit(0.3))


def strategy(text: Column, n_agents: Column) -> Column:
    t = F.lower(text)
    score, timed, many = complexity_words(text), any_of(t, TIME), any_of(t, ["그리고", "또한", ",", "다음"])
    return F.when((score <= 0.3) | (n_agents == 1), "single_agent").when(timed, "sequential").when(many, "parallel").when(score >= 0.7, "hybrid").otherwise("sequential")


def agent_type(agent_id: Column) -> Column:
    a = F.lower(agent_id)
    first, *rest = AGENT_TYPES
    return reduce(lambda c, kv: c.when(a.contains(kv[0]), kv[1]), rest, F.when(a.contains(first[0]), first[1])).otherwise("GENERAL")


def normalise_agent_id(agent_id: Column) -> Column:
    """Lower case, without a hash suffix of 25 or more letters and digits, aliases resolved."""
    plain = F.regexp_replace(F.lower(agent_id), r"_(?=[^_]*[0-9])[a-z0-9]{25,}$", "")
    alias = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(F.element_at(alias, plain), plain)


def keywords(text: Column, stop: list[str], n: int = 5) -> Column:
    return F.slice(F.filter(F.split(F.trim(text), r"\s+"), lambda w: (F.length(w) > 1) & ~F.lower(w).isin(*stop)), 1, n)


def split_connectors(text: Column) -> Column:
    """Parts of a compound query."""
    return F.filter(F.transform(F.split(text, r"그리고|또한|, then | and then | and |,"), lambda x: F.trim(x)), lambda x: F.length(x) > 2)


def enrich(query: Column, output: Column, most: int = 2000) -> Column:
    """A sub-query with the previous output, cut beyond `most` characters."""
    return F.concat(query, F.lit("\n\n"), F.when(F.length(output) > most, F.concat(F.left(output, F.lit(most)), F.lit("... (truncated)"))).otherwise(output))


def uptime(seconds: Column) -> Column:
    """Seconds as d h m s, leading zeros of units left out."""
    s = seconds.cast("long")
    d, h, m, r = F.floor(s / 86400), F.floor(s % 86400 / 3600), F.floor(s % 3600 / 60), s % 60
    return F.when(d > 0, F.format_string("%dd %dh %dm", d, h, m)).when(h > 0, F.format_string("%dh %dm %ds", h, m, r)).when(m > 0, F.format_string("%dm %ds", m, r)).otherwise(F.format_string("%ds", r))


def language_share(text: Column) -> Column:
    """Korean if at least three tenths of all letters are Hangul syllables or compatibility letters; no letters count as English."""
    ko, letters = F.regexp_count(text, F.lit("[가-힣ㄱ-ㆎ]")), F.regexp_count(text, F.lit(r"\p{L}"))
    return F.when(F.coalesce(F.try_divide(ko.cast("double"), letters), F.lit(0.0)) >= 0.3, "ko").otherwise("en")


def task_strategy(n_tasks: Column, has_dependencies: Column) -> Column:
    """Single, sequential, parallel or hybrid by the number of tasks and their dependencies."""
    return F.when(n_tasks <= 1, "single").when(has_dependencies, "sequential").when(n_tasks <= 3, "parallel").otherwise("hybrid")
