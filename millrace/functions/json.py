"""Functions on heterogeneous results held as JSON text, through VARIANT."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that hold the core of a result, in order.
CORE_KEYS = ["answer", "result", "content", "data", "text"]


def field(json: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_parse_json(json), f"$.{key}", kind)


def core_result(json: Column) -> Column:
    """The core of a nested result: text itself, or the first of the core keys, followed down to five levels; a result or
    data key that leads to nothing gives way to the next key. What has none of the keys is given as indented JSON; text
    that is no JSON is its own core.

    An Arrow batch function: the search goes back up the tree, which no fixed expression does without growing by a
    factor of five a level.
    """
    import pandas as pd

    def core(texts):
        import json as j

        def search(v, depth=0):
            if depth > 5 or v is None:
                return ""
            if isinstance(v, str):
                return v
            if isinstance(v, list) and len(v) == 1:
                return search(v[0], depth + 1)
            if isinstance(v, dict):
                for key in CORE_KEYS:
                    if key not in v:
                        continue
                    if isinstance(v[key], str) and key != "data":
                        return v[key]
                    if key == "text":
                        continue
                    found = search(v[key], depth + 1)
                    if found or key in ("answer", "content"):
                        return found
            return j.dumps(v, ensure_ascii=False, indent=2) if isinstance(v, (dict, list)) else str(v)

        def read(text):
            try:
                return search(j.loads(text))
            except ValueError:
                return text

        return texts.map(read, na_action="ignore")

    core.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(core, "string")(json)


def clean_json(text: Column) -> Column:
    """The outermost braces of a model's answer without code fences and trailing commas."""
    inner = F.regexp_extract(F.regexp_replace(text, r"```(json)?", ""), r"(?s)(\{.*\})", 1)
    return F.regexp_replace(inner, r",\s*([}\]])", "$1")


def truthy(json: Column) -> Column:
    """Whether a value would count as true: null, empty text, list or object, zero and false do not."""
    return json.isNotNull() & ~json.isin("", "[]", "{}", "0", "false", "null", '""')


def transform_by_type(source: Column, target: Column, data: Column) -> Column:
    """Direct conversions between types; null where there is none."""
    from .text import html_to_text

    same = (source == target) | (source == "any") | (target == "any")
    query = F.coalesce(field(data, "query"), field(data, "question"), data)
    return F.when(same, data).when((source == "text") & (target == "structured_data"), F.to_json(F.struct(data.alias("text"), F.length(data).alias("length")))).when((source == "json") & (target == "query"), query).when((source == "html") & (target == "text"), html_to_text(data))


def event_line(columns: list[str]) -> Column:
    """A row as a server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(*columns)), F.lit("\n\n"))


#: Keys that tell the type of a result, in order.
TYPE_KEYS = [("visualization", ["chart", "graph", "plot", "visualization"]), ("calculation", ["calculation", "math", "number", "result"]), ("analysis", ["analysis", "insights", "conclusion"]), ("comparison", ["comparison", "vs", "versus", "diff"]), ("information", ["information", "data", "facts"])]


def result_type(json: Column) -> Column:
    """The type of a JSON object by its keys."""
    keys = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    out = F.lit("general")
    for name, words in reversed(TYPE_KEYS):
        out = F.when(F.arrays_overlap(keys, F.array(*map(F.lit, words))), name).otherwise(out)
    return out
