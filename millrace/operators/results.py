"""Typed results of agents: context, matching, aggregation of outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Words in an agent's id that tell the bucket of its results, in order.
BUCKETS = [("information", ["internet", "search", "web", "news"]), ("analysis", ["analysis", "analyze", "research"]), ("calculation", ["calculate", "math", "finance", "stock"]), ("visualization", ["chart", "graph", "visual", "plot"])]
#: Seconds by type of task; 3.0 for any other.
TASK_SECONDS = {"weather_inquiry": 3.0, "currency_inquiry": 2.0, "stock_inquiry": 3.0, "crypto_inquiry": 3.0, "financial_data": 4.0, "calculation": 1.0, "math_operation": 2.0, "search": 5.0, "visualization": 4.0, "analysis": 6.0, "translation": 3.0, "image_generation": 8.0, "image_editing": 6.0, "image_processing": 5.0, "audio_generation": 7.0, "audio_processing": 5.0, "voice_synthesis": 4.0, "file_management": 3.0, "document_processing": 4.0, "file_operation": 2.0, "memo_creation": 2.0, "data_storage": 2.0, "record_keeping": 3.0}
#: Points for the first of these words that an id holds.
VISUAL_NAMES = [("data_visualization", 10.0), ("chart", 8.0), ("graph", 8.0), ("visual", 7.0), ("plot", 6.0), ("diagram", 6.0), ("mermaid", 5.0)]


def bucket(agent_id):
    out = F.lit("general")
    for name, words in reversed(BUCKETS):
        out = F.when(F.lower(agent_id).rlike("|".join(words)), name).otherwise(out)
    return out


def task_seconds(kind):
    table = F.create_map(*(F.lit(x) for kv in TASK_SECONDS.items() for x in kv))
    return F.coalesce(F.element_at(table, kind), F.lit(3.0))


def visual_score(agent_id, tags):
    """Points for a name, two for each tag that speaks of charts; one if there are none."""
    name = F.lit(0.0)
    for word, points in reversed(VISUAL_NAMES):
        name = F.when(F.lower(agent_id).contains(word), points).otherwise(name)
    score = name + 2.0 * F.size(F.filter(tags, lambda t: F.lower(t).rlike("visual|chart|graph")))
    return F.when(score == 0, 1.0).otherwise(score)


def dependency_context(dag: DataFrame) -> DataFrame:
    """For each task its known dependencies with their times, in order of the table."""
    deps = dag.select("dag_id", "task_id", F.explode("depends_on").alias("dep"))
    known = dag.select("dag_id", F.col("task_id").alias("dep"), "seq", "est_time")
    g = deps.join(known, ["dag_id", "dep"]).groupBy("dag_id", "task_id").agg(F.array_sort(F.collect_list(F.struct("seq", "dep", "est_time"))).alias("d"))
    return g.select("dag_id", "task_id", F.array_join(F.transform("d", lambda x: F.concat_ws("=", x["dep"], F.format_number(x["est_time"], 1))), "; ").alias("context"))


def query_chains(dag: DataFrame) -> DataFrame:
    """Sources of each task's data, and whether a task needs context."""
    flows = dag.select("dag_id", "task_id", F.explode("depends_on").alias("source")).groupBy("dag_id", "task_id").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))
    return dag.select("dag_id", "task_id").join(flows, ["dag_id", "task_id"], "left").select("dag_id", "task_id", F.coalesce("sources", F.lit("")).alias("sources"), F.col("sources").isNotNull().alias("needs_context"))


def stage_output(log: DataFrame, width: int = 3) -> DataFrame:
    """A stage is `width` results in a row: one output alone, several as a list, successes only once any failed."""
    s = log.withColumn("stage", F.floor((F.col("pos") - 1) / width))
    g = s.groupBy("workflow_id", "stage").agg(F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("pos", "agent_id")))).alias("ok"), F.count("*").alias("n"), F.count_if("success").alias("n_ok"))
    return g.select("workflow_id", "stage", F.when(F.size("ok") == 0, F.lit(None)).otherwise(F.array_join(F.col("ok.agent_id"), "|")).alias("output"), (F.col("n") == F.col("n_ok")).alias("all_ok"))


def last_success(log: DataFrame, width: int = 3) -> DataFrame:
    """The last successful output that is not empty of each workflow's last stage, null if that stage has none."""
    stage = F.floor((F.col("pos") - 1) / width)
    s = log.select("workflow_id", "pos", stage.alias("stage"), F.when(F.col("success"), F.nullif("agent_id", F.lit(""))).alias("output"))
    per = s.groupBy("workflow_id", "stage").agg(F.max_by("output", F.when(F.col("output").isNotNull(), F.col("pos"))).alias("output"))
    return per.groupBy("workflow_id").agg(F.max_by("output", "stage").alias("output"))


def combined(log: DataFrame) -> DataFrame:
    """Nothing, a single output or the ordered list of the successful ones."""
    g = log.groupBy("workflow_id").agg(F.array_sort(F.collect_list(F.when(F.col("success"), F.struct("pos", "agent_id")))).alias("ok"))
    return g.select("workflow_id", F.size("ok").alias("items"), F.array_join(F.col("ok.agent_id"), ",").alias("output"))


def sequential_dependencies(log: DataFrame) -> DataFrame:
    """Each agent depends on the one before; of repeated agents the last dependency stays."""
    w = Window.partitionBy("workflow_id").orderBy("pos")
    d = log.withColumn("previous", F.lag("agent_id").over(w)).where("previous is not null")
    return d.groupBy("workflow_id", "agent_id").agg(F.max_by("previous", "pos").alias("depends_on"))


def best_agent(texts: DataFrame, agents: DataFrame) -> DataFrame:
    """For each text the agent with most tags in it; the agents' table is small and broadcast, first in order wins ties."""
    score = 20 * F.size(F.filter("tags", lambda t: F.contains("lower_text", F.lower(t))))
    scored = texts.select("qid", F.lower("text").alias("lower_text")).crossJoin(F.broadcast(agents.select("seq", "agent_id", "tags"))).select("qid", "seq", "agent_id", score.alias("score"))
    g = scored.where("score > 0").groupBy("qid").agg(F.max_by(F.struct("agent_id", "score"), F.struct("score", -F.col("seq"))).alias("b"))
    return g.select("qid", "b.agent_id", "b.score")


def stage_times(log: DataFrame) -> DataFrame:
    """Start, end and duration of each workflow in seconds."""
    g = log.groupBy("workflow_id").agg(F.min(F.unix_micros("created_at")).alias("a"), F.max(F.unix_micros("created_at")).alias("z"), F.avg("execution_time").alias("m"))
    return g.select("workflow_id", F.round((F.col("z") - F.col("a")) / 1e6, 3).alias("duration"), F.round("m", 6).alias("mean_step"))


def running_mean(log: DataFrame) -> DataFrame:
    w = Window.partitionBy("agent_id").orderBy("created_at", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return log.select("agent_id", "event_id", F.round(F.avg("execution_time").over(w) + 1e-9, 6).alias("mean"))  # off the ties of rounding


def tag_overlap(agents: DataFrame) -> DataFrame:
    """Pairs of agents that share tags, with shared over the larger number of tags."""
    a, b = agents.alias("a"), F.broadcast(agents.alias("b"))
    pairs = a.join(b, F.col("a.seq") < F.col("b.seq"))
    shared = F.size(F.array_intersect("a.tags", "b.tags"))
    return pairs.select(F.col("a.agent_id").alias("first"), F.col("b.agent_id").alias("second"), F.round(shared / F.greatest(F.size("a.tags"), F.size("b.tags")), 6).alias("overlap")).where("overlap > 0")
