"""Sources and sinks over files."""

import json

from millrace.sources import agents, sinks


def test_agent_files(spark, tmp_path):
    (tmp_path / "demo_agent.py").write_text('class DemoAgent(Base):\n    """Does demos."""\n    capabilities = ["a", \'b c\']\n    tags: ["x"]\n')
    (tmp_path / "plain_agent.py").write_text('description = "plain one"\n')
    for skipped in ("test_demo_agent.py", "_hidden_agent.py", "other.py"):
        (tmp_path / skipped).write_text("class XAgent:\n    pass\n")
    got = {r.agent_id: r for r in agents.scan_agent_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"demo_agent", "plain_agent"}
    assert got["demo_agent"].class_name == "DemoAgent" and got["demo_agent"].description == "Does demos."
    assert got["demo_agent"].capabilities == ["a", "b c"] and got["plain_agent"].description == "plain one"


def test_metadata_and_merge(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps({"demo": {"description": "from metadata", "tags": ["t"]}, "new_agent": {"version": "2", "capabilities": ["c"]}}))
    meta = agents.load_metadata(spark, str(path))
    assert {(r.agent_id, r.version) for r in meta.collect()} == {("demo_agent", "1.0.0"), ("new_agent", "2")}
    first = spark.createDataFrame([("demo_agent", "", [], ["own"])], "agent_id string, description string, capabilities array<string>, tags array<string>")
    got = {r.agent_id: r for r in agents.merge_agents(first, meta).collect()}
    assert got["demo_agent"].description == "from metadata" and got["demo_agent"].tags == ["own"]
    assert got["demo_agent"].sources == "files+metadata" and got["new_agent"].sources == "metadata"


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path / "s")
    sinks.save_snapshot(spark.range(3).toDF("id"), folder)
    sinks.save_snapshot(spark.range(5).toDF("id"), folder)
    assert sinks.load_snapshot(spark, folder).count() == 5
