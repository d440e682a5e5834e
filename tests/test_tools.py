"""The ten tools over a small repository with a history, by JSON-RPC lines."""

import io
import json
import sqlite3
import subprocess

import pytest

from graphmill import tools
from graphmill.plans.workspace import Workspace
from graphmill.sources import readers
from tests.conftest import rows
from tests.test_workspace import FILES


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    folder = tmp_path_factory.mktemp("tools")
    git = lambda *a: subprocess.run(["git", "-C", str(folder), "-c", "user.name=A", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    for path, content in FILES.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(content)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "first")
    for path in ("tools/a.py", "tools/b.py"):
        (folder / path).write_text(FILES[path] + "\n# more\n")
    git("commit", "-qam", "second")
    for path in ("src/index.ts", "src/routes/users.ts"):
        (folder / path).write_text(FILES[path] + "\n// more\n")
        git("commit", "-qam", "another")
    (folder / "tools/b.py").write_text(FILES["tools/b.py"] + "\n# other\n")
    return str(folder)


def ask(spark, repo, name, log=None, **arguments):
    got = tools.call(spark, name, {"repo": repo, **arguments}, log)
    assert not got["isError"], got
    text = got["content"][0]["text"]
    return json.loads(text) if text.startswith("{") else text


def test_messages(spark):
    sent = [
        {"jsonrpc": "2.0", "id": 1, "method": "initialize", "params": {"protocolVersion": "2024-11-05"}},
        {"jsonrpc": "2.0", "method": "notifications/initialized"},
        {"jsonrpc": "2.0", "id": "x", "method": "tools/list"},
        {"jsonrpc": "2.0", "id": 3, "method": "nothing"},
        {"jsonrpc": "2.0", "id": 4, "method": "tools/call", "params": {"name": "nothing"}},
        {"jsonrpc": "2.0", "id": 5, "method": "ping"},
        [1],
    ]
    out = io.StringIO()
    tools.serve(spark, io.StringIO("\n".join([*map(json.dumps, sent), "{broken", ""])), out)
    got = [json.loads(line) for line in out.getvalue().splitlines()]
    assert [g["id"] for g in got] == [1, "x", 3, 4, 5, None, None]
    assert got[0]["result"]["protocolVersion"] == "2024-11-05"
    listed = {t["name"]: t["inputSchema"] for t in got[1]["result"]["tools"]}
    assert set(listed) == {"analyze", "layer-violations", "blast-radius", "dead-code", "coupling", "flows", "impact", "risk", "seams", "check"}
    assert listed["impact"]["required"] == ["repo", "symbol"]
    assert [g.get("error", {}).get("code") for g in got[2:]] == [-32601, -32602, None, -32600, -32700]


def test_refusals(spark, repo, tmp_path):
    for name, given in (
        ("flows", {}), ("flows", {"repo": str(tmp_path / "none")}), ("impact", {"repo": repo}), ("impact", {"repo": repo, "symbol": "nobody"}), ("analyze", {"repo": repo, "tier": 7}),
        ("analyze", {"repo": repo, "format": "pdf"}), ("dead-code", {"repo": repo, "top": 0}), ("dead-code", {"repo": repo, "top": "3"}), ("risk", {"repo": repo, "diff": str(tmp_path / "none")}),
    ):
        assert tools.call(spark, name, given)["isError"], (name, given)


def test_file_tools(spark, repo):
    assert {v["direction"] for v in ask(spark, repo, "layer-violations")["layerViolations"]} == {"skip-layer", "backward"}
    assert len(ask(spark, repo, "layer-violations", top=1)["layerViolations"]) == 1
    got = ask(spark, repo, "blast-radius", file="src/services/user.ts")
    assert got == {"directDependents": ["src/models/user.ts", "src/routes/users.ts"], "transitiveDependents": ["src/index.ts"]}
    assert ask(spark, repo, "blast-radius", file="none")["directDependents"] == []
    assert {f["entry"] for f in ask(spark, repo, "flows")["flows"]} >= {"src/index.ts"}
    assert isinstance(ask(spark, repo, "seams")["seams"], list)


def test_symbol_tools(spark, repo, tmp_path):
    log = str(tmp_path / "log")
    assert [d["name"] for d in ask(spark, repo, "dead-code", log)["deadCode"]] == ["unused"]
    assert ask(spark, repo, "dead-code", threshold=1, top=1)["deadCode"] in ([], ask(spark, repo, "dead-code")["deadCode"])
    assert [(c["node"], c["hop"]) for c in ask(spark, repo, "impact", log, symbol="inner")["callers"]] == [("tools/b.py:helper", 1), ("tools/a.py:run", 2)]
    kept = [json.loads(line) for line in open(log)]
    assert [(k["tool"], k["failed"], k["params"]) for k in kept] == [("dead-code", False, {}), ("impact", False, {"symbol": "inner"})]
    got = ask(spark, repo, "check", maxViolations=0)
    assert got["breaches"] == ["violations"] and not got["passed"]


def test_history_tools(spark, repo, tmp_path):
    pairs = ask(spark, repo, "coupling")["coupling"]
    assert [(p["file_a"], p["file_b"], p["support"]) for p in pairs] == [("tools/a.py", "tools/b.py", 2)]
    assert ask(spark, repo, "coupling", minSupport=3)["coupling"] == []
    diff = tmp_path / "d"
    diff.write_text("diff --git a/tools/b.py b/tools/b.py\n@@ -4 +4,2 @@\n")
    assert ask(spark, repo, "risk", diff=str(diff))["max_blast"] == 1.0
    assert ask(spark, repo, "risk")["score"] >= 0


def test_formats(spark, repo):
    got = ask(spark, repo, "analyze", tier=6)
    assert got["files"] == 7 and got["runtime_roots"][0] == "src/index.ts"
    ids = {f: [s["id"] for s in got[f]] for f in ("architecture", "risk", "confidence")}
    assert set(ids["architecture"]) == {"hot-files", "instability", "propagation-reach", "layer-violations", "circular-dependencies"}
    assert next(s["data"] for s in got["architecture"] if s["id"] == "circular-dependencies") == {"count": 1}
    assert ids["confidence"] == ["analysis-completeness"] and "temporal-hotspots" in ids["risk"]
    whole = ask(spark, repo, "analyze", format="json")
    assert len(whole["files"]) == 7 and len(whole["edges"]) == 6
    assert "completeness[1]" in ask(spark, repo, "analyze", format="toon")


def test_tiers_come_in_turn(spark, repo):
    published = list(Workspace.read(spark, repo).publish())
    assert [t for t, _ in published] == [0, 1, 2, 4, 6]
    names = [n for _, new in published for n in new]
    assert len(names) == len(set(names)) and {"language", "cycles", "dead_code", "entities"} <= set(names)


def test_sqlite_store(spark, tmp_path):
    path = str(tmp_path / "s.db")
    t = spark.createDataFrame([(1, "a", ["x"], None), (2, None, [], 0.5)], "id long, name string, tags array<string>, v double")
    readers.sink_sqlite({"t": t, "odd \"name": t.limit(0)}, path)
    readers.sink_sqlite({"t": t}, path)
    assert rows(readers.scan_sqlite(spark, path, "t", "id long, name string, v double")) == rows(t.drop("tags"))
    got = readers.scan_sqlite(spark, path, "t", "id long, tags string, later string").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, '["x"]', None), (2, "[]", None)]
    assert readers.scan_sqlite(spark, path, "none", "id long").count() == 0
    assert sqlite3.connect(path).execute("SELECT count(*) FROM t").fetchone() == (2,)
