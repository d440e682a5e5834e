"""A small application through the workspace and the commands."""

import json

import pytest

from graphmill import cli
from graphmill.plans.workspace import Workspace

FILES = {
    "package.json": '{"main": "src/index.ts", "dependencies": {"express": "^4"}}',
    "src/index.ts": "import { users } from './routes/users'\nimport express from 'express'\n",
    "src/routes/users.ts": "import { find } from '../services/user'\nimport { User } from '../models/user'\n",
    "src/services/user.ts": "import { User } from '../models/user'\nexport function find() {\n}\nfunction unused() {\n}\n",
    "src/models/user.ts": "import x from '../services/user'\nexport class User {\n}\n",
    "tools/a.py": "from tools.b import helper\n\ndef run():\n    helper()\n",
    "tools/b.py": "def helper():\n    inner()\n\ndef inner():\n    pass\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    folder = tmp_path_factory.mktemp("app")
    for path, content in FILES.items():
        (folder / path).parent.mkdir(parents=True, exist_ok=True)
        (folder / path).write_text(content)
    return str(folder)


@pytest.fixture(scope="module")
def workspace(spark, root):
    return Workspace.read(spark, root)


def test_graph_and_layers(workspace):
    assert {(r.s, r.t) for r in workspace.edges.collect()} == {
        ("src/index.ts", "src/routes/users.ts"), ("src/routes/users.ts", "src/services/user.ts"), ("src/routes/users.ts", "src/models/user.ts"),
        ("src/services/user.ts", "src/models/user.ts"), ("src/models/user.ts", "src/services/user.ts"), ("tools/a.py", "tools/b.py"),
    }
    assert {(r.s, r.t, r.direction) for r in workspace.violations.collect()} == {
        ("src/routes/users.ts", "src/services/user.ts", "skip-layer"), ("src/routes/users.ts", "src/models/user.ts", "skip-layer"), ("src/models/user.ts", "src/services/user.ts", "backward"),
    }
    assert {r.node for r in workspace.cycles.collect()} == {"src/services/user.ts", "src/models/user.ts"}


def test_symbols(workspace):
    assert {r.name for r in workspace.dead_code.collect()} == {"unused"}
    assert [(r.node, r.hop) for r in workspace.impact("inner").orderBy("hop").collect()] == [("tools/b.py:helper", 1), ("tools/a.py:run", 2)]


def test_commands(spark, root, capsys, tmp_path):
    assert cli.main(["analyze", root, "--tier", "1"], spark) == 0
    out = json.loads(capsys.readouterr().out)
    assert {"name": "Express", "version": "4", "type": "framework"} in out["frameworks"]
    assert out["completeness"][0]["files"] == 7
    assert cli.main(["check", root, "--max-violations", "0"], spark) == 1
    assert cli.main(["dead-code", root, "--format", "table"], spark) == 0
    assert cli.main(["impact", root], spark) == 2
    assert cli.main(["nonsense", root], spark) == 2
    diff = tmp_path / "d"
    diff.write_text("diff --git a/tools/b.py b/tools/b.py\n@@ -4 +4,2 @@\n")
    capsys.readouterr()
    assert cli.main(["risk", root, "--diff", str(diff)], spark) == 0
    assert json.loads(capsys.readouterr().out)["risk"][0]["max_blast"] == 1.0


def test_calls_and_type_imports_of_typescript(spark):
    files = spark.createDataFrame(
        [
            ("src/a.ts", "import type { T } from './t'\nimport { b } from './b'\n\nfunction helper() {\n  return b()\n}\n\nfunction unused() {\n  return 1\n}\n\nexport function main() {\n  return helper()\n}\n"),
            ("src/b.ts", "export function b() {\n  return 2\n}\n"),
            ("src/t.ts", "export interface T {\n  x: number\n}\n"),
            ("m.go", "package m\n\nfunc assist() int {\n\treturn 1\n}\n\nfunc Run() int {\n\treturn assist()\n}\n"),
        ],
        "path string, content string",
    )
    space = Workspace(files)
    assert {(r.file, r.name) for r in space.dead_code.collect()} == {("src/a.ts", "unused")}
    assert {(r.source, r.target, r.type_only) for r in space.imports.collect()} == {("src/a.ts", "src/t.ts", True), ("src/a.ts", "src/b.ts", False)}
    assert {(r.source_file, r.source, r.target_file, r.target) for r in space.symbol_edges.collect()} == {
        ("src/a.ts", "helper", "src/b.ts", "b"), ("src/a.ts", "main", "src/a.ts", "helper"), ("m.go", "Run", "m.go", "assist")
    }
