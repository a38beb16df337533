"""Structure, edits, gates, moves, discovery, snapshots and the service."""

import io
import json
import os
import subprocess

import pytest

from tessera.operators import edit, gate, lookup, moves, structure as st
from tessera.operators.edit import EditError, Op, Overlay

SOURCES = {
    "a.py": ("import os\n\n@dec\ndef f(a, *, b: int = 1) -> int:\n    '''doc'''\n    return a\n\nclass C:\n    def m(self, x): return x\n", ["f", "f:doc", "f:params", "f:param.0", "f:param.1", "f:return", "f:body", "C", "C.m", "C.m:params", "C.m:param.0", "C.m:body"]),
    "a.ts": ("// note\nexport function f(a: number, b = '}'): string {\n  return `${a}`;\n}\nexport class K extends B<{x:1}> {\n  private n: number = 1;\n  m(x: string): void { if (x) { return } }\n}\ninterface I { a: string }\ntype T = { a: 1 };\nconst g = (x) => { return x };\n", ["f", "f:doc", "f:params", "f:param.0", "f:param.1", "f:return", "f:body", "K", "K.n", "K.m", "K.m:params", "K.m:param.0", "K.m:return", "K.m:body", "I", "I.a", "T", "g"]),
    "a.rs": ("/// doc\npub fn f(a: i32) -> Result<i32, E> { Ok(1) }\nstruct S { pub a: i32 }\nimpl S { fn m(&self, q: u8) -> u8 { q } }\ntrait Tr { fn t(&self); }\nmod inner { pub fn g() {} }\nmacro_rules! mm { () => {} }\n", ["f", "f:doc", "f:params", "f:param.0", "f:return", "f:body", "S", "S.a", "S.m", "S.m:params", "S.m:param.0", "S.m:return", "S.m:body", "Tr", "Tr.t", "Tr.t:params", "g", "g:params", "g:body", "mm", "mm:body"]),
    "A.java": ("package a.b;\npublic class A {\n  private int n = 0;\n  public A(int q) { n = q; }\n  public String m(List<String> a) throws E { return \"}\"; }\n}\n", ["A", "A.n", "A.A", "A.A:params", "A.A:param.0", "A.A:body", "A.m", "A.m:params", "A.m:param.0", "A.m:body"]),
    "a.go": ("package a\nfunc F(a int) int { return 1 }\ntype S struct { A int }\nfunc (s *S) M() int { return 1 }\n", ["F", "F:params", "F:param.0", "F:body", "S", "S.M", "S.M:params", "S.M:body"]),
    "a.php": ("<?php\nclass C { private $x = 1; public function m(int $a): int { return $a; } }\n", ["C", "C.$x", "C.m", "C.m:params", "C.m:param.0", "C.m:return", "C.m:body"]),
    "a.c": ("struct P { int a; };\nstatic int add(int a, int b) {\n  if (a) { return b; }\n  return a;\n}\n", ["P", "add", "add:params", "add:param.0", "add:param.1", "add:body"]),
    "a.cpp": ("namespace n { class Q { int m(int a) { return a; } }; }\n", ["n", "n.Q", "n.Q.m", "n.Q.m:params", "n.Q.m:param.0", "n.Q.m:body"]),
    "a.swift": ("struct P { var a: Int = 1\n  func m(_ x: Int) -> Int { return x }\n}\nenum E { case one }\n", ["P", "P.a", "P.m", "P.m:params", "P.m:param.0", "P.m:return", "P.m:body", "E", "E.one"]),
    "a.rb": ("module M\n  class C\n    def m(a)\n      a\n    end\n  end\nend\n", ["M", "M.C", "M.C.m"]),
}


@pytest.mark.parametrize("path", SOURCES)
def test_structure(path):
    text, want = SOURCES[path]
    nodes = st.structure(path, text)
    assert [n.id.split("#", 1)[1] for n in nodes] == want
    for n in nodes:
        assert 0 <= n.start < n.end <= len(text)
        if n.parent:
            parent = next(p for p in nodes if p.id == n.parent)
            assert n.id.startswith(parent.id) and n.id[len(parent.id)] in ".:"
            assert n.kind == "doc" or parent.start <= n.start and n.end <= parent.end
    assert st.structure(path, text) == nodes


def test_structure_table(spark):
    files = spark.createDataFrame([(p, "root", t) for p, (t, _) in SOURCES.items()] + [("bad.py", "root", "def (")], "path string, pkg string, text string")
    nodes = st.extract(files).cache()
    assert nodes.count() == sum(len(w) for _, w in SOURCES.values())
    items = {r["id"]: r for r in st.node_items(nodes, files).collect()}
    assert items["a.py#C.m"]["text"] == "    def m(self, x): return x" and items["a.ts#K"]["start_line"] == 5 and "a.ts#K.m:body" not in items
    assert lookup.read_node(nodes, files, "a.rs#f:doc").first()["text"] == "/// doc"
    assert [r["node_id"] for r in lookup.resolve(nodes, "m", "A.java").collect()] == ["A.java#A.m"]
    assert {r["tier"] for r in lookup.resolve(nodes, "a.ts#K.m").collect()} == {0} and lookup.resolve(nodes, "x.ts#Z.M").first()["node_id"] == "a.go#S.M"
    assert lookup.containing(nodes, files, "a.ts", "private n").first()["node_id"] == "a.ts#K"
    assert [r["line"] for r in st.file_top(files).where("path = 'a.py'").collect()] == [1]


def test_outline():
    assert st.outline("a.ts", "f() {}\nfunction a() { return () => { 1 } }\n") == "f() {}\nfunction a() { /* … */ }\n"
    assert st.outline("a.py", "def f():\n    return 1\n") == "def f():\n    ...\n"


def test_places():
    p = st.Places("é = 1\nx")
    assert p.offset(1, 2) == 1 and p.offset(2, 5) == 7 and p.offset(3, 0) == 7 and p.offset(9, 0) is None and p.at(1) == (1, 2)
    assert lookup.exact_extent("é = 1\nx", (1, 0), (1, 2)) == "é" and lookup.exact_extent("a", (5, 0), (6, 0)) is None


def run(tree, *actions, importers=lambda _p: []):
    files = Overlay(tree.get)
    result = edit.stage([Op.of(a) for a in actions], files, importers)
    return result, files


PY = {"m.py": "def f(a):\n    x = a\n    return x\n\n\ndef g():\n    return f(1)\n"}
TS = {"m.ts": "interface I extends B<{ x: 1 }> {\n  a: string;\n}\nfunction f(a) {\n  run(a);\n}\n"}


@pytest.mark.parametrize("tree,action,want", [
    (PY, {"action": "set_body", "name": "f", "value": "return a"}, "def f(a):\n    return a\n\n\ndef g():\n    return f(1)\n"),
    (PY, {"action": "insert_in_body", "name": "f", "value": "y = 2", "oldText": "x = a"}, "def f(a):\n    x = a\n    y = 2\n    return x\n\n\ndef g():\n    return f(1)\n"),
    (PY, {"action": "insert_in_body", "name": "g", "value": "pass"}, "def f(a):\n    x = a\n    return x\n\n\ndef g():\n    return f(1)\n    pass\n"),
    (PY, {"action": "delete_in_body", "name": "f", "oldText": "x = a"}, "def f(a):\n    return x\n\n\ndef g():\n    return f(1)\n"),
    (PY, {"action": "add_parameter", "name": "f", "value": "b=1"}, PY["m.py"].replace("f(a)", "f(a, b=1)")),
    (PY, {"action": "add_parameter", "name": "g", "value": "b"}, PY["m.py"].replace("g()", "g(b)")),
    (PY, {"action": "set_return_type", "name": "f", "value": "int"}, PY["m.py"].replace("f(a):", "f(a) -> int:")),
    (PY, {"action": "replace_text", "name": "f", "oldText": "x = a", "newText": "x = 2"}, PY["m.py"].replace("x = a", "x = 2")),
    (PY, {"action": "replace_node", "name": "f", "target": "param.0", "value": "b"}, PY["m.py"].replace("f(a)", "f(b)")),
    (PY, {"action": "insert_before", "name": "g", "value": "import os"}, PY["m.py"].replace("def g", "import os\n\ndef g")),
    (PY, {"action": "rename", "name": "f", "value": "h"}, PY["m.py"].replace("f(a)", "h(a)").replace("f(1)", "h(1)")),
    (PY, {"action": "add_symbol", "value": "def k():\n    pass"}, PY["m.py"] + "\ndef k():\n    pass\n"),
    (PY, {"action": "replace_in_file", "oldText": "f(1)", "newText": "f(2)"}, PY["m.py"].replace("f(1)", "f(2)")),
    (TS, {"action": "insert_member", "name": "I", "value": "b: number;"}, TS["m.ts"].replace("> {\n  a", "> {\n  b: number;\n  a")),
    (TS, {"action": "insert_in_body", "name": "f", "value": "stop();"}, TS["m.ts"].replace("run(a);\n", "run(a);\n  stop();\n")),
    (TS, {"action": "set_return_type", "name": "f", "value": "void"}, TS["m.ts"].replace("f(a) {", "f(a): void {")),
])
def test_operations(tree, action, want):
    path = next(iter(tree))
    result, files = run(tree, {"path": path, **action})
    assert result.ok, result.feedback
    assert files.read(path) == want


@pytest.mark.parametrize("tree,action,part", [
    (PY, {"action": "replace_text", "name": "f", "oldText": "x", "newText": "y"}, "occurs 2 times"),
    (PY, {"action": "add_symbol", "value": "def f():\n    pass"}, "already exists"),
    (PY, {"action": "set_body", "name": "zzz", "value": "1"}, "not found"),
    (PY, {"action": "replace_node", "name": "f", "target": "legs", "value": "1"}, "unknown target"),
    (PY, {"action": "create_file", "value": ""}, "already exists"),
    (TS, {"action": "insert_member", "name": "f:params", "value": ""}, "not found"),
    ({"m.java": "class A { int f() { return 1; } }"}, {"action": "set_return_type", "name": "f", "value": "long"}, "before the name"),
])
def test_refusals(tree, action, part):
    path = next(iter(tree))
    result, files = run(tree, {"path": path, **action})
    assert not result.ok and part in result.feedback and files.changed() == []


def test_batches():
    result, files = run(PY, {"action": "set_body", "path": "m.py", "name": "f", "value": "return 9"}, {"action": "set_body", "path": "m.py", "name": "g", "value": "return 8"})
    assert files.read("m.py") == "def f(a):\n    return 9\n\n\ndef g():\n    return 8\n" and result.redundant == 0
    result, files = run(PY, {"action": "set_body", "path": "m.py", "name": "f", "value": "return 9"}, {"action": "set_body", "path": "m.py", "name": "nobody", "value": ""})
    assert not result.ok and result.failed_op == 1 and files.changed() == []
    result, _ = run(PY, {"action": "replace_in_file", "path": "m.py", "oldText": "gone", "newText": "x = a"})
    assert result.ok and result.redundant == 1
    with pytest.raises(EditError):
        Op.of({"action": "rename", "nme": "x"})
    with pytest.raises(EditError):
        Op.of({"action": "explode"})
    assert Op.of({"action": "rename", "file": "a\\b.py"}).path == "a/b.py"


def test_paths_stay_inside(tmp_path):
    (tmp_path / "in").mkdir()
    os.symlink("/", tmp_path / "out")
    assert edit.safe_path(str(tmp_path), "./in/./a.py") == "in/a.py"
    for bad in ("/etc/x", "../x", "in/../../x", "out/etc", "C:/x", ""):
        with pytest.raises(EditError):
            edit.safe_path(str(tmp_path), bad)


def test_workspace_edit():
    files = Overlay({"a": "é one two\n"}.get)
    edit.workspace_edit(files, {"a": [((1, 3), (1, 6), "1"), ((1, 7), (1, 10), "2")], "b": [((1, 0), (1, 0), "new")]}, ["b"])
    assert files.read("a") == "é 1 2\n" and files.read("b") == "new"


def test_gate():
    old = "def f(:\n  pass\n"
    assert gate.syntax_gate({"a.py": old}.get, {"a.py": "\n" + old}) == []
    assert len(gate.syntax_gate({}.get, {"a.py": old})) == 1
    d = lambda line: {"file": "a", "code": 1, "message": "m", "line": line}
    assert gate.new_diagnostics([d(1)], [d(5), d(9), d(9)]) == [d(9)]
    assert [x["message"] for x in gate.syntax_diagnostics("a.ts", "f( { ')' ]")] == ["unexpected ']'", "'(' is never closed", "'{' is never closed"]
    assert gate.syntax_diagnostics("a.json", "{") and not gate.syntax_diagnostics("a.toml", "a = 1")
    assert gate.receipt("a\nb\na\n", "a\nc\n") == ["- a", "- b", "+ c"] or gate.receipt("a\nb\na\n", "a\nc\n") == ["- b", "- a", "+ c"]
    assert gate.receipt(None, "x") == ["created"] and gate.receipt("x", None) == ["deleted"]
    assert json.loads(gate.suggested_fix("n", ["f({", "  a: 1,"]))["oldText"] == "a: 1,"
    assert gate.source_window("a(\nb\n)\nc\nd", 1) == ["a(", "b", ")"]
    assert gate.update_comments("# old is here\nold = 1\n# x", "old", "new") == "# new is here\nold = 1\n# x"
    left = gate.rename_leftovers({"a.py": "def f():\n    return old\n"}, "old", "new")
    assert left[0]["fix"] == {"action": "replace_text", "name": "a.py#f", "oldText": "return old", "newText": "return new"}


def test_commit(tmp_path):
    for p, t in PY.items():
        (tmp_path / p).write_text(t)
    base = lambda p: (tmp_path / p).read_text() if (tmp_path / p).is_file() else None
    bad = gate.commit_edits(str(tmp_path), [Op.of({"action": "set_body", "path": "m.py", "name": "f", "value": "return ("})], Overlay(base))
    assert not bad["ok"] and bad["gated"] is False and "syntax error" in bad["feedback"] and base("m.py") == PY["m.py"]
    good = gate.commit_by_language(str(tmp_path), [Op.of({"action": "rename", "path": "m.py", "name": "f", "value": "h"}), Op.of({"action": "create_file", "path": "n/x.ts", "value": "let a = 1;\n"})], base)
    assert good["ok"] and good["changed"] == ["m.py", "n/x.ts"] and "def h(a)" in base("m.py")
    out = gate.commit_by_language(str(tmp_path), [Op.of({"action": "create_file", "path": "../x.ts", "value": ""})], base)
    assert not out["ok"] and not (tmp_path.parent / "x.ts").exists()


def test_moves():
    tree = {"src/a.ts": "import { b } from './b';\nimport c from './c.js';\n", "src/b.ts": "import x from './c';\n", "src/c.ts": ""}
    _, files = run(tree, {"action": "move_file", "path": "src/b.ts", "value": "src/lib/b.ts"}, importers=lambda _p: ["src/a.ts"])
    assert files.read("src/a.ts").startswith("import { b } from './lib/b';") and files.read("src/lib/b.ts") == "import x from '../c';\n" and files.read("src/b.ts") is None
    java = {"src/a/X.java": "package a;\nclass X {}\n", "src/b/Y.java": 'package b;\nimport a.X;\nclass Y { String s = "a.X"; a.X x; a.Xy z; }\n'}
    _, files = run(java, {"action": "move_file", "path": "src/a/X.java", "value": "src/c/X.java"}, importers=lambda _p: ["src/b/Y.java"])
    assert files.read("src/b/Y.java") == 'package b;\nimport c.X;\nclass Y { String s = "a.X"; c.X x; a.Xy z; }\n' and files.read("src/c/X.java").startswith("package c;")
    rust = {"src/lib.rs": "pub mod a;\nmod b;\nuse crate::a::F;\n", "src/a.rs": "pub struct F;", "src/b/mod.rs": ""}
    _, files = run(rust, {"action": "move_file", "path": "src/a.rs", "value": "src/b/z.rs"}, importers=lambda _p: ["src/lib.rs"])
    assert files.read("src/lib.rs") == "mod b;\nuse crate::b::z::F;\n" and files.read("src/b/mod.rs") == "pub mod z;\n"
    assert moves.splice("abcdef", [(1, 2), (4, 5), (9, 12)], "_") == "a_cd_f"
    result, _ = run(tree, {"action": "delete_file", "path": "src/b.ts"}, importers=lambda _p: ["src/a.ts"])
    assert not result.ok and "L1: import { b }" in result.feedback
    result, files = run(tree, {"action": "replace_in_file", "path": "src/a.ts", "oldText": "import { b } from './b';\n", "newText": ""}, {"action": "delete_file", "path": "src/b.ts"}, importers=lambda _p: ["src/a.ts"])
    assert result.ok and files.changed() == ["src/a.ts", "src/b.ts"]


def test_batches_in_parallel(spark):
    from tessera.plans.queries import QUERIES

    got = QUERIES["edit_batch"](spark, "").collect()
    assert {(r["batch"], r["path"], r["ok"]) for r in got} == {(1, "app/util.py", True), (1, "web/view.ts", True), (2, None, False), (3, None, False)}
    assert next(r["text"] for r in got if r["path"] == "app/util.py") == "def add(a, b, c=0):\n    return a + b + c\n"


@pytest.fixture
def repo(tmp_path):
    tree = {"package.json": json.dumps({"name": "root"}), "apps/api/package.json": json.dumps({"name": "api", "dependencies": {"express": "1"}}), "apps/api/src/server.ts": "import { parse } from '../../web/parse';\nexport function startServer() { return parse('x'); }\n", "apps/web/package.json": "{}", "apps/web/parse.ts": "export function parseConfig(a: string) { return a; }\nexport function parse(a: string) { return parseConfig(a); }\n", "py/tool.py": "def tool():\n    return 1\n", "ignored/x.ts": "let a = 1", ".gitignore": "ignored/\n*.log\n!keep.log\n", "a.log": "", "keep.log": "", "node_modules/x/y.ts": "", "t.d.ts": ""}
    for p, t in tree.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    return str(tmp_path)


def test_discovery(repo):
    from tessera.sources import discover, fingerprint, workspace

    assert [p for p, _ in discover.discover(repo)] == ["apps/api/src/server.ts", "apps/web/parse.ts"]
    assert discover.present_languages(repo) == {"ts", "python"}
    assert "keep.log" in set(discover.walk(repo)) and "a.log" not in set(discover.walk(repo))
    packages, several = workspace.detect(repo)
    assert [(p.name, p.dir) for p in packages] == [("root", ""), ("api", "apps/api"), ("web", "apps/web")] and several
    assert workspace.parse_manifest("Cargo.toml", "[workspace]\nmembers=['a']") is None
    assert workspace.parse_manifest("Cargo.toml", "[package]\nname='x'\n[dependencies]\naxum='1'\nsqlx={version='1'}") == ("x", ["axum", "sqlx"])
    assert workspace.parse_manifest("pyproject.toml", "[project]\nname='p'\ndependencies=['django>=4','celery[redis]; x']\n[tool.poetry.dependencies]\npython='3'\nflask='1'") == ("p", ["django", "celery", "flask"])
    fp = fingerprint.source_fingerprint(repo, lambda p: p.endswith(".ts"), ["package.json", "nope"], skip=["node_modules"])
    assert set(fp) == {"apps/api/src/server.ts", "apps/web/parse.ts", "package.json", "t.d.ts"}
    fingerprint.store(f"{repo}/.x/fp.json", 2, fp)
    assert fingerprint.load(f"{repo}/.x/fp.json", 2) == fp and fingerprint.load(f"{repo}/.x/fp.json", 3) is None
    with open(f"{repo}/apps/web/parse.ts", "a") as f:
        f.write("//")
    new = fingerprint.source_fingerprint(repo, lambda p: p.endswith(".ts"), skip=["node_modules"])
    assert fingerprint.drifted(repo, {**fp, "//mark": "1", "gone.ts": "0"}, new) == ["apps/web/parse.ts", "gone.ts"]


def test_index_and_service(spark, repo, monkeypatch):
    from tessera import cli
    from tessera.sources import snapshot
    from tessera.streaming import watch

    monkeypatch.setattr(cli, "session", lambda: spark)
    folder = cli.folder_of(repo, cli.Config())
    assert cli.main(["doctor", repo]) == 1 and cli.main(["retrieve", repo]) == 2
    cli.index(repo)
    assert cli.main(["doctor", repo]) == 0
    ix = snapshot.load(spark, folder)
    assert {r["pkg"] for r in ix.files.collect()} == {"api", "web", "root"} and ix.packages.where("name = 'api'").first()["role"] == "backend"
    assert [tuple(r) for r in ix.edges.collect()] == [("apps/api/src/server.ts", "apps/web/parse.ts")] and ix.chunks.count() == ix.vectors.count() == 4
    rows = [json.loads(x) for x in cli.retrieve(repo, "where is parseConfig", 3, True)]
    assert rows[0]["file"] == "apps/web/parse.ts"
    cases = os.path.join(repo, "cases.json")
    with open(cases, "w") as f:
        json.dump([{"task": "parseConfig", "expectFiles": ["apps/web/parse.ts"]}, {"task": "startServer", "expectFiles": ["apps/api/src/server.ts"]}], f)
    assert cli.evaluate(repo, cases, 5) == {"n": 2, "hit_rate": 1.0, "mrr": 1.0}
    assert lookup.files_defining(ix.symbols, "parse").first()["file"] == "apps/web/parse.ts"
    assert [r["id"] for r in lookup.resolve_query(ix, "fix parse please").collect()] == ["apps/web/parse.ts#parse"]
    service = cli.Service(repo)
    ask = lambda name, args: json.loads(service.answer({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": args}})["result"]["content"][0]["text"])
    assert ask("inspect", {"mode": "symbol", "query": "tool"})[0]["id"] == "py/tool.py#tool"
    assert ask("inspect", {"mode": "node", "id": "py/tool.py#tool"})[0]["text"] == "def tool():\n    return 1"
    assert any("parseConfig" in r["line"] for r in ask("inspect", {"mode": "file", "path": "apps/web/parse.ts"}))
    assert any("apps/web" in r["line"] for r in ask("inspect", {"mode": "map"}))
    assert ask("apply_edits", {"actions": [{"action": "set_body", "path": "py/tool.py", "name": "tool", "value": "return 2"}]})["ok"]
    out = io.StringIO()
    service.serve(iter(['{"jsonrpc":"2.0","id":1,"method":"initialize"}\n', "{\n", '{"method":"note"}\n', '{"id":2,"method":"nope"}\n', '{"id":3,"method":"tools/list"}\n', '{"id":4,"method":"tools/call","params":{"name":"inspect","arguments":{"mode":"zzz"}}}\n']), out)
    replies = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [("error" in r, r["id"]) for r in replies] == [(False, 1), (True, None), (True, 2), (False, 3), (True, 4)]

    changes = spark.createDataFrame([("py/tool.py", "python", 1.0, "def beta():\n    return 1\n", False, 2), ("py/tool.py", "python", 0.0, "def old(): pass", False, 1), ("apps/web/parse.ts", "ts", 1.0, None, True, 3)], watch.CHANGE)
    before = snapshot.current(folder)
    watch.apply_changes(spark, folder, changes)
    assert snapshot.current(folder) != before and os.path.isdir(before)
    new = snapshot.load(spark, folder)
    assert {r["name"] for r in new.symbols.collect()} == {"beta", "startServer"} and new.chunks.count() == new.vectors.count() == 2
    assert new.postings.where("file = 'apps/web/parse.ts'").count() == 0
    with pytest.raises(RuntimeError):
        snapshot.load(spark, folder, model="other")
    with snapshot.lock(folder), pytest.raises(RuntimeError), snapshot.lock(folder):
        pass
    assert "_LOCK" not in os.listdir(folder)


def test_watch_stream(spark, tmp_path):
    from tessera.sources import snapshot, workspace
    from tessera.streaming import watch

    folder, inbox = str(tmp_path / "index"), str(tmp_path / "in")
    files = spark.createDataFrame([("a.py", "python", 0.0, "def a():\n    pass\n")], "path string, lang string, mtime_ms double, text string")
    snapshot.save(snapshot.build(spark, files, workspace.package_table(spark, [workspace.Package("root", "")])), folder)
    spark.createDataFrame([("b.py", "python", 1.0, "import a\ndef b():\n    pass\n", False, 1)], watch.CHANGE).write.parquet(inbox)
    stream = spark.readStream.schema(watch.CHANGE).parquet(inbox)
    watch.watch(stream, folder, str(tmp_path / "checkpoint")).awaitTermination(120)
    ix = snapshot.load(spark, folder)
    assert {r["name"] for r in ix.symbols.collect()} == {"a", "b"} and [tuple(r) for r in ix.edges.collect()] == [("b.py", "a.py")]


def test_rest_imports_without_the_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['tessera.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'bm25_batch' in e.queries() and not any(q.startswith('op1_') for q in e.queries()); print(len(e.oracle_sql()))"
    assert int(subprocess.run(["python", "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout.split()[-1]) > 40


def number(n):
    out = b""
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def message(*parts):
    """Fields (number, value) as protobuf: numbers, texts, bytes, lists of numbers."""
    out = b""
    for field, value in parts:
        if isinstance(value, int):
            out += number(field << 3) + number(value)
        else:
            body = value.encode() if isinstance(value, str) else b"".join(map(number, value)) if isinstance(value, list) else value
            out += number(field << 3 | 2) + number(len(body)) + body
    return out


def test_symbol_artifact(spark, tmp_path):
    from tessera.sources import artifact

    add, run_ = "scip-x npm . . math/add().", "scip-x npm a  b . app/`Run it`#main()."
    one = message((1, "math.ts"), (2, message((1, [0, 9, 12]), (2, add), (3, 1), (7, [0, 0, 2, 1]))), (4, "ts"), (2, message((2, add), (3, 1), (1, [300, 1, 300, 4]))))
    two = message((2, message((1, [2, 2, 5]), (2, add))), (2, message((1, 1), (1, 2), (1, 3), (2, run_), (3, 1))), (2, message((2, "local 0"), (1, [0, 0, 1]))), (1, "app.ts"))
    (tmp_path / "index.scip").write_bytes(message((1, b""), (2, one), (2, two), (2, message((1, "empty.ts")))))
    got = artifact.read(spark, str(tmp_path / "index.scip"))
    rows = [(r["file"], r["ord"], r["qualified"], r["suffix"], r["is_def"], r["name_range"], r["range"]) for r in got.orderBy("doc", "ord").collect()]
    assert rows[0] == ("math.ts", 0, "add", "method", True, [0, 9, 12], [0, 0, 2, 1]) and rows[1][6] == [300, 1, 300, 4]
    assert rows[2:] == [("app.ts", 0, "add", "method", False, [2, 2, 5], [2, 2, 5]), ("app.ts", 1, "Run it.main", "method", True, [1, 2, 3], [1, 2, 3]), ("app.ts", 2, None, None, False, [0, 0, 1], [0, 0, 1])]
    assert [tuple(r) for r in artifact.edges(got).collect()] == [("app.ts", "math.ts")]
    nodes = {r["node_id"]: (r["start_line"], r["end_line"]) for r in st.symbol_definitions(got).collect()}
    assert nodes == {"math.ts#add": (1, 3), "math.ts#add~1": (301, 301), "app.ts#Run it.main": (2, 2)}
    assert artifact.named("scip-x npm . . math/") == ("", "namespace") and artifact.named("scip-x npm . . math/add().(a)")[1] == "parameter" and artifact.named("odd") == (None, None)
    for wrong in (b"\x12\x7f", b"\x13"):
        with pytest.raises((ValueError, IndexError)):
            list(artifact.occurrences(wrong))


def test_namespaces(tmp_path):
    from tessera.sources import workspace

    assert workspace.namespaces(str(tmp_path)) == []
    (tmp_path / "composer.json").write_text('{"autoload": {"psr-4": {"App\\\\": ["./src/", "lib"], "": "any/"}}, "autoload-dev": {"psr-4": {"App\\\\": "tests", "T\\\\": "tests/", "N": 3}}}')
    assert workspace.namespaces(str(tmp_path)) == [("App", "src", 0), ("App", "lib", 1), ("", "any", 0), ("T", "tests", 0)]
    (tmp_path / "composer.json").write_text("{")
    assert workspace.namespaces(str(tmp_path)) == []


def test_command_gate(tmp_path):
    import sys

    (tmp_path / "a.go").write_text("old bad\n")
    check = "import pathlib\nfor p in sorted(pathlib.Path('.').rglob('*.go')):\n    for i, row in enumerate(p.read_text().splitlines(), 1):\n        if 'bad' in row: print(f'./{p}:{i}:2: error: bad word')"
    engine = gate.CommandEngine(str(tmp_path), [sys.executable, "-c", check])
    base = {"a.go": "old bad\n"}.get
    assert engine.gated and gate.syntax_gate(base, {"a.go": "x\nold bad\n"}, engine) == []
    found = gate.syntax_gate(base, {"a.go": "old bad\nnew bad\n"}, engine)
    assert [(d["file"], d["line"], d["message"]) for d in found] == [("a.go", 2, "bad word")]
    ops = [Op.of({"action": "replace_in_file", "path": "a.go", "oldText": "old", "newText": "new bad\nbad"})]
    reply = gate.commit_by_language(str(tmp_path), ops, base, engines={"go": engine})
    assert not reply["ok"] and reply["gated"] and (tmp_path / "a.go").read_text() == "old bad\n"
    ops = [Op.of({"action": "replace_in_file", "path": "a.go", "oldText": "old bad", "newText": "good"})]
    assert gate.commit_by_language(str(tmp_path), ops, base, engines={"go": engine})["gated"] and (tmp_path / "a.go").read_text() == "good\n"
    with pytest.raises(ValueError):
        engine.diagnostics({"../x.go": ""})
    absent = gate.CommandEngine(str(tmp_path), ["no-such-compiler"])
    assert not absent.gated and absent.diagnostics({"a.go": "f("})[0]["code"] == 3
    slow = gate.CommandEngine(str(tmp_path), [sys.executable, "-c", "import time; time.sleep(9)"], seconds=0.2)
    assert slow.diagnostics({"a.go": "x"}) == [] and not slow.gated


def test_detail_levels(spark):
    manifest = spark.createDataFrame([(0, f"f{k}.py", float(9 - k), "query-match" if k % 2 == 0 else "imports-seed") for k in range(6)], "query_id int, file string, score double, reason string")
    texts = spark.createDataFrame([(f"f{k}.py", f"def f():\n    return {k}\n" + "x\n" * 200) for k in range(6)], "path string, text string")
    shown = {r["file"]: (r["detail"], r["text"]) for r in lookup.detailed(manifest, texts).collect()}
    assert [shown[f"f{k}.py"][0] for k in range(6)] == ["full", "outline", "full", "outline", "pointer", "pointer"]
    assert "return 0" in shown["f0.py"][1] and "return" not in shown["f1.py"][1] and shown["f5.py"][1] is None
    assert len(shown["f0.py"][1].split("\n")) == 100
    assert {r["detail"] for r in lookup.detailed(manifest, texts, "outline").collect()} == {"outline", "pointer"}
    assert {r["detail"] for r in lookup.detailed(manifest, texts, "pointers").collect()} == {"pointer"}
    with pytest.raises(ValueError):
        lookup.detailed(manifest, texts, "all")
