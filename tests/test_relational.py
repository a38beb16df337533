"""Operators on small literal tables."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.config import Config
from tessera.functions import paths, text
from tessera.functions.hashing import fnv1a_bytes
from tessera.operators import arch, dense, diff, graph, imports, intervals, lexical, rank, retrieve, weight


def value(spark, column, **cols):
    frame = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_tokens(spark):
    got = value(spark, text.tokens(F.col("t")), t="buildIndex HTTPServer foo_bar the x Straße")
    assert got == ["buildindex", "build", "index", "httpserver", "http", "server", "foo", "bar", "stra"]
    assert value(spark, text.tokens(F.col("t")), t="") == []


def test_whole_words(spark):
    frame = spark.createDataFrame([("rename it", "name", False), ("my_name", "name", False), ("xóy ó", "ó", True), ("a name.", "name", True), ("", "a", False), ("$name name$", "name", False), ("name-name", "name", True)], "h string, n string, ok boolean")
    for r in frame.select("h", "n", "ok", text.contains_word(F.col("h"), F.col("n")).alias("got")).collect():
        assert r["got"] == r["ok"], r
        assert spark.createDataFrame([(r["h"],)], "h string").select(text.whole_word(F.col("h"), r["n"]).alias("x")).first()["x"] == r["ok"]


def test_lines(spark):
    for a, b, want in ((1, 2, "a\nb"), (2, 9, "b\nc"), (0, 2, ""), (3, 3, "c"), (3, 2, "")):
        assert value(spark, text.slice_lines(F.col("t"), F.lit(a), F.lit(b)), t="a\nb\nc\n") == want
    assert value(spark, text.occurrences(F.col("t"), F.lit("aa")), t="aaaa a") == 2


def test_globs(spark):
    frame = spark.createDataFrame([("a.ts",), ("x/a.ts",), ("x/y/a.tsx",), ("node_modules/a.ts",), ("x/node_modules/y/a.ts",)], "p string")
    got = [r[0] for r in frame.where(text.matches_globs(F.col("p"), ["**/*.ts"]) & ~text.matches_globs(F.col("p"), ["**/node_modules/**"])).collect()]
    assert got == ["a.ts", "x/a.ts"]


@pytest.mark.parametrize("path,language,role,suffix", [
    ("apps/web/server/handler.ts", "ts", "backend", ".ts"),
    ("x/a.d.ts", "other", "unknown", ".d.ts"),
    ("packages/shared/foo.service.ts", "ts", "shared", ".service.ts"),
    ("docs/index.tsx", "tsx", "docs", "index"),
    ("main.rs", "rust", "unknown", "main"),
    ("mobile/x.unknown/Makefile", "other", "mobile", "Makefile"),
    ("Server/.env", "other", "backend", ".env"),
    ("a/b.py", "python", "unknown", ".py"),
])
def test_paths(spark, path, language, role, suffix):
    c = F.col("p")
    row = spark.createDataFrame([(path,)], "p string").select(paths.language(c).alias("l"), paths.path_role(c).alias("r"), paths.file_suffix(paths.base_name(c)).alias("s"), paths.ancestors(paths.parent(c)).alias("a")).first()
    assert (row["l"], row["r"], row["s"]) == (language, role, suffix)
    folders = path.split("/")[:-1]
    assert row["a"] == ["/".join(folders[:k]) for k in range(len(folders), -1, -1)]


def test_normalise(spark):
    assert value(spark, paths.normalise(F.col("p")), p="a/./b/../c//d/../../../x") == "x"


def test_fnv1a():
    assert fnv1a_bytes(b"") == "cbf29ce484222325" and fnv1a_bytes(b"a") == "af63dc4c8601ec8c"


def test_config():
    merged = Config().merged({"top_n": 3, "layers": {"boost": 1.0}, "package_weights": {"a": 2}})
    assert (merged.top_n, merged.layers.boost, merged.layers.enabled, merged.package_weights, merged.rrf_k) == (3, 1.0, True, {"a": 2}, 60.0)
    with pytest.raises(ValueError):
        Config().merged({"nope": 1})


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}", t) for i, t in enumerate(texts)], "id long, file string, text string")


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id int, text string")


def test_bm25(spark):
    frame = docs(spark, "reciprocal rank fusion merge", "unrelated database migration", "")
    got = lexical.bm25(frame, queries(spark, "rank fusion", "nothing"), 5).collect()
    assert [(r["query_id"], r["id"], r["rank"]) for r in got] == [(0, 0, 1)]
    idf, avg = math.log(1 + (3 - 1 + 0.5) / 1.5), 7 / 3
    assert got[0]["score"] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 4 / avg)), abs=1e-8)


def test_scan_word(spark):
    frame = spark.createDataFrame([("b.ts", "x foo\nfood\n foo(foo)"), ("a.ts", "$foo"), ("c.py", "foo")], "path string, text string")
    assert [tuple(r) for r in lexical.scan_word(frame, "foo", "ts").collect()] == [("a.ts", 1, "$foo"), ("b.ts", 1, "x foo"), ("b.ts", 3, "foo(foo)")]


def test_bulk_vectors_in_blocks(spark):
    vectors = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "row_id long, embedding array<float>")
    asked = spark.createDataFrame([(i, [float(i % 3), 1.0 - i]) for i in range(11)], "query_id int, query_vector array<float>")
    want = sorted(map(tuple, dense.rank_vectors(vectors, asked, 3).collect()))
    for size in (1, 4, 11, 12):
        assert sorted(map(tuple, dense.rank_vectors_bulk(vectors, asked, 3, max_queries=size).collect())) == want
    assert dense.rank_vectors_bulk(vectors, asked.limit(0), 3).count() == 0


def test_vectors(spark):
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.7, 0.7]), (3, [0.7, 0.7])], "row_id long, embedding array<float>")
    asked = spark.createDataFrame([(9, [0.0, 1.0])], "query_id int, query_vector array<float>")
    want = [(1, 1), (2, 2), (3, 3)]
    for f in (dense.rank_vectors, dense.rank_vectors_bulk):
        assert [(r["id"], r["rank"]) for r in f(vectors, asked, 3).orderBy("rank").collect()] == want
    with pytest.raises(ValueError):
        dense.rank_vectors_bulk(vectors, asked, 3, max_queries=0)
    got = {r["row_id"]: r["embedding"] for r in dense.embed(spark.createDataFrame([(0, "parse config"), (1, "config parse"), (2, "")], "row_id long, text string")).collect()}
    assert got[0] == pytest.approx(got[1]) and sum(x * x for x in got[0]) == pytest.approx(1, abs=1e-5) and set(got[2]) == {0.0}


def test_fusion(spark):
    lists = [spark.createDataFrame([(0, a, 1), (0, b, 2)], "query_id int, file string, rank int") for a, b in (("x", "y"), ("y", "z"))]
    got = {r["file"]: r["score"] for r in rank.reciprocal_rank_fusion(lists, "file").collect()}
    assert got == pytest.approx({"x": 1 / 61, "y": 1 / 61 + 1 / 62, "z": 1 / 62}, abs=1e-8)


SYMBOLS = "id string, name string, kind string, file string, pkg string, start_line int, end_line int"


def test_symbols(spark):
    rows = [("F#Foo", "Foo", "class", "F", "p", 1, 2), ("F#l", "barBazQuxLib", "function", "F", "p", 3, 4), ("G#n", "rename", "function", "G", "p", 1, 1), ("H#x", "id", "var", "H", "p", 1, 1)]
    got = {r["file"]: (r["score"], r["exact"]) for r in rank.symbol_matches(spark.createDataFrame(rows, SYMBOLS), queries(spark, "fix Foo in bar baz qux lib with id and name")).collect()}
    assert got == {"F": (4, True), "H": (1, False)}


def test_symbols_of_shared_names(spark):
    """Files of one and of several names, ids in more than one row, copies of queries."""
    rows = [(f"{f}#{n}", n, "var", f, "p", 1, 1) for f, names in {"A": ["Foo"], "B": ["Foo", "fooBar"], "C": ["Foo"], "D": ["zz", "Foo"], "E": ["zz"]}.items() for n in names] + [("C#Foo", "Foo", "var", "C", "p", 2, 2), ("N", None, "var", "N", "p", 1, 1), ("0", "bar", "var", None, "p", 1, 1)]
    asked = spark.createDataFrame([(1, "a foo here"), (2, "a foo here"), (3, "bar"), (3, "foo"), (4, None), (5, "no match")], "query_id int, text string")
    got = {(r["query_id"], r["file"]): (r["score"], r["exact"]) for r in rank.symbol_matches(spark.createDataFrame(rows, SYMBOLS), asked).collect()}
    foo = {"A": (3, True), "B": (3, True), "C": (4, True), "D": (3, True)}
    assert got == {(q, f): v for q in (1, 2, 3) for f, v in foo.items()} | {(3, None): (3, True)}


def test_find_symbols(spark):
    rows = [(f"a#{n}", n, "function", "src/a.ts", "p", 1, 2) for n in ("parseConfig", "parse", "parseConfigFile")]
    frame = spark.createDataFrame(rows, SYMBOLS)
    assert [r["name"] for r in retrieve.find_symbols(frame, "parseconfig").collect()] == ["parseConfig"]
    many = retrieve.find_symbols(frame, " Parse ", substring=True).collect()
    assert [r["name"] for r in many] == ["parse", "parseConfig", "parseConfigFile"] and many[0]["total"] == 3
    one = retrieve.find_symbols(frame, "parse", substring=True, cap=1).collect()
    assert len(one) == 1 and one[0]["total"] == 3 and retrieve.find_symbols(frame, "  ").count() == 0


def test_layers_and_roles(spark):
    got = {(r["query_id"], r["role"]): r["mult"] for r in weight.layer_multipliers(queries(spark, "add a database migration", "zzz")).collect()}
    assert got[0, "backend"] > 1 and got[0, "mobile"] == 1 and got[1, "backend"] == 1
    rows = [("a", "x", ["react-native", "react-dom"]), ("b", "x", ["vitest"]), ("c", "apps/api", []), ("core", "packages/core", []), ("q", "q", ["sea-orm-cli"])]
    frame = spark.createDataFrame(rows, "name string, dir string, deps array<string>")
    assert [r[0] for r in frame.select(weight.infer_role(F.col("name"), F.col("dir"), F.col("deps"))).collect()] == ["mobile", "frontend", "backend", "shared", "backend"]
    types = spark.createDataFrame([([], ["node"], []), ([], [], ["dom.iterable"])], "d array<string>, t array<string>, l array<string>")
    assert [r[0] for r in types.select(weight.infer_role(F.lit("zz"), F.lit("zz"), F.col("d"), F.col("t"), F.col("l"))).collect()] == ["backend", "frontend"]
    packs = spark.createDataFrame([("web", "apps/web", None, ["vue"]), ("zz", "zz", "backend", [])], "name string, dir string, role string, deps array<string>")
    weights = {r["pkg"]: (r["role"], r["weight"]) for r in weight.package_weights(packs, queries(spark, "css page"), Config(package_weights={"backend": 0.5})).collect()}
    assert weights == {"web": ("frontend", 1.6), "zz": ("backend", 0.5)}


def test_package_owner(spark):
    packages = spark.createDataFrame([("root", ""), ("a", "apps/a"), ("b", "apps/a/b")], "name string, dir string")
    files = spark.createDataFrame([("x.ts",), ("apps/a/x.ts",), ("apps/a/b/c/x.ts",), ("apps/ab/x.ts",)], "path string")
    assert {r["path"]: r["pkg"] for r in weight.package_owner(files, packages).collect()} == {"x.ts": "root", "apps/a/x.ts": "a", "apps/a/b/c/x.ts": "b", "apps/ab/x.ts": "root"}


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src string, dst string")


def test_graph(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("d", "b"), ("d", "b"))
    assert {r["file"]: r["importers"] for r in graph.reverse(e).collect()} == {"b": ["a", "d"], "c": ["a"]}
    assert graph.reverse_pairs(e).count() == 4
    ring = edges(spark, ("app", "barrel"), ("barrel", "policy"), ("policy", "app"))
    start = spark.createDataFrame([("policy",)], "f string")
    assert {(r["file"], r["hop"]) for r in graph.closure(ring, start).collect()} == {("barrel", 1), ("app", 2)}
    assert graph.closure(ring, spark.createDataFrame([("none",)], "f string")).count() == 0
    assert {r["file"] for r in graph.blast_radius(ring, start, True).collect()} == {"policy", "barrel"}
    assert {r["file"] for r in graph.blast_radius(ring, start, False).collect()} == {"policy", "barrel", "app"}
    seeds = spark.createDataFrame([(0, "b")], "query_id int, file string")
    got = {r["file"]: (r["hop"], r["reason"]) for r in graph.expand(edges(spark, ("a", "b"), ("b", "x"), ("b", "a"), ("x", "y"), ("y", "z")), seeds, 2).collect()}
    assert got == {"a": (1, "imported-by-seed"), "x": (1, "imported-by-seed"), "y": (2, "imported-by-seed")}
    changes = spark.createDataFrame([("a", ["z"]), ("d", None)], "file string, targets array<string>")
    assert sorted(map(tuple, graph.overlay(e, changes).collect())) == [("a", "z")]
    assert graph.union_graphs(spark, []).count() == 0


def test_delete_refusals(spark):
    e = edges(spark, ("a.ts", "b.ts"), ("c.ts", "b.ts"))
    gone = spark.createDataFrame([("b.ts",)], "file string")
    staged = spark.createDataFrame([("c.ts",)], "file string")
    line = spark.createDataFrame([("c.ts", 1, "import x from './b'"), ("c.ts", 2, "b()")], "file string, line int, text string")
    assert sorted(map(tuple, graph.delete_refusals(e, gone, staged, line).collect()), key=str) == [("b.ts", "a.ts", None), ("b.ts", "c.ts", 1)]


def test_definition_edges(spark):
    rows = [("m", 1, "S", True), ("a", 0, "S", False), ("z", 2, "S", True), ("m", 1, "S", False), ("a", 0, "T", False)]
    assert sorted(map(tuple, graph.definition_edges(spark.createDataFrame(rows, "doc string, ord int, symbol string, is_def boolean")).collect())) == [("a", "m")]


CHUNKS = "row_id long, file string, name string, kind string, start_line int, end_line int"


def corpus(spark, files, vectors, symbols, pairs):
    d = spark.createDataFrame([(i, f, "p", t) for i, (f, t) in enumerate(files)], "id long, file string, pkg string, text string")
    c = spark.createDataFrame([(i, f, f, "function", 1, 2) for i, (f, _) in enumerate(files)], CHUNKS)
    v = spark.createDataFrame(list(enumerate(vectors)), "row_id long, embedding array<float>")
    s = spark.createDataFrame(symbols, SYMBOLS)
    packages = spark.createDataFrame([("p", "", None, [])], "name string, dir string, role string, deps array<string>")
    return {"docs": d, "chunks": c, "vectors": v, "symbols": s, "packages": packages, "edges": edges(spark, *pairs)}


def test_exact_definition_beats_hub(spark):
    parts = corpus(spark, [("leaf.ts", "resolve anchor"), ("hub.ts", "hub"), ("a.ts", "a thing"), ("b.ts", "b thing")], [[0.0, 1.0], [0.1, 0.9], [1.0, 0.0], [0.9, 0.1]], [("leaf.ts#resolveAnchor", "resolveAnchor", "function", "leaf.ts", "p", 1, 2)], [("a.ts", "hub.ts"), ("b.ts", "hub.ts")])
    asked = spark.createDataFrame([(0, "where is resolveAnchor", [1.0, 0.0])], "query_id int, text string, query_vector array<float>")
    rows = retrieve.retrieve(**parts, queries=asked, config=Config(top_n=2)).orderBy(F.desc("score")).collect()
    assert rows[0]["file"] == "leaf.ts"


def test_seed_and_expansion(spark):
    parts = corpus(spark, [("a.ts", "alpha"), ("b.ts", "bravo"), ("c.ts", "charlie")], [[1.0, 0.0], [0.0, 1.0], [0.0, 1.0]], [], [("b.ts", "a.ts")])
    asked = spark.createDataFrame([(0, "alpha", [1.0, 0.0])], "query_id int, text string, query_vector array<float>")
    rows = retrieve.retrieve(**parts, queries=asked, config=Config(top_n=1)).collect()
    assert {r["file"]: r["reason"] for r in rows} == {"a.ts": "query-match", "b.ts": "imports-seed"}
    a = next(r for r in rows if r["file"] == "a.ts")
    assert a["pkg"] == "p" and a["whole_file"] and a["symbols"][0]["name"] == "a.ts"
    assert len(retrieve.render_summary(retrieve.retrieve(**parts, queries=asked, config=Config(top_n=1))).collect()) == 2


def test_evaluate(spark):
    ranked = spark.createDataFrame([(c, f, i + 1) for c in range(3) for i, f in enumerate("abc")], "case_id int, file string, rank int")
    expected = spark.createDataFrame([(0, "b"), (1, "c"), (2, "z")], "case_id int, file string")
    got = {r["case_id"]: (r["hit"], r["rr"]) for r in retrieve.evaluate(ranked, expected, 2).collect()}
    assert got == {0: (True, 0.5), 1: (False, pytest.approx(1 / 3)), 2: (False, 0.0)}
    assert retrieve.summary(retrieve.evaluate(ranked, expected, 2)).first()["mrr"] == pytest.approx((0.5 + 1 / 3) / 3, abs=1e-6)


def test_architecture(spark):
    files = [f"features/{d}/{n}" for d in ("auth", "bids", "users") for n in (f"{d}.controller.ts", f"{d}.service.ts", "index.ts")] + ["README.md"]
    nodes = {r["dir"]: r for r in arch.architecture(spark.createDataFrame([(f,) for f in files], "path string")).collect()}
    assert set(nodes) == {"", "features", "features/auth", "features/bids", "features/users"}
    assert nodes["features"]["template"] == [".controller.ts", ".service.ts", "index"] and nodes["features"]["module_count"] == 3 and nodes["features"]["files"] == 0
    frame = spark.createDataFrame([(f,) for f in files], "path string")
    said = [r["line"] for r in arch.format_architecture(arch.architecture(frame), "features").collect()]
    assert said[0].startswith("features/  (0 files: )") and "3 sub-modules, each ~ { .controller.ts, .service.ts, index }" in said[0]
    with pytest.raises(ValueError):
        arch.architecture(frame, max_files=3)


def test_differences(spark):
    kinds = "file string, code int, message string, line int, ord int"
    before = spark.createDataFrame([("a", 1, "m", 3, 0)], kinds)
    after = spark.createDataFrame([("a", 1, "m", 5, 0), ("a", 1, "m", 9, 1), ("b", 1, None, 9, 2)], kinds)
    got = diff.new_instances(before, after, ["file", "code", "message"], ["ord"])
    assert sorted(r["ord"] for r in got.collect()) == [1, 2]
    assert diff.one_per_line(after.withColumn("line", F.lit(1))).count() == 2
    old, new = (spark.createDataFrame(list(x.items()), "path string, hash string") for x in ({"a": "1", "b": "1", "c": "1", "//m": "1"}, {"a": "1", "b": "2", "d": "1"}))
    states = {r["path"]: r["state"] for r in diff.fingerprint_diff(old, new).collect()}
    assert states == {"b": "changed", "c": "missing", "d": "added"}
    seen = spark.createDataFrame([("c", "1")], "path string, hash string")
    assert {r["path"] for r in diff.fingerprint_diff(old, new, seen).collect()} == {"b", "d"}
    assert diff.drift_reason(diff.fingerprint_diff(old, new)).first()["reason"] == "1 file(s) added (e.g. d), 1 file(s) changed (e.g. b), 1 file(s) removed/unreadable (e.g. c)"
    assert diff.drift_reason(diff.fingerprint_diff(old, old)).first()["reason"] is None


def test_edit_order(spark):
    ops = [(0, 0, True, "f", 3), (0, 1, True, "f", 9), (0, 2, False, "f", 0), (0, 3, True, "f", 1), (0, 4, True, "e", 5)]
    got = diff.edit_order(spark.createDataFrame(ops, "batch int, idx int, structural boolean, file string, start_line int")).orderBy("position").collect()
    assert [r["idx"] for r in got] == [1, 0, 2, 4, 3]


def test_intervals(spark):
    nodes = spark.createDataFrame([("f", "C", 1, 9, 0), ("f", "C.m", 3, 5, 1), ("f", "C.m2", 3, 5, 2)], "file string, node_id string, start_line int, end_line int, ord int")
    points = spark.createDataFrame([("f", 4), ("f", 8), ("f", 20)], "file string, line int")
    assert {r["line"]: r["node_id"] for r in intervals.innermost(points, nodes).collect()} == {4: "C.m2", 8: "C", 20: None}
    comment = spark.createDataFrame([("C.m", 2, 2)], "node_id string, start_line int, end_line int")
    above = spark.createDataFrame([("f", 2), ("f", 4)], "file string, line int")
    assert {r["line"]: r["node_id"] for r in intervals.enclosing_anchor(above, nodes, comment).collect()} == {2: "C.m", 4: "C.m"}
    ranges = spark.createDataFrame([("f", 2, 9), ("f", 3, 5), ("f", 9, 12), ("f", 11, 14)], "file string, start int, end int")
    assert sorted((r["start"], r["end"]) for r in intervals.outermost(ranges).collect()) == [(2, 9), (9, 12)]
    texts = spark.createDataFrame([("f", "0123456789abcdef"), ("g", "xyz")], "file string, text string")
    assert {r["file"]: r["text"] for r in intervals.elide(texts, ranges, "_").collect()} == {"f": "01__cdef", "g": "xyz"}
    rows = [("f", 1, True, None), ("f", 2, False, None), ("f", 3, True, None), ("f", 4, True, None), ("f", 5, False, 7), ("f", 6, False, 8)]
    got = intervals.leading_comments(spark.createDataFrame(rows, "file string, line int, is_comment boolean, node_ord int")).collect()
    assert [tuple(r) for r in got] == [("f", 7, 3, 4)]
    ids = spark.createDataFrame([("f", "a", 0), ("f", "a", 1), ("f", "b", 2), ("g", "a", 3)], "file string, name string, ord int")
    assert [r["unique_id"] for r in intervals.dedupe_ids(ids, ["file"], "name", ["ord"]).orderBy("ord").collect()] == ["a", "a~1", "b", "a"]
    decoded = spark.createDataFrame([([4, 1, 9],), ([4, 1, 6, 2],), ([1],)], "r array<int>").select(intervals.decode_range(F.col("r")).alias("d")).collect()
    assert [r["d"] and tuple(r["d"]) for r in decoded] == [(5, 5, 1, 9), (5, 7, 1, 2), None]


def test_reanchor(spark):
    nodes = spark.createDataFrame([("f", "a", "f#a", 10), ("f", "a", "f#a~1", 30), ("f", "b", "f#b", 5)], "file string, name string, node_id string, start_line int")
    found = spark.createDataFrame([("f", "a", 29, 33), ("f", "a", 12, 15)], "file string, name string, start_line int, end_line int")
    assert {r["node_id"]: r["start_line"] for r in intervals.reanchor(nodes, found).collect()} == {"f#a": 12, "f#a~1": 29}


def files(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, text string")


def graph_of(spark, tree, language):
    return sorted(map(tuple, imports.import_graph(files(spark, tree), language).collect()))


def test_imports(spark):
    assert graph_of(spark, {"src/a.ts": "import x from './b.js'\nimport y from 'react'\nconst z = require('../lib')\nexport * from './c'", "src/b.ts": "", "lib/index.ts": "", "src/c/index.tsx": "", "src/c.ts": ""}, "ts") == [("src/a.ts", "lib/index.ts"), ("src/a.ts", "src/b.ts"), ("src/a.ts", "src/c.ts")]
    assert graph_of(spark, {"a.py": "import pkg.mod\nfrom . import b\ndef f():\n    from pkg import sub\n", "b.py": "", "src/pkg/mod.py": "", "src/pkg/__init__.py": "", "src/pkg/sub.py": "", "src/pkg/x.py": "from ..pkg import mod\nfrom .... import q"}, "python") == [("a.py", "b.py"), ("a.py", "src/pkg/__init__.py"), ("a.py", "src/pkg/mod.py"), ("a.py", "src/pkg/sub.py"), ("src/pkg/x.py", "src/pkg/__init__.py"), ("src/pkg/x.py", "src/pkg/mod.py")]
    java = {"src/main/java/a/A.java": "package a;\nimport b.B;\nimport static b.C.m;\nimport d.*;\n", "src/main/java/b/B.java": "package b;", "src/main/java/b/C.java": "package b;", "src/main/java/d/D.java": "package d;", "src/main/java/d/E.java": "package d;"}
    assert [d for _, d in graph_of(spark, java, "java")] == [f"src/main/java/{x}.java" for x in ("b/B", "b/C", "d/D", "d/E")]
    rust = {"src/lib.rs": "mod a;\nuse crate::b::{c::Thing, self};", "src/a.rs": "use super::b::c;\nuse std::io;", "src/b/mod.rs": "mod c;", "src/b/c.rs": ""}
    assert graph_of(spark, rust, "rust") == [("src/a.rs", "src/b/c.rs"), ("src/b/mod.rs", "src/b/c.rs"), ("src/lib.rs", "src/a.rs"), ("src/lib.rs", "src/b/c.rs"), ("src/lib.rs", "src/b/mod.rs")]
    assert graph_of(spark, {"a.go": 'import "fmt"'}, "go") == []


def test_longest_prefix_is_exclusive(spark):
    uses = spark.createDataFrame([("x.php", "App\\Domain\\User"), ("x.php", "App\\Kernel")], "src string, name string")
    roots = spark.createDataFrame([("App", "src/", 0), ("App\\Domain", "domain/", 0)], "prefix string, root string, ord int")
    tree = files(spark, {"src/Domain/User.php": "", "src/Kernel.php": "", "x.php": ""})
    assert [tuple(r) for r in imports.psr4_edges(uses, roots, tree).collect()] == [("x.php", "src/Kernel.php")]
    named = imports.qualified_names(files(spark, {"src/Domain/User.php": "", "domain/A/B.php": ""}), roots, ".php", "\\")
    assert {r["path"]: r["name"] for r in named.collect()} == {"src/Domain/User.php": "App\\Domain\\User", "domain/A/B.php": "App\\Domain\\A\\B"}


def test_php_graph(spark):
    text = "<?php\nnamespace App;\n// use App\\Not;\nuse App\\Domain\\User as U, App\\Kernel;\nuse App\\{ Http\\Call, function App\\run };\nuse function App\\go;\nuse Plain;\nclass A { use SomeTrait; function f() { return function () use ($x) { return 'use App\\Str;'; }; } }\nuse \\App\\Last;\n"
    assert imports.php_uses(text) == ["App\\Domain\\User", "App\\Kernel", "App\\Http\\Call", "App\\App\\run", "App\\go", "Plain", "App\\Last"]
    assert imports.php_uses("<?php namespace A { use B\\C; function f() {} } namespace D { use E; }") == ["B\\C", "E"]
    assert imports.php_uses("") == [] and imports.php_uses("<?php use ;") == []
    roots = spark.createDataFrame([("App", "src", 0), ("App", "lib", 1), ("App\\Domain", "domain", 0), ("", "any", 0), ("App\\Kernel", "kernel", 0)], "prefix string, root string, ord int")
    tree = {"src/a.php": text, "src/Kernel.php": "", "lib/Kernel.php": "", "lib/Last.php": "", "src/Domain/User.php": "", "any/Plain.php": "", "any/App/go.php": "", "src/Http/Call.php": ""}
    got = imports.import_graph(files(spark, tree), "php", roots)
    # the longest prefix owns User and has no such file; a prefix itself names no class; the first root wins
    assert sorted(r["dst"] for r in got.collect()) == ["any/Plain.php", "lib/Last.php", "src/Http/Call.php", "src/Kernel.php"]
    assert imports.import_graph(files(spark, tree), "php").count() == 0


def test_hits_by_group(spark):
    from tessera.operators import retrieve

    ranked = spark.createDataFrame([("a", 1, "x", 1), ("a", 2, "y", 6), ("b", 2, "y", 5), ("b", 1, "q", 1)], "arm string, case_id int, file string, rank int")
    expected = spark.createDataFrame([(1, "x", "py"), (1, "z", "py"), (2, "y", "rs")], "case_id int, file string, lang string")
    got = retrieve.hits_by(ranked, expected, "lang", ["a", "b"], 5)
    assert sorted(map(tuple, got.collect())) == [("py", "a", 1, 1), ("py", "b", 0, 1), ("rs", "a", 0, 1), ("rs", "b", 1, 1)]


def test_ranking_from_stored_postings(spark):
    from tessera.operators import lexical

    texts = ["alpha beta gamma", "beta beta delta", "", None, "gamma alphaBeta", "the of and", "delta " * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame([(1, "beta gamma"), (2, "delta of the"), (3, "nothing")], "query_id int, text string")
    want = sorted(map(tuple, lexical.bm25(docs, asked, 5).select("query_id", "id", "score", "rank").collect()))
    stored = lexical.postings(docs)
    assert want and sorted(map(tuple, lexical.bm25_posted(stored, docs, asked, 5).select("query_id", "id", "score", "rank").collect())) == want


def test_passages_are_found_whole(spark):
    from tessera.operators import retrieve

    texts = ["x the quick brown fox y", "xthe quick brown foxy", "the quick  brown fox", "quick", "", None]
    passages = ["the quick brown fox", "quick", "ick br", "", "absent words here now"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = spark.createDataFrame(list(enumerate(passages)), "case_id long, passage string")
    want = {(c, d) for c, p in enumerate(passages) for d, t in enumerate(texts) if t is not None and p in t}
    got = [tuple(r) for r in retrieve.holders(docs, asked).select("case_id", "id").collect()]
    assert set(got) == want and len(got) == len(want)


def test_fnv1a_of_any_bytes(spark):
    from tessera.functions.hashing import fnv1a, fnv1a_bytes

    texts = ["", "a", "foobar", "déjà 日本 🙂", "x" * 500, None]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fnv1a("t").alias("h"))
    assert {r["i"]: r["h"] for r in frame.collect()} == {i: None if t is None else fnv1a_bytes(t.encode()) for i, t in enumerate(texts)}
