"""The registered queries: each applies operators to the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.corpus import Corpus
from tessera.functions.hashing import fnv1a
from tessera.functions.paths import base_name, parent, path_role
from tessera.functions.text import occurrences, slice_lines, tokens
from tessera.operators import arch, dense, diff, graph, imports, intervals, lexical, rank, retrieve, weight

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Callable[[Corpus], DataFrame]) -> Callable[[Corpus], DataFrame]:
    """Register ``f`` under its name, called with the tables of a folder."""
    QUERIES[f.__name__] = lambda spark, folder: f(Corpus(spark, folder))
    return f


def shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6))


# lexical


@query
def tokens_per_doc(c: Corpus) -> DataFrame:
    t = tokens(F.col("text"))
    return c.documents.select(F.col("id").alias("doc_id"), F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_terms"))


@query
def term_df(c: Corpus) -> DataFrame:
    return lexical.term_df(c.documents)


@query
def doc_stats(c: Corpus) -> DataFrame:
    return lexical.doc_stats(c.documents).withColumn("avgdl", F.round("avgdl", 6))


@query
def bm25_single(c: Corpus) -> DataFrame:
    one = c.queries.agg(F.concat_ws(" ", F.collect_list("text")).alias("text")).select(F.lit(0).alias("query_id"), "text")
    return shown(lexical.bm25(c.documents, one, 10)).select(F.col("id").alias("doc_id"), "score", "rank")


@query
def bm25_batch(c: Corpus) -> DataFrame:
    return shown(lexical.bm25(c.documents, c.queries, 10)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query
def bm25_after_delete(c: Corpus) -> DataFrame:
    gone = c.documents.where("source = 'src3'").select("id")
    return shown(lexical.bm25(lexical.remove_docs(c.documents, gone, "id"), c.queries, 10)).select("query_id", F.col("id").alias("doc_id"), "score", "rank")


@query
def word_scan(c: Corpus) -> DataFrame:
    return lexical.scan_word(c.files.select(F.col("file").alias("path"), "text"), "the").select("path", "line")


# dense


@query
def vector_topk(c: Corpus) -> DataFrame:
    one = c.vector_queries.where("query_id = 0")
    return shown(dense.rank_vectors(c.vectors, one, 10)).select("id", "score", "rank")


@query
def vector_batch(c: Corpus) -> DataFrame:
    return shown(dense.rank_vectors(c.vectors, c.vector_queries, 10)).select("query_id", "id", "score", "rank")


@query
def vector_bulk(c: Corpus) -> DataFrame:
    return shown(dense.rank_vectors_bulk(c.vectors, c.vector_queries, 10)).select("query_id", "id", "score", "rank")


# ranking


@query
def first_per_group_rank(c: Corpus) -> DataFrame:
    near = dense.rank_vectors(c.vectors, c.vector_queries, 80)
    return rank.first_per_group(near.join(c.vectors.select(F.col("row_id").alias("id"), "label"), "id"), "label")


@query
def symbol_match(c: Corpus) -> DataFrame:
    part = c.table("part").where("p_partkey % 20 = 0")
    asked = part.select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("where is "), "p_name", F.lit(" and the old "), "p_type").alias("text"))
    return rank.symbol_matches(c.symbols, asked)


def _hybrid(c: Corpus) -> dict[str, DataFrame]:
    asked = c.queries.join(c.vectors.select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector")), "query_id")
    return {"docs": c.files, "chunks": c.chunks, "vectors": c.vectors, "symbols": c.symbols, "packages": c.packages, "queries": asked}


@query
def rrf_fusion(c: Corpus) -> DataFrame:
    h = _hybrid(c)
    near = dense.rank_vectors_bulk(h["vectors"], h["queries"], 80)
    by_vector = rank.first_per_group(near.join(h["chunks"].select(F.col("row_id").alias("id"), "file"), "id"), "file")
    by_words = rank.first_per_group(lexical.bm25(h["docs"], h["queries"], 80).join(h["docs"].select("id", "file"), "id"), "file")
    named = rank.symbol_matches(h["symbols"], h["queries"])
    by_name = rank.top_n(named.select("query_id", "file", "score"), 1 << 30, ["query_id"], [F.desc("score"), F.asc("file")])
    return shown(rank.reciprocal_rank_fusion([by_vector, by_words, by_name], "file"))


@query
def weighted_fusion(c: Corpus) -> DataFrame:
    return shown(retrieve.fused_weights(**_hybrid(c))[0])


@query
def manifest(c: Corpus) -> DataFrame:
    rows = retrieve.retrieve(edges=c.file_edges, **_hybrid(c))
    return rows.select("query_id", "file", "pkg", F.round("score", 6).alias("score"), "reason", "whole_file", F.size("symbols").alias("n_symbols"))


@query
def find_symbols_exact(c: Corpus) -> DataFrame:
    name = c.symbols.agg(F.min(F.lower("name"))).first()[0]
    return retrieve.find_symbols(c.symbols, name).select("id", "name", "exact", "total")


@query
def find_symbols_substring(c: Corpus) -> DataFrame:
    return retrieve.find_symbols(c.symbols, "blue", substring=True).select("id", "name", "exact", "total")


@query
def eval_mrr(c: Corpus) -> DataFrame:
    ranked = lexical.bm25(c.documents, c.queries, 10).select(F.col("query_id").alias("case_id"), F.col("id").alias("file"), "rank")
    passages = c.queries.select(F.col("query_id").alias("case_id"), F.col("text").alias("passage"))
    holding = retrieve.holders(c.documents, passages).select("case_id", F.col("id").alias("file"))
    return retrieve.summary(retrieve.evaluate(ranked, holding, 5))


@query
def hits_by_language(c: Corpus) -> DataFrame:
    """Of the cases of each language, how many have an expected document among
    the first five, when all documents are ranked and when only English ones are."""
    docs, asked = c.documents, c.queries
    passages = asked.select(F.col("query_id").alias("case_id"), F.col("text").alias("passage"))
    expected = retrieve.holders(docs, passages).select("case_id", F.col("id").alias("file")).join(docs.select(F.col("id").alias("file"), "lang"), "file")
    arms = {"multi": docs, "single": docs.where("lang = 'en'")}
    ranked = [lexical.bm25(d, asked, 5).select(F.lit(arm).alias("arm"), F.col("query_id").alias("case_id"), F.col("id").alias("file"), "rank") for arm, d in arms.items()]
    return retrieve.hits_by(ranked[0].unionByName(ranked[1]), expected, "lang", list(arms), 5)


@query
def jaccard_overlap(c: Corpus) -> DataFrame:
    near = dense.rank_vectors(c.vectors, c.vector_queries, 20).select("query_id", "id")
    asked = c.vectors.where("row_id % 20 = 0").select(F.col("row_id").alias("query_id"), "label")
    alike = asked.join(c.vectors.select(F.col("row_id").alias("id"), "label"), "label").select("query_id", "id")
    return retrieve.overlap(near, alike, "query_id", "id").withColumn("jaccard", F.round("jaccard", 6))


# weights and roles


@query
def layer_multipliers(c: Corpus) -> DataFrame:
    asked = c.spark.createDataFrame([(1, "add a database migration"), (2, "renderScreen navigation and routes"), (3, "nothing here"), (4, "typed helpers in pages, serverless apiKey")], "query_id int, text string")
    return weight.layer_multipliers(asked).withColumn("mult", F.round("mult", 6))


def _roles(c: Corpus) -> DataFrame:
    p = c.table("part")
    pick = lambda column, values: F.element_at(F.array(*values), (column + 1).cast("int"))
    names = [F.lit(x) for x in ("services/api", "web-ui", "Common-types", "infra", "Mobile", "sql", "docs", "lambda")]
    deps = [F.array(*map(F.lit, x)) if x else F.array().cast("array<string>") for x in (["zod", "react-dom"], ["express"], [], ["@nestjs/core", "expo"], ["vue-router", "left-pad"])]
    stored = [F.lit(x).cast("string") for x in ("unknown", None, "backend", "docs")]
    return p.select("p_partkey", pick(F.col("p_partkey") % 8, names).alias("name"), F.concat(F.lit("x/"), F.lower("p_name")).alias("dir"), pick(F.col("p_size") % 5, deps).alias("deps"), pick(F.col("p_partkey") % 4, stored).alias("role"))


@query
def inferred_roles(c: Corpus) -> DataFrame:
    inferred = weight.infer_role(F.col("name"), F.col("dir"), F.col("deps"))
    return _roles(c).select("p_partkey", weight.role_from_dependencies(F.col("deps")).alias("by_deps"), weight.role_from_name(F.col("name"), F.col("dir")).alias("by_name"), inferred.alias("inferred"), weight.resolve_role(F.col("role"), inferred).alias("resolved"))


@query
def path_roles(c: Corpus) -> DataFrame:
    return c.paths.select(F.col("id").alias("page_id"), "path", path_role(F.col("path")).alias("role"))


@query
def package_owner(c: Corpus) -> DataFrame:
    p = c.paths
    homes = p.select(parent(F.col("path")).alias("dir")).unionByName(p.select(F.regexp_extract("path", "^[^/]*", 0).alias("dir"))).unionByName(c.spark.createDataFrame([("",)], "dir string")).distinct()
    owned = weight.package_owner(p, homes.withColumn("name", F.concat(F.lit("pkg:"), "dir")))
    return owned.select(F.col("id").alias("page_id"), "path", "pkg")


# graphs


@query
def reverse_edges(c: Corpus) -> DataFrame:
    r = graph.reverse(c.edges)
    return r.select("file", F.size("importers").cast("long").alias("n_importers"), F.array_join("importers", ",").alias("importers"))


@query
def reverse_pairs(c: Corpus) -> DataFrame:
    return graph.reverse_pairs(c.edges)


@query
def union_graphs(c: Corpus) -> DataFrame:
    both = graph.union_graphs(c.spark, [c.edges, c.file_edges, c.edges.limit(0)])
    return both.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("least"))


@query
def delete_refusals(c: Corpus) -> DataFrame:
    suppliers = c.table("supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"))
    staged = c.table("part").where("p_partkey % 3 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("file"))
    held = F.concat(F.lit("import s"), (F.substring("file", 2, 20).cast("int") % 7).cast("string"))
    return graph.delete_refusals(c.edges, suppliers, staged, staged.select("file", F.lit(3).alias("line"), held.alias("text")))


@query
def transitive_closure(c: Corpus) -> DataFrame:
    starts = c.table("region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("start"))
    return graph.closure(c.edges, starts)


@query
def expand_hops(c: Corpus) -> DataFrame:
    seeds = c.table("nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"))
    return graph.expand(c.edges, seeds, 2)


@query
def seed_adjacency(c: Corpus) -> DataFrame:
    seeds = c.table("nation").select(F.col("n_regionkey").alias("query_id"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"))
    return graph.seed_adjacency(c.edges, seeds)


@query
def graph_overlay(c: Corpus) -> DataFrame:
    s = c.table("supplier")
    moved = F.concat(F.lit("n"), ((F.col("s_nationkey") + 1) % 25).cast("string"))
    changes = s.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("file"), F.when(F.col("s_suppkey") % 3 != 0, F.array(moved)).alias("targets"))
    return graph.overlay(c.edges, changes).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


@query
def blast_radius(c: Corpus) -> DataFrame:
    changed = c.table("nation").where("n_regionkey = 1").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("file"))
    return graph.blast_radius(c.edges, changed, semantic=False)


@query
def definition_owner_edges(c: Corpus) -> DataFrame:
    occurrences_ = c.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_orderkey").alias("ord"), F.col("l_partkey").alias("symbol"), (F.col("l_linenumber") == 1).alias("is_def"))
    name = lambda k: F.concat(F.lit("d"), F.col(k).cast("string")).alias(k)
    return graph.definition_edges(occurrences_).select(name("src"), name("dst"))


# imports and paths


@query
def resolve_first_candidate(c: Corpus) -> DataFrame:
    p = c.paths.select("id", "path", parent(F.col("path")).alias("dir"), F.regexp_replace(base_name(F.col("path")), r"\.html$", "").alias("name"))
    near = F.concat_ws("/", "dir", "name")
    wanted = p.select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("src"), F.lit(0).alias("ord"), F.array(near, F.concat(near, F.lit(".html")), F.concat(parent(F.col("dir")), F.lit("/en/"), "name")).alias("candidates"))
    return imports.resolve_first(wanted, c.paths).select("src", "dst")


@query
def longest_prefix_owner(c: Corpus) -> DataFrame:
    p = c.paths
    prefixes = p.select(F.regexp_extract("path", "^[^/]*", 0).alias("prefix")).unionByName(p.where("id % 2 = 0").select(parent(F.col("path")).alias("prefix"))).distinct()
    return imports.longest_prefix(p.select(F.col("path").alias("name")).distinct(), prefixes.withColumn("root", F.lit("")), "/").select("name", "prefix")


@query
def suffix_histogram(c: Corpus) -> DataFrame:
    return arch.suffix_histogram(c.paths)


@query
def top_suffixes(c: Corpus) -> DataFrame:
    return arch.top_suffixes(arch.suffix_histogram(c.paths))


@query
def architecture(c: Corpus) -> DataFrame:
    return arch.architecture(c.paths, max_files=None).select("dir", "files", F.size("suffixes").alias("n_kinds"), "module_count")


@query
def dir_templates(c: Corpus) -> DataFrame:
    folder = F.concat("p_brand", F.lit("/"), F.regexp_replace("p_type", "[^A-Za-z]+", "-"))
    files = c.table("part").select(F.concat(folder, F.lit("/x."), (F.col("p_size") % 6).cast("string"), F.lit(".ts")).alias("path"))
    t = arch.module_templates(arch.suffix_histogram(files))
    return t.select("dir", "module_count", F.array_join("template", ",").alias("template"))


# texts, ranges and differences


@query
def line_slice(c: Corpus) -> DataFrame:
    return c.documents.select(F.col("id").alias("doc_id"), slice_lines(F.col("text"), F.lit(2), F.lit(4)).alias("slice"))


@query
def unique_occurrence(c: Corpus) -> DataFrame:
    needle = F.concat(F.substring_index("text", " ", 1), F.lit(" "))
    return c.documents.select(F.col("id").alias("doc_id"), occurrences(F.col("text"), needle).alias("n"))


@query
def innermost_interval(c: Corpus) -> DataFrame:
    points = c.table("orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 20).cast("int").alias("line"))
    return intervals.innermost(points, c.nodes)


@query
def enclosing_anchor(c: Corpus) -> DataFrame:
    points = c.table("orders").select(F.col("o_orderkey").alias("file"), (F.col("o_orderkey") % 20).cast("int").alias("line"))
    docs = c.nodes.select("node_id", (F.col("start_line") - 2).alias("start_line"), (F.col("start_line") - 1).alias("end_line"))
    return intervals.enclosing_anchor(points, c.nodes, docs)


@query
def decode_ranges(c: Corpus) -> DataFrame:
    l = c.table("lineitem")  # noqa: E741
    ints = F.slice(F.array(F.col("l_linenumber").cast("int"), (F.col("l_suppkey") % 9).cast("int"), (F.col("l_partkey") % 11).cast("int"), (F.col("l_orderkey") % 13).cast("int")), F.lit(1), (2 + F.col("l_orderkey") % 3).cast("int"))
    found = l.select(intervals.decode_range(ints).alias("r"))
    return found.groupBy("r.start_line", "r.end_line", "r.start_char", "r.end_char").agg(F.count(F.lit(1)).alias("n"))


@query
def leading_comments(c: Corpus) -> DataFrame:
    l = c.table("lineitem").select("l_orderkey", "l_linenumber", "l_returnflag").groupBy(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line")).agg((F.max("l_returnflag") != "R").alias("is_comment"))
    return intervals.leading_comments(l.withColumn("node_ord", F.when(~F.col("is_comment"), F.col("line"))))


@query
def containment(c: Corpus) -> DataFrame:
    kept = intervals.without_inner(c.nodes)
    return kept.select("file", "ord")


@query
def dedupe_ids(c: Corpus) -> DataFrame:
    return intervals.dedupe_ids(c.table("part").select("p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "unique_id")


@query
def elide_outermost(c: Corpus) -> DataFrame:
    start = (F.col("l_linenumber") * 7).cast("int")
    ranges = c.table("lineitem").select(F.col("l_orderkey").alias("file"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))
    return intervals.outermost(ranges)


@query
def fingerprint_diff(c: Corpus) -> DataFrame:
    customers = c.table("customer")
    path = F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("path")
    renamed = F.when(F.col("c_custkey") % 10 == 2, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name"))
    old = customers.where("c_custkey % 10 != 1").select(path, F.md5(F.concat("c_name", "c_mktsegment")).alias("hash"))
    new = customers.where("c_custkey % 10 != 3").select(path, F.md5(F.concat(renamed, "c_mktsegment")).alias("hash"))
    return diff.fingerprint_diff(old, new)


@query
def multiset_new(c: Corpus) -> DataFrame:
    rows = c.table("lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("file"), F.col("l_linenumber").alias("code"), F.concat("l_returnflag", "l_linestatus").alias("message"), F.col("l_orderkey").alias("ord"), (F.col("l_orderkey") % 2).alias("side"))
    return diff.new_instances(rows.where("side = 0").drop("side"), rows.where("side = 1").drop("side"), ["file", "code", "message"], ["ord"])


@query
def line_receipt(c: Corpus) -> DataFrame:
    before = c.documents.select("id", "text")
    numbered = F.transform(F.split("text", "\n"), lambda l, i: F.struct(l.alias("line"), (i + 1).alias("at")))
    last = F.when(F.element_at(numbered, -1)["line"] == "", F.slice(numbered, 1, F.size(numbered) - 1)).otherwise(numbered)
    kept = F.filter(last, lambda x: (x["at"] + F.col("id")) % 7 != 0)
    edited = F.transform(kept, lambda x: F.when((x["at"] + F.col("id")) % 5 == 0, F.concat(x["line"], F.lit(" (edited)"))).otherwise(x["line"]))
    after = before.select("id", F.when(F.size(kept) > 0, F.concat(F.array_join(edited, "\n"), F.lit("\n"))).otherwise("").alias("text"))
    return diff.line_receipt(before, after)


@query
def diag_anchor(c: Corpus) -> DataFrame:
    diags = c.table("orders").select(F.col("o_orderkey").alias("file"), F.lit(1).alias("code"), F.lit("m").alias("message"), (F.col("o_orderkey") % 30).cast("int").alias("line"), F.lit(0).alias("ord"))
    ops = c.nodes.select("file", F.col("ord").alias("idx"), "node_id", "start_line", "end_line")
    return diff.anchor(diags, ops).select("file", "line", "op_index")


@query
def one_per_line(c: Corpus) -> DataFrame:
    diags = c.table("lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_linenumber").alias("line"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    return diff.one_per_line(diags)


@query
def edit_order(c: Corpus) -> DataFrame:
    l = c.table("lineitem")  # noqa: E741
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    ops = l.select(F.col("l_orderkey").alias("batch"), place.alias("idx"), (F.col("l_returnflag") != "R").alias("structural"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("file"), F.col("l_quantity").cast("int").alias("start_line"))
    return diff.edit_order(ops).select("batch", "idx", "position")


# measurements


@query
def bench_medians(c: Corpus) -> DataFrame:
    arm = F.when(F.col("user_id") % 2 == 0, "baseline").otherwise("tool")
    medians = c.table("events").groupBy(F.col("event_type").alias("task"), arm.alias("arm")).agg(F.median("value").alias("median_value"), F.count(F.lit(1)).alias("n"))
    base = medians.where("arm = 'baseline'").select("task", F.col("median_value").alias("_base"))
    change = 100 * (F.col("median_value") - F.col("_base")) / F.col("_base")
    return medians.join(base, "task").select("task", "arm", F.round("median_value", 6).alias("median_value"), "n", F.round(change, 4).alias("percent"))


@query
def read_before_edit(c: Corpus) -> DataFrame:
    turns = c.table("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("_s"),
        F.min(F.when(F.col("role") == "user", F.col("turn"))).alias("_u"),
        F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("_a"),
        F.sum(F.when(F.col("role") == "assistant", 1).otherwise(0)).alias("n_answers"),
    )
    return turns.select("conv_id", "n_turns", F.array_join(F.transform("_s", lambda s: s["role"]), ">").alias("sequence"), F.coalesce(F.col("_u") < F.col("_a"), F.lit(False)).alias("asked_first"), "n_answers")


# beyond SQL


@query
def fnv1a_hash(c: Corpus) -> DataFrame:
    return c.table("customer").select("c_custkey", fnv1a(F.col("c_name")).alias("hash"))


@query
def reanchor_greedy(c: Corpus) -> DataFrame:
    old = c.nodes.select(F.col("file").cast("string").alias("file"), F.concat(F.lit("n"), (F.col("ord") % 2).cast("string")).alias("name"), "node_id", "start_line")
    new = c.nodes.select(F.col("file").cast("string").alias("file"), F.when(F.col("ord") == 1, "moved").otherwise(F.concat(F.lit("n"), (F.col("ord") % 2).cast("string"))).alias("name"), (F.col("start_line") + 1).alias("start_line"), (F.col("end_line") + 1).alias("end_line"))
    return intervals.reanchor(old, new)


#: Literal sources for the queries that need program texts.
SOURCES = {
    "app/main.py": "import os\nfrom app import util\n\n\ndef run(a, b: int = 1) -> int:\n    '''Run.'''\n    return util.add(a, b)\n\n\nclass Job:\n    def start(self, when):\n        return run(when)\n",
    "app/util.py": "def add(a, b):\n    return a + b\n",
    "web/view.ts": "export class View {\n  private n: number = 1;\n  show(x: string): void {\n    console.log(x);\n  }\n}\n",
}


@query
def python_structure(c: Corpus) -> DataFrame:
    from tessera.operators import structure

    files = c.spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    return structure.extract(files)


@query
def edit_batch(c: Corpus) -> DataFrame:
    import json

    from tessera.operators import edit

    files = c.spark.createDataFrame([(b, p, t) for b in (1, 2, 3) for p, t in SOURCES.items()], "batch int, path string, text string")
    ops = [
        (1, 0, {"action": "add_parameter", "path": "app/util.py", "name": "add", "value": "c=0"}),
        (1, 1, {"action": "set_body", "path": "app/util.py", "name": "add", "value": "return a + b + c"}),
        (1, 2, {"action": "insert_member", "path": "web/view.ts", "name": "View", "value": "size = 2;"}),
        (2, 0, {"action": "replace_text", "path": "app/main.py", "name": "run", "oldText": "add(a, b)", "newText": "add(b, a"}),
        (3, 0, {"action": "replace_text", "path": "app/main.py", "name": "nobody", "oldText": "x", "newText": "y"}),
    ]
    return edit.apply_batches(files, c.spark.createDataFrame([(b, i, json.dumps(a)) for b, i, a in ops], "batch int, idx int, action string"))
