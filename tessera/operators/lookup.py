"""Looking things up in an index: symbols, files, nodes, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tessera.config import Config
from tessera.functions.text import lines, query_name_tokens, slice_lines
from tessera.operators import arch, dense, retrieve
from tessera.operators.structure import Places, file_top

MODES = ["search", "symbol", "file", "node", "map"]


def file_of(node_id: str) -> str:
    return node_id.split("#", 1)[0]


def leaf_of(node_id: str) -> str:
    """The last part of an id's name, without a part of the node."""
    return node_id.split("#", 1)[-1].split(":", 1)[0].rsplit(".", 1)[-1]


def leaf(column):
    name = F.element_at(F.split(column, "#"), -1)
    return F.element_at(F.split(F.element_at(F.split(name, ":"), 1), r"\."), -1)


def nodes_named(nodes: DataFrame, file: str, name: str) -> DataFrame:
    """Nodes of a file with exactly this name, in order."""
    return nodes.where((F.col("file") == file) & (F.col("name") == name)).orderBy("ord")


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where((F.col("file") == file_of(node_id)) & (F.col("node_id") == node_id))


def resolve(nodes: DataFrame, reference: str, path: str | None = None, cap: int = Config().candidate_ids) -> DataFrame:
    """node_id, tier: what a reference may mean, only the best tier: the id
    itself, a name in the file, a name anywhere, and else suggestions: the same
    last part, then a part of it."""
    wanted = leaf_of(reference)
    symbols = nodes.where("is_symbol")
    here = F.col("file") == (path if path is not None else "")
    tier = (
        F.when(F.col("node_id") == reference, 0)
        .when(here & (F.col("name") == reference), 1)
        .when(F.col("name") == reference, 2)
        .when(leaf(F.col("node_id")) == wanted, 3)
        .when(F.contains(F.lower(leaf(F.col("node_id"))), F.lit(wanted.lower())), 4)
    )
    rows = (nodes if "#" in reference else symbols).select("node_id", "file", "ord", tier.alias("tier")).where("tier is not null")
    best = rows.crossJoin(rows.agg(F.min("tier").alias("_best")))
    return best.where("tier = _best").drop("_best").orderBy("tier", "file", "ord").limit(cap).select("node_id", "tier")


def viable(candidates: DataFrame, nodes: DataFrame, files: DataFrame, needle: str) -> DataFrame:
    """The candidates whose lines hold ``needle``."""
    held = candidates.join(nodes.select("node_id", "file", "start_line", "end_line"), "node_id").join(files.select(F.col("path").alias("file"), "text"), "file")
    return held.where(F.contains(slice_lines(F.col("text"), F.col("start_line"), F.col("end_line")), F.lit(needle))).select("node_id")


def containing(nodes: DataFrame, files: DataFrame, path: str, needle: str) -> DataFrame:
    """The innermost top-level symbols of a file whose text holds ``needle``."""
    from tessera.operators.intervals import without_inner

    top = nodes.where((F.col("file") == path) & F.col("is_symbol") & (F.col("depth") == 0))
    hits = top.join(viable(top.select("node_id"), nodes, files, needle), "node_id").select("file", "node_id", "start_line", "end_line")
    return without_inner(hits)


def resolve_query(index, query: str, config: Config = Config()) -> DataFrame:
    """name, id: symbols that a query's words name; without any, those of the
    best two files that retrieval finds."""
    spark = index.symbols.sparkSession
    asked = spark.createDataFrame([(query,)], "text string")
    words = asked.select(F.explode(query_name_tokens(F.col("text"))).alias("_w"))
    named = index.symbols.join(words, F.lower("name") == F.col("_w"), "left_semi").select("name", "id")
    if not named.isEmpty():
        return named.orderBy("id")
    found = search(index, query, config.merged({"top_n": 3}))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file")
    best = found.withColumn("_k", F.row_number().over(order)).where("_k <= 2")
    return index.symbols.join(best.select("file"), "file", "left_semi").select("name", "id").orderBy("id")


def files_defining(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name).select("file").distinct().orderBy("file")


def read_node(nodes: DataFrame, files: DataFrame, node_id: str) -> DataFrame:
    """node_id, start_line, end_line, text of one node."""
    one = node_by_id(nodes, node_id).join(files.select(F.col("path").alias("file"), "text"), "file")
    return one.select("node_id", "start_line", "end_line", slice_lines(F.col("text"), F.col("start_line"), F.col("end_line")).alias("text"))


def exact_extent(text: str, start: tuple[int, int], end: tuple[int, int]) -> str | None:
    """The characters between two places (line, byte column); None if a place
    is outside the text."""
    places = Places(text)
    a, b = places.offset(*start), places.offset(*end)
    return text[a:b] if a is not None and b is not None and a <= b else None


def list_anchors(index, path: str, config: Config = Config()) -> DataFrame:
    """k, line: who imports a file, its import lines, its tree of symbols; a
    short file without symbols is shown whole."""
    importers = index.edges.where(F.col("dst") == path).agg(F.concat(F.lit("imported by: "), F.array_join(F.array_sort(F.collect_set("src")), ", ")).alias("line"), F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(0).alias("part"), F.lit(0).alias("at"), "line")
    top = file_top(index.files.where(F.col("path") == path)).select(F.lit(1).alias("part"), F.col("line").alias("at"), F.col("text").alias("line"))
    mine = index.nodes.where((F.col("file") == path) & F.col("is_symbol"))
    tree = mine.select(F.lit(2).alias("part"), F.col("ord").alias("at"), F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.lit(" "), F.coalesce("name", F.lit("?")), F.lit(" L"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit("  "), F.col("node_id")).alias("line"))
    bare = index.files.where(F.col("path") == path).join(mine.select("file").distinct(), F.col("path") == F.col("file"), "left_anti").where(F.size(F.split("text", "\n")) <= config.whole_file_lines)
    whole = bare.select(F.posexplode(lines(F.col("text"))).alias("at", "line")).select(F.lit(3).alias("part"), "at", "line")
    return importers.unionByName(top).unionByName(tree).unionByName(whole).orderBy("part", "at").select("line")


def search(index, task: str, config: Config = Config(), dims: int = 64) -> DataFrame:
    """The manifest of one task over an index of chunks."""
    spark: SparkSession = index.files.sparkSession
    asked = spark.createDataFrame([(0, task)], "query_id int, text string")
    vector = dense.embed(asked, "query_id", "text", dims).select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    docs = index.chunks.select(F.col("row_id").alias("id"), "file", "pkg", "text")
    return retrieve.retrieve(docs, index.chunks, index.vectors, index.symbols, index.packages, index.edges, asked.join(vector, "query_id"), config, index.postings)


def inspect(index, mode: str, config: Config = Config(), **args) -> DataFrame:
    """One of five ways to look at an index; any other mode is refused."""
    if mode == "search":
        return search(index, args["query"], config)
    if mode == "symbol":
        return retrieve.find_symbols(index.symbols, args["query"], index.packages, args.get("substring", False), args.get("cap"), config)
    if mode == "file":
        return list_anchors(index, args["path"], config)
    if mode == "node":
        return read_node(index.nodes, index.files, args["id"])
    if mode == "map":
        nodes = arch.architecture(index.files, "path", config.arch_files)
        return arch.format_architecture(nodes, args.get("path"))
    raise ValueError(f"unknown mode {mode!r}; one of {', '.join(MODES)}")


def detailed(manifest: DataFrame, files: DataFrame, level: str = "full", entries: int = 4, most_lines: int = 100) -> DataFrame:
    """query_id, file, detail, text: code of the first entries, cut to a number
    of lines; of the others a pointer. At level "outline" bodies are left out, at
    "full" only those of files that the query itself did not match; "pointers"
    has no code."""
    if level not in ("pointers", "outline", "full"):
        raise ValueError(f"unknown level {level!r}; one of pointers, outline, full")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "file")
    whole = (F.col("reason") == "query-match") if level == "full" else F.lit(False)
    kind = F.when(F.col("_k") > (0 if level == "pointers" else entries), "pointer").when(whole, "full").otherwise("outline")
    ranked = manifest.withColumn("_k", F.row_number().over(order)).select("query_id", "file", kind.alias("detail"))
    pointers = ranked.where("detail = 'pointer'").withColumn("text", F.lit(None).cast("string"))
    texts = files.select(F.col("path").alias("file"), F.col("text").alias("_t"))
    code = slice_lines(F.col("text"), F.lit(1), F.lit(most_lines)).alias("text")
    shown = _outlined(ranked.where("detail != 'pointer'").join(texts, "file", "left").select("query_id", "file", "detail", F.col("_t").alias("text")))
    return shown.select("query_id", "file", "detail", code).unionByName(pointers)


def _outlined(rows: DataFrame) -> DataFrame:
    from tessera.operators.structure import outline

    def run(batches):
        for batch in batches:
            batch["text"] = [outline(p, t) if d == "outline" and t is not None else t for p, d, t in zip(batch["file"], batch["detail"], batch["text"])]
            yield batch

    return rows.mapInPandas(run, rows.schema)
