"""Lexical search: postings, statistics and BM25, batched by query."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.config import Config
from tessera.functions.text import clip, lines, tokens
from tessera.plans.scratch import kept

#: Scores are rounded before they are ranked, so that the order of a sum's
#: terms never decides a tie.
DIGITS = 9


def tokenised(docs: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns ``keep``, tokens and dl (their number)."""
    out = docs.select(F.col(id_col).alias("id"), *keep, tokens(F.col(text_col)).alias("tokens"))
    return out.withColumn("dl", F.size("tokens").cast("long"))


def postings(docs: DataFrame, id_col: str = "id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """term, id, the columns ``keep``, tf, dl. The counts are combined before
    they are shuffled; a document's terms stay together otherwise."""
    exploded = tokenised(docs, id_col, text_col, keep).select("id", *keep, "dl", F.explode("tokens").alias("term"))
    return exploded.groupBy("term", "id", *keep, "dl").agg(F.count(F.lit(1)).alias("tf"))


def term_df(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """term, df: the documents that hold it. Terms are made distinct within
    each document first, so nothing has to be counted distinct across tasks."""
    exploded = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return exploded.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def doc_stats(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """One row: n_docs (empty ones included), avgdl (0 without documents)."""
    sized = docs.select(F.size(tokens(F.col(text_col))).alias("dl"))
    return sized.agg(F.count(F.lit(1)).alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def remove_docs(docs: DataFrame, removed: DataFrame, on: str) -> DataFrame:
    """``docs`` without those in ``removed``; statistics follow from what is left."""
    return docs.join(removed.select(on).distinct(), on, "left_anti")


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    """query_id, term: each distinct term of each query."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def bm25_scores(docs: DataFrame, queries: DataFrame, config: Config = Config(), id_col: str = "id", text_col: str = "text", query_col: str = "query_id") -> DataFrame:
    """query_id, id, score of every document that holds a term of the query.

    Texts are cut into tokens once: only tokens that some query has are counted,
    and one mark per document, which carries its length; the terms of the queries meet
    the exploded tokens before any shuffle, and the counts are written, as they
    are read for N, the mean length (over all documents, also those left without
    a posting), the document frequencies and the scores.
    """
    terms = query_terms(queries, query_col)
    wanted = terms.select("term").union(queries.sparkSession.createDataFrame([("",)], "term string")).distinct()
    marked = tokenised(docs, id_col, text_col).select("id", "dl", F.explode(F.concat("tokens", F.array(F.lit("")))).alias("term"))
    counted = kept(marked.join(wanted, "term").groupBy("term", "id", "dl").agg(F.count(F.lit(1)).alias("tf")), "counted")
    marks, posted = counted.where("term = ''"), counted.where("term != ''")
    stats = marks.agg(F.sum("tf").alias("n_docs"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    return _scored(posted, terms, stats, config)


def _scored(posted: DataFrame, terms: DataFrame, stats: DataFrame, config: Config) -> DataFrame:
    with_df = posted.join(posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term")
    scored = with_df.join(terms, "term").crossJoin(stats)
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    length = 1 - config.b + config.b * F.col("dl") / F.greatest(F.col("avgdl"), F.lit(1.0))
    part = idf * (F.col("tf") * (config.k1 + 1)) / (F.col("tf") + config.k1 * length)
    return scored.groupBy("query_id", "id").agg(F.round(F.sum(part), DIGITS).alias("score")).where("score > 0")


#: Terms of all queries up to which they are a filter that reaches the scan.
FEW_TERMS = 1000


def bm25_posted(stored: DataFrame, docs: DataFrame, queries: DataFrame, k: int | None = None, config: Config = Config(), id_col: str = "id", query_col: str = "query_id") -> DataFrame:
    """As ``bm25``, from stored postings (term, id, tf, dl) of all ``docs``: no
    text is read. Postings are sorted by term, so the terms of a request, as
    long as they are few, read a few row groups; more of them are joined."""
    terms = query_terms(queries, query_col)
    asked = terms.select("term").distinct()
    few = [r["term"] for r in asked.limit(FEW_TERMS + 1).collect()]
    mine = stored.where(F.col("term").isin(few)) if len(few) <= FEW_TERMS else stored.join(asked, "term")
    posted = mine.select("term", F.col(id_col).alias("id"), "tf", "dl")
    total = stored.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_tokens"))  # a document's length is the sum of its counts
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs")).crossJoin(total).select("n_docs", F.when(F.col("n_docs") > 0, F.col("_tokens") / F.col("n_docs")).alias("avgdl"))
    return top_ranked(_scored(posted, terms, stats, config), k or config.search_rows)


def top_ranked(scores: DataFrame, k: int, id_col: str = "id") -> DataFrame:
    """The ``k`` best rows of each query with their rank: score, then id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = None, config: Config = Config(), id_col: str = "id", text_col: str = "text", query_col: str = "query_id") -> DataFrame:
    """query_id, id, score, rank."""
    return top_ranked(bm25_scores(docs, queries, config, id_col, text_col, query_col), k or config.search_rows)


def scan_word(files: DataFrame, word: str, extension: str = "", hits: int = Config().scan_hits) -> DataFrame:
    """path, line, text of the first ``hits`` lines, by path and line, in which
    ``word`` stands alone; one hit a line. Files that don't hold it at all are
    dropped before they are cut into lines."""
    held = files.where(F.contains(F.col("text"), F.lit(word)))
    if extension:
        held = held.where(F.endswith(F.col("path"), F.lit("." + extension)))
    cut = held.select("path", F.posexplode(lines(F.col("text"))).alias("at", "line_text"))
    quoted = "\\Q" + word + "\\E"
    found = cut.where(F.col("line_text").rlike(f"(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])"))
    return found.select("path", (F.col("at") + 1).alias("line"), clip(F.trim("line_text"), 120).alias("text")).orderBy("path", "line").limit(hits)
