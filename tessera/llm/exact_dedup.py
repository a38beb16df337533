"""Exact deduplication (2): skew-safe combining.

Three rounds of the same aggregation, each keyed by digest *and* the full
normalised content, so that equal digests of different texts never meet:

1. locally, before anything is shuffled (the partial aggregation of round 2);
2. by (digest, salt), the salt being that of the map task, so a text copied
   into every task is merged by several tasks;
3. over the salts: one row per salt and text at most reaches this round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.common import ASCII_SPACE, spread_lookup, text_or_empty, written

SALTS = 16
#: 2**64 as a decimal: room for every id below a length.
_STEP = "18446744073709551616"


def normalised(text: Column) -> Column:
    """``text`` without any character of [\\x20\\x09-\\x0D]."""
    return F.translate(text, ASCII_SPACE, "")


def _rank(points: Column, doc: Column) -> Column:
    """One number that orders rows by most code points, then smallest id; a
    null id comes after all others. It fits decimal(38,0), which hash
    aggregation can update in place, unlike a struct."""
    known = F.coalesce(doc.cast("decimal(20,0)"), F.lit("9223372036854775808").cast("decimal(20,0)"))
    return (points.cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(20,0)")).cast("decimal(38,0)") - known


def combine(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: text_sha256, content, group_size,
    points (of the row that stays), keep_id."""
    text = text_or_empty(text_col)
    rows = docs.select(
        F.sha2(normalised(text), 256).alias("text_sha256"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("salt"),
        normalised(text).alias("content"),
        F.char_length(text).alias("points"),
        _rank(F.char_length(text), F.col(id_col).cast("long")).alias("best"),
    )
    sums = [F.max("points").alias("points"), F.max("best").alias("best")]
    salted = rows.groupBy("text_sha256", "salt", "content").agg(F.count(F.lit(1)).alias("n"), *sums)
    merged = salted.groupBy("text_sha256", "content").agg(F.sum("n").alias("group_size"), *sums)
    keep = (F.col("points").cast("decimal(12,0)") * F.lit(_STEP).cast("decimal(20,0)")).cast("decimal(38,0)") - F.col("best")
    known = F.when(keep < F.lit("9223372036854775808").cast("decimal(20,0)"), keep.cast("long"))
    return merged.select("text_sha256", "content", "group_size", "points", known.alias("keep_id"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space; null is empty. Of
    equal texts the row with the most code points in the original text stays,
    then the smallest id, a null id last. Rows with the same id and text are
    one document repeated: one of them is kept, if any. Other columns are
    ignored; an empty table gives no rows.

    Rows get their group by digest and length of content. Two texts with one
    SHA-256 stay apart in every round of ``combine``; they would only share a
    row here if their lengths were equal too.
    """
    text = text_or_empty(text_col)
    found = combine(docs, id_col, text_col, salts).select(
        F.struct("text_sha256", F.char_length("content").alias("length")).alias("key"), "group_size", "points", "keep_id", F.col("group_size").alias("weight")
    )
    found = written(found, "groups")
    members = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.struct(F.sha2(normalised(text), 256).alias("text_sha256"), F.char_length(normalised(text)).alias("length")).alias("key"),
        F.char_length(text).alias("own_points"),
    )
    members = members.groupBy("doc_id", "key", "own_points").agg(F.count(F.lit(1)).cast("int").alias("times"))
    joined = spread_lookup(members, found, "key", "weight", "doc_id")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own_points") == F.col("points"))
    once = F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: stays & (k == 1))
    return joined.select("doc_id", "keep_id", "group_size", F.explode(once).alias("kept"), F.col("key.text_sha256").alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` that ``exact_groups`` keeps, with their columns: a row
    stays if its id and its own text won its group; of rows that repeat both,
    the one with the least original text, any one where that is equal too.
    """
    text = text_or_empty(text_col)
    winners = combine(docs, id_col, text_col, salts).select(F.col("keep_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.char_length("content").alias("_length"), F.col("points").alias("_points"))
    winners = written(winners, "winners")
    key = ["_id", "_sha", "_length", "_points"]
    rows = docs.withColumns({"_id": docs[id_col].cast("long"), "_sha": F.sha2(normalised(text), 256), "_length": F.char_length(normalised(text)), "_points": F.char_length(text)})

    def among(frame: DataFrame, table: DataFrame, how: str) -> DataFrame:
        table = table.select(*(F.col(k).alias(f"_{k}") for k in key))
        return frame.join(table, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key], how)

    kept = among(rows, winners, "left_semi")
    again = written(kept.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key), "repeated")
    if again.isEmpty():
        return kept.select(*docs.columns)
    first = F.row_number().over(Window.partitionBy(*key).orderBy(text))
    once = among(kept, again, "left_semi").withColumn("_first", first).where("_first = 1")
    return among(kept, again, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
