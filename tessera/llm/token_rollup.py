"""Token counts (6): rollups maintained by deltas.

A store is a folder of batches. A batch of changes becomes signed entries: a
new count adds, a superseded or deleted one subtracts. Entries are summed to a
delta of the totals by source, language and tokenizer version; totals are the
sum of the deltas. A batch counts once its commit mark exists. Each try at a
batch writes tables of its own, and the mark, which names them, is made last and
by one writer only, so a batch that is applied again, by two at a time, or that
failed half-way, changes nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.llm.common import text_or_empty

ENTRY = "doc_id long, source string, lang string, version string, n_tokens long, sign int"
DELTA = "source string, lang string, version string, n_docs long, n_tokens long"


def token_count(text: Column, version: Column, versions: Mapping[str, str]) -> Column:
    """The tokens of ``text`` under its row's tokenizer version; null for an
    unknown version. ``versions``: a tokenizer file (``.json``, counted by the
    tokenizers library, no special tokens) or a pattern whose matches count."""
    files = {name: what for name, what in versions.items() if what.endswith(".json")}

    @F.arrow_udf("long")
    def by_file(texts, names):
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, codec

        counts = [len(codec(files[v]).encode(t)) // 4 if v in files else None for t, v in zip(byte_values(texts), names.to_pylist())]
        return pa.array(counts, pa.int64())

    out = F.when(version.isin(list(files)), by_file(text, version)) if files else None
    for name, what in versions.items():
        if name not in files:
            count = F.regexp_count(text, F.lit(what)).cast("long")
            out = F.when(version == name, count) if out is None else out.when(version == name, count)
    return out


class TokenStore:
    """Totals of tokens, kept in a folder that the driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, versions: Mapping[str, str]) -> None:
        self.spark, self.path, self.versions = spark, path.rstrip("/"), versions

    def _file(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _marks(self) -> dict[str, dict]:
        """What each mark says: where its tables are and which batches they hold."""
        folder, fs = self._file("commits")
        out = {}
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            stream = fs.open(status.getPath())
            try:
                text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("}"):  # else its writer died over it
                out[status.getPath().getName()] = json.loads(text)
        return out

    def _commit(self, name: str, **what) -> bool:
        """Make a mark; False if another writer has made it."""
        mark, fs = self._file(f"commits/{name}")
        fs.mkdirs(mark.getParent())
        if fs.exists(mark) and name in self._marks():
            return False
        try:
            stream = fs.create(mark, name not in self._marks() and fs.exists(mark))  # replaces a mark left unfinished, never a whole one
        except Py4JJavaError as error:
            if "AlreadyExists" in str(error.java_exception):
                return False
            raise
        stream.write(bytearray(json.dumps(what).encode()))
        stream.close()
        return True

    def committed(self) -> list[int]:
        """The numbers of the batches that count, in order."""
        return sorted({n for what in self._marks().values() for n in what["batches"]})

    def _read(self, kind: str, schema: str) -> DataFrame:
        """The tables in force: the compaction of most batches, and the batches
        that it doesn't hold."""
        marks = self._marks().values()
        base = max((m for m in marks if m["base"]), key=lambda m: len(m["batches"]), default=None)
        held = set(base["batches"]) if base else set()
        paths = [f"{self.path}/{kind}/{m['folder']}" for m in marks if m is base or not m["base"] and not held.issuperset(m["batches"])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The counts in force: one row per document and tokenizer version."""
        keys = ["doc_id", "source", "lang", "version", "n_tokens"]
        return self._read("entries", ENTRY).groupBy(*keys).agg(F.sum("sign").alias("net")).where("net > 0").drop("net")

    def totals(self) -> DataFrame:
        """source, lang, version, n_docs, n_tokens; groups without documents go."""
        sums = self._read("deltas", DELTA).groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs != 0 or n_tokens != 0")

    def compact(self) -> None:
        """Write the entries in force and the totals as one table each, which
        later reads take instead of all batches so far. Nothing is removed."""
        batches, folder = self.committed(), f"base-{uuid.uuid4().hex}"
        if batches:
            self.entries().withColumn("sign", F.lit(1)).write.parquet(f"{self.path}/entries/{folder}")
            self.totals().write.parquet(f"{self.path}/deltas/{folder}")
            self._commit(folder, folder=folder, batches=batches, base=True)

    def apply(self, batch: int, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, text, source, lang, version) as batch
        number ``batch``; False if that batch was committed before.

        insert adds a document's count, and replaces one of the same version;
        revise replaces the document's counts in every version; delete removes
        them. A null text is empty, null keys are groups of their own, changes
        with a null id are left out, and of several changes to a document in one
        batch the one of the greatest (op, version, text) counts, so that the
        order of rows doesn't matter. Only the ids and signed counts of changed
        documents are shuffled, never texts; sums are made before shuffling, so
        a hot source is one row per task.
        """
        if batch in (done := self.committed()):
            return False
        folder = f"{batch}-{uuid.uuid4().hex}"
        one_of = changes.where("doc_id is not null").select(
            "op", F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "version",
            F.when(F.col("op") != "delete", token_count(text_or_empty("text"), F.col("version"), self.versions)).alias("n_tokens"), F.xxhash64(text_or_empty("text")).alias("_h"))
        order = Window.partitionBy("doc_id").orderBy(F.desc("op"), F.desc("version"), F.desc("_h"), F.desc("source"), F.desc("lang"))
        one = one_of.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k", "_h")
        if done:
            old = self.entries().join(one.select("doc_id", "op", F.col("version").alias("_new")), "doc_id")
            old = old.where("op != 'insert' or version <=> _new").select("doc_id", "source", "lang", "version", "n_tokens", F.lit(-1).alias("sign"))
        else:
            old = self.spark.createDataFrame([], ENTRY)
        new = one.where("op != 'delete' and n_tokens is not null").select("doc_id", "source", "lang", "version", "n_tokens", F.lit(1).alias("sign"))
        new.unionByName(old).write.parquet(f"{self.path}/entries/{folder}")
        signed = self.spark.read.schema(ENTRY).parquet(f"{self.path}/entries/{folder}")
        deltas = signed.groupBy("source", "lang", "version").agg(F.sum(F.col("sign").cast("long")).alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"))
        deltas.write.parquet(f"{self.path}/deltas/{folder}")
        return self._commit(str(batch), folder=folder, batches=[batch], base=False)


def maintained_totals(docs: DataFrame, path: str, versions: Mapping[str, str]) -> DataFrame:
    """Totals after a fixed history over all of ``docs``, with two ``versions``:
    every document is inserted under the first; German ones move to the second;
    those of source src3 are deleted; the batches so far are compacted; the
    second batch comes once more and changes nothing.

    Null texts are empty and null sources and languages groups of their own;
    rows with a null id are left out and rows that repeat an id count once (see
    ``TokenStore.apply``); other columns are ignored; an empty table has no
    totals.
    """
    store, (first, second) = TokenStore(docs.sparkSession, path, versions), list(versions)
    base = docs.select("doc_id", "text", "source", "lang")
    moved = base.where("lang = 'de'").withColumns({"op": F.lit("revise"), "version": F.lit(second)})
    store.apply(1, base.withColumns({"op": F.lit("insert"), "version": F.lit(first)}))
    store.apply(2, moved)
    store.apply(3, base.where("source = 'src3'").withColumns({"op": F.lit("delete"), "version": F.lit(first)}))
    store.compact()
    store.apply(2, moved)
    return store.totals()
