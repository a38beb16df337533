"""The index: a bundle of Parquet tables in versions, with a pointer to the
current one. A version is complete before the pointer moves to it."""

from __future__ import annotations

import os
import shutil
import time
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.config import Config
from tessera.operators import dense, imports, lexical, structure, weight
from tessera.schemas import NAMESPACES, SCHEMA_VERSION
from tessera.sources import discover, workspace

TABLES = ["files", "packages", "nodes", "chunks", "symbols", "vectors", "postings", "edges", "namespaces", "meta"]
#: Seconds after which a lock is taken to be left over.
STALE = 15 * 60


@dataclass
class Index:
    tables: dict[str, DataFrame]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.tables[name]
        raise AttributeError(name)


def build(spark: SparkSession, files: DataFrame, packages: DataFrame, root: str = "", config: Config = Config(), dims: int = 64, namespaces: DataFrame | None = None) -> Index:
    """All tables from files (path, lang, mtime_ms, text)."""
    if namespaces is None:
        namespaces = spark.createDataFrame([], NAMESPACES)
    owned = weight.package_owner(files, packages).withColumn("pkg", F.coalesce("pkg", F.lit("root")))
    nodes = structure.extract(owned)
    items = structure.node_items(nodes, owned)
    chunks = items.withColumn("row_id", F.xxhash64("id", "start_line", "file"))
    languages = {r["lang"] for r in files.select("lang").distinct().collect()}  # a dozen at most
    now = str(int(time.time() * 1000))
    several = packages.limit(2).count() > 1
    meta = spark.createDataFrame([(SCHEMA_VERSION, now, now, config.embedding_model, dims, root, several)], "version int, created_ms string, updated_ms string, model string, dims int, root string, monorepo boolean")
    return Index({
        "files": owned.select("path", "pkg", "lang", "mtime_ms", "text"),
        "packages": packages,
        "nodes": nodes,
        "chunks": chunks.select("row_id", "id", "name", "kind", "file", "pkg", "start_line", "end_line", "text"),
        "symbols": items.select("id", "name", "kind", "file", "pkg", "start_line", "end_line"),
        "vectors": dense.embed(chunks, "row_id", "text", dims),
        "postings": lexical.postings(chunks, "row_id", "text", ("file",)).withColumnRenamed("id", "row_id"),
        "edges": imports.all_edges(owned, languages, namespaces),
        "namespaces": namespaces,
        "meta": meta,
    })


def build_local(spark: SparkSession, root: str, config: Config | None = None) -> Index:
    """The index of a local repository; without a configuration, of all the
    languages that have files."""
    if config is None:
        languages = discover.present_languages(root)
        config = Config().merged({"include": list(discover.include_for(languages))}) if languages else Config()
    packages, _ = workspace.detect(root)
    return build(spark, discover.local_files(spark, root, config), workspace.package_table(spark, packages), root, config, namespaces=spark.createDataFrame(workspace.namespaces(root), NAMESPACES))


@contextmanager
def lock(folder: str):
    """One writer at a time; a lock older than 15 minutes is taken over."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, "_LOCK")
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL)
    except FileExistsError:
        if time.time() - os.stat(path).st_mtime < STALE:
            raise RuntimeError(f"another writer holds {path}") from None
        os.utime(path)
        handle = os.open(path, os.O_RDONLY)
    try:
        yield
    finally:
        os.close(handle)
        os.remove(path)


def current(folder: str) -> str | None:
    try:
        with open(os.path.join(folder, "_CURRENT"), encoding="utf-8") as f:
            return os.path.join(folder, f.read().strip())
    except OSError:
        return None


def save(index: Index, folder: str) -> str:
    """Write the next version and point to it; the version before stays for
    readers that have begun, older ones go, other files are left alone."""
    with lock(folder):
        old = current(folder)
        number = int(os.path.basename(old).split("=")[1]) + 1 if old else 1
        name = f"v={number}"
        target = os.path.join(folder, name)
        shutil.rmtree(target, ignore_errors=True)
        for table in TABLES:
            df = index.tables[table]
            if table == "postings":  # so that a few terms read a few row groups
                df = df.repartitionByRange("term").sortWithinPartitions("term")
            df.write.parquet(os.path.join(target, table))
        with open(os.path.join(folder, "_CURRENT.tmp"), "w", encoding="utf-8") as f:
            f.write(name)
        os.replace(os.path.join(folder, "_CURRENT.tmp"), os.path.join(folder, "_CURRENT"))
        for other in os.listdir(folder):
            if other.startswith("v=") and other.split("=")[1].isdigit() and int(other.split("=")[1]) < number - 1:
                shutil.rmtree(os.path.join(folder, other))
    return target


def load(spark: SparkSession, folder: str, model: str | None = None, dims: int | None = None) -> Index:
    """The current version. Another schema version, or another embedding model
    or size than asked for, is refused."""
    path = current(folder)
    if path is None:
        raise FileNotFoundError(f"no index in {folder}; run index")
    meta = spark.read.parquet(os.path.join(path, "meta")).first()
    if meta["version"] != SCHEMA_VERSION:
        raise RuntimeError(f"the index has version {meta['version']}, not {SCHEMA_VERSION}; index again")
    check_model(meta["model"], meta["dims"], model, dims)
    return Index({t: spark.read.parquet(os.path.join(path, t)) for t in TABLES})


def check_model(model: str, dims: int, wanted: str | None, wanted_dims: int | None) -> None:
    if wanted not in (None, model) or wanted_dims not in (None, dims):
        raise RuntimeError(f"the index was made with {model} of {dims} dimensions, not {wanted} of {wanted_dims}; index again")


_cache: dict[str, Index] = {}


def cached(spark: SparkSession, folder: str) -> Index:
    """The loaded index of the current version, read anew only when it changed."""
    path = current(folder) or folder
    if path not in _cache:
        _cache.clear()
        _cache[path] = load(spark, folder)
    return _cache[path]


def update(spark: SparkSession, index: Index, changed: DataFrame, deleted: DataFrame, config: Config = Config()) -> Index:
    """``index`` with the ``changed`` files (path, lang, mtime_ms, text) put in
    anew and the ``deleted`` ones (path) gone, in every table at once; edges are
    those of the whole tree, as other files may now resolve elsewhere."""
    touched = changed.select("path").unionByName(deleted.select("path")).distinct()
    fresh = build(spark, changed, index.packages, "", config)
    out = {}
    for name, column in (("files", "path"), ("nodes", "file"), ("chunks", "file"), ("symbols", "file"), ("postings", "file")):
        kept = index.tables[name].join(touched.withColumnRenamed("path", column), column, "left_anti").select(*index.tables[name].columns)
        out[name] = kept.unionByName(fresh.tables[name])
    gone = index.chunks.join(touched.withColumnRenamed("path", "file"), "file", "left_semi").select("row_id")
    out["vectors"] = index.vectors.join(gone, "row_id", "left_anti").unionByName(fresh.vectors)
    whole = out["files"]
    out["edges"] = imports.all_edges(whole, {x for group in imports.GROUPS for x in group}, index.namespaces)
    out["namespaces"] = index.namespaces
    out["packages"] = index.packages
    out["meta"] = index.meta.withColumn("updated_ms", F.lit(str(int(time.time() * 1000))))
    return Index(out)
