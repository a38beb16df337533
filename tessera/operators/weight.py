"""Roles of packages and paths, and the weights that queries give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tessera.config import Config
from tessera.functions.paths import ancestors, parent, path_role
from tessera.functions.tables import LAYER_TERMS, ROLE_DEPENDENCIES, ROLE_NAMES
from tessera.functions.text import tokens


def role_from_dependencies(deps: Column) -> Column:
    """The first role, in order, of which some dependency equals or begins with
    a fingerprint; null if none does."""
    out = None
    for role, prefixes in ROLE_DEPENDENCIES.items():
        found = F.exists(deps, _begins(prefixes))
        out = F.when(found, role) if out is None else out.when(found, role)
    return out


def _begins(prefixes: list[str]) -> Callable[[Column], Column]:
    return lambda d: F.coalesce(_any([F.startswith(d, F.lit(p)) for p in prefixes]), F.lit(False))


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def role_from_name(name: Column, directory: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", name, directory))
    out = None
    for role, parts in ROLE_NAMES.items():
        found = _any([F.contains(hay, F.lit(p)) for p in parts])
        out = F.when(found, role) if out is None else out.when(found, role)
    return out.otherwise("unknown")


def infer_role(name: Column, directory: Column, deps: Column, ts_types: Column | None = None, ts_lib: Column | None = None) -> Column:
    """Dependencies, then compiler settings, then name and directory."""
    settings = F.lit(None).cast("string")
    if ts_types is not None:
        settings = F.when(F.exists(ts_types, lambda t: t.isin("bun-types", "node")), "backend")
    if ts_lib is not None:
        settings = F.coalesce(settings, F.when(F.exists(ts_lib, lambda t: F.startswith(t, F.lit("dom"))), "frontend"))
    return F.coalesce(role_from_dependencies(deps), settings, role_from_name(name, directory))


def resolve_role(stored: Column, inferred: Column) -> Column:
    return F.coalesce(F.nullif(stored, F.lit("unknown")), inferred)


def layer_terms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r, t) for r, ts in LAYER_TERMS.items() for t in ts], "role string, term string")


def layer_multipliers(queries: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, role, hits, mult for the five known roles of every query.

    A term is hit by an equal token, or by one that it begins if it has four
    bytes or more; a layer's multiplier is 1 plus the boost times its share of
    the best layer's hits. Terms are few and fixed, so tokens are cut to the
    prefixes that could be terms, and the join is on equality.
    """
    spark = queries.sparkSession
    terms = layer_terms(spark).withColumn("long", F.octet_length("term") >= 4)
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    longest = max(len(t) for ts in LAYER_TERMS.values() for t in ts)
    size = F.char_length("token")
    cuts = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(longest))), lambda n: F.struct(F.substring("token", F.lit(1), n).alias("term"), (n == size).alias("all")))
    hit = words.select("query_id", F.explode(cuts).alias("c")).select("query_id", "c.term", "c.all").join(terms, "term").where("all or long")
    hits = hit.select("query_id", "role", "term").distinct().groupBy("query_id", "role").agg(F.count(F.lit(1)).alias("hits"))
    roles = spark.createDataFrame([(r,) for r in LAYER_TERMS], "role string")
    every = queries.select("query_id").distinct().crossJoin(roles).join(hits, ["query_id", "role"], "left").withColumn("hits", F.coalesce("hits", F.lit(0).cast("long")))
    most = F.max("hits").over(Window.partitionBy("query_id"))
    boost = config.layers.boost if config.layers.enabled else 0.0
    return every.withColumn("mult", F.when(F.col("hits") > 0, 1 + boost * F.col("hits") / most).otherwise(1.0))


def package_owner(files: DataFrame, packages: DataFrame, path_col: str = "path") -> DataFrame:
    """``files`` with pkg: the deepest package whose directory holds the file
    (of several with one directory, the one whose name comes last), or null.

    The directories above a file are joined by equality with those of packages,
    instead of testing every package's prefix on every file.
    """
    homes = packages.groupBy(F.col("dir")).agg(F.max("name").alias("pkg"))
    above = files.select(F.col(path_col).alias("_path")).distinct().select("_path", F.posexplode(ancestors(parent(F.col("_path")))).alias("up", "dir"))
    owner = above.join(homes, "dir").groupBy("_path").agg(F.min_by("pkg", "up").alias("pkg"))
    return files.join(owner, files[path_col] == owner["_path"], "left").drop("_path")


def static_weight(pkg: Column, role: Column, weights: dict[str, float]) -> Column:
    """By package name, else by its role, else 1."""
    if not weights:
        return F.lit(1.0)
    table = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, float(v))))
    return F.coalesce(F.try_element_at(table, F.coalesce(pkg, F.lit(""))), F.try_element_at(table, role), F.lit(1.0))


def file_weights(found: DataFrame, files: DataFrame, packages: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, file, weight, for the pairs (query_id, file) of ``found`` only.
    ``files``: file, pkg."""
    mult = layer_multipliers(queries, config)
    roles = packages.select(F.col("name").alias("pkg"), resolve_role(F.col("role"), infer_role(F.col("name"), F.col("dir"), F.col("deps"))).alias("_prole"))
    rows = files.select("file", "pkg").join(roles, "pkg", "left").withColumn("_prole", F.coalesce("_prole", F.lit("unknown")))
    own = path_role(F.col("file"))
    rows = rows.withColumn("role", F.when(own != "unknown", own).otherwise(F.col("_prole"))).withColumn("_w", static_weight(F.col("pkg"), F.col("_prole"), config.package_weights))
    joined = found.select("query_id", "file").distinct().join(rows, "file").join(mult.select("query_id", "role", "mult"), ["query_id", "role"], "left")
    return joined.select("query_id", "file", (F.col("_w") * F.coalesce("mult", F.lit(1.0))).alias("weight"))


def package_weights(packages: DataFrame, queries: DataFrame, config: Config = Config()) -> DataFrame:
    """query_id, pkg, role, weight: the same at the grain of packages."""
    roles = packages.select(F.col("name").alias("pkg"), resolve_role(F.col("role"), infer_role(F.col("name"), F.col("dir"), F.col("deps"))).alias("role"))
    joined = roles.crossJoin(queries.select("query_id").distinct()).join(layer_multipliers(queries, config).select("query_id", "role", "mult"), ["query_id", "role"], "left")
    return joined.select("query_id", "pkg", "role", (static_weight(F.col("pkg"), F.col("role"), config.package_weights) * F.coalesce("mult", F.lit(1.0))).alias("weight"))
