"""URL filters (3): rules first, then gradient-boosted trees on lexical
features. DataFrame functions and the JVM's tree learner only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, functions as F

#: The rules of the registered query.
ALLOW = ["org/", "com/fr/"]
BLOCK = ["example.org/es/", "example.org/en/1", "com/de/"]
#: Labelled URLs learnt from, of each class, at most.
SAMPLE = 8000
TREES, DEPTH, SEED = 10, 4, 7
#: Weight of the overall share of blocked URLs in a suffix's share.
SMOOTH = 20.0
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "host_digit_ratio", "hyphens", "entropy", "parameters", "query_length", "fragment_length", "suffix_share", "suffix_count"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.char_length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def matching_rule(host_col: Column, path_col: Column, rules: list[str]) -> Column:
    """The longest rule that fits: its host or a subdomain of it, and a path
    that begins with the rule's; null if none does."""
    out = None
    for rule in sorted(set(rules), key=lambda r: (-len(r), r)):
        name, slash, rest_ = rule.partition("/")
        fits = ((host_col == name) | F.endswith(host_col, F.lit("." + name))) & F.startswith(path_col, F.lit(slash + rest_))
        out = F.when(fits, rule) if out is None else out.when(fits, rule)
    return F.lit(None).cast("string") if out is None else out


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``urls`` with host, path, suffix and the lexical features added."""
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    out = urls.withColumn("_rest", rest(url)).withColumn("host", host(url)).withColumn("path", path(url))
    query = F.regexp_extract("_rest", r"\?([^#]*)", 1)
    digits = lambda c: F.char_length(c) - F.char_length(F.translate(c, "0123456789", ""))
    count = lambda c, what: F.char_length(c) - F.char_length(F.replace(c, F.lit(what), F.lit("")))
    share = lambda c: (F.char_length("host") - F.char_length(F.replace(F.col("host"), c, F.lit("")))) / F.char_length("host")
    chars = F.filter(F.array_distinct(F.split("host", "")), lambda c: c != "")
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return out.withColumns({
        "suffix": F.substring_index("host", ".", -3),
        "url_length": F.char_length(url).cast("double"),
        "host_length": F.char_length("host").cast("double"),
        "path_length": F.char_length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"),
        "labels": count(F.col("host"), ".").cast("double"),
        "digit_ratio": digits(url) / F.greatest(F.char_length(url), F.lit(1)),
        "host_digit_ratio": digits(F.col("host")) / F.greatest(F.char_length("host"), F.lit(1)),
        "hyphens": count(F.col("host"), "-").cast("double"),
        "entropy": F.coalesce(entropy, F.lit(0.0)),
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1.0),
        "query_length": F.char_length(query).cast("double"),
        "fragment_length": F.char_length(F.regexp_extract("_rest", "#(.*)", 1)).cast("double"),
    }).drop("_rest")


@dataclass(frozen=True)
class UrlModel:
    """The trees, with the suffix statistics of the URLs learnt from (at most
    one row per such URL, so small enough to broadcast)."""

    trees: Model | None
    suffixes: DataFrame | None
    share: float

    def blocked(self, urls: DataFrame) -> DataFrame:
        """``urls`` (with the lexical features) and the boolean ``_blocked``."""
        if self.trees is None:
            return urls.withColumn("_blocked", F.lit(self.share >= 0.5))
        rows = with_suffixes(urls, self.suffixes, self.share)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
        return self.trees.transform(vectors).withColumn("_blocked", F.col("_prediction") > 0.5)


def with_suffixes(rows: DataFrame, suffixes: DataFrame, share: float) -> DataFrame:
    return rows.join(F.broadcast(suffixes), "suffix", "left").withColumns({
        "suffix_share": (F.coalesce("_bad", F.lit(0)) + SMOOTH * share) / (F.coalesce("_all", F.lit(0)) + SMOOTH),
        "suffix_count": F.log1p(F.coalesce("_all", F.lit(0)).cast("double")),
    })


def fit(labelled: DataFrame, url_col: str = "url", label_col: str = "label", sample: int = SAMPLE) -> UrlModel:
    """Learn from URLs with label 1 (block) or 0 (allow).

    The first ``sample`` different URLs of each class in the order of a hash are
    taken, whatever way rows are dealt; a URL with both labels counts as bad. A URL's own label is left out of its suffix's
    statistics while learning, so that they don't give it away.
    """
    known = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label")).where("url is not null and label in (0, 1)").groupBy("url").agg(F.max("label").alias("label"))
    parts = [known.where(F.col("label") == k).orderBy(F.xxhash64("url"), "url").limit(sample) for k in (0, 1)]
    chosen = lexical(parts[0].union(parts[1])).persist()
    try:
        counts = {r["label"]: r["n"] for r in chosen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if len(counts) < 2:
            return UrlModel(None, None, float(max(counts, default=0)))
        share = counts[1] / (counts[0] + counts[1])
        spark = labelled.sparkSession
        sums = chosen.groupBy("suffix").agg(F.sum("label").alias("_bad"), F.count(F.lit(1)).alias("_all"))
        suffixes = spark.createDataFrame(sums.collect(), sums.schema)  # 2 * sample rows at most
        others = chosen.join(F.broadcast(suffixes), "suffix").withColumn("_bad", F.col("_bad") - F.col("label")).withColumn("_all", F.col("_all") - 1)
        rows = others.withColumns({
            "suffix_share": (F.col("_bad") + SMOOTH * share) / (F.col("_all") + SMOOTH),
            "suffix_count": F.log1p(F.col("_all").cast("double")),
            "_weight": F.when(F.col("label") == 1, 0.5 / counts[1]).otherwise(0.5 / counts[0]) * (counts[0] + counts[1]),
        })
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows).select("_x", "_weight", F.col("label").cast("double").alias("label")).coalesce(4)
        trees = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="_weight", predictionCol="_prediction", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
        return UrlModel(trees.fit(vectors), suffixes, share)
    finally:
        chosen.unpersist()


def filter_urls(urls: DataFrame, labelled: DataFrame, allow: list[str] = ALLOW, block: list[str] = BLOCK, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``urls``: page_id, host, path, rule, verdict.

    The longest rule that fits decides; else the trees do. A null URL, or one
    without ``://``, has an empty host and path, fits no rule and is judged by
    the trees. Repeated rows come out as often; an empty table gives no rows;
    without labels of both classes the trees say the one class there is, or
    allow. Nothing is shuffled; other columns are ignored.
    """
    model = fit(labelled)
    rows = urls.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    judged = model.blocked(lexical(rows))
    rule = matching_rule(F.col("host"), F.col("path"), [*allow, *block])
    by_rule = F.when(rule.isin(list(block)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.when(rule.isNotNull(), by_rule).otherwise(F.when(F.col("_blocked"), "block").otherwise("allow")).alias("verdict"))


#: Words in host names that mark a URL as bad when labelling.
BAD_WORDS = ["ads", "adult", "bet", "bets", "betting", "casino", "malware", "phish", "phishing", "pills", "poker", "porn", "spam", "track", "tracker", "viagra", "warez", "xxx"]


def label_by_host(urls: DataFrame, url_col: str = "url", words: list[str] = BAD_WORDS) -> DataFrame:
    """Labelled URLs for a corpus without labels of its own: 1 where one of
    ``words`` stands in the host between dots or hyphens, else 0."""
    name = host(F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    return urls.select(F.col(url_col).cast("string").alias("url"), name.rlike(f"(^|[.-])({'|'.join(words)})([.-]|$)").cast("int").alias("label")).where(name != "")


def held_out_accuracy(labelled: DataFrame, url_col: str = "url", label_col: str = "label") -> dict[int, float]:
    """For each label the share of URLs that trees judge rightly which learnt
    only from the other URLs: those whose crc32 mod 5 isn't 0."""
    known = labelled.select(F.col(url_col).cast("string").alias("url"), F.col(label_col).cast("int").alias("label")).where("url is not null").distinct()
    out = F.crc32(F.col("url").cast("binary")) % 5 == 0
    judged = fit(known.where(~out)).blocked(lexical(known.where(out)))
    right = judged.groupBy("label").agg(F.avg((F.col("_blocked").cast("int") == F.col("label")).cast("double")).alias("share"))
    return {r["label"]: r["share"] for r in right.collect()}
