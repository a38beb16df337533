"""The registered queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

WORD_TOKENIZER, BYTE_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary(WORD_TOKENIZER))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
"""


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.url_filter import filter_urls, label_by_host

    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, label_by_host(pages))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_model import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.common import scratch_path
    from tessera.llm.token_rollup import maintained_totals

    versions = {"bytes-50k": vocabulary(BYTE_TOKENIZER), "words-49k": vocabulary(WORD_TOKENIZER)}
    return maintained_totals(table(spark, sf_dir, "documents"), scratch_path(spark, "rollup"), versions)


#: The tokens of tokenizer versions that SQL can count, as patterns.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "pieces-2": r"[^\x20\x09-\x0D]{1,4}"}


def pattern_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 6 with tokenizers that SQL can express."""
    from tessera.llm.common import scratch_path
    from tessera.llm.token_rollup import maintained_totals

    return maintained_totals(table(spark, sf_dir, "documents"), scratch_path(spark, "rollup"), PATTERNS)


PATTERN_ROLLUP_SQL = r"""
SELECT source, lang,
       CASE WHEN lang = 'de' THEN 'pieces-2' ELSE 'words-1' END AS version,
       count(*) AS n_docs,
       CAST(sum(CASE WHEN lang = 'de'
                     THEN len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]{1,4}'))
                     ELSE len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) END) AS BIGINT) AS n_tokens
FROM documents
WHERE source IS DISTINCT FROM 'src3'
GROUP BY ALL
"""


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.tokenfile import token_files_round_trip

    return token_files_round_trip(table(spark, sf_dir, "documents"), vocabulary(BYTE_TOKENIZER))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_texts

    coded = encode_texts(table(spark, sf_dir, "documents"), vocabulary(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.suffix_dedup import cut_repeats

    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS bytes FROM documents),
n AS (SELECT doc_id, bytes, CAST(length(bytes) // 2 AS BIGINT) AS n_bytes FROM d),
windows AS (
  SELECT doc_id, i, substr(bytes, CAST(2 * i + 1 AS BIGINT), 200) AS w
  FROM n, unnest(range(0, n_bytes - 99)) AS r(i)),
later AS (
  SELECT doc_id, i FROM windows
  QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, i) > 1),
steps AS (
  SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS step FROM later),
spans AS (
  SELECT doc_id, i, step, sum(CASE WHEN step <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
runs AS (
  SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM spans GROUP BY ALL),
between_runs AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
cut AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed, max(b) AS last,
         string_agg(substr(bytes, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
  FROM between_runs JOIN n USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN last IS NULL THEN bytes ELSE head || substr(bytes, CAST(2 * last + 1 AS BIGINT)) END)) AS kept_sha256
FROM n LEFT JOIN cut USING (doc_id)
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_sql() -> str:
    """The rules, cutoffs and exact binomial bounds of ``quality_rules`` in SQL."""
    from tessera.llm.quality_rules import LEVEL, RISK, RULES

    cuts = ", ".join(f"('{rule}', {k}, {cut!r}::DOUBLE)" for rule, (_, many) in RULES.items() for k, cut in enumerate(many))
    figures = " UNION ALL ".join(f"SELECT doc_id, stratum, '{rule}' AS rule, {sql.replace(' / ', '::DOUBLE / ')} AS x FROM base" for rule, (sql, _) in RULES.items())
    return rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
w AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM t, unnest(range(1, len(words) - 6)) AS r(i)),
again AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
repeated AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(following - i, 8))) AS BIGINT) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM again) GROUP BY doc_id),
base AS (
  SELECT doc_id, stratum, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS BIGINT) AS n_upper,
         CAST(length(text) - length(translate(text, '!', '')) AS BIGINT) AS n_shouts,
         len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(n, 0) AS n_repeat_words
  FROM t LEFT JOIN repeated USING (doc_id)),
cuts(rule, k, cut) AS (VALUES {cuts}),
figures AS ({figures}),
known AS (SELECT doc_id, max(quality) AS label FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
rejected AS (
  SELECT stratum, rule, k, cut, count(*) FILTER (label = 1) AS good,
         count(*) FILTER (label = 1 AND x > cut) AS lost, count(*) FILTER (label = 0 AND x > cut) AS caught
  FROM figures JOIN known USING (doc_id) JOIN cuts USING (rule) GROUP BY ALL),
tests AS (SELECT count(*) AS n FROM (SELECT DISTINCT stratum FROM rejected), cuts),
chance AS (
  SELECT stratum, rule, k, cut, caught,
         (SELECT sum(exp(lgamma(good + 1.0) - lgamma(i + 1.0) - lgamma(good - i + 1.0) + i * ln({RISK / len(RULES)!r}) + (good - i) * ln(1 - {RISK / len(RULES)!r}))) FROM unnest(range(0, lost + 1)) AS r(i)) AS p
  FROM rejected WHERE good > 0 AND caught > 0 AND lost < good * {RISK / len(RULES)!r}),
chosen AS (
  SELECT stratum, rule, cut FROM chance, tests WHERE p <= {LEVEL!r} / tests.n
  QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, k DESC) = 1),
bad AS (SELECT DISTINCT doc_id FROM figures JOIN chosen USING (stratum, rule) WHERE x > cut)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND bad.doc_id IS NULL AS kept
FROM base LEFT JOIN bad USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_simhash": op4_simhash,
    "op5_quality_model": op5_quality_model,
    "op6_token_rollup": op6_token_rollup,
    "op7_token_files": op7_token_files,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality_rules": op10_quality_rules,
    "pattern_rollup": pattern_rollup,
}
ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2_SQL, "op9_suffix_dedup": OP9_SQL, "op10_quality_rules": op10_sql(), "pattern_rollup": PATTERN_ROLLUP_SQL}
