"""Quality rules (10): risk-controlled thresholds, DataFrame functions only.

Each rule is a figure of the text and a cutoff beyond which a document is
rejected. Cutoffs are chosen per stratum from labelled documents: a cutoff may
be used only if an exact binomial test shows that it rejects at most a given
share of good documents, at a level divided by the number of all tests.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import text_or_empty, written

#: Share of good documents of a stratum that all rules together may reject, and
#: the chance that this is ever exceeded.
RISK, LEVEL = 0.05, 0.05
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Bits for a word's place in a text when window hashes are sorted with it.
PLACE_BITS = 28

#: The rules: a figure of the base columns, larger being worse, and its cutoffs.
RULES: dict[str, tuple[str, list[float]]] = {
    "symbols": ("n_symbols / greatest(word_chars, 1)", [0.005 * 1.3**k for k in range(20)]),
    "upper": ("n_upper / greatest(word_chars, 1)", [0.04 * 1.2**k for k in range(18)]),
    "shouts": ("n_shouts / greatest(n_words, 1)", [0.02 * 1.3**k for k in range(18)]),
    "repeats": ("n_repeat_words / greatest(n_words, 1)", [0.01 * 1.25**k for k in range(18)]),
    "lines": ("n_dup_lines / greatest(n_lines, 1)", [0.05 * k for k in range(1, 19)]),
}


def text_figures(text: Column) -> list[tuple[str, str]]:
    """(column, SQL) pairs to be added one after another to a frame with the
    column ``text``; each may use those before it. An array read within a
    lambda is a column of its own and read there more than once: Catalyst then
    leaves it a column, where a single reference would be inlined and the array
    made anew for every element."""
    last = f"{PLACE_BITS}"
    mask = (1 << PLACE_BITS) - 1

    def twice(packed: str) -> str:
        """The places in a sorted array of (hash bits, place) whose hash bits
        stand beside equal ones."""
        same = f"(shiftright({packed}, {last}) = shiftright(v, {last}))"
        around = [same.replace(f"({packed},", f"(get({packed}, k {sign} 1),") for sign in "-+"]
        return f"filter(transform({packed}, (v, k) -> if((k > 0 and {around[0]}) or coalesce({around[1]}, false), v & {mask}L, null)), p -> p is not null)"

    return [
        ("words", r"filter(split(text, '[ \\t\\n\\x0B\\f\\r]+'), w -> w != '')"),
        ("n_words", "cast(size(words) as bigint)"),
        ("word_chars", r"cast(char_length(translate(text, ' \t\n\u000B\u000C\r', '')) as bigint)"),
        ("n_symbols", f"cast(char_length(text) - char_length(translate(text, '{SYMBOLS}', '')) as bigint)"),
        ("n_upper", "cast(char_length(text) - char_length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) as bigint)"),
        ("n_shouts", "cast(char_length(text) - char_length(translate(text, '!', '')) as bigint)"),
        ("lines", r"filter(split(text, '\n'), l -> translate(l, ' \t\n\u000B\u000C\r', '') != '')"),
        ("n_lines", "cast(size(lines) as bigint)"),
        ("n_dup_lines", "cast(size(lines) - size(array_distinct(lines)) as bigint)"),
        ("hashes", f"if(n_words >= {WINDOW}, transform(words, w -> xxhash64(w)), null)"),
        ("windows", f"if(n_words >= {WINDOW}, transform(sequence(0, cast(n_words as int) - {WINDOW}), i -> xxhash64({', '.join(f'get(hashes, i + {k})' for k in range(WINDOW))})), null)"),
        ("again", "coalesce(size(array_distinct(windows)) < size(windows), false)"),
        ("low", f"if(again, sort_array(transform(windows, (h, i) -> shiftleft(h, {last}) | i)), null)"),
        ("high", f"if(again, sort_array(transform(windows, (h, i) -> shiftleft(shiftrightunsigned(h, {last}), {last}) | i)), null)"),
        ("low_places", f"if(again, {twice('low')}, null)"),
        ("high_places", f"if(again, {twice('high')}, null)"),
        ("places", "if(again, sort_array(array_intersect(low_places, high_places)), null)"),
        ("n_repeat_words", f"coalesce(if(again, aggregate(transform(places, (p, k) -> least({WINDOW}L, coalesce(get(places, k + 1) - p, {WINDOW}L))), 0L, (a, x) -> a + x), 0L), 0L)"),
        ("base_failed", "n_words < 20 or 100 * n_repeat_words > 30 * n_words"),
    ]


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the figures of every whole text. Null text has no
    words; the stratum of a null (or of no) column is ''."""
    stratum = F.coalesce(F.col(stratum_col).cast("string"), F.lit("")) if stratum_col else F.lit("")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.alias("stratum"), text_or_empty(text_col).alias("text"))
    for name, sql in text_figures(F.col("text")):
        out = out.withColumn(name, F.expr(sql))
    return out.select("doc_id", "stratum", *BASE, "n_upper", "n_shouts", "n_lines", "base_failed")


def at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exactly but for rounding."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * math.fsum(math.exp(x - top) for x in logs))


@dataclass(frozen=True)
class Cutoff:
    stratum: str
    rule: str
    above: float
    good: int
    good_rejected: int
    bad_rejected: int


def choose_cutoffs(counts: dict[tuple[str, str, int], dict[int, int]], risk: float = RISK, level: float = LEVEL) -> list[Cutoff]:
    """``counts[stratum, rule, bucket][label]``: documents whose figure exceeds
    exactly ``bucket`` of the rule's cutoffs. Each rule gets an equal part of
    the risk; every test of a stratum, rule and cutoff an equal part of the
    level (Bonferroni). Of the cutoffs that pass, the one that rejects most bad
    documents is used, the laxest of equals; none if it rejects no bad one."""
    strata = sorted({s for s, _, _ in counts})
    tests = sum(len(cuts) for _, cuts in RULES.values()) * max(1, len(strata))
    out = []
    for stratum in strata:
        for rule, (_, cuts) in RULES.items():
            at = [counts.get((stratum, rule, b), {}) for b in range(len(cuts) + 1)]
            good = sum(x.get(1, 0) for x in at)
            best = None
            for j in range(len(cuts) - 1, -1, -1):  # figures above cuts[j] are those of bucket j + 1 and more
                wrong, right = (sum(x.get(k, 0) for x in at[j + 1 :]) for k in (1, 0))
                if good and at_most(wrong, good, risk / len(RULES)) <= level / tests and right > (best.bad_rejected if best else 0):
                    best = Cutoff(stratum, rule, cuts[j], good, wrong, right)
            if best:
                out.append(best)
    return out


def calibrate(figures: DataFrame, labels: DataFrame, label_col: str = "quality", risk: float = RISK, level: float = LEVEL) -> list[Cutoff]:
    """Cutoffs from all labelled documents. What reaches the driver is a count
    per stratum, rule, bucket and label, whatever the number of documents."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    buckets = [F.expr("+".join(f"cast(({sql}) > {c!r}D as int)" for c in cuts)).alias(rule) for rule, (sql, cuts) in RULES.items()]
    joined = figures.select("doc_id", "stratum", *buckets).join(known, "doc_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.col(r).alias("bucket")) for r in RULES))).alias("x")
    rows = joined.select("stratum", "label", pairs).groupBy("stratum", "x.rule", "x.bucket", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    counts: dict[tuple[str, str, int], dict[int, int]] = {}
    for r in rows:
        counts.setdefault((r["stratum"], r["rule"], r["bucket"]), {})[r["label"]] = r["n"]
    return choose_cutoffs(counts, risk, level)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str | None = "lang", risk: float = RISK, level: float = LEVEL) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept.

    The figures are written once to the shared folder (a few numbers a row) and
    read twice: for the cutoffs and for the verdicts. Without enough labelled
    documents no cutoff is proven, and only the base rules reject. Null texts
    have no words and fail them; repeated rows are judged alike; an empty table
    gives no rows; other columns are ignored.
    """
    figures = written(base_figures(docs, id_col, text_col, stratum_col), "figures")
    rejected = F.lit(False)
    for cut in calibrate(figures, labels, risk=risk, level=level):
        rejected = rejected | ((F.col("stratum") == cut.stratum) & F.expr(f"({RULES[cut.rule][0]}) > {cut.above!r}D"))
    return figures.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"))
