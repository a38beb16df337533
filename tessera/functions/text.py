"""Column expressions on text. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from tessera.functions.tables import STOPWORDS

#: Between the humps of a word: lower case or digit before upper case, and the
#: last of several upper-case letters before a lower-case one.
HUMP = "(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])"


#: A whole ASCII word of lower case, longer than one character, no stop word.
USEFUL = f"(?<![a-z0-9])(?!(?:{'|'.join(STOPWORDS)})(?![a-z0-9]))[a-z0-9]{{2,}}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def camel_split(word: Column) -> Column:
    return F.split(word, HUMP)


def _useful(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(USEFUL), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case ASCII words longer than one character and not stop words; a
    word of several humps also gives each hump. Duplicates stay.

    Most texts have no hump at all: one pass of one pattern gives their tokens.
    In the others every word is written with its humps behind it first.
    """
    words = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    spread = F.array_join(F.transform(words, lambda w: F.when(F.size(camel_split(w)) > 1, F.concat(w, F.lit(" "), F.array_join(camel_split(w), " "))).otherwise(w)), " ")
    humps = text.rlike("[a-z0-9][A-Z]|[A-Z][A-Z][a-z]")
    return F.coalesce(F.when(humps, _useful(spread)).otherwise(_useful(text)), F.array().cast("array<string>"))


def query_name_tokens(text: Column) -> Column:
    """Words of a query that may name a symbol: lower case, cut at whatever is
    neither alphanumeric nor "_", longer than two characters."""
    return F.filter(F.split(F.lower(text), r"[^\p{Alnum}_]+"), lambda w: F.char_length(w) > 2)


def lines(text: Column) -> Column:
    """Lines without their ends; a final line end doesn't begin another."""
    parts = F.split(text, "\n")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def slice_lines(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last``, counted from 1 and both included."""
    count = F.greatest(last - first + 1, F.lit(0))
    return F.when((first <= 0) | (count == 0), "").otherwise(F.array_join(F.slice(lines(text), F.greatest(first, F.lit(1)), count), "\n"))


def whole_word(haystack: Column, needle: str, word: str = "A-Za-z0-9_$") -> Column:
    """Whether ``needle`` occurs with no character of ``word`` beside it."""
    if not needle:
        return F.lit(False)
    return haystack.rlike(f"(?<![{word}])\\Q" + needle.replace("\\E", "\\E\\\\E\\Q") + f"\\E(?![{word}])")


def contains_word(haystack: Column, needle: Column, word: str = "A-Za-z0-9_$") -> Column:
    """``whole_word`` for a needle per row: the text is cut at the needle, and
    some cut has no word character on either side."""
    parts = F.split(haystack, F.concat(F.lit("\\Q"), needle, F.lit("\\E")), -1)
    cuts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: (~F.coalesce(F.element_at(parts, i), F.lit("")).rlike(f"[{word}]$")) & (~F.coalesce(F.try_element_at(parts, i + 1), F.lit("")).rlike(f"^[{word}]"))), lambda ok: ok)
    return F.when((needle == "") | ~F.contains(haystack, needle), F.lit(False)).otherwise(F.size(cuts) > 0)


def occurrences(haystack: Column, needle: Column) -> Column:
    """How often ``needle`` occurs, not counting overlaps; 0 for an empty one."""
    less = F.char_length(haystack) - F.char_length(F.replace(haystack, needle, F.lit("")))
    return F.when(F.char_length(needle) > 0, (less / F.char_length(needle)).cast("long")).otherwise(F.lit(0).cast("long"))


def clip(text: Column, size: int) -> Column:
    return F.when(F.char_length(text) > size, F.concat(F.substring(text, 1, size), F.lit("…"))).otherwise(text)


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression over whole repository paths: ``**`` spans
    directories, ``*`` and ``?`` don't; a leading ``**/`` also matches nothing."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "{" and "}" in glob[i:]:
            end = glob.index("}", i)
            out, i = out + "(?:" + "|".join(re.escape(x) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def matches_globs(path: Column, globs) -> Column:
    """Whether a path matches one of the globs: a single alternation."""
    return path.rlike("^(?:" + "|".join(glob_pattern(g) for g in globs) + ")$") if globs else F.lit(False)
