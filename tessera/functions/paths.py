"""Column expressions on repository paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.tables import ENTRY_STEMS, LANGUAGE_OF, SEGMENT_ROLES


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, "[^/]*$", ""), "/$", "")


def relative(root: str, path: Column) -> Column:
    """``path`` below ``root`` with forward slashes."""
    clean = F.replace(path, F.lit("\\"), F.lit("/"))
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(clean, F.lit(prefix)), F.substring(clean, len(prefix) + 1, 1 << 30)).otherwise(clean)


def language(path: Column) -> Column:
    extension = F.regexp_extract(base_name(path), r"[^.]\.([^.]*)$", 1)
    table = F.create_map(*(F.lit(x) for kv in LANGUAGE_OF.items() for x in kv))
    return F.when(F.endswith(path, F.lit(".d.ts")), "other").otherwise(F.coalesce(F.try_element_at(table, extension), F.lit("other")))


def ancestors(directory: Column) -> Column:
    """The directory and all above it, down to the root "", nearest first."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def path_role(path: Column) -> Column:
    """The role of the nearest directory that has one, else "unknown"; the file
    name doesn't count."""
    table = F.create_map(*(F.lit(x) for role, names in SEGMENT_ROLES.items() for name in names for x in (name, role)))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    folders = F.reverse(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))))
    found = F.filter(F.transform(folders, lambda p: F.try_element_at(table, F.lower(p))), lambda r: r.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit("unknown"))


def file_suffix(name: Column) -> Column:
    """The stem of entry files, ".kind.ts" for dotted script names, else the
    extension with its dot, else the name."""
    stem = F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_extract(name, r"^(.+)\.[^.]*$", 1)).otherwise(name)
    script = F.regexp_extract(name, r"\.(tsx?)$", 1)
    kind = F.regexp_extract(name, r"\.([A-Za-z0-9-]+)\.tsx?$", 1)
    return (
        F.when(stem.isin(ENTRY_STEMS), stem)
        .when((script != "") & (kind != ""), F.concat(F.lit("."), kind, F.lit("."), script))
        .when(script != "", F.concat(F.lit("."), script))
        .when(name.rlike(r"^.+\.[^.]*$"), F.concat(F.lit("."), F.regexp_extract(name, r"\.([^.]*)$", 1)))
        .otherwise(name)
    )


def normalise(path: Column) -> Column:
    """``path`` without "." and with ".." resolved; ".." above the root goes."""
    step = lambda out, p: F.when(p.isin("", "."), out).when(p == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")
