"""Files of a repository: an ignore-aware walk of local roots, and a Spark read
of trees in any store."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.config import Config
from tessera.functions.paths import language
from tessera.functions.text import glob_pattern, matches_globs
from tessera.operators.structure import language_of


class Ignore:
    """Rules of one ignore file, for paths below its folder."""

    def __init__(self, folder: str, text: str) -> None:
        self.folder, self.rules = folder, []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            keep = line.startswith("!")
            pattern = line[keep:].removeprefix("\\")
            only_folders, pattern = pattern.endswith("/"), pattern.rstrip("/")
            anchored, pattern = "/" in pattern, pattern.removeprefix("/")
            self.rules.append((keep, only_folders, re.compile(("" if anchored else "(?:.*/)?") + glob_pattern(pattern) + "$")))

    def verdict(self, path: str, is_folder: bool) -> bool | None:
        """Ignored, kept, or nothing said; the last rule that fits decides."""
        tail = path[len(self.folder) :].lstrip("/") if self.folder else path
        out = None
        for keep, only_folders, pattern in self.rules:
            if (is_folder or not only_folders) and pattern.match(tail):
                out = not keep
        return out


def walk(root: str) -> Iterator[str]:
    """Relative paths of the files that no ignore file hides; hidden folders and
    files are left out. Ignored folders are not entered."""

    def visit(folder: str, rules: list[Ignore]) -> Iterator[str]:
        here = os.path.join(root, folder)
        for name in (".gitignore", ".ignore"):
            if os.path.isfile(os.path.join(here, name)):
                with open(os.path.join(here, name), encoding="utf-8", errors="replace") as f:
                    rules = [*rules, Ignore(folder, f.read())]
        for entry in sorted(os.scandir(here), key=lambda e: e.name):
            if entry.name.startswith(".") or entry.is_symlink():
                continue
            path = f"{folder}/{entry.name}" if folder else entry.name
            said = [v for r in rules if (v := r.verdict(path, entry.is_dir())) is not None]
            if said and said[-1]:
                continue
            if entry.is_dir():
                yield from visit(path, rules)
            elif entry.is_file():
                yield path

    yield from visit("", [])


def _selected(config: Config):
    join = lambda globs: re.compile("^(?:" + "|".join(glob_pattern(g) for g in globs) + ")$") if globs else re.compile(r"(?!)")
    return join(config.include), join(config.exclude)


def discover(root: str, config: Config = Config()) -> list[tuple[str, str]]:
    """(path, language) of the code files to index, by path: not ignored, not
    excluded, of a known language, and included."""
    include, exclude = _selected(config)
    return sorted((p, language_of(p)) for p in walk(root) if not exclude.match(p) and language_of(p) != "other" and include.match(p))


def present_languages(root: str, config: Config = Config()) -> set[str]:
    """Languages that have files under ``root``, whatever is included."""
    _, exclude = _selected(config)
    return {language_of(p) for p in walk(root) if not exclude.match(p)} - {"other"}


def include_for(languages: set[str]) -> tuple[str, ...]:
    """Globs of all files of the given languages."""
    from tessera.functions.tables import LANGUAGE_OF

    return tuple(f"**/*.{e}" for e, lang in LANGUAGE_OF.items() if lang in languages)


def local_files(spark: SparkSession, root: str, config: Config = Config()) -> DataFrame:
    """path, lang, mtime_ms, text of the files that ``discover`` gives, read by
    tasks; the root must be on a file system that executors see."""
    found = discover(root, config)
    base = os.path.abspath(root)

    def read(batches: Iterator) -> Iterator:
        for rows in batches:
            full = [os.path.join(base, p) for p in rows["path"]]
            texts = []
            for f in full:
                with open(f, encoding="utf-8", errors="replace", newline="") as h:
                    texts.append(h.read())
            yield rows.assign(mtime_ms=[os.stat(f).st_mtime * 1000 for f in full], text=texts)

    listed = spark.createDataFrame(found or [], "path string, lang string")
    return listed.repartition(max(1, min(256, len(found) // 64 + 1))).mapInPandas(read, "path string, lang string, mtime_ms double, text string")


def stored_files(spark: SparkSession, uri: str, config: Config = Config()) -> DataFrame:
    """path, lang, mtime_ms, text of a tree in any store that Spark reads,
    filtered by the configuration's globs before texts are decoded."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(uri)
    prefix = uri.rstrip("/") + "/"
    path = F.regexp_replace(F.col("path"), "^.*?" + re.escape(prefix.split("://", 1)[-1].lstrip("/")), "")
    rows = raw.select(path.alias("path"), (F.unix_millis("modificationTime").cast("double")).alias("mtime_ms"), "content")
    kept = rows.where(matches_globs(F.col("path"), config.include) & ~matches_globs(F.col("path"), config.exclude)).withColumn("lang", language(F.col("path"))).where("lang != 'other'")
    return kept.select("path", "lang", "mtime_ms", F.expr("make_valid_utf8(cast(content as string))").alias("text"))


def matches(path: str, globs) -> bool:
    return any(fnmatch.fnmatch(path, g) or re.match(glob_pattern(g) + "$", path) for g in globs)
