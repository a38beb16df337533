"""Fingerprints of trees: path to hash, stored with a version."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.hashing import fnv1a_bytes
from tessera.sources.discover import walk


def hash_file(path: str) -> str | None:
    try:
        with open(path, "rb") as f:
            return fnv1a_bytes(f.read())
    except OSError:
        return None


def source_fingerprint(root: str, is_input, extra: list[str] = (), skip: list[str] = ()) -> dict[str, str]:
    """Hashes of the inputs below ``root`` that aren't in a skipped folder, and
    of the extra files that exist."""
    chosen = {p for p in walk(root) if is_input(p) and not set(p.split("/")[:-1]) & set(skip)}
    found = {p: hash_file(os.path.join(root, p)) for p in sorted(chosen | set(extra))}
    return {p: h for p, h in found.items() if h}


def store(path: str, version: int, fingerprint: dict[str, str]) -> None:
    """Written beside its place and moved there: a reader sees all or nothing."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".tmp", "w", encoding="utf-8") as f:
        json.dump({"version": version, "files": fingerprint}, f, sort_keys=True)
    os.replace(path + ".tmp", path)


def load(path: str, version: int) -> dict[str, str] | None:
    """None if there is none of this version."""
    try:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        return data["files"] if data["version"] == version else None
    except (OSError, ValueError, KeyError, TypeError):
        return None


def table(spark: SparkSession, fingerprint: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(sorted(fingerprint.items()), "path string, hash string")


def drifted(root: str, stored: dict[str, str], current: dict[str, str]) -> list[str]:
    """Paths whose cached data can't be trusted any more."""
    out = [p for p, h in current.items() if stored.get(p) != h]
    out += [p for p, h in stored.items() if p not in current and not p.startswith("//") and hash_file(os.path.join(root, p)) != h]
    return sorted(out)
