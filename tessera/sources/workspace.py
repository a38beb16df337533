"""Packages of a repository, from their manifests."""

from __future__ import annotations

import json
import os
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tessera.sources.discover import walk

#: Files that describe a package.
MANIFESTS = ["package.json", "Cargo.toml", "pyproject.toml"]


@dataclass
class Package:
    name: str
    dir: str
    deps: list[str] = field(default_factory=list)
    ts_types: list[str] = field(default_factory=list)
    ts_lib: list[str] = field(default_factory=list)


def requirement_name(spec: str) -> str:
    """The project of a requirement such as ``celery[redis]>=5; python_version``."""
    return re.match(r"\s*([A-Za-z0-9._-]*)", spec)[1]


def parse_manifest(name: str, text: str) -> tuple[str | None, list[str]] | None:
    """(package name, dependencies), or None if the manifest names no package
    (as the root of a Cargo workspace) or can't be read."""
    try:
        data = json.loads(text) if name == "package.json" else tomllib.loads(text)
    except ValueError:
        return None
    if not isinstance(data, dict):
        return None
    if name == "package.json":
        deps = [d for key in ("dependencies", "devDependencies", "peerDependencies") for d in (data.get(key) or {})]
        return data.get("name"), deps
    if name == "Cargo.toml":
        return (data["package"].get("name"), list(data.get("dependencies", {}))) if "package" in data else None
    project, poetry = data.get("project"), data.get("tool", {}).get("poetry")
    if project is None and poetry is None:
        return None
    deps = [requirement_name(d) for d in (project or {}).get("dependencies", [])]
    deps += [d for d in (poetry or {}).get("dependencies", {}) if d.lower() != "python"]
    return (project or {}).get("name") or (poetry or {}).get("name"), deps


def detect(root: str) -> tuple[list[Package], bool]:
    """The packages by directory, and whether there are several; a repository
    without a manifest is one package, "root"."""
    found = {}
    for path in walk(root):
        folder, name = os.path.split(path)
        if name in MANIFESTS and folder not in found:
            with open(os.path.join(root, path), encoding="utf-8", errors="replace") as f:
                parsed = parse_manifest(name, f.read())
            if parsed:
                found[folder] = Package(parsed[0] or os.path.basename(folder) or "root", folder, parsed[1], *_typescript(os.path.join(root, folder)))
    packages = [found[d] for d in sorted(found)] or [Package("root", "")]
    return packages, len(packages) > 1


def _typescript(folder: str) -> tuple[list[str], list[str]]:
    try:
        with open(os.path.join(folder, "tsconfig.json"), encoding="utf-8") as f:
            options = json.loads(re.sub(r"^\s*//.*$", "", f.read(), flags=re.M)).get("compilerOptions", {})
        return [t.lower() for t in options.get("types", [])], [t.lower() for t in options.get("lib", [])]
    except (OSError, ValueError, AttributeError):
        return [], []


def package_table(spark: SparkSession, packages: list[Package]) -> DataFrame:
    """The packages as a table, with the role their dependencies give; unknown
    is stored as null."""
    from pyspark.sql import functions as F

    from tessera.operators.weight import infer_role

    raw = spark.createDataFrame([(p.name, p.dir, p.deps, p.ts_types, p.ts_lib) for p in packages], "name string, dir string, deps array<string>, ts_types array<string>, ts_lib array<string>")
    role = infer_role(F.col("name"), F.col("dir"), F.col("deps"), F.col("ts_types"), F.col("ts_lib"))
    return raw.select("name", "dir", F.nullif(role, F.lit("unknown")).alias("role"), "deps")


def namespaces(root: str) -> list[tuple[str, str, int]]:
    """(prefix, root, ord): the directories that ``composer.json`` gives to PHP
    namespaces, in order; of a prefix given twice the first entry counts. None
    without that file or if it can't be read."""
    try:
        with open(os.path.join(root, "composer.json"), encoding="utf-8") as f:
            data = json.load(f)
    except (OSError, ValueError):
        return []
    found: dict[str, list[str]] = {}
    for key in ("autoload", "autoload-dev"):
        block = data.get(key) if isinstance(data, dict) else None
        entries = block.get("psr-4") if isinstance(block, dict) else None
        for prefix, dirs in (entries.items() if isinstance(entries, dict) else ()):
            if isinstance(dirs, (str, list)):
                found.setdefault(prefix.rstrip("\\"), [d for d in ([dirs] if isinstance(dirs, str) else dirs) if isinstance(d, str)])
    return [(prefix, re.sub(r"^(?:\./)+", "", d).rstrip("/"), k) for prefix, dirs in found.items() for k, d in enumerate(dirs)]
