"""Import resolution: every import gives candidate paths in order, and the
first that exists in the tree wins. Parsing is per file; the look-up is a join."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.paths import normalise, parent
from tessera.functions.tables import SCRIPT_EXTENSIONS


def resolve_first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """src, ord, dst: for each import (src, ord) the first of its ``candidates``
    (array of paths) that is a file (path)."""
    each = candidates.select("src", "ord", F.posexplode("candidates").alias("at", "path"))
    found = each.join(files.select("path").distinct(), "path")
    return found.groupBy("src", "ord").agg(F.min_by("path", "at").alias("dst"))


def script_candidates(source: Column, specifier: Column) -> Column:
    """Paths that a relative specifier may mean: as written, then with each
    extension in place of its own, then as a directory's index."""
    base = normalise(F.concat_ws("/", parent(source), specifier))
    stem = F.regexp_replace(base, r"\.(?:" + "|".join(SCRIPT_EXTENSIONS) + r")$", "")
    plain = F.regexp_replace(stem, r"(?<=[^/])\.[^./]*$", "")
    tails = F.array(*(F.lit(e) for e in SCRIPT_EXTENSIONS))
    return F.concat(F.array(base), F.transform(tails, lambda e: F.concat(plain, F.lit("."), e)), F.transform(tails, lambda e: F.concat(stem, F.lit("/index."), e)))


#: A quoted specifier of import, export-from, require or dynamic import.
SCRIPT_IMPORT = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\n]+)["']"""


def script_imports(files: DataFrame) -> DataFrame:
    """src, ord, candidates of the relative imports of script files."""
    found = files.select(F.col("path").alias("src"), F.posexplode(F.regexp_extract_all("text", F.lit(SCRIPT_IMPORT), F.lit(1))).alias("ord", "spec"))
    near = found.where(F.col("spec").rlike(r"^\.\.?(/|$)"))
    return near.select("src", "ord", script_candidates(F.col("src"), F.col("spec")).alias("candidates"))


def python_modules(path: str, text: str) -> list[list[str]]:
    """Candidate files of each import of a Python text, nested ones included: a
    module, and each imported name as a module of it."""
    import ast

    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    folder = path.rsplit("/", 1)[0].split("/") if "/" in path else []
    out: list[list[str]] = []

    def add(bases: list[list[str]], parts: list[str]) -> None:
        if parts:
            out.append([tail for base in bases for tail in ("/".join([*base, *parts]) + ".py", "/".join([*base, *parts, "__init__.py"]))])

    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            for name in node.names:
                add([[], ["src"]], name.name.split("."))
        elif isinstance(node, ast.ImportFrom):
            parts = node.module.split(".") if node.module else []
            if node.level:
                if node.level - 1 > len(folder):
                    continue
                bases = [folder[: len(folder) - node.level + 1]]
            else:
                bases = [[], ["src"]]
            add(bases, parts)
            for name in node.names:
                if name.name != "*":
                    add(bases, [*parts, name.name])
    return out


def java_package(text: str) -> str | None:
    """The declared package, if it is the first statement."""
    for line in text.splitlines():
        if m := re.match(r"\s*package\s+([\w.]+)\s*;", line):
            return m[1]
        if re.match(r"\s*(import|public|class)\s", line):
            return None
    return None


def java_modules(path: str, text: str) -> list[list[str]]:
    """Candidates of each import: below the root that the file's own package
    gives, then the usual roots; a static import without its member."""
    package = java_package(text)
    folder = path.rsplit("/", 1)[0] if "/" in path else ""
    roots: list[str] = []
    tail = package.replace(".", "/") if package else ""
    if not tail:
        roots.append(folder)
    elif folder == tail or folder.endswith("/" + tail):
        roots.append(folder[: len(folder) - len(tail)].rstrip("/"))
    roots += [r for r in ("src/main/java", "src/test/java", "src", "") if r not in roots]
    out = []
    for static, name, star in re.findall(r"^\s*import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", text, re.M):
        parts = name.split(".")
        if static and not star:
            parts = parts[:-1]
        end = "/*" if star and not static else ".java"
        out.append(["/".join(x for x in (r, "/".join(parts)) if x) + end for r in roots])
    return out


def rust_modules(path: str, text: str) -> list[list[str]]:
    """Candidates of ``mod x;`` and of ``use`` paths from crate, self and super:
    the deepest module that is a file comes first."""
    folder, name = path.rsplit("/", 1) if "/" in path else ("", path)
    own = folder if name in ("lib.rs", "main.rs", "mod.rs") else f"{folder}/{name[:-3]}".lstrip("/")
    source = "/".join(path.split("/")[: path.split("/").index("src") + 1]) if "src" in path.split("/") else folder
    join = lambda *p: "/".join(x for x in p if x)
    out = []
    code = re.sub(r"//[^\n]*", "", text)
    for m in re.findall(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", code, re.M):
        out.append([join(own, m + ".rs"), join(own, m, "mod.rs")])
    for use in re.findall(r"\buse\s+((?:crate|self|super)[^;]*);", code):
        for one in _use_paths(use):
            segs = one.split("::")
            base = {"crate": source, "self": own}.get(segs[0], own)
            rest = segs[1:]
            if segs[0] == "super":
                base = own.rsplit("/", 1)[0] if "/" in own else ""
                while rest and rest[0] == "super":
                    base, rest = (base.rsplit("/", 1)[0] if "/" in base else ""), rest[1:]
            tails = []
            for k in range(len(rest), 0, -1):
                tails += [join(base, *rest[:k]) + ".rs", join(base, *rest[:k], "mod.rs")]
            if segs[0] == "crate":
                tails += [join(source, "lib.rs"), join(source, "main.rs")]
            out.append(tails)
    return [x for x in out if x]


def _use_paths(text: str) -> list[str]:
    """The single paths of a use tree."""
    text = re.sub(r"\s+", " ", text.strip())
    text = re.sub(r" as \w+", "", text).replace(" ", "")
    at = text.find("{")
    if at < 0:
        return [text.removesuffix("::*").removesuffix("::self")]
    depth, parts, last = 0, [], at + 1
    for i in range(at, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if not depth:
                parts.append(text[last:i])
                break
        elif text[i] == "," and depth == 1:
            parts.append(text[last:i])
            last = i + 1
    return [q for p in parts if p for q in _use_paths(text[:at] + p)]


def php_uses(text: str) -> list[str]:
    """Qualified names of the ``use`` statements of a PHP text, groups expanded
    and aliases left out. In bodies, ``use`` means traits and captured variables."""
    from tessera.operators.structure import masked_spans

    code, at = [], 0
    for a, b, _ in masked_spans("php", text):
        code.append(text[at:a] + " " * (b - a))
        at = b
    out: list[str] = []
    foreign, namespaces, statement = 0, 0, ""  # open braces of bodies and of namespaces
    for part in re.findall(r"[{};]|[^{};]+", "".join(code) + text[at:]):
        statement = re.sub(r"^\s*<\?(?:php\b|=)?", "", statement)
        group = re.match(r"\s*use\b(?!\s*\()", statement) and not foreign
        if part == "{" and not group:
            namespaces, foreign = (namespaces + 1, 0) if not foreign and re.match(r"\s*namespace\b", statement) else (namespaces, foreign + 1)
            statement = ""
        elif part == "}" and not group:
            namespaces, foreign = (namespaces, foreign - 1) if foreign else (max(namespaces - 1, 0), 0)
            statement = ""
        elif part == ";":
            if group:
                out += _use_names(statement)
            statement = ""
        else:
            statement += part
    return out


def _use_names(statement: str) -> list[str]:
    """Names of ``use [function|const] A\\B, C as D`` or ``use A\\{B, C\\D}``."""
    body = re.sub(r"^\s*use\s+(?:(?:function|const)\s+)?", "", statement)
    prefix, brace, inner = body.partition("{")
    names = (inner.rpartition("}")[0] if brace else prefix).split(",")
    bare = [re.sub(r"^\s*(?:(?:function|const)\s+)?([\w\\]*).*", r"\1", n, flags=re.S).strip("\\") for n in names]
    head = prefix.strip().strip("\\") if brace else ""
    return [f"{head}\\{n}" if head else n for n in bare if n]


def php_names(files: DataFrame) -> DataFrame:
    """src, name of the names that PHP files (path, text) use."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for rows in batches:
            yield pd.DataFrame([(p, n) for p, t in zip(rows["path"], rows["text"]) for n in php_uses(t or "")], columns=["src", "name"])

    return files.select("path", "text").mapInPandas(run, "src string, name string")


PARSERS = {"python": python_modules, "java": java_modules, "rust": rust_modules}


def parsed_imports(files: DataFrame, language: str) -> DataFrame:
    """src, ord, candidates of the files (path, text) of a language with a parser."""
    parse = PARSERS[language]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for rows in batches:
            out = [(p, k, c) for p, t in zip(rows["path"], rows["text"]) for k, c in enumerate(parse(p, t or ""))]
            yield pd.DataFrame(out, columns=["src", "ord", "candidates"])

    return files.select("path", "text").mapInPandas(run, "src string, ord int, candidates array<string>")


#: Languages that share a resolver.
GROUPS = [["ts", "tsx", "js"], ["python"], ["java"], ["rust"], ["php"]]


def all_edges(files: DataFrame, languages: set[str], namespaces: DataFrame | None = None) -> DataFrame:
    """src, dst of all files (path, lang, text), each in its language's graph."""
    from tessera.operators.graph import union_graphs

    return union_graphs(files.sparkSession, [import_graph(files.where(F.col("lang").isin(group)), group[0], namespaces) for group in GROUPS if languages & set(group)]).distinct()


def import_graph(files: DataFrame, language: str, namespaces: DataFrame | None = None) -> DataFrame:
    """src, dst of one language's files (path, text). ``namespaces`` (prefix,
    root, ord) are those of PHP. Languages without a resolver have no edges,
    rather than guessed ones."""
    spark = files.sparkSession
    if language == "php" and namespaces is not None:
        return psr4_edges(php_names(files), namespaces, files)
    if language in ("ts", "tsx", "js"):
        wanted = script_imports(files)
    elif language in PARSERS:
        wanted = parsed_imports(files, language)
    else:
        return spark.createDataFrame([], "src string, dst string")
    found = resolve_first(wanted, files).select("src", "dst")
    if language == "java":  # a wildcard means all files of the directory, in the first root that has any
        stars = wanted.select("src", "ord", F.posexplode("candidates").alias("at", "path")).where(F.endswith("path", F.lit("/*")))
        inside = stars.withColumn("_dir", F.regexp_replace("path", r"/\*$", "")).join(files.select(F.col("path").alias("dst"), parent(F.col("path")).alias("_dir")), "_dir")
        first = inside.withColumn("_k", F.dense_rank().over(Window.partitionBy("src", "ord").orderBy("at"))).where("_k = 1")
        found = found.unionByName(first.select("src", "dst"))
    return found.where("src != dst").distinct()


def longest_prefix(names: DataFrame, prefixes: DataFrame, separator: str) -> DataFrame:
    """name, prefix, root: the longest prefix that fits each name, and no other:
    a shorter one is not tried when nothing is found below it. ``names`` (name)
    meet ``prefixes`` (prefix, and more) by equality on their leading segments;
    the empty prefix fits every name."""
    parts = F.split("name", re.escape(separator))
    cuts = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(parts, 1, k), separator).alias("prefix")))
    each = names.select("name", F.explode(cuts).alias("c")).select("name", "c.k", "c.prefix")
    hit = each.join(prefixes, "prefix")
    best = hit.groupBy("name").agg(F.max("k").alias("k"))
    return hit.join(best, ["name", "k"]).select("name", *prefixes.columns)


def psr4_edges(uses: DataFrame, prefixes: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst of qualified names used (src, name): of the longest prefix
    (prefix, root, ord) above the name, the first root that has the file that
    the rest of the name gives. A prefix itself names no class."""
    cut = F.locate("\\", F.reverse("name"))
    space = F.when(cut > 0, F.substring("name", F.lit(1), F.char_length("name") - cut)).otherwise("")
    each = uses.select("src", "name", space.alias("space"))
    owner = longest_prefix(each.select(F.col("space").alias("name")).distinct(), prefixes, "\\").withColumnRenamed("name", "space")
    rest = F.substring("name", F.when(F.col("prefix") == "", 1).otherwise(F.char_length("prefix") + 2), F.char_length("name"))
    path = F.concat(F.when(F.col("root") != "", F.concat(F.regexp_replace("root", "/$", ""), F.lit("/"))).otherwise(""), F.replace(rest, F.lit("\\"), F.lit("/")), F.lit(".php"))
    found = each.join(owner, "space").select("src", "name", "ord", path.alias("dst")).join(files.select(F.col("path").alias("dst")), "dst", "left_semi")
    return found.groupBy("src", "name").agg(F.min_by("dst", "ord").alias("dst")).select("src", "dst").where("src != dst").distinct()


def qualified_names(files: DataFrame, prefixes: DataFrame, extension: str, separator: str) -> DataFrame:
    """path, name: the qualified name that a file's place gives, by the deepest
    root (prefix, root) above it."""
    from tessera.functions.paths import ancestors

    homes = prefixes.select("prefix", F.regexp_replace("root", "/$", "").alias("_dir"))
    above = files.where(F.endswith("path", F.lit(extension))).select("path", F.posexplode(ancestors(parent(F.col("path")))).alias("up", "_dir"))
    hit = above.join(homes, "_dir").groupBy("path").agg(F.min_by(F.struct("prefix", "_dir"), "up").alias("h"))
    tail = F.substring("path", F.char_length("h._dir") + F.when(F.col("h._dir") == "", 1).otherwise(2), F.char_length("path") - F.char_length("h._dir") - F.when(F.col("h._dir") == "", 0).otherwise(1) - len(extension))
    return hit.select("path", F.concat_ws(separator, F.nullif("h.prefix", F.lit("")), F.replace(tail, F.lit("/"), F.lit(separator))).alias("name"))
