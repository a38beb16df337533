"""Structure of source texts: one flat, pre-order table of nodes per file.

Python is parsed exactly, with the standard library; other languages by a
scanner that masks strings and comments, finds declarations by patterns and
matches braces. What it can't tell it leaves out.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from tessera.functions.tables import LANGUAGE_OF
from tessera.schemas import NODES


def language_of(path: str) -> str:
    if path.endswith(".d.ts"):
        return "other"
    name = path.rsplit("/", 1)[-1]
    return LANGUAGE_OF.get(name.rsplit(".", 1)[1], "other") if "." in name[1:] else "other"


# strings and comments

_STRINGS = {
    "python": r'[rbfuRBFU]{0,2}"""(?:\\.|[^\\])*?"""|[rbfuRBFU]{0,2}\'\'\'(?:\\.|[^\\])*?\'\'\'|[rbfuRBFU]{0,2}"(?:\\.|[^"\\\n])*"|[rbfuRBFU]{0,2}\'(?:\\.|[^\'\\\n])*\'',
    "rust": r'b?r(#*)".*?"\1|b?"(?:\\.|[^"\\])*"|b?\'(?:\\.[^\']*|[^\'\\])\'',
    "go": r'`[^`]*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "js": r'`(?:\\.|[^`\\])*`|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'',
    "swift": r'"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"',
    "other": r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'',
}
_COMMENTS = {"python": r"#[^\n]*", "ruby": r"#[^\n]*|^=begin\b.*?^=end\b[^\n]*", "php": r"//[^\n]*|/\*.*?\*/|#(?!\[)[^\n]*"}
_LEXERS: dict[str, re.Pattern] = {}


def masked_spans(language: str, text: str) -> list[tuple[int, int, str]]:
    """(start, end, "string" or "comment") of the characters that aren't code."""
    if language not in _LEXERS:
        strings = _STRINGS.get({"ts": "js", "tsx": "js"}.get(language, language), _STRINGS["other"])
        comments = _COMMENTS.get(language, r"//[^\n]*|/\*.*?\*/")
        _LEXERS[language] = re.compile(f"(?P<comment>{comments})|(?P<string>{strings.replace(chr(92) + '1', '(?P=hashes)').replace('(#*)', '(?P<hashes>#*)')})", re.S | re.M)
    return [(m.start(), m.end(), "comment" if m.group("comment") is not None else "string") for m in _LEXERS[language].finditer(text)]


def mask(language: str, text: str) -> str:
    """``text`` with strings and comments blanked, line ends kept."""
    out, at = [], 0
    for a, b, _ in masked_spans(language, text):
        out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
        at = b
    return "".join([*out, text[at:]])


# nodes


@dataclass
class Node:
    """A node with its extent in characters; ``is_symbol`` false for parts."""

    id: str
    name: str | None
    kind: str
    start: int
    end: int
    parent: str | None = None
    depth: int = 0
    is_symbol: bool = True


def _closing(code: str, at: int, pair: str) -> int:
    """The position behind the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(code)):
        if code[i] == pair[0]:
            depth += 1
        elif code[i] == pair[1]:
            depth -= 1
            if not depth:
                return i + 1
    return len(code)


def _split_parameters(code: str, start: int, end: int, text: str) -> list[tuple[int, int]]:
    """The extents of the comma-separated items between brackets; ``text`` is
    the code before masking."""
    out, depth, last = [], 0, start
    for i in range(start, end):
        if code[i] in "([{<":
            depth += 1
        elif code[i] in ")]}>" and not (code[i] == ">" and code[i - 1] in "-="):
            depth -= 1
        if code[i] == "," and depth == 0:
            out.append((last, i))
            last = i + 1
    out.append((last, end))
    kept = []
    for a, b in out:
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            kept.append((a, b))
    return kept


_SELF = re.compile(r"^(?:self|cls|&?\s*(?:'\w+\s+)?(?:mut\s+)?self\b.*)$", re.S)
_MODIFIERS = r"(?:(?:export|default|pub(?:\([^)]*\))?|public|private|protected|internal|open|fileprivate|static|abstract|final|async|unsafe|extern|const|override|declare|readonly|synchronized|native|virtual|inline|mutating|lazy|weak|required|convenience)\s+)*"

#: Declarations by language: (role, kind, pattern with the group ``name``).
#: Roles: fn, container (members get its name), type, field, wrap (searched
#: through, with its name as a prefix but no node of its own).
_DECLARATIONS: dict[str, list[tuple[str, str, str]]] = {
    "js": [
        ("fn", "function", _MODIFIERS + r"function\s*\*?\s*(?P<name>[\w$]+)"),
        ("container", "class", _MODIFIERS + r"class\s+(?P<name>[\w$]+)"),
        ("container", "interface", _MODIFIERS + r"interface\s+(?P<name>[\w$]+)"),
        ("container", "enum", _MODIFIERS + r"enum\s+(?P<name>[\w$]+)"),
        ("type", "type", _MODIFIERS + r"type\s+(?P<name>[\w$]+)(?=[^=\n]*=)"),
        ("field", "var", r"(?:export\s+)?(?:const|let|var)\s+(?P<name>[\w$]+)"),
    ],
    "go": [
        ("fn", "method", r"func\s*\(\s*\w*\s*\*?(?P<owner>\w+)[^)]*\)\s*(?P<name>\w+)"),
        ("fn", "function", r"func\s+(?P<name>\w+)"),
        ("type", "struct", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("type", "interface", r"type\s+(?P<name>\w+)(?:\[[^\]]*\])?\s+interface\b"),
        ("type", "type", r"type\s+(?P<name>\w+)"),
        ("field", "var", r"(?:const|var)\s+(?P<name>\w+)"),
    ],
    "java": [
        ("container", "class", _MODIFIERS + r"(?:class|record)\s+(?P<name>\w+)"),
        ("container", "interface", _MODIFIERS + r"interface\s+(?P<name>\w+)"),
        ("container", "enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"),
    ],
    "php": [
        ("container", "class", _MODIFIERS + r"(?:class|trait)\s+(?P<name>\w+)"),
        ("container", "interface", _MODIFIERS + r"interface\s+(?P<name>\w+)"),
        ("container", "enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"),
        ("fn", "function", _MODIFIERS + r"function\s+&?\s*(?P<name>\w+)"),
        ("field", "var", _MODIFIERS + r"const\s+(?:\w+\s+)?(?P<name>\w+)\s*="),
        ("field", "var", r"(?:(?:public|private|protected|static|readonly|var)\s+)+(?:[?\w\\|]+\s+)?(?P<name>\$\w+)"),
    ],
    "c": [
        ("type", "struct", r"(?:typedef\s+)?(?:struct|union)\s+(?P<name>\w+)\s*(?=\{)"),
        ("type", "enum", r"(?:typedef\s+)?enum\s+(?P<name>\w+)\s*(?=\{)"),
        ("fn", "function", r"(?:[A-Za-z_][\w:<>,]*[\s*&]+)+(?P<name>~?\w+)\s*(?=\([^;{}]*\)[^;{}()]*\{)"),
    ],
    "swift": [
        ("container", "class", _MODIFIERS + r"(?:class|actor|extension)\s+(?!func|var|let)(?P<name>\w+)"),
        ("container", "struct", _MODIFIERS + r"struct\s+(?P<name>\w+)"),
        ("container", "enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"),
        ("container", "interface", _MODIFIERS + r"protocol\s+(?P<name>\w+)"),
        ("fn", "function", _MODIFIERS + r"func\s+(?P<name>\w+)"),
        ("fn", "method", _MODIFIERS + r"(?P<name>init)[?!]?\s*(?=\()"),
        ("field", "var", _MODIFIERS + r"(?:class\s+)?(?:var|let)\s+(?P<name>\w+)"),
        ("field", "var", r"case\s+(?P<name>\w+)"),
    ],
    "rust": [
        ("fn", "function", _MODIFIERS + r"(?:extern\s+)?fn\s+(?P<name>\w+)"),
        ("members", "struct", _MODIFIERS + r"(?:struct|union)\s+(?P<name>\w+)"),
        ("members", "enum", _MODIFIERS + r"enum\s+(?P<name>\w+)"),
        ("container", "interface", _MODIFIERS + r"trait\s+(?P<name>\w+)"),
        ("wrap", "impl", r"(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s*(?:[^{;]*?\bfor\s+)?&?(?:\w+::)*(?P<name>\w+)"),
        ("flat", "mod", _MODIFIERS + r"mod\s+(?P<name>\w+)\s*(?=\{)"),
        ("fn", "function", r"macro_rules!\s*(?P<name>\w+)"),
        ("type", "type", _MODIFIERS + r"type\s+(?P<name>\w+)"),
        ("field", "var", r"(?:pub(?:\([^)]*\))?\s+)?(?:const|static)\s+(?:mut\s+)?(?P<name>\w+)\s*:"),
    ],
}
_DECLARATIONS["ts"] = _DECLARATIONS["tsx"] = _DECLARATIONS["js"]
_DECLARATIONS["cpp"] = [("container", "class", r"class\s+(?P<name>\w+)(?=[^;{()]*\{)"), ("container", "class", r"namespace\s+(?P<name>\w+)"), *_DECLARATIONS["c"]]
#: Members of containers that only stand there.
_MEMBERS: dict[str, list[tuple[str, str, str]]] = {
    "js": [
        ("fn", "method", r"(?:(?:public|private|protected|static|async|override|abstract|readonly|get|set)\s+)*\*?(?P<name>#?[\w$]+)\s*(?=(?:<[^(]*>)?\([^;{}]*\)\s*(?::[^{;]+)?\{)"),
        ("field", "var", r"(?:(?:public|private|protected|static|readonly|declare)\s+)*(?P<name>#?[\w$]+)\s*[?!]?\s*(?=[:=;,]|\s*\n|$)"),
    ],
    "java": [
        ("fn", "method", r"(?:@\w+(?:\([^)]*\))?\s+)*" + _MODIFIERS + r"(?:<[^>]*>\s+)?(?:[\w.<>\[\],?]+\s+)?(?P<name>\w+)\s*(?=\([^;{}]*\)\s*(?:throws[^;{]*)?[;{])"),
        ("field", "var", _MODIFIERS + r"[\w.<>\[\],?]+\s+(?P<name>\w+)\s*(?=[=;])"),
    ],
    "swift": [],
}
_MEMBERS["ts"] = _MEMBERS["tsx"] = _MEMBERS["js"]
#: Words that open a block without declaring anything.
_CONTROL = {"if", "for", "while", "switch", "catch", "return", "else", "do", "try", "new", "match", "loop", "function", "await", "throw", "case", "in", "of"}


class _Scanner:
    def __init__(self, path: str, text: str, language: str) -> None:
        self.path, self.text, self.language, self.nodes = path, text, language, []
        self.code = mask(language, text)
        self.comments = [(a, b) for a, b, k in masked_spans(language, text) if k == "comment"]
        join = lambda rules: re.compile("|".join(f"(?P<r{i}>(?<![\\w$.@]){p.replace('?P<name>', f'?P<n{i}>').replace('?P<owner>', f'?P<o{i}>')})" for i, (_, _, p) in enumerate(rules)))
        self.top = _DECLARATIONS.get(language, [])
        self.inner = [*self.top, *_MEMBERS.get(language, [])]
        self.patterns = {id(r): join(r) for r in (self.top, self.inner) if r}

    def scan(self, start: int, end: int, prefix: str, parent: str | None, depth: int) -> None:
        rules = self.inner if prefix else self.top
        if not rules:
            return
        pattern, at = self.patterns[id(rules)], start
        while m := pattern.search(self.code, at, end):
            i = next(k for k in range(len(rules)) if m.group(f"r{k}") is not None)
            role, kind, _ = rules[i]
            name = m.group(f"n{i}")
            first = m.group(0).split(None, 1)[0]
            if name in _CONTROL or first in _CONTROL - {"function"} and (first, self.language) != ("case", "swift"):
                at = max(m.end(), at + 1)
                continue
            owner = m.groupdict().get(f"o{i}")
            at = max(at + 1, self.declare(m, role, kind, name, f"{owner}." if owner else prefix, parent, depth, end))

    def declare(self, m, role: str, kind: str, name: str, prefix: str, parent: str | None, depth: int, end: int) -> int:
        code, begin = self.code, m.start()
        begin += len(m.group(0)) - len(m.group(0).lstrip())
        open_, params = None, None
        i, angle = m.end(), 0
        while i < end:  # to the body, or to where the declaration stops
            ch = code[i]
            if ch == "(" and role == "fn" and params is None:
                params = (i, _closing(code, i, "()"))
                i = params[1]
                continue
            if ch in "([":
                i = _closing(code, i, "()" if ch == "(" else "[]")
                continue
            if ch == "<" and role != "field":
                angle += 1
            elif ch == ">" and angle and code[i - 1] not in "-=":
                angle -= 1
            elif ch == "{" and (role not in ("field", "type") or kind in ("struct", "enum", "interface")) and not angle:
                open_ = i
                break
            elif ch == "{":
                i = _closing(code, i, "{}")
                continue
            elif ch == ";" or ch == "}" or role == "field" and (ch == "," and self.language in ("rust", "ts", "js", "tsx")) or ch == "\n" and self.stops(role, code, i):
                break
            i += 1
        stop = _closing(code, open_, "{}") if open_ is not None else min(i + (i < end and code[i] == ";"), end)
        if role in ("wrap", "flat"):
            if open_ is not None:
                self.scan(open_ + 1, stop - 1, f"{name}." if role == "wrap" else prefix, parent, depth)
            return stop
        full = f"{prefix}{name}"
        node = Node(f"{self.path}#{full}", name, "method" if role == "fn" and prefix else kind, begin, stop, parent, depth)
        self.nodes.append(node)
        self.doc(node)
        if role == "fn":
            if params:
                self.part(node, "params", *params)
                listed = [x for x in _split_parameters(code, params[0] + 1, params[1] - 1, self.text) if not _SELF.match(code[x[0] : x[1]])]
                for k, (a, b) in enumerate(listed):
                    self.part(node, f"param.{k}", a, b)
                found = re.match(r"\s*(?:->|:)\s*", code[params[1] : open_ if open_ is not None else stop])
                if found:
                    a = params[1] + found.end()
                    b = a + len(re.split(r"\bwhere\b", code[a : open_ if open_ is not None else stop].rstrip(" ;\n\t"))[0].rstrip())
                    if b > a:
                        self.part(node, "return", a, b)
            if open_ is not None:
                self.part(node, "body", open_, stop)
        elif role == "container" and open_ is not None:
            self.scan(open_ + 1, stop - 1, f"{full}.", node.id, depth + 1)
        elif role == "members" and open_ is not None:
            for a, b in _split_parameters(code, open_ + 1, stop - 1, self.text):
                if found := re.match(r"(?:#\[[^\]]*\]\s*)*(?:pub(?:\([^)]*\))?\s+)?(\w+)", code[a:b]):
                    self.nodes.append(Node(f"{node.id}.{found[1]}", found[1], "var", a, b, node.id, depth + 1))
        return stop

    def stops(self, role: str, code: str, i: int) -> bool:
        """Whether a line end closes the declaration."""
        rest = code[i:].lstrip()[:2]
        if role == "field" and self.language in ("js", "ts", "tsx", "swift", "go"):
            return rest[:1] not in (".", "=", "+", "?", "|", "&", ":") and code[:i].rstrip()[-1:] not in ("=", "(", ",", "+", ">", ":")
        return role == "type" and self.language in ("go", "ts", "tsx", "swift") and rest[:1] not in ("|", "&", "=", "{") and code[:i].rstrip()[-1:] != "="

    def part(self, node: Node, tag: str, start: int, end: int) -> None:
        self.nodes.append(Node(f"{node.id}:{tag}", None, tag.split(".")[0], start, end, node.id, node.depth + 1, False))

    def doc(self, node: Node) -> None:
        """Comments that directly precede a node."""
        first, last, end = None, self.text.rfind("\n", 0, node.start) + 1, 0
        for a, b in reversed([c for c in self.comments if c[1] <= node.start]):
            between = self.text[b:last]
            alone = not self.text[self.text.rfind("\n", 0, a) + 1 : a].strip()
            marks = re.fullmatch(r"\s*(?:(?:#\[[^\]]*\]|@\w+(?:\([^)]*\))?)\s*)*", between)
            if not alone or not marks or between.strip() == "" and between.count("\n") > 1:
                break
            first, last, end = a, a, end or b
        if first is not None:
            self.part(node, "doc", first, end)


def _ruby(path: str, text: str) -> list[Node]:
    """Ruby by indentation: a definition ends with the ``end`` below it."""
    out: list[Node] = []
    rows = text.splitlines(keepends=True)
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))
    code = mask("ruby", text).splitlines(keepends=True)
    open_: list[tuple[int, Node, str]] = []
    for i, line in enumerate(code):
        indent = len(line) - len(line.lstrip())
        if open_ and re.match(r"\s*end\b", line) and indent == open_[-1][0]:
            node = open_.pop()[1]
            node.end = starts[i] + indent + 3
        if m := re.match(r"\s*(def|class|module)\s+(?:self\.)?([\w:?!=]+)", line):
            if open_ and open_[-1][2] == "def":
                continue
            names = [n.name for _, n, _ in open_]
            kind = ("method" if names else "function") if m[1] == "def" else "class"
            node = Node(f"{path}#{'.'.join([*names, m[2]])}", m[2], kind, starts[i] + indent, starts[i + 1], open_[-1][1].id if open_ else None, len(open_))
            out.append(node)
            if not re.search(r"\bend\s*$", line):
                open_.append((indent, node, m[1]))
    return out


def _python(path: str, text: str) -> list[Node]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    rows = text.splitlines(keepends=True)
    starts = [0]
    for r in rows:
        starts.append(starts[-1] + len(r))

    def place(line: int, column: int) -> int:
        row = rows[line - 1] if line <= len(rows) else ""
        return starts[line - 1] + len(row.encode()[:column].decode("utf-8", "ignore"))

    out: list[Node] = []

    def part(node: Node, tag: str, a: int, b: int) -> None:
        out.append(Node(f"{node.id}:{tag}", None, tag.split(".")[0], a, b, node.id, node.depth + 1, False))

    def visit(body: list[ast.stmt], prefix: str, parent: str | None, depth: int) -> None:
        for item in body:
            if not isinstance(item, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            first = min([item.lineno, *(d.lineno for d in item.decorator_list)])
            start = place(first, item.col_offset) if first != item.lineno else place(item.lineno, item.col_offset)
            node = Node(f"{path}#{prefix}{item.name}", item.name, "class" if isinstance(item, ast.ClassDef) else "method" if prefix else "function", start, place(item.end_lineno, item.end_col_offset), parent, depth)
            out.append(node)
            said = item.body[0]
            has_doc = isinstance(said, ast.Expr) and isinstance(said.value, ast.Constant) and isinstance(said.value.value, str)
            if has_doc:
                part(node, "doc", place(said.lineno, said.col_offset), place(said.end_lineno, said.end_col_offset))
            if isinstance(item, ast.ClassDef):
                visit(item.body, f"{prefix}{item.name}.", node.id, depth + 1)
                continue
            code = mask("python", text)
            open_ = code.index("(", place(item.lineno, item.col_offset))
            part(node, "params", open_, _closing(code, open_, "()"))
            a = item.args
            named = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
            extents = _split_parameters(code, open_ + 1, _closing(code, open_, "()") - 1, text)
            kept = [(s, e) for s, e in extents if text[s:e] not in ("*", "/")]
            k = 0
            for arg, (s, e) in zip(named, kept):
                if arg.arg not in ("self", "cls") or arg is not named[0]:
                    part(node, f"param.{k}", s, e)
                    k += 1
            if item.returns is not None:
                part(node, "return", place(item.returns.lineno, item.returns.col_offset), place(item.returns.end_lineno, item.returns.end_col_offset))
            part(node, "body", place(said.lineno, said.col_offset), node.end)

    visit(tree.body, "", None, 0)
    return out


def structure(path: str, text: str) -> list[Node]:
    """The nodes of a file, parents first, in order of place."""
    language = language_of(path)
    if language == "python":
        return _python(path, text)
    if language == "ruby":
        return _ruby(path, text)
    if language not in _DECLARATIONS:
        return []
    scanner = _Scanner(path, text, language)
    scanner.scan(0, len(text), "", None, 0)
    return scanner.nodes


class Places:
    """Characters of a text as lines from 1 and UTF-8 byte columns from 0."""

    def __init__(self, text: str) -> None:
        self.text, self.starts = text, [0]
        for i, ch in enumerate(text):
            if ch == "\n":
                self.starts.append(i + 1)

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, offset) - 1
        return line + 1, len(self.text[self.starts[line] : offset].encode())

    def offset(self, line: int, column: int) -> int | None:
        """The character at a line and byte column; columns past a line's end
        are at its end, the place behind the last line is legal."""
        if line < 1 or line > len(self.starts) + 1:
            return None
        if line == len(self.starts) + 1:
            return len(self.text)
        end = self.starts[line] - 1 if line < len(self.starts) else len(self.text)
        row = self.text[self.starts[line - 1] : end].encode()
        return self.starts[line - 1] + len(row[:column].decode("utf-8", "ignore"))


def rows(path: str, text: str) -> list[tuple]:
    """The nodes of a file as rows of the node table."""
    places, out = Places(text), []
    for ord_, n in enumerate(structure(path, text)):
        (a, c), (b, d) = places.at(n.start), places.at(n.end)
        out.append((path, n.id, n.parent, n.depth, ord_, n.name, n.kind, n.is_symbol, a, b, c, d))
    return out


def extract(files: DataFrame) -> DataFrame:
    """The node table of ``files`` (path, text): a file at a time, in batches."""
    names = [c.split()[0] for c in NODES.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            yield pd.DataFrame([r for p, t in zip(batch["path"], batch["text"]) for r in rows(p, t or "")], columns=names)

    return files.select("path", "text").mapInPandas(run, NODES)


def node_items(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their text: id, name ("?" without one), kind, file, pkg,
    start_line, end_line, text. The lines are cut in the JVM."""
    from tessera.functions.text import slice_lines

    named = nodes.where("is_symbol").withColumnRenamed("file", "path")
    joined = named.join(files.select("path", "pkg", F.col("text").alias("_text")), "path")
    return joined.select(F.col("node_id").alias("id"), F.coalesce("name", F.lit("?")).alias("name"), "kind", F.col("path").alias("file"), "pkg", "start_line", "end_line", slice_lines(F.col("_text"), F.col("start_line"), F.col("end_line")).alias("text"))


def outline(path: str, text: str) -> str:
    """A text with the outermost function bodies replaced by a placeholder."""
    shown = "..." if language_of(path) == "python" else "{ /* … */ }"
    out, at = [], 0
    for n in sorted((n for n in structure(path, text) if n.kind == "body"), key=lambda n: (n.start, -n.end)):
        if n.start >= at:
            out += [text[at : n.start], shown]
            at = n.end
    return "".join([*out, text[at:]])


#: What begins a statement at the top of a file.
TOP_STATEMENT = r"^\s*(?:import\b|from\s+\S+\s+import\b|use\b|mod\b|pub\s+(?:use|mod)\b|export\s+.*\bfrom\b|#include\b|require\b|package\b|include\b)"


def file_top(files: DataFrame, most: int = 20, width: int = 120) -> DataFrame:
    """path, line, text of the first import-like lines of each file."""
    from pyspark.sql import Window

    from tessera.functions.text import clip, lines

    cut = files.select("path", F.posexplode(lines(F.col("text"))).alias("at", "t")).where(F.col("t").rlike(TOP_STATEMENT))
    numbered = cut.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy("at"))).where(F.col("_k") <= most)
    return numbered.select("path", (F.col("at") + 1).alias("line"), clip(F.trim("t"), width).alias("text"))


def symbol_definitions(occurrences: DataFrame) -> DataFrame:
    """Nodes of an external symbol index: occurrences (file, ord, qualified,
    suffix, is_def, range) with the suffix's kind; later ones of a name in a
    file get ~1, ~2, ..."""
    from tessera.operators.intervals import decode_range, dedupe_ids

    kind = F.when(F.col("suffix") == "method", "function").when(F.col("suffix") == "type", "class").when(F.col("suffix") == "term", "var")
    kept = occurrences.where("is_def").withColumn("kind", kind).where("kind is not null").withColumn("_r", decode_range(F.col("range"))).where("_r is not null")
    return dedupe_ids(kept, ["file"], "qualified", ["ord"]).select("file", F.concat_ws("#", "file", "unique_id").alias("node_id"), "ord", "kind", "_r.*")


def deepen(semantic: DataFrame, syntactic: DataFrame) -> DataFrame:
    """Parts of syntactic nodes under the semantic symbol of their file whose
    range holds them, the innermost; nodes of symbols outside all stay out."""
    parts = syntactic.where("not is_symbol").select("file", F.col("node_id").alias("part"), "kind", F.col("start_line").alias("s"), F.col("end_line").alias("e"))
    held = parts.join(semantic.select("file", "node_id", "start_line", "end_line"), "file").where("start_line <= s and e <= end_line")
    best = held.groupBy("file", "part", "kind", "s", "e").agg(F.min_by("node_id", F.struct((F.col("end_line") - F.col("start_line")).alias("x"), "node_id")).alias("parent_id"))
    return best.select("file", "parent_id", F.col("part").alias("node_id"), "kind", F.col("s").alias("start_line"), F.col("e").alias("end_line"))
