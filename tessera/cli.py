"""Command line and JSON-RPC service.

    python -m tessera.cli index ROOT
    python -m tessera.cli retrieve ROOT TASK [--top N] [--json]
    python -m tessera.cli eval ROOT CASES.json [--top K]
    python -m tessera.cli doctor ROOT
    python -m tessera.cli serve ROOT
"""

from __future__ import annotations

import json
import os
import sys
from typing import Any

from tessera.config import Config

USAGE = 2


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.config("spark.sql.shuffle.partitions", os.environ.get("TESSERA_PARTITIONS", "8")).config("spark.ui.enabled", "false").getOrCreate()


def folder_of(root: str, config: Config) -> str:
    return os.path.join(os.path.abspath(root), config.index_dir)


def index(root: str) -> str:
    from tessera.sources import snapshot

    return snapshot.save(snapshot.build_local(session(), root), folder_of(root, Config()))


def retrieve(root: str, task: str, top: int | None, as_json: bool) -> list[str]:
    from tessera.operators import lookup
    from tessera.operators.retrieve import render_summary
    from tessera.sources import snapshot

    config = Config() if top is None else Config(top_n=top)
    found = lookup.search(snapshot.cached(session(), folder_of(root, config)), task, config)
    if as_json:
        return [r for r in found.orderBy("score", ascending=False).toJSON().collect()]
    return [r["line"] for r in render_summary(found).collect()]


def evaluate(root: str, cases_path: str, k: int) -> dict[str, Any]:
    """Hit rate and mean reciprocal rank over labelled tasks, in the order of
    the final entries."""
    from pyspark.sql import Window, functions as F

    from tessera.operators import dense, retrieve as r
    from tessera.sources import snapshot

    with open(cases_path, encoding="utf-8") as f:
        cases = json.load(f)
    spark = session()
    config = Config(top_n=k)
    ix = snapshot.cached(spark, folder_of(root, config))
    asked = spark.createDataFrame([(i, c["task"]) for i, c in enumerate(cases)], "query_id int, text string")
    expected = spark.createDataFrame([(i, e) for i, c in enumerate(cases) for e in c["expectFiles"]], "case_id int, file string")
    vectors = dense.embed(asked, "query_id").select(F.col("row_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    docs = ix.chunks.select(F.col("row_id").alias("id"), "file", "pkg", "text")
    found = r.retrieve(docs, ix.chunks, ix.vectors, ix.symbols, ix.packages, ix.edges, asked.join(vectors, "query_id"), config)
    ranked = found.select(F.col("query_id").alias("case_id"), "file", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "file")).alias("rank"))
    return r.summary(r.evaluate(ranked, expected, k)).first().asDict()


def doctor(root: str) -> list[tuple[str, bool]]:
    """Named checks and whether they hold."""
    from tessera.sources import discover, snapshot

    folder = folder_of(root, Config())
    checks = [("root exists", os.path.isdir(root)), ("has source files", os.path.isdir(root) and bool(discover.present_languages(root))), ("has an index", snapshot.current(folder) is not None)]
    if checks[-1][1]:
        try:
            snapshot.load(session(), folder)
            checks.append(("index can be read", True))
        except RuntimeError:
            checks.append(("index can be read", False))
    return checks


TOOLS = [
    {"name": "inspect", "description": "Look at the index: search, symbol, file, node or map.", "inputSchema": {"type": "object", "properties": {"mode": {"type": "string"}, "query": {"type": "string"}, "path": {"type": "string"}, "id": {"type": "string"}, "substring": {"type": "boolean"}}, "required": ["mode"]}},
    {"name": "apply_edits", "description": "Apply a batch of edits, all or nothing.", "inputSchema": {"type": "object", "properties": {"actions": {"type": "array"}}, "required": ["actions"]}},
]


class Service:
    """JSON-RPC 2.0, one message a line."""

    def __init__(self, root: str, config: Config = Config()) -> None:
        self.root, self.config = os.path.abspath(root), config

    def base(self, path: str) -> str | None:
        try:
            with open(os.path.join(self.root, path), encoding="utf-8", newline="") as f:
                return f.read()
        except OSError:
            return None

    def importers(self, path: str) -> list[str]:
        from tessera.sources import snapshot

        if snapshot.current(folder_of(self.root, self.config)) is None:
            return []
        ix = snapshot.cached(session(), folder_of(self.root, self.config))
        return sorted(r["src"] for r in ix.edges.where(ix.edges["dst"] == path).select("src").distinct().collect())

    def apply_edits(self, actions: list[dict[str, Any]]) -> dict[str, Any]:
        from tessera.operators.edit import EditError, Op
        from tessera.operators.gate import commit_by_language

        try:
            ops = [Op.of(a) for a in actions]
        except EditError as e:
            return {"ok": False, "feedback": str(e), "gated": False}
        out = commit_by_language(self.root, ops, self.base, self.importers)
        if out.get("ok"):
            self.reindex()
        return out

    def reindex(self) -> None:
        """Bring the index, if there is one, up to date with what was committed."""
        from tessera.sources import snapshot

        if snapshot.current(folder_of(self.root, self.config)) is not None:
            index(self.root)

    def inspect(self, args: dict[str, Any]) -> list[dict[str, Any]]:
        from tessera.operators import lookup
        from tessera.sources import snapshot

        args = dict(args)
        found = lookup.inspect(snapshot.cached(session(), folder_of(self.root, self.config)), args.pop("mode", ""), self.config, **args)
        return [json.loads(x) for x in found.toJSON().collect()]

    def answer(self, message: dict[str, Any]) -> dict[str, Any] | None:
        method, params, wanted = message.get("method"), message.get("params") or {}, message.get("id")
        if wanted is None:
            return None
        reply: dict[str, Any] = {"jsonrpc": "2.0", "id": wanted}
        try:
            if method == "initialize":
                result: Any = {"protocolVersion": "2024-11-05", "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}
            elif method == "ping":
                result = {}
            elif method == "tools/list":
                result = {"tools": TOOLS}
            elif method == "tools/call":
                name, args = params.get("name"), params.get("arguments") or {}
                if name not in ("inspect", "apply_edits"):
                    return reply | {"error": {"code": -32602, "message": f"unknown tool {name!r}"}}
                got = self.inspect(args) if name == "inspect" else self.apply_edits(args.get("actions", []))
                result = {"content": [{"type": "text", "text": json.dumps(got)}], "isError": isinstance(got, dict) and not got.get("ok", True)}
            else:
                return reply | {"error": {"code": -32601, "message": f"unknown method {method!r}"}}
        except Exception as e:  # a tool's failure is an answer, not the service's end
            return reply | {"error": {"code": -32000, "message": str(e)[:2000]}}
        return reply | {"result": result}

    def serve(self, lines=sys.stdin, out=sys.stdout) -> None:
        for line in lines:
            if line.strip():
                try:
                    reply = self.answer(json.loads(line))
                except json.JSONDecodeError:
                    reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
                if reply:
                    print(json.dumps(reply), file=out, flush=True)


def main(argv: list[str]) -> int:
    flags = {"--json"} & set(argv)
    top = None
    if "--top" in argv:
        at = argv.index("--top")
        if at + 1 >= len(argv) or not argv[at + 1].isdigit():
            print(__doc__, file=sys.stderr)
            return USAGE
        top = int(argv[at + 1])
        argv = argv[:at] + argv[at + 2 :]
    words = [a for a in argv if not a.startswith("--")]
    needs = {"index": 2, "retrieve": 3, "eval": 3, "doctor": 2, "serve": 2}
    if not words or needs.get(words[0]) != len(words):
        print(__doc__, file=sys.stderr)
        return USAGE
    command, root = words[:2]
    if command == "index":
        print(index(root))
    elif command == "retrieve":
        print("\n".join(retrieve(root, words[2], top, bool(flags))))
    elif command == "eval":
        print(json.dumps(evaluate(root, words[2], top or 8)))
    elif command == "serve":
        Service(root).serve()
    else:
        checks = doctor(root)
        print("\n".join(f"{'ok  ' if ok else 'FAIL'} {name}" for name, ok in checks))
        return int(not all(ok for _, ok in checks))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
