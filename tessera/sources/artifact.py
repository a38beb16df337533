"""Symbol artifacts: occurrences of symbols by document, as protobuf messages
that language indexers write."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Field numbers of the messages, and the role of a definition.
INDEX_DOCUMENTS = 2
DOCUMENT_PATH, DOCUMENT_OCCURRENCES = 1, 2
OCCURRENCE_RANGE, OCCURRENCE_SYMBOL, OCCURRENCE_ROLES, OCCURRENCE_ENCLOSING = 1, 2, 3, 7
DEFINITION = 1

OCCURRENCES = "file string, doc long, ord long, symbol string, qualified string, suffix string, is_def boolean, name_range array<int>, range array<int>"

#: One descriptor of a symbol: its name, plain or between backticks, and its suffix.
DESCRIPTOR = re.compile(r"(?:\((?P<parameter>[^)]*)\)|\[(?P<variable>[^\]]*)\]|(?:`(?P<quoted>(?:[^`]|``)*)`|(?P<plain>[\w+$-]+))(?P<mark>/|#|:|!|\([^)]*\)\.|\.))")
SUFFIXES = {"/": "namespace", "#": "type", ".": "term", ":": "meta", "!": "macro"}


def varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at
        if shift > 63:
            raise ValueError("a number of more than 64 bits")


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """(number, value) of a message's fields in order; bytes are views."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("a field runs beyond its message")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield tag >> 3, value


def numbers(value: int | memoryview) -> list[int]:
    """A repeated number, packed or one by one."""
    if isinstance(value, int):
        return [value]
    out, at = [], 0
    while at < len(value):
        n, at = varint(value, at)
        out.append(n)
    return out


def descriptors(symbol: str) -> list[tuple[str, str]]:
    """(name, suffix) of a symbol's descriptors; none for local symbols and for
    what can't be read. Four words come before them, where two blanks are one."""
    head = re.match(r"(?!local )(?:(?:[^ ]|  )* ){4}", symbol)
    out, at = [], head.end() if head else len(symbol)
    while at < len(symbol):
        m = DESCRIPTOR.match(symbol, at)
        if not m:
            return []
        at = m.end()
        if m["parameter"] is not None or m["variable"] is not None:
            out.append((m["parameter"] or m["variable"] or "", "parameter" if m["parameter"] is not None else "variable"))
        else:
            name = m["quoted"].replace("``", "`") if m["quoted"] is not None else m["plain"]
            out.append((name, SUFFIXES.get(m["mark"], "method")))
    return out


def named(symbol: str) -> tuple[str | None, str | None]:
    """(qualified name without namespaces, suffix of the last descriptor)."""
    found = descriptors(symbol)
    if not found:
        return None, None
    return ".".join(n for n, s in found if s != "namespace"), found[-1][1]


def occurrences(data: bytes) -> Iterator[tuple]:
    """Rows of OCCURRENCES in order of the artifact."""
    documents = (v for n, v in fields(memoryview(data)) if n == INDEX_DOCUMENTS)
    for doc, body in enumerate(documents):
        path, found = "", []
        for number, value in fields(body):
            if number == DOCUMENT_PATH:
                path = bytes(value).decode()
            elif number == DOCUMENT_OCCURRENCES:
                found.append(value)
        for ord_, one in enumerate(found):
            symbol, roles, place, enclosing = "", 0, [], []
            for number, value in fields(one):
                if number == OCCURRENCE_SYMBOL:
                    symbol = bytes(value).decode()
                elif number == OCCURRENCE_ROLES:
                    roles = value
                elif number == OCCURRENCE_RANGE:
                    place += numbers(value)
                elif number == OCCURRENCE_ENCLOSING:
                    enclosing += numbers(value)
            yield (path, doc, ord_, symbol, *named(symbol), bool(roles & DEFINITION), place, enclosing or place)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The occurrences of the artifacts in ``path``. ``structure.symbol_definitions``
    makes nodes of them and ``edges`` a graph. An artifact that can't be read is
    an error."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        for batch in batches:
            for data in batch["content"]:
                block = []
                for row in occurrences(data):
                    block.append(row)
                    if len(block) == 10000:
                        yield pd.DataFrame(block, columns=names)
                        block = []
                yield pd.DataFrame(block, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, OCCURRENCES)


def edges(found: DataFrame) -> DataFrame:
    """src, dst: a file depends on the first file that defines a symbol it mentions."""
    from tessera.operators.graph import definition_edges

    return definition_edges(found.select(F.col("file").alias("doc"), F.col("doc").alias("ord"), "symbol", "is_def"))
