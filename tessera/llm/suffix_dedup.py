"""Suffix-array dedup (9): every byte covered by a ``size``-byte string that
starts earlier as well is removed; the first occurrence stays.

Equal windows of ``size`` bytes pick equal anchors (see ``winnow``), so the
collection is dealt by anchor, and each task builds the Burrows-Wheeler
transform and common prefixes of its strings column-wise (see
``collection_bwt``); windows with a common prefix of ``size`` bytes are
neighbours in it. The rows of the transform are files in the shared folder when
there are many. Equal runs are one string there, whatever their number: they are
combined within a map task and again when they meet, and all but the earliest
are removed whole. Runs are equal if both their anchors and their digests are,
128 bits in all; windows are compared byte by byte in the transform.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.common import free_shuffles, scratch_path, text_or_empty, written
from tessera.llm.wordcodec import tidied

SIZE = 100
#: Rows of a map task that are combined at once.
COMBINE = 400_000
#: Strings of one anchor built together; a group with more is cut into parts,
#: and what each part keeps is combined by the windows' content.
GROUP = 2048
#: Bytes of strings in one transform: mostly all that a task has.
BATCH = 8 << 20
#: What a row says: a run (to be removed), a string of a whole group, one of a
#: group in parts, a window kept by such a part.
RUN, WHOLE, PART, KEPT = 1, 2, 3, 4
#: The key of a null id where all ids differ: before all others.
NULL_ID = -(1 << 63)


def _key(column):
    return F.coalesce(column.cast("long"), F.lit(NULL_ID))


def _places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """id, digest, key: the place of each distinct id and text in the order of
    ids, null ones first, and of digests within an id. None where rows have
    different ids, which then are their own keys."""
    if docs.select(_key(docs[id_col]).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return None
    pairs = docs.select(docs[id_col].cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("digest")).distinct()
    ranked = pairs.orderBy(F.asc_nulls_first("id"), "digest").rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    return written(docs.sparkSession.createDataFrame(ranked, "id long, digest long, key long"), "places")


def _keyed(rows: DataFrame, places: DataFrame | None, id_col: str) -> DataFrame:
    """``rows``, which have a column ``text``, with their key."""
    if places is None:
        return rows.withColumn("key", _key(F.col(id_col)))
    table = places.withColumnsRenamed({"id": "_id", "digest": "_digest"})
    same = F.col(id_col).cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_digest"))
    return rows.join(table, same).drop("_id", "_digest")


def _found_runs(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.winnow import runs
        from tessera.llm.wordcodec import byte_values, release

        release()
        held: list[dict[str, np.ndarray]] = []
        count = 0

        def flush():
            cols = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
            order = np.lexsort((cols["start"], cols["doc"], cols["anchor"], cols["digest"]))
            cols = {k: v[order] for k, v in cols.items()}
            again = np.concatenate([[False], (cols["digest"][1:] == cols["digest"][:-1]) & (cols["anchor"][1:] == cols["anchor"][:-1])])
            cols["kind"] = np.where(again, RUN, 0).astype(np.int32)
            cols["anchor"] = np.where(again, cols["digest"] ^ (cols["doc"] * 0x9E3779B1 + cols["start"]), cols["anchor"])  # spread what only passes through
            for k in range(0, len(order), 50_000):
                yield pa.RecordBatch.from_pydict({n: cols[n][k : k + 50_000] for n in ("anchor", "digest", "doc", "start", "n", "kind")})

        for batch in batches:
            docs, data = batch.column(0).to_numpy(zero_copy_only=False), byte_values(batch.column(1))
            for k in range(0, len(data), 500):
                got = runs(data[k : k + 500], size)
                if len(got["n"]):
                    held.append({"anchor": got["anchor"], "digest": got["digest"], "doc": docs[k : k + 500][got["text"]], "start": got["start"], "n": got["n"].astype(np.int32)})
                    count += len(got["n"])
                if count >= COMBINE:
                    yield from flush()
                    held, count = [], 0
        if held:
            yield from flush()

    return run


def _group_runs(batches: Iterator) -> Iterator:
    """From rows in order of (anchor, digest, doc, start): all but the first of
    equal runs are removed; anchors with several strings give their strings."""
    import pyarrow as pa

    def rows(doc, start, n, group, part, kind):
        return pa.RecordBatch.from_pydict({"doc": doc, "start": start, "n": n, "grp": group, "part": np.asarray(part, np.int32), "kind": np.asarray(kind, np.int32)})

    held: list[tuple[np.ndarray, ...]] = []  # strings of the anchor that may go on: doc, start, n
    count = part = 0
    anchor = last = None

    def give(kind: int):
        cols = [np.concatenate([h[k] for h in held]) for k in range(3)]
        size = len(cols[0])
        return rows(*cols, np.full(size, anchor), np.full(size, part), np.full(size, kind))

    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "digest", "doc", "start", "n", "kind")}
        passing = cols["kind"] == RUN
        out = {n: v[passing] for n, v in cols.items()}
        cols = {n: v[~passing] for n, v in cols.items()}
        size = len(cols["n"])
        if size:
            same = np.concatenate([[(cols["anchor"][0], cols["digest"][0]) == last], (cols["anchor"][1:] == cols["anchor"][:-1]) & (cols["digest"][1:] == cols["digest"][:-1])])
            last = (cols["anchor"][-1], cols["digest"][-1])
            out = {n: np.concatenate([out[n], v[same]]) for n, v in cols.items()}
            cols = {n: v[~same] for n, v in cols.items()}
        if len(out["n"]):
            none = np.zeros(len(out["n"]), np.int64)
            yield rows(out["doc"], out["start"], out["n"], none, none, none + RUN)
        size = len(cols["n"])
        if not size:
            continue
        a = cols["anchor"]
        cuts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1, [size]])
        inner = np.zeros(size, bool)  # strings of groups that lie within the batch
        if len(cuts) > 3:
            long = np.diff(cuts)
            keep = (long > 1) & (long <= GROUP)
            keep[0] = keep[-1] = False
            inner = np.repeat(keep, long)
            if inner.any():
                k = int(inner.sum())
                yield rows(cols["doc"][inner], cols["start"][inner], cols["n"][inner], a[inner], np.zeros(k), np.full(k, WHOLE))
        edges = [i for i in range(len(cuts) - 1) if i in (0, len(cuts) - 2) or cuts[i + 1] - cuts[i] > GROUP]
        for i in edges:
            if a[cuts[i]] != anchor:
                if held and (part or count > 1):
                    yield give(PART if part else WHOLE)
                held, count, part, anchor = [], 0, 0, a[cuts[i]]
            for k in range(cuts[i], cuts[i + 1], GROUP):
                end = min(k + GROUP, cuts[i + 1])
                if count and count + end - k > GROUP:
                    yield give(PART)
                    held, count, part = [], 0, part + 1
                held.append((cols["doc"][k:end], cols["start"][k:end], cols["n"][k:end]))
                count += end - k
    if held and (part or count > 1):
        yield give(PART if part else WHOLE)


def _contents(size: int):
    """The strings of each document with their content."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values

        for batch in batches:
            docs, data, own = batch.column("doc"), byte_values(batch.column("text")), batch.column("own")
            for k in range(0, len(data), 200):
                lists = own.slice(k, 200)
                items, many = lists.flatten(), np.diff(lists.offsets.to_numpy())
                text = np.repeat(np.arange(k, k + len(many)), many)
                start, n = items.field("start").to_numpy(), items.field("n").to_numpy()
                content = [data[i][a:b] for i, a, b in zip(text.tolist(), start.tolist(), (start + n + size - 1).tolist())]
                cols = {c: items.field(c) for c in ("grp", "part", "kind", "start")}
                yield pa.RecordBatch.from_pydict(cols | {"doc": docs.take(pa.array(text)), "content": pa.array(content, pa.binary())})

    return run


def may_share(strings: list[bytes], groups: np.ndarray, size: int) -> np.ndarray:
    """Whether a string may share a window with another one of its group. Equal
    windows have the anchor at one place, with half of the window's other bytes
    or more on its left or on its right; a string whose bytes there are like no
    other's on either side shares none."""
    from tessera.llm.winnow import GRAM, anchor_places

    side = (size - GRAM + 1) // 2
    places = anchor_places(strings, groups).tolist()
    left = [(g, s[p - side : p + GRAM]) if p >= side else None for s, g, p in zip(strings, groups.tolist(), places)]
    right = [(g, s[p : p + GRAM + side]) if 0 <= p <= len(s) - GRAM - side else None for s, g, p in zip(strings, groups.tolist(), places)]
    n, m = Counter(left), Counter(right)
    n[None] = m[None] = 0
    return np.array([p < 0 or n[x] > 1 or m[y] > 1 for p, x, y in zip(places, left, right)], bool)


def _compare(size: int, folder: str):
    """From strings in order of (group, part): the runs of windows that start
    earlier in another string, and the windows that parts of a group keep."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.collection_bwt import equal_windows

        held: list[tuple] = []  # content, doc, start, kind, group
        amount, last = 0, None

        def flush():
            group, kind = (np.array([h[k] for h in held], np.int64) for k in (4, 3))
            rest = np.flatnonzero((kind == PART) | may_share([h[0] for h in held], group, size)).tolist()
            if not rest:
                return
            strings = [held[i][0] for i in rest]
            doc, start, kind = (np.array([held[i][k] for i in rest], np.int64) for k in (1, 2, 3))
            string, offset, group = equal_windows(strings, size, kind == PART, folder)
            if not len(string):
                return
            place = np.unique(doc, return_inverse=True)[1][string] * (1 << 40) + start[string] + offset
            order = np.lexsort((place, group))
            string, offset, group, place = string[order], offset[order], group[order], place[order]
            head = np.concatenate([[True], group[1:] != group[:-1]])
            least = place[np.flatnonzero(head)][np.cumsum(head) - 1]
            later = place != least
            s, o = string[later], offset[later]
            by = np.lexsort((o, s))
            s, o = s[by], o[by]
            if len(s):
                new = np.concatenate([[True], (s[1:] != s[:-1]) | (o[1:] != o[:-1] + 1)])
                first = np.flatnonzero(new)
                n = np.diff(np.append(first, len(s)))
                yield pa.RecordBatch.from_pydict({"doc": doc[s[first]], "start": start[s[first]] + o[first], "n": n.astype(np.int32), "kind": np.full(len(first), RUN, np.int32), "high": np.zeros(len(first), np.int64), "low": np.zeros(len(first), np.int64)})
            kept = np.flatnonzero(head & (kind[string] == PART))
            for k in range(0, len(kept), 50_000):
                s, o = string[kept[k : k + 50_000]], offset[kept[k : k + 50_000]]
                content = np.frombuffer(b"".join(hashlib.blake2b(strings[i][j : j + size], digest_size=16).digest() for i, j in zip(s.tolist(), o.tolist())), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_pydict({"doc": doc[s], "start": start[s] + o, "n": np.ones(len(s), np.int32), "kind": np.full(len(s), KEPT, np.int32), "high": content[:, 0].copy(), "low": content[:, 1].copy()})

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("grp", "part", "content", "doc", "start", "kind")]
            for group, part, content, doc, start, kind in zip(*cols):
                if amount >= BATCH and (group, part) != last:
                    yield from flush()
                    held, amount = [], 0
                last = (group, part)
                held.append((content, doc, start, kind, group))
                amount += len(content)
        if held:
            yield from flush()

    return run


def removed_runs(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", places: DataFrame | None = None) -> DataFrame:
    """key, start, n: the runs of windows to be removed, ``n`` windows from byte
    ``start``. ``key`` is that of ``_keyed``; rows that share it count once."""
    spark = docs.sparkSession
    free_shuffles(spark)  # of what came before
    rows = _keyed(docs.select(docs[id_col].alias("id"), text_or_empty(text_col).alias("text")), places, "id").select(F.col("key").alias("doc"), "text")
    if places is not None:
        rows = rows.dropDuplicates(["doc"])
    found = rows.mapInArrow(tidied(_found_runs(size)), "anchor long, digest long, doc long, start long, n int, kind int")
    dealt = found.repartition("anchor").sortWithinPartitions("anchor", "digest", "doc", "start")
    marks = written(dealt.mapInArrow(tidied(_group_runs), "doc long, start long, n int, grp long, part int, kind int"), "runs")
    del found, dealt
    free_shuffles(spark)
    strings = marks.where(F.col("kind") != RUN)
    own = strings.groupBy("doc").agg(F.collect_list(F.struct("grp", "part", "kind", "start", "n")).alias("own"))
    cut = rows.join(own, "doc").mapInArrow(tidied(_contents(size)), "grp long, part int, kind int, start long, doc long, content binary")
    dealt = cut.repartition("grp", "part").sortWithinPartitions("grp", "part")
    seen = written(dealt.mapInArrow(tidied(_compare(size, scratch_path(spark, "transform"))), "doc long, start long, n int, kind int, high long, low long"), "windows")
    del cut, dealt
    free_shuffles(spark)
    order = F.row_number().over(Window.partitionBy("high", "low").orderBy("doc", "start"))
    parts = seen.where(F.col("kind") == KEPT).withColumn("k", order).where("k > 1")
    all_runs = marks.where(F.col("kind") == RUN).select("doc", "start", "n")
    return all_runs.unionAll(seen.where(F.col("kind") == RUN).select("doc", "start", "n")).unionAll(parts.select("doc", "start", "n")).withColumnRenamed("doc", "key")


def _cut(size: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values

        for batch in batches:
            data = byte_values(batch.column("text"))
            runs = batch.column("runs")
            for k in range(0, len(data), 500):
                out = []
                for text, own in zip(data[k : k + 500], runs.slice(k, 500)):
                    items = own.values
                    if items is None or not len(items) or not text:
                        out.append((len(text), 0, 0, text))
                        continue
                    start = np.minimum(items.field("start").to_numpy(), len(text))
                    end = np.minimum(start + items.field("n").to_numpy() + size - 1, len(text))
                    edge = np.bincount(start, minlength=len(text) + 1) - np.bincount(end, minlength=len(text) + 1)
                    gone = np.cumsum(edge[:-1]) > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
                cols = list(zip(*out))
                named = {"n_bytes": pa.array(cols[0], pa.int64()), "n_removed": pa.array(cols[1], pa.int64()), "n_spans": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.binary())}
                rest = {n: batch.column(n).slice(k, 500) for n in batch.schema.names if n not in ("text", "runs")}
                yield pa.RecordBatch.from_pydict(rest | named)

    return run


def cut_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal
    removed runs) and kept (the remaining bytes).

    Removed is each byte covered by a ``size``-byte string that also starts
    earlier: in a document with a smaller id, or before it in the same one.
    Strings are judged on the input, may overlap, and never cross documents.
    Null and short texts lose nothing; a null id is before all others. Rows
    that repeat an id and a text are one document: neither removes the other.
    Different texts with one id, or with null ids, are documents of their own,
    in the order of their digests. Other columns are ignored; an empty table
    gives no rows.
    """
    places = _places(docs, id_col, text_col)
    rows = _keyed(docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")), places, "doc_id")
    runs = removed_runs(docs, size, id_col, text_col, places).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    joined = rows.join(runs, "key", "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(tidied(_cut(size)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeats(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the remaining text of each document, other columns as they
    are. A character that is left without some of its bytes goes as well; null
    texts become empty; null ids, repeated ids and repeated rows are as in
    ``cut_repeats``; an empty table stays as it is."""
    if docs.isEmpty():
        return docs
    others = [c for c in docs.columns if c != text_col]
    places = _places(docs, id_col, text_col)
    runs = removed_runs(docs, size, id_col, text_col, places).groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    renamed = [docs[c].alias(f"c{i}") for i, c in enumerate(others)]
    rows = _keyed(docs.select(*renamed, text_or_empty(text_col).alias("text")), places, f"c{others.index(id_col)}")
    joined = rows.join(runs, "key", "left").drop("key")
    schema = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(others))
    cut = joined.mapInArrow(tidied(_cut(size)), f"{schema}, n_bytes long, n_removed long, n_spans long, kept binary")
    kept = F.expr("try_validate_utf8(cast(kept as string))")
    names = {c: F.col(f"c{i}").alias(c) for i, c in enumerate(others)}
    return cut.select(*(names.get(c, F.coalesce(kept, F.translate(F.expr("make_valid_utf8(cast(kept as string))"), "�", "")).alias(c)) for c in docs.columns))
