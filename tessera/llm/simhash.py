"""SimHash near-dedup (4): covering locality-sensitive hashing.

Two fingerprints within ``radius`` bits agree under at least one of
2**(radius+1) - 1 masks: every bit gets a vector of radius+1 bits, a mask v
drops the bits whose vector is orthogonal to v, and for any ``radius`` bits
there is a v other than 0 orthogonal to all their vectors. So no link is
missed, and none is invented, as members of a bucket are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.common import drop_written, free_shuffles, remove_path, scratch_path, spread_lookup, text_or_empty, written
from tessera.llm.wordcodec import tidied

SEED = 42
RADIUS = 3
#: Members of a bucket that are compared without splitting it.
LARGE = 4096


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The masks as unsigned integers. Bits get the vectors other than 0 in
    turn, so every mask keeps close to half of the bits."""
    size = (1 << (radius + 1)) - 1
    vectors = [1 + i % size for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, size + 1)]


_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(data: bytes, shingle: int) -> Iterator:
    """The XXH64 of every shingle of a text, in order, in arrays of up to 65,536,
    which bounds what is held at once for a very long text. A-Z are lower-cased;
    words are runs of characters outside [\\x20\\x09-\\x0D]; fewer words than
    ``shingle`` are one shingle; without words there is none."""
    import numpy as np
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = data.translate(_LOWER).split()
    if not words:
        return
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    line = b" ".join(words)
    starts = [0, *(e + 1 for e in ends[:-1])]
    last = ends[min(shingle, len(words)) - 1 :]
    for k in range(0, len(last), 1 << 16):
        yield np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], last[k : k + (1 << 16)])], "<u8")


def majority(parts: list) -> int:
    """The fingerprint of a text, as a signed long, from its shingles' hashes."""
    import numpy as np

    ones, n = np.zeros(64, np.int64), 0
    for h in parts:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the 64-bit fingerprint, as a signed long.

    Every shingle of ``shingle`` words counts, repeats included (see
    ``shingle_hashes``); a text without words (null, empty) has fingerprint 0.
    A bit is 1 if more than half of the shingles' XXH64 have it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values

        for batch in batches:
            found = [majority(shingle_hashes(x, shingle)) for x in byte_values(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, fp long")


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints that connect every pair
    within ``radius`` bits: each bucket gives a spanning tree per component,
    never all its pairs, and every pair given is within the radius. ``fps``:
    one column fp, distinct.

    A bucket's members are read in a stream, 8 bytes each. From one member,
    all others not yet reached are compared at once; members reached are taken
    out, so a large bucket of near copies needs a few such sweeps. The smallest
    member begins, so that tables mostly give the same trees. A bucket beyond
    ``LARGE`` members is split by further bits: those that its mask drops fall
    into ``radius`` + 1 blocks, and two members within the radius agree in all
    bits of one block, so the members that share a block's bits are compared,
    block by block.
    """
    masks = covering_masks(radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    tables = F.array(*(F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("bucket")) for k, m in enumerate(signed)))

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def trees(members):
            left, found = members, []
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    at = queue.pop(0)
                    near = np.bitwise_count(left ^ at) <= radius
                    if near.any():
                        new = left[near]
                        left = left[~near]
                        queue.extend(new)
                        found.append((np.full(len(new), at, np.uint64), new))
            return found

        def parts(members, table):
            if len(members) <= LARGE:
                yield members
                return
            free = [i for i in range(64) if not masks[table] >> i & 1]
            for block in range(radius + 1):
                value = members & np.uint64(sum(1 << i for i in free[block :: radius + 1]))
                order = np.argsort(value, kind="stable")
                cuts = np.flatnonzero(np.diff(value[order])) + 1
                yield from (members[x] for x in np.split(order, cuts) if len(x) > 1)

        def flush(pieces, table):
            members = np.unique(np.concatenate(pieces))
            for a, b in (edge for part in parts(members, table) if len(part) > 1 for edge in trees(part)):
                a, b = a.view(np.int64), b.view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        held, key = [], None
        for batch in batches:
            t, bucket = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            fp = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((t[1:] != t[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            bounds = [0, *cuts.tolist(), len(fp)]
            for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if i or (t[a], bucket[a]) != key:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        yield from flush(held, key[0])
                    held, key = [], (t[a], bucket[a])
                held.append(fp[a:b])
        if len(held) > 1 or held and len(held[0]) > 1:
            yield from flush(held, key[0])

    rows = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.bucket", "fp")
    dealt = rows.repartition("t", "bucket").sortWithinPartitions("t", "bucket")
    return dealt.mapInArrow(tidied(run), "a long, b long").distinct()


#: Edges that one task contracts at most; bounds its memory to some 100 MB.
LOCAL_EDGES = 1 << 20


def _contract(batches: Iterator) -> Iterator:
    """The edges of one task as stars: node, least node that it reaches there."""
    import numpy as np
    import pyarrow as pa

    pairs = [np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]) for b in batches if b.num_rows]
    if not pairs:
        return
    names, ends = np.unique(np.concatenate(pairs, axis=1), return_inverse=True)
    parent = list(range(len(names)))
    for a, b in ends.reshape(2, -1).T.tolist():
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)  # names are in order
    for i, p in enumerate(parent):  # a parent is smaller, so it is done before
        parent[i] = parent[p]
    root = np.array(parent)
    keep = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([pa.array(names[keep]), pa.array(names[root[keep]])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each connected component, for every
    node that has an edge. ``edges``: columns a, b.

    Tasks contract their own edges to stars; where one task has them all, that
    is the answer. Else large-star and small-star rounds bring the tasks' stars
    together, each round written to the shared folder; their number grows with
    the logarithm of the longest path of what the tasks leave. Groups are
    reduced by minima, so a hub's neighbours are never collected.
    """
    spark = edges.sparkSession
    both = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = both(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
        joined = near.join(least, "a")
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).where("a != b").distinct()
        out = joined.select(F.col("b").alias("a"), F.col("least").alias("b"))
        own = least.select("a", F.col("least").alias("b"))
        return out.union(own).where("a != b").distinct()

    path, before = scratch_path(spark, "edges"), None
    edges.select("a", "b").where("a != b").write.parquet(path)
    while True:
        now = spark.read.schema("a long, b long").parquet(path)
        sign = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if sign == before:
            break
        parts, after = -(-sign["n"] // LOCAL_EDGES), scratch_path(spark, "edges")
        stars = now.coalesce(max(1, parts)).mapInArrow(tidied(_contract), "a long, b long")
        (stars if parts <= 1 else star(star(stars, True), False)).write.parquet(after)
        remove_path(spark, path)
        path, before = after, sign
        if parts <= 1:
            now = spark.read.schema("a long, b long").parquet(path)
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)


def least_ids(rows: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``rows`` (doc_id, ``node``) with ``least``, the smallest doc_id of their
    node's component; ``roots`` as ``components`` gives them. Neither a node nor
    a component is too large (see ``spread_lookup``)."""
    own = rows.groupBy(node).agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("docs"))
    nodes = own.join(roots, own[node] == roots["node"], "left").select(own[node], "first", "docs", F.coalesce("root", own[node]).alias("root"))
    nodes = written(nodes, "nodes")
    least = written(nodes.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("nodes")), "roots")
    table = written(spread_lookup(nodes.select(node, "docs", "root"), least, "root", "nodes", node).select(node, "docs", "least"), "least")
    drop_written(nodes, least)
    return spread_lookup(rows, table, node, "docs", "doc_id")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 lower-case hex
    digits), component_id (the smallest doc_id reachable over links of
    ``radius`` bits or fewer, itself included).

    Copies share a fingerprint and count as one in the search, so a group of
    any size costs one fingerprint. Null ids never name a component unless all
    of it are null; repeated rows come out as often; an empty table gives none.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "fingerprints")
    fingerprints(docs, shingle, id_col, text_col).write.parquet(path)
    rows = spark.read.schema("doc_id long, fp long").parquet(path)
    out = least_ids(rows, components(links(rows.select("fp").distinct(), radius)), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


#: Shingles that may be ranked as common, and shingles of a task counted at once.
#: They only say in which order the shingles of a set are taken.
COMMON, COUNTED = 1 << 18, 1 << 21
#: Orders by which a bucket picks the member that the others are compared with first.
HEADS = 8
#: Buckets of up to so many members are compared together.
SMALL = 16


def shingle_sets(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, place (hash of the text), key (64-bit hash of the set), fp
    (fingerprint), hashes: one row per row whose id isn't null.

    ``hashes`` are the distinct shingles as sorted 32-bit hashes, which halve
    what is moved against 64-bit ones and agree by chance for one pair of
    shingles in four thousand million.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import xxhash

        from tessera.llm.wordcodec import byte_values, release

        release()
        for batch in batches:
            data = byte_values(batch.column(2))
            for k in range(0, len(data), 500):
                fps, sets = [], []
                for text in data[k : k + 500]:
                    parts = list(shingle_hashes(text, shingle))
                    fps.append(majority(parts))
                    sets.append(np.unique(np.concatenate([np.empty(0, "<u8"), *parts]).astype(np.uint32)))
                keys = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
                columns = [batch.column(0).slice(k, 500), batch.column(1).slice(k, 500), pa.array(keys), pa.array(fps, pa.int64()), pa.array([s.view(np.int32) for s in sets], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "place", "key", "fp", "hashes"])

    text = text_or_empty(text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("place"), text.alias("text")).where("doc_id is not null")
    return rows.mapInArrow(tidied(run), "doc_id long, place long, key long, fp long, hashes array<int>")


def common_shingles(sets: DataFrame) -> tuple:
    """Hashes, in order, of shingles that many sets have, and their ranks from 1,
    the commonest last."""
    import numpy as np

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush():
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes[n > 1]), pa.array(n[n > 1])], ["hash", "n"])

        held, count = [], 0
        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False))
            count += len(held[-1])
            if count >= COUNTED:
                yield flush()
                held, count = [], 0
        if count:
            yield flush()

    counts = sets.select("hashes").mapInArrow(tidied(run), "hash int, n long").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 2")
    top = counts.orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes = top["hash"].to_numpy().view(np.uint32)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes), dtype=np.int64))[order]


def _prefixes(similarity: float, common: tuple):
    """Two sets as similar as that share one of the first shingles of each, if
    all are in one order: rare ones first, so that few sets meet by chance.
    ``rare``: the share of a set's shingles that aren't common, in 64ths."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, ranks = common
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                keys, which = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_index=True)
                lists = part.column(1).take(pa.array(which))
                hashes, sizes = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(lists.offsets.to_numpy())
                if not len(hashes):
                    continue
                rank = np.zeros(len(hashes), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                    rank = np.where(known[at] == hashes, ranks[at], 0)
                own = np.repeat(np.arange(len(sizes)), sizes)
                order = np.argsort(own << 32 | rank, kind="stable")  # the hashes of a set are in order already
                place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                first = np.flatnonzero(place < (sizes - np.ceil(similarity * sizes - 1e-9) + 1)[own])
                rare = np.bincount(own, rank == 0, minlength=len(sizes)) * 64 // np.maximum(1, sizes)
                columns = [hashes[order[first]].view(np.int32), keys[own[first]], sizes[own[first]].astype(np.int32), place[first].astype(np.int32), rare[own[first]].astype(np.int8)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "key", "size", "place", "rare"])

    return run


def _whole_buckets(batches: Iterator) -> Iterator:
    """Columns of rows in order of bucket, such that no bucket is cut."""
    import numpy as np

    held: list[dict] = []
    for batch in batches:
        cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        b = cols["bucket"]
        if not len(b):
            continue
        if held and held[0]["bucket"][0] != b[0]:
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held = []
        cuts = np.flatnonzero(b[1:] != b[:-1]) + 1
        if len(cuts):
            held.append({n: v[: cuts[-1]] for n, v in cols.items()})
            yield {n: np.concatenate([h[n] for h in held]) for n in cols}
            held, cols = [], {n: v[cuts[-1] :] for n, v in cols.items()}
        held.append(cols)
    if held:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def _shared(batches: Iterator) -> Iterator:
    """The rows of buckets that several sets are in, each set once."""
    import numpy as np
    import pyarrow as pa

    for cols in _whole_buckets(batches):
        order = np.lexsort((cols["key"], cols["bucket"]))
        b, k = cols["bucket"][order], cols["key"][order]
        new = np.concatenate([[True], (b[1:] != b[:-1]) | (k[1:] != k[:-1])])
        order, b = order[new], b[new]
        same = b[1:] == b[:-1]
        order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        for at in range(0, len(order), 50_000):
            yield pa.RecordBatch.from_pydict({n: v[order[at : at + 50_000]] for n, v in cols.items()})


def _give(cols: dict, x, y, similarity: float) -> Iterator:
    """The pairs of rows x[i], y[i] of a bucket that aren't connected yet and
    may be similar, by their sizes, the shingles that can still follow the
    shared one and, where there are sketches, the least that the sets differ."""
    import numpy as np
    import pyarrow as pa

    m, n, p, q = cols["size"][x].astype(np.int64), cols["size"][y].astype(np.int64), cols["place"][x], cols["place"][y]
    most = np.minimum(p, q) + np.minimum(m - p, n - q)
    may = (cols["root"][x] != cols["root"][y]) & (np.minimum(m, n) >= similarity * np.maximum(m, n) - 1e-9) & (most >= similarity / (1 + similarity) * (m + n) - 1e-9)
    if "sketch" in cols:
        at = np.flatnonzero(may)
        may[at] = differing(cols["sketch"], cols["at"], cols["words"], x[at], y[at]) <= (1 - similarity) / (1 + similarity) * (m[at] + n[at]) + 1e-9
    a, b = cols["key"][x[may]], cols["key"][y[may]]
    found = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    for k in range(0, len(found), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(found[k : k + 50_000, 0].copy()), pa.array(found[k : k + 50_000, 1].copy())], ["a", "b"])


def _head_pairs(similarity: float):
    """Each bucket's head with the others of the bucket. The head is a member
    with the least share of rare shingles: of a text and its altered copies it
    is the text, which the copies are most similar to."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for cols in _whole_buckets(batches):
            mixed = (cols["key"].view(np.uint64) ^ (cols["bucket"].view(np.uint32) % HEADS).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
            order = np.lexsort((mixed, cols["rare"], cols["bucket"]))
            cols = {n: v[order] for n, v in cols.items()}
            b = cols["bucket"]
            head = np.concatenate([[True], b[1:] != b[:-1]])
            heads = np.flatnonzero(head)[np.cumsum(head) - 1]
            yield from _give(cols, heads[~head], np.flatnonzero(~head), similarity)

    return run


def _apart(batches: Iterator) -> Iterator:
    """The rows of buckets whose members aren't all connected, and whether the
    bucket is a large one."""
    import numpy as np
    import pyarrow as pa

    for cols in _whole_buckets(batches):
        b, root = cols["bucket"], cols["root"]
        new = np.concatenate([[True], b[1:] != b[:-1]])
        starts = np.flatnonzero(new)
        long = np.diff(np.append(starts, len(b)))
        several = (np.maximum.reduceat(root, starts) != np.minimum.reduceat(root, starts)) if len(b) else np.empty(0, bool)
        at = np.flatnonzero(np.repeat(several, long))
        cols["large"] = np.repeat(long > SMALL, long)
        for k in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_pydict({n: v[at[k : k + 50_000]] for n, v in cols.items()})


def _small_pairs(similarity: float):
    """All pairs that may be similar in buckets of ``SMALL`` members or fewer."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        for cols in _whole_buckets(batches):
            for d in range(1, SMALL):
                x = np.flatnonzero(cols["bucket"][d:] == cols["bucket"][:-d])
                if not len(x):
                    break
                yield from _give(cols, x, x + d, similarity)

    return run


def sketch(hashes) -> bytes:
    """Bit i says whether an odd number of the set's hashes fall in slot i, of
    four slots or more for each hash. A slot where two sets differ holds a hash
    that only one of them has, so sets differ in no fewer hashes than sketches
    in bits. A sketch of half as many slots is the exclusive or of its halves."""
    import numpy as np

    slots = 64
    while slots < 4 * len(hashes):
        slots *= 2
    spread = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)
    odd = np.bincount((spread % np.uint64(slots)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differing(words, at, size, x, y):
    """For the pairs of sketches x[i], y[i], the bits in which they differ. Sketch
    k is ``size[k]`` 64-bit words from ``words[at[k]]``."""
    import numpy as np

    out = np.zeros(len(x), np.int64)
    less = np.minimum(size[x], size[y])
    for n in np.unique(less).tolist():
        rows = np.flatnonzero(less == n)
        for k in range(0, len(rows), max(1, (1 << 21) // n)):
            part = rows[k : k + max(1, (1 << 21) // n)]

            def folded(which):
                here = np.zeros((len(part), n), np.uint64)
                for times in range(int(size[which[part]].max()) // n):
                    own = np.flatnonzero(size[which[part]] > times * n)
                    here[own] ^= words[at[which[part[own]]][:, None] + times * n + np.arange(n)]
                return here

            out[part] = np.bitwise_count(folded(x) ^ folded(y)).sum(1, dtype=np.int64)
    return out


def _large_pairs(similarity: float):
    """In large buckets, the pairs of members that are apart and that neither
    sizes and places nor sketches tell to be dissimilar."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def flush(bucket):
            cols = {n: np.concatenate([h[n] for h in bucket]) for n in bucket[0]}
            cols["at"] = np.concatenate([[0], np.cumsum(cols["words"])[:-1]])
            _, root, members = np.unique(cols["root"], return_inverse=True, return_counts=True)
            most = root == members.argmax()  # connected already
            rest, others = np.flatnonzero(most), np.flatnonzero(~most)
            for k in range(0, len(others), step := max(1, (1 << 18) // len(root))):
                x, y = [], []
                for i in range(k, min(k + step, len(others))):
                    y.append(np.concatenate([rest, others[i + 1 :]]))
                    x.append(np.full(len(y[-1]), others[i]))
                yield from _give(cols, np.concatenate(x), np.concatenate(y), similarity)

        held: list[dict] = []
        for batch in batches:
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0]["bucket"][0] != bucket[a]:
                    yield from flush(held)
                    held = []
                part = batch.slice(a, b - a)
                cols = {n: part.column(n).to_numpy(zero_copy_only=False) for n in ("bucket", "key", "size", "place", "root")}
                sketches = part.column("sketch").to_pylist()
                cols |= {"words": np.array([len(s) // 8 for s in sketches], np.int64), "sketch": np.frombuffer(b"".join(sketches), "<u8")}
                held.append(cols)
        if held:
            yield from flush(held)

    return run


def _sketched(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            lists = batch.column(1).slice(k, 500)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 500), pa.array([sketch(values[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())], ["key", "sketch"])


#: Keys that may be broadcast, once counted (some 50 MB in a hash table).
FEW = 1 << 20


def _own(sets: DataFrame, keys: DataFrame) -> DataFrame:
    """key, hashes: the sets with one of the distinct ``keys``, as a written
    table. Keys are written and counted first: while they are few they are
    broadcast, so that not all sets are moved."""
    wanted = written(keys, "wanted")
    side = F.broadcast(wanted) if wanted.count() <= FEW else wanted
    out = written(sets.select("key", "hashes").join(side, "key", "left_semi").dropDuplicates(["key"]), "shingles")
    drop_written(wanted)
    free_shuffles(sets.sparkSession)
    return out


def _verified(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of the ``pairs`` of keys, a written table that is removed afterwards,
    those whose sets are similar: their Jaccard similarity is computed in full."""
    own = _own(sets, pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct())
    joined = pairs.join(own.select(F.col("key").alias("a"), F.col("hashes").alias("_a")), "a").join(own.select(F.col("key").alias("b"), F.col("hashes").alias("_b")), "b")
    both = F.size(F.array_intersect("_a", "_b"))
    similar = written(joined.where(both >= similarity * (F.size("_a") + F.size("_b") - both)).select("a", "b"), "similar")
    del joined
    drop_written(own, pairs)
    free_shuffles(sets.sparkSession)
    return similar


def fingerprint_pairs(sets: DataFrame, radius: int = RADIUS) -> DataFrame:
    """a, b: keys that connect all sets whose fingerprints link, by covering
    masks (see ``links``); each fingerprint stands for its smallest key."""
    heads = written(sets.groupBy("fp").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("sets")), "fingerprints")
    same = spread_lookup(sets.select("fp", "key").distinct(), heads, "fp", "sets", "key").select(F.col("head").alias("a"), F.col("key").alias("b"))
    near = links(heads.select("fp"), radius).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("_a")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("_b")), "b")
    return same.unionByName(near.select(F.col("_a").alias("a"), F.col("_b").alias("b"))).where("a != b")


def similar_links(sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """a, b: keys of similar sets (Jaccard, computed in full) that connect every
    similar pair, though they aren't all such pairs: sets that are connected
    already aren't compared. ``sets``: written ``shingle_sets``.

    1. Covering masks link near fingerprints; linked sets are compared.
    2. No radius bounds what a similarity of 0.8 does to a fingerprint (an added
       passage moves many bits), so a search that is exact for Jaccard follows
       for sets that are still apart. Two sets of similarity t share one of the
       first n - ceil(t n) + 1 shingles of each, n being the size of the set.
       Each bucket's head is compared with the others, which connects the copies
       of one text by few pairs.
    3. All pairs in a bucket that are still apart: in small buckets at once, in
       large ones if their sketches leave them a chance.
    """
    spark = sets.sparkSession
    links = _verified(sets, written(fingerprint_pairs(sets), "near-pairs"), similarity)
    found = sets.select("key", "hashes").mapInArrow(tidied(_prefixes(similarity, common_shingles(sets))), "bucket int, key long, size int, place int, rare byte")
    shared = written(found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(_shared), found.schema), "buckets")
    del found
    free_shuffles(spark)

    def rooted(rows: DataFrame, links: DataFrame) -> DataFrame:
        roots = components(links)
        return rows.join(roots, rows["key"] == roots["node"], "left").select(*rows.columns, F.coalesce("root", "key").alias("root"))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition("bucket").sortWithinPartitions("bucket")

    pairs = written(dealt(rooted(shared, links)).mapInArrow(tidied(_head_pairs(similarity)), "a long, b long").distinct(), "near-pairs")
    free_shuffles(spark)
    links = links.unionByName(_verified(sets, pairs, similarity))
    rows = rooted(shared, links)
    apart = written(dealt(rows).mapInArrow(tidied(_apart), rows.schema.add("large", "boolean")), "apart")
    del rows
    drop_written(shared)
    free_shuffles(spark)
    large = apart.where("large").drop("large")
    own = _own(sets, large.select("key").distinct())
    sketches = written(own.mapInArrow(tidied(_sketched), "key long, sketch binary"), "sketches")
    drop_written(own)
    few = dealt(apart.where("not large").drop("large")).mapInArrow(tidied(_small_pairs(similarity)), "a long, b long")
    many = dealt(large.join(sketches, "key")).mapInArrow(tidied(_large_pairs(similarity)), "a long, b long")
    pairs = written(few.unionByName(many).distinct(), "near-pairs")
    del few, many, large
    drop_written(apart, sketches)
    free_shuffles(spark)
    return links.unionByName(_verified(sets, pairs, similarity))


def similar_pairs(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """a, b (a < b): documents whose sets of ``shingle``-word shingles have a
    Jaccard similarity of ``similarity`` or more, computed in full. They connect
    every such pair, though they aren't all of them."""
    sets = written(shingle_sets(docs, shingle, id_col, text_col), "shingle-sets")
    heads = written(sets.groupBy("key").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("docs")), "heads")
    same = spread_lookup(sets.select("key", "doc_id"), heads, "key", "docs", "doc_id").select(F.col("head").alias("a"), F.col("doc_id").alias("b"))
    ids = similar_links(sets, similarity).join(heads.select(F.col("key").alias("a"), F.col("head").alias("_a")), "a").join(heads.select(F.col("key").alias("b"), F.col("head").alias("_b")), "b")
    return same.unionByName(ids.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))).where("a < b").distinct()


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but those of which a similar document (directly, or
    through others) has a smaller id. Rows with a null id stay; rows with one id
    and different texts are judged each by its text, and repeated rows stay or
    go together. Texts without words (null, empty) are alike, so one id of them
    stays. Other columns stay as they are; an empty table gives no rows."""
    free_shuffles(docs.sparkSession)  # of what came before
    sets = written(shingle_sets(docs, shingle, id_col, text_col), "shingle-sets")
    keys = written(sets.select("doc_id", "place", "key"), "shingle-keys")
    roots = components(similar_links(sets, similarity))
    drop_written(sets)
    gone = least_ids(keys, roots, "key").where("doc_id > least").select(F.col("doc_id").alias("_gone"), F.col("place").alias("_place")).distinct()
    return docs.join(gone, (docs[id_col].cast("long") == F.col("_gone")) & (F.xxhash64(text_or_empty(text_col)) == F.col("_place")), "left_anti")
