"""Token-ID output (7): patched frame-of-reference files.

A shard file (``.tpf``) holds the ids of consecutive documents. Ids are cut
into blocks; a block stores its minimum, the rest packed at a width that a
given share of them fits, and the few that don't fit in an exception list. An
index holds where every block starts, so a reader can go to any id.

Layout, little-endian::

    magic "TPF1"  u32 block length  u64 first id's position in its partition
    u64 ids  u64 documents  u64 blocks  u64 bytes of payload
    i64 doc ids[documents]  u8 doc id is null[documents]  u64 ids per document[documents]
    u64 block start[blocks + 1]              offsets into the payload
    per block: u32 minimum  u8 width  u16 exceptions  u8 0
               packed low bits (length * width bits, padded to a byte)
               u16 exception positions[]  u32 exception values[]
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm.common import scratch_path, text_or_empty

MAGIC = b"TPF1"
HEAD = struct.Struct("<4sIQQQQQ")
#: Ids in a block (fewer, larger blocks take fewer calls), and the share of its
#: ids that the packed width must hold.
BLOCK, SHARE = 4096, 0.95
#: Ids in a shard file; bounds the memory of writers and readers.
SHARD_IDS = 1 << 21


def encode_blocks(ids, block: int = BLOCK, share: float = SHARE):
    """The payload and the block starts for an array of unsigned 32-bit ids."""
    import numpy as np

    out, starts, at = [], [0], 0
    for k in range(0, len(ids), block):
        part = ids[k : k + block].astype(np.uint32)
        low = int(part.min())
        rest = part - np.uint32(low)
        within = int(np.partition(rest, int(share * (len(rest) - 1)))[int(share * (len(rest) - 1))])
        width = within.bit_length()
        odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
        small = rest.copy()
        small[odd] = 0
        body = b""
        if width:
            size = 8 if width <= 8 else 16 if width <= 16 else 32
            bits = np.unpackbits(small.astype(f">u{size // 8}").view(np.uint8).reshape(len(small), -1), axis=1)[:, size - width :]
            body = np.packbits(bits).tobytes()
        data = struct.pack("<IBHB", low, width, len(odd), 0) + body + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()
        out.append(data)
        at += len(data)
        starts.append(at)
    return b"".join(out), np.array(starts, "<u8")


def decode_block(data, n: int):
    """The ``n`` ids of one block."""
    import numpy as np

    low, width, odd, _ = struct.unpack_from("<IBHB", data)
    at, size = 8, (n * width + 7) // 8
    out = np.zeros(n, np.uint32)
    if width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width).reshape(n, width)
        wide = 8 if width <= 8 else 16 if width <= 16 else 32
        full = np.zeros((n, wide), np.uint8)
        full[:, wide - width :] = bits
        out[:] = np.packbits(full, axis=1).view(f">u{wide // 8}").ravel()
    at += size
    where = np.frombuffer(data, "<u2", odd, at)
    out[where] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
    return out + np.uint32(low)


def encode_shard(doc_ids: list, lengths: list[int], ids, first: int, block: int = BLOCK) -> bytes:
    import numpy as np

    payload, starts = encode_blocks(ids, block)
    head = HEAD.pack(MAGIC, block, first, len(ids), len(doc_ids), len(starts) - 1, len(payload))
    known = np.array([x or 0 for x in doc_ids], "<i8").tobytes()
    return b"".join([head, known, bytes(x is None for x in doc_ids), np.array(lengths, "<u8").tobytes(), starts.tobytes(), payload])


class Shard:
    """A shard file's bytes: documents in order, and ids from any position."""

    def __init__(self, data: bytes) -> None:
        import numpy as np

        magic, self.block, self.first, self.n_ids, docs, blocks, size = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token file")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.nulls = np.frombuffer(data, np.uint8, docs, at + 8 * docs)
        self.lengths = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        at += 17 * docs
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at).astype(np.int64)
        self.payload = memoryview(data)[at + 8 * (blocks + 1) :]
        if len(self.payload) != size:
            raise ValueError("the token file is cut short")

    def ids(self, start: int, n: int):
        """``n`` ids from position ``start`` of the shard; only the blocks that
        hold them are read."""
        import numpy as np

        if not n:
            return np.empty(0, np.uint32)
        a, b = start // self.block, (start + n - 1) // self.block
        parts = [decode_block(self.payload[self.starts[k] : self.starts[k + 1]], min(self.block, self.n_ids - k * self.block)) for k in range(a, b + 1)]
        return np.concatenate(parts)[start - a * self.block :][:n]


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Write the ids of every document, in ascending id order, as shard files in
    the folder ``path``, which all executors share. Returns the manifest: one
    row per file (partition, shard, file, n_docs, n_ids).

    Rows are dealt by ranges of the id, so files in name order hold ascending
    ids whatever their number. A file appears under its final name when it is
    whole, and a task run again writes the same bytes. Null ids come first; a
    null text is empty (the end id alone); rows with one id stay in the order
    of their texts; an empty table gives no file.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        from tessera.llm.wordcodec import byte_values, codec, packed

        store, folder = fs.FileSystem.from_uri(path)
        encoder, end = codec(tokenizer_path), packed([end_id])
        task = TaskContext.get()
        held_docs: list = []
        held: list[bytes] = []
        count = before = shard = 0

        def flush():
            nonlocal count, before, shard, held, held_docs
            ids = np.frombuffer(b"".join(held), "<u4")
            data = encode_shard(held_docs, [len(x) // 4 for x in held], ids, before)
            name = f"{folder}/part-{task.partitionId():06d}-{shard:06d}.tpf"
            trial = f"{folder}/_trial-{task.taskAttemptId()}-{shard}"
            with store.open_output_stream(trial) as out:
                out.write(data)
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)  # of an earlier run of this task, with the same bytes
            store.move(trial, name)
            row = pa.RecordBatch.from_pylist([{"partition": task.partitionId(), "shard": shard, "file": name, "n_docs": len(held_docs), "n_ids": count}])
            held_docs, held, before, shard, count = [], [], before + count, shard + 1, 0
            return row

        for batch in batches:
            for doc, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                ids = encoder.encode(data) + end
                if count and count + len(ids) // 4 > shard_ids:
                    yield flush()
                held_docs.append(doc)
                held.append(ids)
                count += len(ids) // 4
        if held:
            yield flush()

    spark = docs.sparkSession
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, "partition long, shard long, file string, n_docs long, n_ids long")


def read_token_files(spark: SparkSession, path: str, starts: dict[int, int], with_ids: bool = False) -> DataFrame:
    """One row per document of the shard files in ``path``: doc_id, start,
    n_tokens, ids_crc32 and, if asked for, ids. ``starts``: the ids before each
    partition, by its number in the file names."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for name, data in zip(batch.column(0), batch.column(1)):
                shard = Shard(data.as_buffer())
                part = int(name.as_py().rsplit("part-", 1)[1].split("-")[0])
                ends = np.cumsum(shard.lengths)
                ids = shard.ids(0, shard.n_ids).astype("<u4")
                raw = ids.tobytes()
                spans = [(int(b - n), int(b)) for b, n in zip(ends, shard.lengths)]
                cols = {
                    "doc_id": pa.array(shard.doc_ids, mask=shard.nulls.astype(bool)),
                    "start": pa.array(ends - shard.lengths + shard.first + starts[part], pa.int64()),
                    "n_tokens": pa.array(shard.lengths, pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in spans], pa.int64()),
                }
                if with_ids:
                    cols["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in spans], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(cols)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tpf").load(path).select("path", "content")
    return files.mapInArrow(run, schema)


def token_files_round_trip(docs: DataFrame, tokenizer_path: str, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` as token files, then read them back: one row per document
    with the global position of its first id."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    manifest = write_token_files(docs, path, tokenizer_path, **options)
    sums = manifest.groupBy("partition").agg(F.sum("n_ids").alias("n")).collect()  # a row per shuffle partition, a setting
    starts, total = {}, 0
    for row in sorted(sums, key=lambda r: r["partition"]):
        starts[row["partition"]], total = total, total + row["n"]
    if not starts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read_token_files(spark, path, starts)
