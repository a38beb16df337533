"""Byte-level BPE (8): encoding and decoding over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessera.llm.common import text_or_empty


def encode_texts(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (packed little-endian unsigned 32-bit), decoded (bytes), n_tokens.

    Each match of ``pattern`` is encoded by itself with the ranks in
    ``ranks_path``; no special tokens. ``decoded`` comes from the ids alone and
    equals the text's UTF-8 bytes. Null text is empty: no ids; null ids stay
    null. Rows stay where they are, repeated rows included; other columns are
    ignored; a very long text is encoded whole; an empty table gives no rows.
    """

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, codec

        encoder = codec(ranks_path, pattern)
        for batch in batches:
            data = byte_values(batch.column(1))
            for k in range(0, len(data), 500):
                ids = [encoder.encode(x) for x in data[k : k + 500]]
                back = [encoder.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 500), pa.array(ids, pa.binary()), pa.array(back, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["doc_id", "ids", "decoded", "n_tokens"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded binary, n_tokens long")


def encode_offsets(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, starts, ends: for every id the characters of the text it
    covers. A character whose bytes are split belongs to each of its ids. Null
    and empty texts have empty lists; null ids and repeated rows stay as they
    are; other columns are ignored; an empty table gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, codec

        encoder, kind = codec(ranks_path, pattern), pa.list_(pa.int32())
        for batch in batches:
            data = byte_values(batch.column(1))
            for k in range(0, len(data), 200):
                got = [encoder.offsets(x.decode()) for x in data[k : k + 200]]
                cols = [[ids for ids, _ in got], [[a for a, _ in x] for _, x in got], [[b for _, b in x] for _, x in got]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 200), *(pa.array(c, kind) for c in cols)], ["doc_id", "ids", "starts", "ends"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>, ends array<int>")


def decode_ids(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text: packed ids back to text. Bytes are joined first, so
    characters split over ids come together; what isn't UTF-8 then becomes
    U+FFFD. Null ids are no text: empty. Repeated rows stay; other columns are
    ignored; an empty table gives no rows."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from tessera.llm.wordcodec import codec

        decoder = codec(ranks_path, pattern)
        for batch in batches:
            texts = [decoder.decode(np.frombuffer(x or b"", "<u4").tolist()).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(encoded[id_col].cast("long").alias("doc_id"), encoded[ids_col].alias("ids")).mapInArrow(run, "doc_id long, text string")
