"""Packing (1): cost-balanced sequences of at most ``max_tokens`` ids.

The cost of a sequence is linear plus quadratic in its pieces: attention is
quadratic within a document, everything else is linear. Documents go in
descending length, each to the cheapest sequence with room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from tessera.llm.common import text_or_empty
from tessera.llm.wordcodec import tidied

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long"
#: Linear and quadratic attention cost of a piece: LINEAR * n + SQUARE * n * n.
LINEAR, SQUARE = 1.0, 1.0 / 1024
#: Ids gathered by a task before it packs them; bounds its memory. Documents are
#: in descending length within such a block.
BLOCK_TOKENS = 1 << 22


def capacities(total: int, max_tokens: int, last: bool) -> list[int]:
    """Room of the sequences for ``total`` ids: full ones, and at the end of a
    task powers of two for the rest, so that nothing is padded."""
    rooms = [max_tokens] * (total // max_tokens)
    if last:
        rest = total % max_tokens
        rooms += [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return rooms


def pack_block(lengths: list[int], rooms: list[int], max_tokens: int) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]]]:
    """Place items of the given lengths in sequences with the given rooms.

    Full sequences are cut off long items first. The others go in descending
    length, each to the sequence of least cost with room for all of it; where
    none has, to the one with most room, and the rest of it goes on likewise.
    Returns the pieces (item, start, length, sequence, offset) and what found
    no room (item, start, length). Every room is filled when the lengths reach
    the sum of the rooms.
    """
    import numpy as np

    pieces, rest, left = [], [], list(rooms)
    whole = iter([k for k, room in enumerate(rooms) if room == max_tokens])
    order: list[tuple[int, int, int]] = []
    for item, n in enumerate(lengths):
        start = 0
        while n - start >= max_tokens and (k := next(whole, None)) is not None:
            pieces.append((item, start, max_tokens, k, 0))
            left[k], start = 0, start + max_tokens
        if start < n:
            order.append((n - start, item, start))
    order.sort(key=lambda x: (-x[0], x[1]))
    room, cost = np.array(left, np.int64), np.zeros(len(left))
    for n, item, start in order:
        while n:
            fits = room >= n
            if fits.any():
                k = int(np.where(fits, cost, np.inf).argmin())
            else:
                k = int(room.argmax()) if len(room) else -1
                if k < 0 or not room[k]:
                    rest.append((item, start, n))
                    break
            take = min(n, int(room[k]))
            pieces.append((item, start, take, k, rooms[k] - int(room[k])))
            room[k] -= take
            cost[k] += LINEAR * take + SQUARE * take * take
            n, start = n - take, start + take
    return pieces, rest


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document placed in a sequence.

    A document is its ids and ``end_id``; null and empty texts are that id
    alone. Sequences hold ``max_tokens`` ids, but for a few at the end of each
    task whose lengths are powers of two, so none is padded. Every task packs
    the rows it reads: nothing is shuffled, a hot source does no harm, and a
    task run again after a lost executor gives the same rows. Repeated rows are
    packed as often as they occur, null ids stay null, other columns are
    ignored, an empty table gives no rows. ``with_ids`` adds the piece's ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from tessera.llm.wordcodec import byte_values, codec, packed, sliced

        encoder, end = codec(tokenizer_path), packed([end_id])
        base = TaskContext.get().partitionId() << 32
        names = [x.split()[0] for x in schema.split(", ")]
        held: list[tuple] = []  # id, ids of the piece, its start, ids of the document
        count = done = 0

        def flush(last: bool):
            nonlocal held, count, done
            rooms = capacities(count, max_tokens, last)
            pieces, rest = pack_block([len(x[1]) // 4 for x in held], rooms, max_tokens)
            pieces.sort(key=lambda x: (x[3], x[4]))
            rows = []
            for item, start, n, k, offset in pieces:
                doc, ids, first, total = held[item]
                part = ids[4 * start : 4 * (start + n)]
                row = (doc, first + start, n, zlib.crc32(part), total, base + done + k, offset, rooms[k])
                rows.append((*row, np.frombuffer(part, "<i4")) if with_ids else row)
            done += len(rooms)
            held = [(held[i][0], held[i][1][4 * s : 4 * (s + n)], held[i][2] + s, held[i][3]) for i, s, n in rest]
            count = sum(n for _, _, n in rest)
            for k in range(0, len(rows), 20_000):
                cols = list(zip(*rows[k : k + 20_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for c, n in zip(cols, names)], names)

        for batch in sliced(batches):
            for doc, data in zip(batch.column(0).to_pylist(), byte_values(batch.column(1))):
                ids = encoder.encode(data) + end
                held.append((doc, ids, 0, len(ids) // 4))
                count += len(ids) // 4
                if count >= BLOCK_TOKENS:
                    yield from flush(False)
        if count:
            yield from flush(True)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), schema)
