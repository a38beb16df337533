"""Quality classifier (5): attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded, gated attention
weighs the encodings, and the weighted sum is scored; only documents carry
labels. A document with one bad part is thus told from one that is good
throughout without any passage being labelled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, functions as F

from tessera.llm.common import text_or_empty
from tessera.llm.wordcodec import tidied

#: Bytes of a passage, bytes of one text whose features are held at once, and
#: bytes of several texts (about 100 bytes are needed for each while they are made).
PASSAGE, CHUNK, HELD = 400, 1 << 21, 1 << 18
#: Labelled documents learnt from, of each class, at most. The bound only
#: limits training; every document is scored.
SAMPLE = 2500
#: Passages of a labelled document learnt from, at most, evenly spaced: with
#: SAMPLE it bounds what the driver holds (520 bytes a passage, 166 MB in all).
LEARNT = 64
HIDDEN, GATE, ROUNDS, RATE, DECAY, SEED = 24, 12, 40, 0.01, 1e-4, 7
#: A document is accepted from this score on.
ACCEPT = 0.3

#: Classes of bytes, by the characters in them.
CLASSES = [" ", "\t\n\x0b\x0c\r", "aeiouy", "bcdfghjklmnpqrstvwxz", "AEIOUY", "BCDFGHJKLMNPQRSTVWXZ", "0123456789", ".,;:", "!?", "#*$%&", "<>", "|", "'\"()[]{}-", "@_/\\^~`+="]
_KIND = np.full(256, 14, np.uint8)
for _k, _chars in enumerate(CLASSES):
    _KIND[list(_chars.encode())] = _k
_KIND[128:] = 15
_POWERS = np.cumprod(np.full(512, 0x9E3779B97F4A7C15, np.uint64))
WIDTH = 256 + 4


def passage_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The features of every passage, and the passage at which each text begins.

    A passage has the square roots of the shares of its class pairs, and four
    figures on words: repeated just before, distinct, mean length, and size.
    """
    n = np.array([len(x) for x in texts], np.int64)
    count = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    total = int(first[-1])
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.concatenate([[0], np.cumsum(n + 1)])[:-1]
    at = np.arange(len(data)) - np.repeat(begin, n + 1)
    where = np.repeat(first[:-1], n + 1) + at // PASSAGE
    where[begin + n] = total  # the separators
    kind = _KIND[data]
    pairs = kind[:-1].astype(np.int64) * 16 + kind[1:]
    counts = np.bincount(where[:-1] * 256 + pairs, minlength=(total + 1) * 256)[: total * 256].reshape(total, 256)
    size = np.maximum(1, counts.sum(1))
    out = np.zeros((total, WIDTH), np.float32)
    out[:, :256] = np.sqrt(counts / size[:, None])
    out[:, 257] = 1
    blank = kind < 2
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    if len(starts):
        ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
        length = ends - starts
        inside = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
        terms = np.where(blank, np.uint64(0), (data.astype(np.uint64) + np.uint64(1)) * _POWERS[inside % 512])
        word = np.add.reduceat(terms, starts)
        mine = where[starts]
        words = np.bincount(mine, minlength=total + 1)[:total]
        same = np.concatenate([[False], (word[1:] == word[:-1]) & (mine[1:] - mine[:-1] <= 1)])
        key = word * np.uint64(0xD6E8FEB86659FD93) + mine.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        order = np.argsort(key)
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
        distinct = np.bincount(mine[order][new], minlength=total + 1)[:total]
        per = np.maximum(1, words)
        out[:, 256] = np.bincount(mine, same, minlength=total + 1)[:total] / per
        out[:, 257] = np.where(words > 0, distinct / per, 1)
        out[:, 258] = np.bincount(mine, length, minlength=total + 1)[:total] / per / 10
    out[:, 259] = size / PASSAGE
    return out, first


class Model:
    """Encoder tanh(xE + e), gate (tanh(hV) * sigmoid(hU))w, score sigmoid(zc + b)."""

    def __init__(self, params: dict[str, np.ndarray], shift: float = 0.0) -> None:
        self.params, self.shift = params, shift

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The attention and the value of each passage."""
        p = self.params
        h = np.tanh(x @ p["E"] + p["e"])
        gate = (np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))) @ p["w"]
        return gate, h @ p["c"]

    def scores(self, texts: list[bytes]) -> list[float]:
        """The score of every whole text. Texts are read in chunks of passages;
        the attention sums of a very long one run on from chunk to chunk."""
        out: list[float] = []
        held: list[bytes] = []
        size = 0

        def done():
            nonlocal held, size
            if held:
                x, first = passage_features(held)
                gate, value = self.passages(x)
                weight = np.exp(gate - np.repeat(np.maximum.reduceat(gate, first[:-1]), np.diff(first)))
                z = np.add.reduceat(weight * value, first[:-1]) / np.add.reduceat(weight, first[:-1])
                out.extend(self.final(z).tolist())
            held, size = [], 0

        for text in texts:
            if len(text) > CHUNK:
                done()
                top, over, under = -np.inf, 0.0, 0.0
                for k in range(0, len(text), CHUNK // PASSAGE * PASSAGE):
                    gate, value = self.passages(passage_features([text[k : k + CHUNK // PASSAGE * PASSAGE]])[0])
                    new = max(top, float(gate.max()))
                    weight, old = np.exp(gate - new), np.exp(top - new)
                    over, under, top = over * old + float(weight @ value), under * old + float(weight.sum()), new
                out.append(float(self.final(np.float64(over / under))))
                continue
            if size + len(text) > HELD:
                done()
            held.append(text)
            size += len(text)
        done()
        return out

    def final(self, z):
        return 1 / (1 + np.exp(-np.clip(z + self.params["b"][0] + self.shift, -50, 50).astype(np.float64)))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, prior: float) -> Model:
    """Adam on the cross-entropy of documents; ``prior`` is the share of label 1
    among all labelled documents, to which the scores are shifted."""
    rng = np.random.default_rng(SEED)
    init = lambda a, b: (rng.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    p = {"E": init(WIDTH, HIDDEN), "e": np.zeros(HIDDEN, np.float32), "V": init(HIDDEN, GATE), "U": init(HIDDEN, GATE), "w": init(GATE, 1)[:, 0], "c": init(HIDDEN, 1)[:, 0], "b": np.zeros(1, np.float32)}
    mean = {k: np.zeros_like(v) for k, v in p.items()}
    square = {k: np.zeros_like(v) for k, v in p.items()}
    docs, step = len(y), 0
    for round_ in range(ROUNDS):
        rate = RATE * (1 - round_ / ROUNDS)
        for part in np.array_split(rng.permutation(docs), max(1, docs // 64)):
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in part])
            n = np.diff(first)[part]
            cut = np.concatenate([[0], np.cumsum(n)])[:-1]
            xb = x[rows].astype(np.float32)
            h = np.tanh(xb @ p["E"] + p["e"])
            t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
            gate = (t * s) @ p["w"]
            weight = np.exp(gate - np.repeat(np.maximum.reduceat(gate, cut), n))
            weight /= np.repeat(np.add.reduceat(weight, cut), n)
            value = h @ p["c"]
            z = np.add.reduceat(weight * value, cut)
            dz = (1 / (1 + np.exp(-np.clip(z + p["b"][0], -50, 50))) - y[part]) / len(part)
            spread = np.repeat(dz, n)
            dgate = spread * weight * (value - np.repeat(z, n))
            dts = dgate[:, None] * p["w"]
            da, db = dts * s * (1 - t * t), dts * t * s * (1 - s)
            dh = (spread * weight)[:, None] * p["c"] + da @ p["V"].T + db @ p["U"].T
            dx = dh * (1 - h * h)
            grads = {"E": xb.T @ dx, "e": dx.sum(0), "V": h.T @ da, "U": h.T @ db, "w": (t * s).T @ dgate, "c": h.T @ (spread * weight), "b": np.array([dz.sum()])}
            step += 1
            for k, g in grads.items():
                g = (g + DECAY * p[k]).astype(np.float32)
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.001 * (g * g - square[k])
                p[k] -= rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if docs else 0.5
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(p, float(np.log(prior / (1 - prior)) - np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model from the labelled rows whose crc32(id as text) mod 5 isn't 0.

    The first ``sample`` ids of each class in the order of a hash of the id are
    taken: a bounded sample that doesn't depend on how rows are dealt. A
    document labelled twice counts by its largest label; null labels and ids
    don't count. None if a class has no document.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where("doc_id is not null and label in (0, 1)").where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    picked = [known.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, release

        release()
        for batch in batches:
            data = byte_values(batch.column(1))
            for k in range(0, len(data), 200):
                x, first = passage_features(data[k : k + 200])
                x = x.astype(np.float16)
                spaced = [np.linspace(a, b - 1, min(b - a, LEARNT)).astype(np.int64) for a, b in zip(first, first[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 200), pa.array([x[i].tobytes() for i in spaced], pa.binary()), batch.column(2).slice(k, 200)], ["doc_id", "x", "label"])

    chosen = F.broadcast(picked[0].union(picked[1]))  # 2 * sample rows at most
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).join(chosen, "doc_id")
    got = rows.select("doc_id", "text", "label").mapInArrow(tidied(run), "doc_id long, x binary, label int").toArrow().sort_by([("doc_id", "ascending")])
    bags = [np.frombuffer(v, np.float16).reshape(-1, WIDTH) for v in got["x"].to_pylist()]
    y = np.array(got["label"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return None
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return train(np.concatenate(bags), first, y, counts[1] / (counts[0] + counts[1]))


def held_out(name: str):
    return F.crc32(F.col(name).cast("string").cast("binary")) % 5 == 0


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score for every row; without a model every score is 0.5.
    Null text is empty and is scored like any other."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, release, sliced

        release()
        for batch in sliced(batches):
            data = byte_values(batch.column(1))
            got = model.scores(data) if model else [0.5] * len(data)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(tidied(run), "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Learns from ``labels`` (see ``fit``); only texts are inputs of a score. A
    null id is not held out. An empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels, **options))
    return scored.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns. The
    score is computed beside each row, so nothing is joined or shuffled.

    Null and empty texts are scored like any other; repeated rows stay or go
    together; without labels of both classes every row stays; a null id is no
    obstacle; an empty table gives no rows."""
    model = fit(docs, labels, id_col, text_col)
    if model is None:
        return docs
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from tessera.llm.wordcodec import byte_values, release, sliced

        release()
        for batch in sliced(batches):
            yield batch.filter(pa.array([x >= accept for x in model.scores(byte_values(batch.column(at)))], pa.bool_()))

    return docs.mapInArrow(tidied(run), schema)
