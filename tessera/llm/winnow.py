"""Content-defined anchors: from every window of ``size`` bytes one k-gram is
picked by its content alone, so equal windows pick equal k-grams at equal
places. Neighbouring windows that pick the same k-gram form a run."""

from __future__ import annotations

import numpy as np

#: Bytes of a k-gram: long enough that equal ones are rarely chance.
GRAM = 32
#: Bytes whose windows are worked on at once.
SLICE = 1 << 19
_PLACE = np.uint64((1 << 20) - 1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


_UP = _powers(int(_ODD), SLICE + 1)
_DOWN = _powers(pow(int(_ODD), -1, 1 << 64), SLICE + 1)


def _rolling(u: np.ndarray, gram: int) -> np.ndarray:
    """A hash of each gram, from those of its halves."""
    if gram == 1:
        return u
    half = _rolling(u, gram // 2)
    both = half[: len(u) - 2 * (gram // 2) + 1] * _UP[gram // 2] + half[gram // 2 : gram // 2 + len(u) - 2 * (gram // 2) + 1]
    return both if gram % 2 == 0 else both[: len(u) - gram + 1] * _ODD + u[gram - 1 :]


def _words(data: np.ndarray) -> np.ndarray:
    """A mixed value of the 8 bytes from each place."""
    x = data.astype(np.uint64)
    for k in (1, 2, 4):
        x = x[:-k] | x[k:] << np.uint64(8 * k)
    return _mix(x + _ODD)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    out = x
    while 2 * done <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def runs(texts: list[bytes], size: int, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The runs of all texts: ``text``, ``start`` (first window), ``n`` (windows),
    ``anchor`` (hash of the k-gram), ``digest`` (of the run's bytes and of the
    k-gram's place in them). Runs are told apart by both, 128 bits. The digest
    is a polynomial of mixed 8-byte words, as one of single bytes has known
    strings that meet."""
    parts: list[dict[str, np.ndarray]] = []
    held: list[tuple[int, int, bytes]] = []
    total = 0

    def done():
        nonlocal held, total
        if held:
            parts.append(_runs(held, size, gram))
        held, total = [], 0

    for i, text in enumerate(texts):
        for at in range(0, len(text) - size + 1, SLICE - size + 1):  # slices share size - 1 bytes, so no window is lost
            piece = text[at : at + SLICE]
            if len(piece) < size:
                continue
            if total + len(piece) > SLICE:
                done()
            held.append((i, at, piece))
            total += len(piece)
    done()
    names = ("text", "start", "n", "anchor", "digest")
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.empty(0, np.int64) for k in names}


def anchor_places(strings: list[bytes], anchors: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Where each run's k-gram lies in the run's bytes: where it first occurs, as
    the windows would have picked an earlier one. -1 if it doesn't occur."""
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    out = np.full(len(strings), -1, np.int64)
    k = 0
    while k < len(strings):
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - sizes[k] + SLICE, "right")))
        data = np.frombuffer(b"".join(strings[k:to]), np.uint8)
        if len(data) >= gram:
            grams = _mix(_rolling(_BYTES[data], gram)).view(np.int64)
            begin = ends[k:to] - sizes[k:to] - (ends[k] - sizes[k])
            hits = np.flatnonzero(grams == np.repeat(anchors[k:to], sizes[k:to])[: len(grams)])
            owner = np.searchsorted(begin, hits, "right") - 1
            inside = hits + gram <= begin[owner] + sizes[k:to][owner]
            owner, first = np.unique(owner[inside], return_index=True)
            out[k + owner] = hits[inside][first] - begin[owner]
        k = to
    return out


def _runs(held: list[tuple[int, int, bytes]], size: int, gram: int) -> dict[str, np.ndarray]:
    data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
    sizes = np.array([len(x) for _, _, x in held])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    u = _BYTES[data]
    grams = _mix(_rolling(u, gram))
    key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    pick = (_sliding_min(key, size - gram + 1) & _PLACE).astype(np.int64)
    owner = np.repeat(np.arange(len(held)), np.maximum(0, sizes))[: len(pick)]
    inside = np.arange(len(pick)) + size <= begin[owner + 1]
    new = np.empty(len(pick), bool)
    new[0], new[1:] = True, (pick[1:] != pick[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & inside)
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:] & ~new[1:], [False]])) + 1
    words = _words(data)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(words * _UP[: len(words)])])
    whole = (sums[ends + size - 8] - sums[first]) * _DOWN[first]
    place = (pick[first] - first).astype(np.uint64)
    digest = _mix(whole ^ _mix(place * np.uint64(1 << 20) + (ends - first).astype(np.uint64)))
    which = owner[first]
    text, base = (np.array([x[k] for x in held], np.int64) for k in (0, 1))
    return {"text": text[which], "start": base[which] + first - begin[which], "n": ends - first, "anchor": grams[pick[first]].view(np.int64), "digest": digest.view(np.int64)}
