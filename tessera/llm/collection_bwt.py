"""The Burrows-Wheeler transform and common prefixes of a collection of byte
strings, built column-wise: every round inserts one symbol of each string,
from the right, so after round j all suffixes of up to j bytes are in place.

A suffix cX goes to the block of c, behind as many rows as have c before the
row of X. Its common prefix with its neighbours is one more than the least
common prefix between the rows that precede theirs. A round reads the rows once
in order for that, and once more to write them anew with the inserted ones
among them; what it holds meanwhile is a block of rows and a few numbers per
string and symbol. The rows are files when there are many.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Rows held in memory (6 bytes each); above, they are files.
MEMORY_ROWS = 1 << 22
#: Rows worked on at once.
BLOCK = 1 << 16
#: The symbol before a whole string: no further suffix.
END = 0
#: Symbols: the end and all bytes.
SYMBOLS = 257
NAMES = ("symbol", "prefix", "origin")


class Rows:
    """The rows of the transform in order, in blocks that are written and read
    in sequence: ``symbol``, ``prefix`` and ``origin``, the place in the joined
    strings where the suffix begins. They lie in memory, or in one file a column
    in ``folder`` (a URI that lasts as long as the task) if they are external."""

    def __init__(self, kinds: tuple, folder: str | None) -> None:
        self.kinds, self.sizes, self.counts = kinds, [], np.zeros(SYMBOLS, np.int64)
        self.held: list[tuple] = []
        self.folder = None
        if folder:
            from pyarrow import fs

            self.store, path = fs.FileSystem.from_uri(folder)
            self.folder = f"{path}/{uuid.uuid4().hex}"
            self.store.create_dir(self.folder)
            self.files = [self.store.open_output_stream(f"{self.folder}/{n}") for n in NAMES]

    def add(self, *columns: np.ndarray) -> None:
        parts = -(-len(columns[0]) // (2 * BLOCK))
        for part in zip(*(np.array_split(c, parts) for c in columns)) if parts > 1 else [columns]:
            self.sizes.append(len(part[0]))
            if self.folder:
                for file, column in zip(self.files, part):
                    file.write(memoryview(np.ascontiguousarray(column)).cast("B"))
            else:
                self.held.append(part)

    def end(self) -> None:
        for file in self.files if self.folder else ():
            file.close()

    def blocks(self, *wanted: int) -> Iterator[list[np.ndarray]]:
        """The wanted columns, block by block."""
        if not self.folder:
            yield from ([part[k] for k in wanted] for part in self.held)
            return
        files = [self.store.open_input_stream(f"{self.folder}/{NAMES[k]}") for k in wanted]
        for n in self.sizes:
            yield [np.frombuffer(f.read(n * np.dtype(self.kinds[k]).itemsize), self.kinds[k]) for f, k in zip(files, wanted)]
        for file in files:
            file.close()

    def drop(self) -> None:
        self.held = []
        if self.folder:
            self.end()
            self.store.delete_dir(self.folder)


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """min(values[first..last]) for each pair, ends included, first <= last."""
    ends = np.empty(2 * len(first), np.int64)
    ends[0::2], ends[1::2] = first, last + 1
    padded = np.append(values, np.uint8(255))
    return np.minimum.reduceat(padded, ends)[0::2]


class _Ends:
    """min(values[0..i]) and min(values[i..]) for a few i, by minima of tiles."""

    def __init__(self, values: np.ndarray) -> None:
        self.tiles = np.full((len(values) // 64 + 1, 64), 255, np.uint8)
        self.tiles.reshape(-1)[: len(values)] = values
        least = self.tiles.min(1)
        self.before = np.concatenate([[255], np.minimum.accumulate(least)])
        self.after = np.concatenate([np.minimum.accumulate(least[::-1])[::-1], [255]])
        self.all = int(self.after[0])

    def until(self, at: np.ndarray) -> np.ndarray:
        own = np.where(np.arange(64) <= (at & 63)[:, None], self.tiles[at >> 6], 255).min(1, initial=255)
        return np.minimum(own, self.before[at >> 6])

    def since(self, at: np.ndarray) -> np.ndarray:
        own = np.where(np.arange(64) >= (at & 63)[:, None], self.tiles[at >> 6], 255).min(1, initial=255)
        return np.minimum(own, self.after[(at >> 6) + 1])


def _places(rows: Rows, newest: np.ndarray, cap: int, strings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows of the longest suffixes so far that go on (``newest``,
    ascending): the place of the suffix that is one symbol longer in the rows
    after this round, and its common prefix with the row above (0 if that
    begins otherwise) and below (-1)."""
    base = strings + np.cumsum(np.where(np.arange(SYMBOLS) == END, 0, rows.counts)) - np.where(np.arange(SYMBOLS) == END, 0, rows.counts)
    place, up, down = np.zeros(len(newest), np.int64), np.zeros(len(newest), np.int64), np.full(len(newest), -1, np.int64)
    seen, waits = np.zeros(SYMBOLS, np.int64), np.full(SYMBOLS, -1)  # rows with a symbol; the new row that waits for its next one
    above = np.full(SYMBOLS, -1)  # least prefix since the last row with a symbol; -1 without such a row
    below = np.full(SYMBOLS, 255)  # least prefix since the new row that waits
    at = k = 0
    for symbol, prefix in rows.blocks(0, 1):
        n = len(symbol)
        end = int(np.searchsorted(newest, at + n))
        q = newest[k:end] - at
        order = np.argsort(symbol, kind="stable")
        counts = np.bincount(symbol, minlength=SYMBOLS)
        ends = np.cumsum(counts)
        begins, present = ends - counts, np.flatnonzero(counts)
        least = _Ends(prefix)
        found = present[waits[present] >= 0]
        down[waits[found]] = 1 + np.minimum(below[found], least.until(order[begins[found]]))
        waits[found] = -1
        below = np.minimum(below, least.all)
        if len(q):
            c = symbol[q].astype(np.int64)
            new = np.zeros(n, bool)
            new[q] = True
            where = np.flatnonzero(new[order])
            where = where[np.argsort(order[where])]
            place[k:end] = base[c] + seen[c] + where - begins[c]
            inside = np.flatnonzero(where > begins[c])
            outside = np.flatnonzero((where == begins[c]) & (above[c] >= 0))
            if len(inside):
                up[k + inside] = 1 + _least(prefix, order[where[inside] - 1] + 1, q[inside]).astype(np.int64)
            up[k + outside] = 1 + np.minimum(above[c[outside]], least.until(q[outside]))
            inside = np.flatnonzero(where + 1 < ends[c])
            outside = np.flatnonzero(where + 1 == ends[c])
            if len(inside):
                down[k + inside] = 1 + _least(prefix, q[inside] + 1, order[where[inside] + 1]).astype(np.int64)
            waits[c[outside]], below[c[outside]] = k + outside, least.since(q[outside] + 1)
        above = np.minimum(above, least.all)
        above[present] = least.since(order[ends[present] - 1] + 1)
        seen += counts
        at, k = at + n, end
    return place, np.minimum(up, cap), np.minimum(down, cap)


def _inserted(rows: Rows, into: Rows, place: np.ndarray, fresh: tuple, down: np.ndarray) -> Rows:
    """``rows`` written to ``into`` with the new ones (``fresh``: columns) at
    their ascending places, and the prefix of the row below each that has one."""
    before = place - np.arange(len(place))  # the old row that each goes before
    joins = np.flatnonzero(down >= 0)
    below, value = place[joins] + 1, down[joins].astype(np.uint8)
    at = done = k = j = 0
    total = sum(rows.sizes)
    for columns in rows.blocks(0, 1, 2):
        n = len(columns[0])
        at += n
        end = len(place) if at == total else int(np.searchsorted(before, at))
        size = n + end - k
        where = place[k:end] - done
        old = np.ones(size, bool)
        old[where] = False
        now = []
        for column, new in zip(columns, fresh):
            merged = np.empty(size, column.dtype)
            merged[old] = column
            merged[where] = new[k:end]
            now.append(merged)
        last = int(np.searchsorted(below, done + size))
        now[1][below[j:last] - done] = value[j:last]
        into.add(*now)
        done, k, j = done + size, end, last
    into.counts = rows.counts + np.bincount(fresh[0], minlength=SYMBOLS)
    into.end()
    return into


def _built(strings: list[bytes], starts: np.ndarray, cap: int, folder: str | None, memory_rows: int) -> Rows:
    m, sizes = len(strings), np.diff(starts)
    text = np.frombuffer(b"".join(strings), np.uint8)
    wide = len(text) > 0 and int(text.max()) == 255  # never in UTF-8
    kinds = (np.uint16 if wide else np.uint8, np.uint8, np.int32)

    def column(which: np.ndarray, j: int) -> np.ndarray:
        known = text[np.maximum(starts[which + 1] - 1 - j, 0)].astype(kinds[0]) + 1 if len(text) else 0
        return np.where(sizes[which] > j, known, END).astype(kinds[0])

    empty = lambda n: Rows(kinds, folder if n > memory_rows else None)
    everyone, rows = np.arange(m), empty(m)
    rows.add(column(everyone, 0), np.zeros(m, np.uint8), starts[1:].astype(np.int32))
    rows.counts = np.bincount(column(everyone, 0), minlength=SYMBOLS)
    rows.end()
    newest = who = everyone[sizes > 0]
    for j in range(int(sizes.max(initial=0))):
        into = None
        try:
            place, up, down = _places(rows, newest, cap, m)
            by = np.argsort(place)
            place, who = place[by], who[by]
            into = empty(sum(rows.sizes) + len(place))
            fresh = (column(who, j + 1), up[by].astype(np.uint8), (starts[who + 1] - 1 - j).astype(np.int32))
            _inserted(rows, into, place, fresh, down[by])
        except BaseException:
            if into:
                into.drop()
            raise
        finally:
            rows.drop()
        rows = into
        on = sizes[who] > j + 1
        newest, who = place[on], who[on]
    return rows


def build(strings: list[bytes], cap: int, folder: str | None = None, memory_rows: int = MEMORY_ROWS) -> dict[str, np.ndarray]:
    """The rows of all suffixes of all strings in order, as columns: ``symbol``
    (the byte before the suffix plus 1, 0 before a whole string), ``prefix``
    (bytes shared with the row above, at most ``cap`` < 255) and ``origin`` (the
    suffix's place in the joined strings). The empty suffixes come first,
    strings in order. Beyond ``memory_rows`` rows are files in ``folder``, if
    one is given."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    rows = _built(strings, starts, cap, folder, memory_rows)
    try:
        parts = list(rows.blocks(0, 1, 2))
        return {n: np.concatenate([p[k] for p in parts]) for k, n in enumerate(NAMES)}
    finally:
        rows.drop()


def equal_windows(strings: list[bytes], size: int, alone: np.ndarray, folder: str | None = None, memory_rows: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every position that starts ``size`` bytes: string, offset and a class
    that two positions share just when those bytes are equal. Suffixes with a
    common prefix of ``size`` or more are neighbours in the transform. Positions
    without an equal are left out, but for strings with a true ``alone``."""
    starts = np.concatenate([[0], np.cumsum([len(s) for s in strings])]).astype(np.int64)
    rows = _built(strings, starts, size, folder, memory_rows)
    found: list[tuple[np.ndarray, ...]] = []
    try:
        groups, at, last = 0, 0, (np.empty(0, np.int64),) * 3
        for prefix, origin in rows.blocks(1, 2):  # a group may go on in the next block
            origin = origin.astype(np.int64)
            string = np.searchsorted(starts, origin, side="right") - 1
            long = (np.arange(at, at + len(origin)) >= len(strings)) & (starts[np.minimum(string, len(strings) - 1) + 1] - origin >= size)
            at += len(origin)
            group = groups + np.cumsum(prefix < size)
            groups = int(group[-1]) if len(group) else groups
            place, group, string = (np.concatenate([x, y[long]]) for x, y in zip(last, (origin, group, string)))
            on = group == groups
            last = place[on], group[on], string[on]
            found.append(_alike(place[~on], group[~on], string[~on], alone))
        found.append(_alike(*last, alone))
    finally:
        rows.drop()
    place, group, string = (np.concatenate([f[k] for f in found]) for k in range(3))
    return string, place - starts[string], group


def _alike(place: np.ndarray, group: np.ndarray, string: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places of groups with two members or more and of strings that are
    given ``alone``; ``group`` is ascending."""
    same = group[1:] == group[:-1]
    keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | alone[string] if len(group) else np.empty(0, bool)
    return place[keep], group[keep], string[keep]
