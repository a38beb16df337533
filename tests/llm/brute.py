"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

SPACE = " \t\n\x0b\x0c\r"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def tokenizer(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return t


def ids_of(name, texts):
    return [e.ids + [2] for e in tokenizer(name).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def fingerprint(text, shingle=3):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + shingle]).encode(), 42) for i in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, size):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def classes(fps, ids, radius=3):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(d, least.get(root(i), d))
    return [least[root(i)] for i in range(len(fps))]


def figures(text):
    text = text or ""
    w = words(text)
    n = len(w)
    windows = Counter(tuple(w[i : i + 8]) for i in range(n - 7))
    covered = set()
    for i in range(n - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return n, sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def repeats(rows, size=100):
    """doc_id -> (n_bytes, n_removed, n_spans, kept bytes), by a set of all strings."""
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        mark = np.zeros(len(data), bool)
        for i in range(len(data) - size + 1):
            s = data[i : i + size]
            if s in seen:
                mark[i : i + size] = True
            seen.add(s)
        spans = int((mark & ~np.concatenate([[False], mark[:-1]])).sum()) if len(mark) else 0
        out[doc] = (len(data), int(mark.sum()), spans, np.frombuffer(data, np.uint8)[~mark].tobytes())
    return out


#: Texts that cover nulls, empties, ties, odd characters and long words.
ODD = [None, "", " ", "\n\n", "a", "A  b\tc", "ab  cd", "x\xa0\n\ny z", "don't we'll 'S it's", "déjà vu, Straße!!", "naïve İstanbul ΑΣ", "<|endoftext|> and <|startoftext|>", "tail  ", " lead", "日本語 テキスト 🙂🙂", "e\u0301 ñ", "w" * 3000, "a b c d e f g h " * 50, "line one two\nline one two\n\nline one two", "\x1c odd \x85 space \u2003x\u2003\n y", "12 3456 7,8.9", "ABC! abc? #$%"]
