"""Token ids of whole texts through the tokenizers library, a piece at a time.

Byte-level BPE never merges across pre-tokens, so the ids of a text are the
ids of its pieces in order once the pieces are cut where a pre-token is sure
to end. Pieces repeat a lot; their ids are kept in a bounded table, and only
pieces not in it reach the library. Where no sure cut exists, the library gets
the whole text.
"""

from __future__ import annotations

import base64
import ctypes
import json
import re
import string
import struct
from collections.abc import Callable, Iterator

from tokenizers import Regex, Tokenizer, decoders, models, pre_tokenizers

#: Pieces kept by one worker before the table is emptied (about 200 bytes each).
TABLE_LIMIT = 700_000
#: White space outside ASCII, as UTF-8 (Unicode's White_Space).
WIDE_SPACE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
WIDE_EDGE = re.compile(b"^[ \t\n\r\x0b\x0c]?(?:" + WIDE_SPACE.pattern + b")|(?:" + WIDE_SPACE.pattern + b")$")
#: A word with the space before it, or a run of white space less its last character.
SPACED = re.compile(rb" ?[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
MARKS = "".join(c for c in string.punctuation if c != "'")


def byte_chars() -> list[str]:
    """The character that stands for each byte: printable Latin-1 ones stand for
    themselves, the others for U+0100 onwards in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


BYTE_CHARS = byte_chars()
BYTE_MAP = dict(enumerate(BYTE_CHARS))
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def as_bytes_chars(data: bytes) -> str:
    return data.decode("latin-1").translate(BYTE_MAP)


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


def tokenizer_from_ranks(path: str, pattern: str) -> Tokenizer:
    """A tokenizers-library BPE with the ranks of a ``.tiktoken`` file.

    Each rank above the single bytes is the join of two earlier ranks; those
    two are found by merging its bytes with the lower ranks only.
    """
    ranks = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                joins = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:])]
                least = min(joins)
                if least >= rank:
                    break
                k = joins.index(least)
                parts[k : k + 2] = [parts[k] + parts[k + 1]]
            if len(parts) == 2:
                merges.append((as_bytes_chars(parts[0]), as_bytes_chars(parts[1])))
    vocab = {as_bytes_chars(token): rank for token, rank in ranks.items()}
    out = Tokenizer(models.BPE(vocab, merges, ignore_merges=True))
    split = pre_tokenizers.Split(Regex(pattern), behavior="isolated")
    out.pre_tokenizer = pre_tokenizers.Sequence([split, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    out.decoder = decoders.ByteLevel()
    return out


class Unsafe(Exception):
    """White space beside white space: the pieces can't be told apart there."""


class _Pieces(dict):
    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: bytes) -> bytes:
        ids = self.encode(piece)
        if len(self) >= TABLE_LIMIT:
            self.clear()
        self[piece] = ids
        return ids


class WordCodec:
    """Encodes UTF-8 texts to packed ids and decodes ids to bytes.

    ``style``: "spaced" for pre-tokens that keep the space before a word,
    "words" for lower-casing tokenizers that drop white space, "whole" for any
    other (every text goes to the library whole).
    """

    def __init__(self, tokenizer: Tokenizer, style: str) -> None:
        tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        self.tokenizer, self.model, self.style = tokenizer, tokenizer.model, style
        self.pieces, self.parts, self.after = _Pieces(self._piece), _Pieces(self._part), _Pieces(self._after)

    def whole(self, data: bytes) -> bytes:
        return packed(self.tokenizer.encode(data.decode(), add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        chars = part.replace(" ", BYTE_CHARS[32]) if part.isascii() else as_bytes_chars(part.encode())
        return packed([t.id for t in self.model.tokenize(chars)])

    def _piece(self, piece: bytes) -> bytes:
        """A piece between sure cuts, without ASCII white space but at its ends."""
        text = piece.decode()
        body = text.rstrip(MARKS)
        word = body[1:] if body[:1] == " " else body
        if not word.isalpha() or not word.isascii() and (max(word) >= "ɐ" or "İ" in word):
            if self.style == "spaced" and WIDE_EDGE.search(piece):
                raise Unsafe
            return self.whole(piece)
        marks = text[len(body) :]
        return self.parts[body if self.style == "spaced" else body.lower()] + (self.parts[marks] if marks else b"")

    def _after(self, word: bytes) -> bytes:
        """A space and what follows it up to the next space."""
        lines = word.split()
        if not lines or not word.startswith(lines[0]) or not word.endswith(lines[-1]):
            raise Unsafe
        if len(lines) > 1:
            if len(word) - sum(map(len, lines)) >= len(lines):
                raise Unsafe
            return b"".join(map(self.pieces.__getitem__, SPACED.findall(b" " + word)))
        return self._piece(b" " + word)

    def encode(self, data: bytes) -> bytes:
        """The ids of one whole text, packed."""
        if self.style == "words":
            return b"".join(map(self.pieces.__getitem__, data.split()))
        if self.style == "whole":
            return self.whole(data)
        try:
            first, *others = data.split(b" ")
            if first.split() != [first]:
                raise Unsafe
            return self.pieces[first] + b"".join(map(self.after.__getitem__, others))
        except Unsafe:
            return self.whole(data) if WIDE_SPACE.search(data) else b"".join(map(self.pieces.__getitem__, SPACED.findall(data)))

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids with the characters of ``text`` that each covers; a character
        whose bytes are split over ids belongs to each of them."""
        got = self.tokenizer.encode(text, add_special_tokens=False)
        return got.ids, got.offsets

    def byte_table(self) -> list[bytes]:
        """The bytes of each id, by the reversed byte table."""
        if not hasattr(self, "_bytes"):
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self._bytes = [b""] * (max(vocab.values()) + 1)
            for token, i in vocab.items():
                self._bytes[i] = bytes(CHAR_BYTES[c] for c in token) if all(c in CHAR_BYTES for c in token) else token.encode()
        return self._bytes

    def decode(self, ids) -> bytes:
        """The bytes of ids. Characters split over ids come together again, as
        bytes are joined before anything is read as UTF-8."""
        return b"".join(map(self.byte_table().__getitem__, ids))


def style_of(path: str) -> str:
    """How a tokenizer file's texts may be cut into pieces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    if model.get("type") != "BPE" or spec.get("post_processor") and spec["post_processor"].get("type") != "ByteLevel":
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer"):
        return "spaced"
    steps = before.get("pretokenizers") or []
    kinds = [x.get("type") for x in steps]
    norms = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    if kinds == ["Split", "ByteLevel"] and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and steps[1].get("use_regex") is False and norms == ["NFC", "Replace", "Lowercase"]:
        return "words"
    return "whole"


_kept: dict[tuple, WordCodec] = {}


def codec(path: str, pattern: str | None = None) -> WordCodec:
    """The worker's codec for a tokenizer file (``.json``) or a ranks file with
    its pattern, made once a process."""
    if (path, pattern) not in _kept:
        if pattern is None:
            _kept[path, pattern] = WordCodec(Tokenizer.from_file(path), style_of(path))
        else:
            _kept[path, pattern] = WordCodec(tokenizer_from_ranks(path, pattern), "spaced" if "| ?\\p{L}+|" in pattern else "whole")
    return _kept[path, pattern]


def release() -> None:
    """Empty the tables of this worker's codecs: another operator needs the memory."""
    for known in _kept.values():
        for pieces in (known.pieces, known.parts, known.after):
            pieces.clear()


def tidy() -> None:
    """Give back what this worker has freed: Arrow's pool and the C library keep
    it, and a worker that waits for its next task counts like any other."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not in this C library
        return


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, a function on a task's Arrow batches, tidying up when it ends."""

    def run_and_tidy(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            tidy()

    return run_and_tidy


def sliced(batches: Iterator, rows: int = 500) -> Iterator:
    """The batches in slices of a few rows, so that few texts are held as bytes at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def byte_values(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
