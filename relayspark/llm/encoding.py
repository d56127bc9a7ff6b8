"""Token ids by the ``tokenizers`` library, with one library call for each distinct piece of text.

Where it is known that no token spans a place, a text can be cut there: the ids of the text are the ids of its
pieces in order. That holds for the pre-tokenisers that ``cuts_of`` recognises. Both read letters, digits, other
characters and white space as runs of their own; only a white space may go with the run behind it, and an
apostrophe with the letters behind it. So a text is cut

* before white space that follows anything else,
* between letters, digits and punctuation of ASCII, but not behind an apostrophe,
* between Latin letters beyond ASCII and the ASCII digits or punctuation behind them.

White space and special tokens beyond ASCII stay inside a piece. A text with the mark that special tokens start
with is cut at white space alone. Texts of a vocabulary with any other pre-tokeniser are not cut at all.

Pieces repeat: each batch asks for its distinct pieces only, and a worker keeps the ids of those it has seen,
in two generations of bounded size.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The two pre-tokenisers' patterns, as the vocabulary files state them.
SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: What special tokens start with.
MARK = "<|"

#: Pieces that one generation of a worker's cache may hold (about 60 MB), and the longest piece that is kept.
CACHE_PIECES = 250_000
CACHE_BYTES = 64
#: Bytes of text that are cut at once; a longer text is cut on its own.
CHUNK_BYTES = 1 << 21
#: Pieces that go to the library at once.
ASK_PIECES = 200

_OTHER, _SPACE, _LETTER, _DIGIT, _PUNCT, _QUOTE, _HIGH = range(7)


def _classes() -> np.ndarray:
    """Class of each byte. Control characters are of no class, so nothing is cut beside them."""
    out = np.full(256, _OTHER, dtype=np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = _SPACE
    out[0x21:0x7F] = _PUNCT
    out[0x30:0x3A] = _DIGIT
    out[0x41:0x5B] = out[0x61:0x7B] = _LETTER
    out[0x27] = _QUOTE
    out[0x80:] = _HIGH
    return out


def _pairs(fine: bool) -> np.ndarray:
    """For (class before) * 8 + (class behind): 1 to cut there, 2 to look at the character before first."""
    out = np.zeros(64, dtype=np.uint8)
    visible = (_LETTER, _DIGIT, _PUNCT, _QUOTE)
    for a in visible:
        out[a * 8 + _SPACE] = 1
    out[_HIGH * 8 + _SPACE] = 2
    if fine:
        kind = {_LETTER: 1, _DIGIT: 2, _PUNCT: 3, _QUOTE: 3}
        for a in visible:
            for b in visible:
                if kind[a] != kind[b] and (a, b) != (_QUOTE, _LETTER):
                    out[a * 8 + b] = 1
        for b in (_DIGIT, _PUNCT, _QUOTE):
            out[_HIGH * 8 + b] = 2
    return out


_CLASS, _FINE, _COARSE = _classes(), _pairs(True), _pairs(False)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _ends(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the characters beyond ASCII that end before ``at``: which are white space, and which are Latin letters.
    (U+0130 is left out: its lower case ends in a mark, which joins the punctuation behind it.)"""
    one, two = data[at - 1], data[at - 2]
    three = np.where(at >= 3, data[at - 3], 0)
    space = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    space |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
    space |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (one == 0xA9) | (one == 0xAF))
    space |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
    space |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
    code = (two.astype(np.uint32) & 0x1F) << 6 | (one.astype(np.uint32) & 0x3F)
    latin = (two >= 0xC3) & (two <= 0xC9) & (code <= 0x24F) & (code != 0xD7) & (code != 0xF7) & (code != 0x130)
    return space, latin


def cuts_of(tokenizer) -> str | None:
    """How texts may be cut for a tokeniser: ``"kept"`` or ``"dropped"`` for what becomes of white space, None
    if its pre-tokeniser is not one of the known ones."""
    spec = json.loads(tokenizer.to_str())
    special = all(
        t["content"].startswith(MARK) and not any(c.isspace() for c in t["content"]) and not (t["single_word"] or t["lstrip"] or t["rstrip"])
        for t in spec["added_tokens"]
    )
    if not special or spec["truncation"] or spec["padding"] or spec["post_processor"]:
        return None
    before, steps = spec["pre_tokenizer"] or {}, spec["normalizer"]

    def byte_level(x: dict, regex: bool) -> bool:
        return x.get("type") == "ByteLevel" and x.get("use_regex", True) is regex and not x.get("add_prefix_space")

    if steps is None and byte_level(before, True):
        return "kept"
    parts = before.get("pretokenizers", [])
    names = [x["type"] for x in (steps or {}).get("normalizers", [])]
    if len(parts) == 2 and parts[0]["type"] == "Split" and byte_level(parts[1], False) and names == ["NFC", "Replace", "Lowercase"]:
        replaced, split = steps["normalizers"][1], parts[0]
        if (replaced["pattern"], replaced["content"]) == ({"Regex": "\\s+"}, " ") and split["pattern"] == {"Regex": SPLIT_PATTERN}:
            return "dropped" if (split["behavior"], split["invert"]) == ("Removed", True) else None
    return None


class PieceEncoder:
    """Ids of whole texts, a column at a time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cuts = cuts_of(self.tokenizer)
        self.separator = next((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), None)
        self.separator_id = self.tokenizer.token_to_id(self.separator) if self.separator else None
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in made]

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """Ids of each piece. Pieces go to the library together, with a special token between them: it is found
        first, and the text on each side of it is read on its own."""
        out: dict[bytes, bytes] = {}
        mark = MARK.encode()
        plain = [p for p in pieces if mark not in p] if self.separator else []
        between = (self.separator or "").encode()
        for at in range(0, len(plain), ASK_PIECES):
            some = plain[at : at + ASK_PIECES]
            joined = between.join(some).decode("utf-8", "replace")
            ids = np.asarray(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.separator_id)
            if len(ends) != len(some) - 1:
                raise ValueError("a piece holds a special token")
            raw, ends = ids.tobytes(), [-4, *(4 * ends).tolist(), 4 * len(ids)]
            out.update((p, raw[a + 4 : b]) for p, a, b in zip(some, ends[:-1], ends[1:], strict=True))
        rest = [p for p in pieces if p not in out]
        out.update(zip(rest, self._whole([p.decode("utf-8", "replace") for p in rest]), strict=True))
        return out

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start of each piece, in texts that lie back to back in ``data`` with these ``bounds``; the class of each
        byte; and the bytes, with capitals of ASCII as small letters if the tokeniser makes them so."""
        kind = _CLASS[data]
        pair = kind[:-1] * np.uint8(8) + kind[1:]
        cut = _FINE[pair]
        folded = _LOWER[data] if self.cuts == "dropped" else data
        marks = np.flatnonzero((data[:-1] == ord(MARK[0])) & (data[1:] == ord(MARK[1])))
        for row in np.unique(np.searchsorted(bounds, marks, side="right") - 1).tolist():
            a, b = int(bounds[row]), int(bounds[row + 1])
            cut[a : b - 1] = _COARSE[pair[a : b - 1]]
            if folded is not data:
                folded[a:b] = data[a:b]  # special tokens are found before letters become small
        unsure = np.flatnonzero(cut == 2) + 1
        space, latin = _ends(data, unsure)
        cut[unsure - 1] = np.where(kind[unsure] == _SPACE, ~space, latin)
        if self.cuts == "dropped":
            cut |= (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)
        starts = np.concatenate([np.zeros(1, dtype=np.uint8), cut])
        starts[bounds[:-1][bounds[:-1] < bounds[1:]]] = 1
        return np.flatnonzero(starts), kind, folded

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in order as unsigned 32-bit numbers, number of ids of each text); null is empty."""
        if self.cuts is None or not len(column):
            made = self._whole([x or "" for x in column.to_pylist()])
            return np.frombuffer(b"".join(made), dtype="<u4"), np.asarray([len(x) // 4 for x in made], dtype=np.int64)
        column = pc.fill_null(column, "").cast(pa.large_string())
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        if bounds[-1] == bounds[0]:
            return np.zeros(0, dtype="<u4"), np.zeros(len(column), dtype=np.int64)
        data = np.frombuffer(column.buffers()[2], dtype=np.uint8)
        made, at = [], 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + CHUNK_BYTES, side="right")) - 1)
            made.append(self._encode(data[bounds[at] : bounds[end]], bounds[at : end + 1] - bounds[at]))
            at = end
        return np.concatenate([ids for ids, _ in made]), np.concatenate([counts for _, counts in made])

    def _encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``encode_column``, of texts that lie back to back in ``data`` with these ``bounds``."""
        if not len(data):
            return np.zeros(0, dtype="<u4"), np.zeros(len(bounds) - 1, dtype=np.int64)
        starts, kind, data = self._pieces(data, bounds)
        if self.cuts == "dropped":
            # White space goes; every piece that is left starts with something else.
            keep = kind != _SPACE
            shift = np.concatenate([np.zeros(1, dtype=np.int32), np.cumsum(keep, dtype=np.int32)])
            starts, bounds, data = shift[starts[keep[starts]]], shift[bounds], data[keep]
        edges = np.append(starts, len(data)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        found = self._ids_of(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        known = np.frombuffer(b"".join(found), dtype="<u4")
        index = coded.indices.to_numpy()
        # Gather each piece's ids: the k-th id of the output is the k-th of the pieces laid out in order.
        of_piece = sizes[index]
        ends = np.cumsum(of_piece)
        shift = (np.cumsum(sizes) - sizes)[index] - (ends - of_piece)
        total = int(ends[-1]) if len(ends) else 0
        ids = known[np.repeat(shift, of_piece) + np.arange(total)]
        before = np.concatenate([[0], ends])[np.searchsorted(starts, bounds)]
        return ids, np.diff(before)

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of distinct pieces, from the cache or the library."""
        young, old = self.young, self.old
        out = [young.get(p) for p in pieces]
        missing = [i for i, x in enumerate(out) if x is None]
        asked = []
        for i in missing:
            again = old.get(pieces[i])
            if again is None:
                asked.append(i)
            else:
                out[i] = young[pieces[i]] = again
        if asked:
            made = self._learn([pieces[i] for i in asked])
            for i in asked:
                out[i] = made[pieces[i]]
                if len(pieces[i]) <= CACHE_BYTES:
                    young[pieces[i]] = out[i]
        if len(young) > CACHE_PIECES:
            self.young, self.old = {}, young
        return out

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        ids, counts = self.encode_column(pa.array(texts, pa.string()))
        raw, ends = ids.astype("<u4").tobytes(), np.concatenate([[0], 4 * np.cumsum(counts)]).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids as numbers of ``kind`` with ``end_id`` behind each text, and the new counts."""
    after = counts + 1
    last = np.cumsum(after) - 1
    out = np.empty(len(ids) + len(counts), dtype=kind)
    body = np.ones(len(out), dtype=bool)
    body[last] = False
    out[body] = ids
    out[last] = end_id
    return out, after


def binary_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow array of the bytes of ``counts`` numbers each."""
    edges = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(values)])


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a vocabulary file; kept while the worker lives."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
