"""Exact tokenisation of whole texts through a bounded table of already encoded pieces.

A piece is a stretch of text that no pre-token of the tokenizer crosses, so ids(text) is the concatenation of
ids(piece). The library encodes each piece once per table. Where the fast cuts are not proven, ids come from the whole
text, and counts from the pre-tokens that the tokenizer itself makes.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
from array import array
from collections import Counter
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces held per worker; beyond it the table starts anew, so its memory is bounded.
TABLE_LIMIT = 1_000_000
#: Characters encoded together: the more, the fewer pieces are looked up again.
ENCODE_BATCH = 8_000_000
#: Longer pieces leave the table again, so that its entries are small.
PIECE_LIMIT = 64

#: Characters for which normalisation form C is the identity and whose case and white space all libraries agree on.
_PROVEN = re.compile("[^\t\n\r\x20-\x7e\xa1-\u012f\u0131-\u01c3]").search
#: A word and the ASCII signs (but the apostrophe) behind it: every tokenizer here splits between the two.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ƺ]+").fullmatch
_ODD_SPACE = re.compile("  |\n\n| \n|\n |\t|\r").search


#: Per byte: 1 for an ASCII sign, 2 for a space, 3 for an apostrophe, else 0.
_SORT = bytes(3 if c == 39 else 2 if c == 32 else 1 if 33 <= c < 127 and not chr(c).isalnum() else 0 for c in range(256))

#: The proven characters beyond ASCII that are neither letter nor digit: for the tokenizers signs like any other.
_LATIN_SIGN = re.compile("[\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7]")


def _lone_signs(text: str) -> int:
    """2 if every full stop and comma stands between a letter or digit and no other sign, 1 if one may follow a space."""
    if not text.isascii():
        text = _LATIN_SIGN.sub("!", text)
    sort = text.encode("utf-8", "surrogatepass").translate(_SORT)
    if b"\1\1" in sort or b"\3" in sort:
        return 0
    return 1 if b"\2\1" in sort or sort[:1] == b"\1" else 2


#: Stands between pieces; it is in no text that is cut.
CUT = "\x00"


def word_cuts(text: str) -> str | None:
    """Cuts at white space and around lone stops and commas, for tokenizers that drop white space and lower-case."""
    if _PROVEN(text) or "<|" in text:
        return None
    text = text.lower()
    if _lone_signs(text):
        text = text.replace(",", " , ").replace(".", " . ")
    return text.replace("\n", CUT).replace(" ", CUT).replace("\t", CUT).replace("\r", CUT)


def spaced_cuts(text: str) -> str | None:
    """Cuts before single spaces, around single newlines and lone stops and commas, for byte-level tokenizers."""
    if _PROVEN(text) or _ODD_SPACE(text):
        return None
    if _lone_signs(text) == 2:
        text = text.replace(",", "\x00,\x00").replace(".", "\x00.\x00")
    return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")


class PieceTable:
    """What the library makes of each piece: its ids as bytes or, with counts_only, their number. Both add up."""

    def __init__(self, path: str, cuts, counts_only: bool = False) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.cuts, self.counts_only = cuts, counts_only
        self.code = "H" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = np.dtype("<u2" if self.code == "H" else "<u4")
        self.edge: np.ndarray | None = None
        self.empty = 0 if counts_only else b""
        self.table = {"": self.empty}
        self.long: list[str] = []
        self.special = re.compile("|".join(re.escape(t.content) for t in sorted(self.library.get_added_tokens_decoder().values(), key=lambda t: -len(t.content))) or "(?!)")
        self.sizes: dict[str, int] = {}
        self.limit: int | None = None  # of pieces held; None: TABLE_LIMIT

    def whole(self, texts: list[str]) -> list:
        code, encoded = self.code, self.library.encode_batch(texts, add_special_tokens=False)
        return [len(e) for e in encoded] if self.counts_only else [array(code, e.ids).tobytes() for e in encoded]

    def words(self, words: list[str]) -> list:
        """As whole(), for words of letters only: one call for all, cut where the vocabulary marks a word's edge."""
        if self.edge is None:
            mark = (lambda t: t.endswith("</w>")) if self.cuts is word_cuts else (lambda t: t.startswith("\u0120"))
            self.edge = np.zeros(self.library.get_vocab_size(with_added_tokens=True), bool)
            self.edge[[i for t, i in self.library.get_vocab().items() if mark(t)]] = True
        text = " ".join(words) if self.cuts is word_cuts else "".join(words)
        ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        at = np.flatnonzero(self.edge[ids])
        if len(at) != len(words):
            return self.whole(words)
        ends = at + 1 if self.cuts is word_cuts else np.append(at[1:], len(ids))
        if self.counts_only:
            return np.diff(ends, prepend=0).tolist()
        data, w = ids.tobytes(), self.dtype.itemsize
        stops = (ends * w).tolist()
        return [data[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text: distinct pre-tokens with their frequencies, joined to the counts and summed.

        Where the fast cuts are not proven the tokenizer's own normaliser and pre-tokenizer cut the text; no text is
        encoded whole."""
        self._drop_long()
        frequencies = [None if (p := self.cuts(t)) is None else Counter(p.split(CUT)) for t in texts]
        out = [0 if f is not None else self._own_count(t) for t, f in zip(texts, frequencies, strict=True)]
        used = set().union(*(f for f in frequencies if f))
        get = self._known(list(used - self.table.keys()), used).__getitem__
        for i, f in enumerate(frequencies):
            if f:
                out[i] = sum(map(mul, map(get, f), f.values()))
        return out

    def pre_tokens(self, text: str) -> tuple[Counter, int]:
        """Pre-tokens of the tokenizer itself with their frequencies, and the number of special strings in the text."""
        normal, cut = self.library.normalizer, self.library.pre_tokenizer
        stretches = self.special.split(text)
        out: Counter = Counter()
        for stretch in stretches:
            out.update(piece for piece, _ in cut.pre_tokenize_str(normal.normalize_str(stretch) if normal else stretch))
        return out, len(stretches) - 1

    def _own_count(self, text: str) -> int:
        frequencies, total = self.pre_tokens(text)
        if len(self.sizes) > TABLE_LIMIT:
            self.sizes.clear()
        for piece, n in frequencies.items():
            size = self.sizes.get(piece)
            if size is None:
                size = len(self.library.model.tokenize(piece))
                if len(piece) <= PIECE_LIMIT:
                    self.sizes[piece] = size
            total += n * size
        return total

    def encode(self, texts: list[str]) -> list[bytes]:
        """One entry for each text, in order."""
        collecting = gc.isenabled()
        gc.disable()  # many long-lived small objects, none in a cycle
        try:
            return self._encode(texts)
        finally:
            if collecting:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        self._drop_long()
        joined = [self.cuts(t) for t in texts]
        out: list[bytes] = [b""] * len(texts)
        if rest := [i for i, j in enumerate(joined) if j is None]:
            for i, ids in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = ids
        if fast := [i for i, j in enumerate(joined) if j is not None]:
            lists = pc.split_pattern(pa.array([joined[i] for i in fast], pa.large_string()), CUT)
            encoded = lists.values.dictionary_encode()
            distinct = encoded.dictionary.to_pylist()
            values = list(map(self.table.get, distinct))
            if missing := [p for p, v in zip(distinct, values, strict=True) if v is None]:
                get = self._known(missing, distinct).__getitem__
                values = [get(p) if v is None else v for p, v in zip(distinct, values, strict=True)]
            ids = np.frombuffer(b"".join(values), self.dtype)
            size = np.fromiter(map(len, values), np.int32, len(values)) // self.dtype.itemsize
            first = np.cumsum(size, dtype=np.int32) - size
            at = encoded.indices.to_numpy()
            n = size[at]
            ends = np.concatenate(([0], np.cumsum(n, dtype=np.int32))).astype(np.int32)
            take = np.repeat(first[at] - ends[:-1], n) + np.arange(ends[-1], dtype=np.int32)
            data = ids[take].tobytes()
            stops = (ends[lists.offsets.to_numpy()].astype(np.int64) * self.dtype.itemsize).tolist()
            for i, a, b in zip(fast, stops, stops[1:], strict=False):
                out[i] = data[a:b]
        return out

    def _drop_long(self) -> None:
        """Pieces of the texts before that are too long to be kept."""
        for piece in self.long:
            self.table.pop(piece, None)
        self.long = []

    def _known(self, missing: list[str], used) -> dict:
        """A table that holds all of `used`, the missing ones put together from letters and signs where they can be."""
        table = self.table
        if len(table) > (TABLE_LIMIT if self.limit is None else self.limit):  # what these texts use stays
            table = self.table = {"": self.empty} | {p: table[p] for p in used if p in table}
        heads, tails, rest = [], [], []
        for piece in missing:
            word = piece.rstrip(_SIGNS)
            if _LETTERS(word):
                heads.append(word)
                tails.append(piece[len(word) :])
            else:
                heads.append(None)
                tails.append("")
                rest.append(piece)
        word_like = set(heads)
        word_like.discard(None)
        if self.cuts is spaced_cuts:
            rest += [w for w in word_like if w[0] != " "]
            word_like = {w for w in word_like if w[0] == " "}
        for fresh, measure in ((word_like - table.keys(), self.words), ({*rest, *tails} - table.keys(), self.whole)):
            fresh = list(fresh)
            for at in range(0, len(fresh), 20_000):
                part = fresh[at : at + 20_000]
                for piece, value in zip(part, measure(part), strict=True):
                    table[piece] = value
        for piece, word, signs in zip(missing, heads, tails, strict=True):
            if word is not None:
                table[piece] = table[word] + table[signs]
        self.long = [p for p in (*missing, *word_like, *tails) if len(p) > PIECE_LIMIT]
        return table


_TABLES: dict[tuple[str, str, bool], PieceTable] = {}
#: What operators keep in a worker between its tasks.
_HELD: list[dict] = [_TABLES]


def held(store: dict) -> dict:
    """`store`, which release() empties from now on."""
    _HELD.append(store)
    return store


def encoder(path: str, kind: str, counts_only: bool = False, limit: int | None = None) -> PieceTable:
    """The worker's own table; kind 'word' or 'spaced' names the cuts, limit the pieces it holds if not TABLE_LIMIT. A new
    table takes the place of all that is held."""
    key = (path, kind, counts_only)
    if key not in _TABLES:
        release()
        _TABLES[key] = PieceTable(path, {"word": word_cuts, "spaced": spaced_cuts}[kind], counts_only)
    _TABLES[key].limit = limit
    return _TABLES[key]


def release(keep: dict | None = None) -> None:
    """Free what is held, but for `keep`: a reused Python worker must not hold it while another operator runs in it."""
    stores = [s for s in _HELD if s and s is not keep]
    if not stores:
        return
    for s in stores:
        s.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back at the end of a task: an idle worker stands beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library: it keeps what it holds


def slices(column: pa.Array, limit: int = 4_000_000, nulls: bool = False):
    """(start, end, texts) of a text column, in ranges of at most about `limit` bytes but one text at least.

    Only the texts of one range are Python strings at a time; a null is an empty text, or with `nulls` None."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(column):
        before = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        texts = column.slice(start, end - start).to_pylist()
        yield start, end, texts if nulls else [t or "" for t in texts]
        start = end
