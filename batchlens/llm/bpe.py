"""Token ids of whole texts by a public tokenizer file, inside Spark tasks.

The tokenizers library makes every id. As the vocabulary splits a text into pieces
that are encoded alone, the pieces of a slice of texts are found on its UTF-8 buffer
and made distinct by Arrow; each worker remembers the ids of pieces it has met (a bounded
number) and hands the library's model the new ones only. Texts with characters
outside the plain Latin range, where this module's split could differ from the
library's, go to the library whole.
"""

from __future__ import annotations

import re
from codecs import charmap_decode
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_UNSURE = re.compile("[^\x00-ɏ]|[²³¹¼-¾\x1c-\x1f]")
#: Pieces that a worker remembers (about 130 bytes each); a worker keeps them as long as it lives, so after the stage too.
MOST = 1_000_000
_JOIN = 32_768
# Kinds of characters by code point: a piece is a run of one kind, but for spaces before it, contractions and the end of white space.
_OTHER, _SPACE, _LETTER, _DIGIT, _ODD = range(5)
_LATIN = 0x250


def _kind(c: str) -> int:
    if _UNSURE.match(c):
        return _ODD
    return _SPACE if c.isspace() else _DIGIT if re.match(r"\d", c) else _LETTER if re.match(r"[^\W_]", c) else _OTHER


_KINDS = np.full(1 << 11, _ODD, np.uint8)
_KINDS[:_LATIN] = [_kind(chr(i)) for i in range(_LATIN)]
# The kind of a byte that is a character; bytes that begin longer characters than two are odd.
_OF_BYTE = np.where(np.arange(256) < 128, _KINDS[np.arange(256) % 128], _ODD).astype(np.uint8)
_CONTRACTED = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
# How byte-level vocabularies write bytes: those that show as themselves, all others as characters from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_rest = iter(range(256, 512))
_WRITTEN = "".join(chr(i if i in _SHOWN else next(_rest)) for i in range(256))
_BLANK = _WRITTEN[32]


def default_tokenizer() -> str:
    """The path of the 50k byte-level vocabulary, where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of the ranges [first, first + length), one after another."""
    ends = np.cumsum(length)
    return np.repeat(first - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    return a if len(a) >= size else np.append(a, np.zeros(max(size, len(a) * 3 // 2) - len(a), a.dtype))


def _buffer(texts: pa.Array) -> tuple[pa.Buffer, np.ndarray]:
    """The UTF-8 of large strings without nulls, one after another, and where each ends."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return data.slice(at[0], at[-1] - at[0]) if at[-1] > at[0] else pa.py_buffer(b""), at[1:] - at[0]


def kinds(raw: np.ndarray) -> np.ndarray:
    """The kind of the character that each byte of valid UTF-8 belongs to."""
    out = _OF_BYTE[raw]
    two = np.flatnonzero((raw >= 0xC2) & (raw < 0xE0))
    out[two] = out[two + 1] = _KINDS[(raw[two].astype(np.int64) & 31) << 6 | raw[two + 1] & 63]
    return out


def pieces(raw: np.ndarray, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: ``raw`` holds texts that aren't empty one after another, up to ``ends``."""
    fresh = np.zeros(len(raw) + 1, bool)  # where a text begins
    fresh[0] = fresh[ends] = True
    begins = fresh.copy()
    # Between kinds; a blank belongs to what follows it.
    begins[1:-1] |= (kind[1:] != kind[:-1]) & (raw[:-1] != 32)
    # The last of several white-space characters before something else in the text begins a piece.
    space = kind == _SPACE
    at = np.flatnonzero(space[:-1] & ~space[1:] & ~fresh[1:-1])
    at -= raw[at] & 0xC0 == 0x80  # from its last byte to its first
    begins[at] = True
    # Contractions, where the apostrophe begins a piece.
    at = np.flatnonzero((raw == 39) & begins[:-1])
    if len(at):
        padded, text_ends = np.append(raw, np.zeros(2, np.uint8)), ends[np.searchsorted(ends, at, "right")]
        for mark in _CONTRACTED:
            after = at + 1 + len(mark)
            same = after <= text_ends
            for k, c in enumerate(mark, 1):
                same &= padded[at + k] == c
            begins[at[same] + 1] = False
            begins[after[same]] = True
    return np.flatnonzero(begins[:-1])


class Encoder:
    """``ids(texts)``: for each text its ids as little-endian unsigned 16-bit integers.

    ``path`` is a tokenizer file with byte-level pieces and fewer than 65,536 ids; about ``most`` pieces are remembered.
    """

    def __init__(self, path: str, most: int = MOST):
        self.most = most
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        if self.library.get_vocab_size() > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 ids")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        # The library's model on pieces with blanks between them.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        # Whether an id begins with a space, written as another character.
        self.begins = np.zeros(1 << 16, bool)
        self.begins[[i for t, i in self.library.get_vocab().items() if t.startswith(_BLANK)]] = True
        self.known: dict[bytes, int] = {}  # the place of each piece: its ids are held[first[place] : first[place + 1]]
        self.held, self.first = np.zeros(0, "<u2"), np.zeros(1, np.int64)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    def _hold(self, pieces: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember the ids of new pieces at the places after the last."""
        n = len(self.known)
        ends = self.first[n] + np.cumsum(lengths)
        self.held, self.first = _grown(self.held, self.first[n] + len(ids)), _grown(self.first, n + len(pieces) + 1)
        self.held[self.first[n] : self.first[n] + len(ids)], self.first[n + 1 : n + len(pieces) + 1] = ids, ends
        self.known.update(zip(pieces, range(n, n + len(pieces))))

    def _learn(self, together: list[bytes], alone: list[bytes]) -> None:
        """Pieces that begin with a space and have no other are encoded ``together``: ids that begin with a space tell them apart."""
        for i in range(0, len(together), _JOIN):
            part = together[i : i + _JOIN]
            written = charmap_decode(b"".join(part), "strict", _WRITTEN)[0].replace(_BLANK, " " + _BLANK)
            ids = np.array(self.model.encode_batch_fast([written], add_special_tokens=False)[0].ids, "<u2")
            lengths = np.diff(np.flatnonzero(self.begins[ids]), append=len(ids))
            if len(lengths) != len(part):
                raise ValueError("the tokenizer's pieces don't begin at spaces")
            self._hold(part, ids, lengths)
        each = [[t.id for t in self.library.model.tokenize(charmap_decode(p, "strict", _WRITTEN)[0])] for p in alone]
        self._hold(alone, np.array(list(chain.from_iterable(each)), "<u2"), np.array(list(map(len, each)), np.int64))

    def _forget(self, distinct: list[bytes], at: np.ndarray) -> np.ndarray:
        """What these texts need stays: it holds the frequent pieces. Their places afterwards."""
        stay = np.flatnonzero(at >= 0)
        first, lengths = self.first[at[stay]], np.diff(self.first)[at[stay]]
        ids = self.held[_ranges(first, lengths)]
        self.known, self.held, self.first = {}, np.zeros(0, "<u2"), np.zeros(1, np.int64)
        self._hold([distinct[i] for i in stay], ids, lengths)
        at[stay] = np.arange(len(stay))
        return at

    def _places(self, distinct: list[bytes]) -> np.ndarray:
        """The place of each piece; those not met before are learnt together."""
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) > self.most:
                at = self._forget(distinct, at)
            joined = np.array([p.rfind(b" ") == 0 < len(p) - 1 for p in map(distinct.__getitem__, new)])
            together, alone, n = new[joined], new[~joined], len(self.known)
            self._learn([distinct[i] for i in together], [distinct[i] for i in alone])
            at[np.append(together, alone)] = np.arange(n, n + len(new))
        return at

    def _odd(self, data: pa.Buffer, kind: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Which texts go to the library whole."""
        out = np.full(len(ends), self.library.normalizer is not None)
        flat = data.to_pybytes() if self.special else b""
        marks = [m.start() for s in self.special for m in re.finditer(re.escape(s), flat)]
        out[np.searchsorted(ends, np.append(np.flatnonzero(kind == _ODD), np.array(marks, np.int64)), "right")] = True
        return out

    def _plain(self, data: pa.Buffer, begins: np.ndarray, cuts: np.ndarray) -> list[bytes]:
        """The ids of texts without odd characters: their pieces, found in ``data``, and how many pieces precede each text's end."""
        offsets = pa.py_buffer(np.append(begins, data.size).astype(np.int32))
        found = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, offsets, data]).dictionary_encode()
        at = self._places(found.dictionary.to_numpy(zero_copy_only=False).tolist())
        first, lengths, at = self.first[at], self.first[at + 1] - self.first[at], found.indices.to_numpy()
        each = lengths[at]
        raw = self.held[_ranges(first[at], each)].tobytes()
        stops = (2 * np.append(0, np.cumsum(each))[cuts]).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops)]

    def ids(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        texts.validate(full=True)
        data, ends = _buffer(texts)
        raw = np.frombuffer(data, np.uint8)
        kind = kinds(raw)
        whole = self._odd(data, kind, ends)
        if whole.any():
            odd = iter([self._whole(t) for t in texts.filter(pa.array(whole)).to_pylist()])
            plain = iter(self.ids(texts.filter(pa.array(~whole))) if not whole.all() else [])
            return [next(odd if w else plain) for w in whole.tolist()]
        if not len(raw):
            return [b""] * len(texts)
        begins = pieces(raw, kind, np.unique(ends[ends > 0]))
        return self._plain(data, begins, np.searchsorted(begins, ends))


@lru_cache(maxsize=2)
def encoder(path: str, most: int = MOST) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, most)
