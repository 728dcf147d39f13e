"""Token ids of a public tokenizer, encoded in batches inside tasks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa

#: Fixed by the vocabulary: byte-level BPE first cuts a text into a word, a number or other signs, each with one space
#: before it, the contractions below, and what white space is left. Characters that are sorted into these kinds here:
_WORD = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-Ωα-ωА-я"
_NUMBER = "0-9²³¹¼-¾"
_SPACE = "\t\n\r "
_SIGN = "!-/:-@\\[-`{-~¡-©«-±´¶·»¿×÷–—‘-„…"
#: A text with any other character is encoded whole by the library.
_OTHER = re.compile(f"[^{_WORD}{_NUMBER}{_SPACE}{_SIGN}]")
_END, _W, _N, _S, _BLANK = range(5)
_TOP = 0x2027
_ID = attrgetter("id")
#: Pieces that the library is asked for in one call.
ASKED = 200
#: Bytes of the longest pieces that stay known.
LONGEST = 64


def _kinds() -> np.ndarray:
    out = np.zeros(_TOP, np.uint8)
    for kind, chars in ((_S, _SIGN), (_W, _WORD), (_N, _NUMBER), (_BLANK, _SPACE)):
        out[[ord(c) for c in re.findall(f"[{chars}]", "".join(map(chr, range(_TOP))))]] = kind
    return out


_KIND = _kinds()


def starts_of_pieces(cp: np.ndarray) -> np.ndarray:
    """Places where pieces begin, in code points of texts that each end in a 0, which is a piece of its own."""
    kind = _KIND[cp]
    start = np.empty(len(cp), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _END
    # The last blank before a word, number or sign leaves the others; if a space, it belongs to what follows.
    blank = kind == _BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & (kind[1:] != _END))
    start[last] = True
    start[last[cp[last] == 0x20] + 1] = False
    # 's 't 'm 'd 're 've 'll, where the apostrophe begins a piece and a word follows.
    at = np.flatnonzero(cp == 0x27)
    at = at[start[at] & (kind[at + 1] == _W)]
    one, two = cp[at + 1], cp[at + 2] if len(at) else at
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    start[at[short] + 2] = True
    start[at[long] + 3] = True
    return np.flatnonzero(start)


def _byte_chars() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable character: itself if printable, else one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(moved)}


class _Pieces(dict):
    """piece (UTF-8) -> its ids as bytes, asked of the library once.

    At ``most`` entries the store becomes the older generation and a new one begins, so common
    pieces stay known and memory is bounded by twice that, of LONGEST bytes each.
    """

    def __init__(self, tokenize, most: int, parting: int | None):
        super().__init__()
        self.tokenize, self.most, self.older, self.chars, self.parting = tokenize, most, {}, _byte_chars(), parting
        self.asked = 1 if parting is None else ASKED

    def _ask(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces in one call, parted by the byte that UTF-8 lacks: as no merge holds it, none reaches from piece to piece."""
        written = b"\xff".join(pieces).decode("latin-1").translate(self.chars)
        ids = array("I", map(_ID, self.tokenize(written)))
        at = [] if len(pieces) == 1 else np.flatnonzero(np.frombuffer(ids, np.uint32) == self.parting).tolist()
        data = ids.tobytes()
        return [data[4 * lo : 4 * hi] for lo, hi in zip([0, *(k + 1 for k in at)], [*at, len(ids)], strict=True)]

    def ids_of(self, pieces: np.ndarray) -> list[bytes]:
        """The ids of different pieces."""
        ids = [*map(self.get, pieces)]
        places = [k for k, x in enumerate(ids) if x is None]
        missing = pieces[places]
        found = [*map(self.older.get, missing)]
        new = [p for p, x in zip(missing, found) if x is None]
        asked = chain.from_iterable(self._ask(new[lo : lo + self.asked]) for lo in range(0, len(new), self.asked))
        for k, x in zip(places, found):
            ids[k] = next(asked) if x is None else x
        kept = [k for k in places if len(pieces[k]) <= LONGEST]
        for lo in range(0, len(kept), self.most):
            part = kept[lo : lo + self.most]
            if len(self) + len(part) > self.most:
                self.older = dict(self)
                self.clear()
            self.update((pieces[k], ids[k]) for k in part)
        return ids


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The library's tokenizer, loaded once a process."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=2)
def _parting(path: str) -> int | None:
    """The id of the byte 0xFF, if it is an entry and no other entry holds it."""
    held = {t: i for t, i in _tokenizer(path).get_vocab(with_added_tokens=False).items() if "\xff" in t}
    return held.get("\xff") if len(held) == 1 else None


class Encoder:
    """Ids of whole texts, each with an end id behind it.

    A text's pieces are encoded apart from each other, so the library is asked once for a piece: the different pieces of a
    stretch of texts are found by arrays and looked up in ``_Pieces``. Encoding whole texts with the library takes
    several times as long. The ids are those of the tokenizer as the library loads it: a marker such as
    <|endoftext|> in a text is its own id, so a text with the content of an added token is encoded whole by the library.
    """

    def __init__(self, path: str, most: int = 250_000):
        self.tokenizer = _tokenizer(path)
        contents = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.marks = re.compile("|".join(map(re.escape, contents))) if contents else None
        self.known = _Pieces(self.tokenizer.model.tokenize, most, _parting(path))

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts as one stream, and where each text ends in it; null is empty."""
        texts = [t or "" for t in texts]
        whole = [k for k, t in enumerate(texts) if _OTHER.search(t) or (self.marks and self.marks.search(t))]
        parts = texts if not whole else texts.copy()
        for k in whole:
            parts[k] = ""
        joined = "\0".join([*parts, ""])
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        if not len(cp):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        at = starts_of_pieces(cp)
        data = joined.encode()
        edges = np.append(at, len(cp)).astype(np.int64)
        if len(data) > len(cp):  # no sorted character takes more than three bytes
            edges[1:] += np.cumsum(np.add.reduceat((cp >= 0x80).view(np.uint8) + (cp >= 0x800), at, dtype=np.int64))
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        ids = self.known.ids_of(pieces.dictionary.to_numpy(zero_copy_only=False))
        ids[pieces.indices[-1].as_py()] = np.array([end_id], np.uint32).tobytes()
        taken = pa.array(ids, pa.large_binary()).take(pieces.indices)
        stop = np.frombuffer(taken.buffers()[1], np.int64)[1 : len(at) + 1] // 4
        stream = np.frombuffer(taken.buffers()[2], np.uint32, stop[-1])
        ends = stop[cp[at] == 0]
        if not whole:
            return stream, ends
        extra = [self._by_library(texts[k]) for k in whole]
        cut = np.split(stream, ends[whole] - 1)
        stream = np.concatenate([cut[0], *(x for pair in zip(extra, cut[1:], strict=True) for x in pair)])
        more = np.zeros(len(ends), np.int64)
        more[whole] = [len(x) for x in extra]
        return stream, ends + np.cumsum(more)


def stretches(texts: pa.Array, most_chars: int = 3_000_000) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of parts of about ``most_chars`` characters; a longer text is a part alone."""
    held, size, first = [], 0, 0
    for k, text in enumerate(texts):
        text = text.as_py()
        n = len(text or "")
        if held and size + n > most_chars:
            yield first, held
            held, size, first = [], 0, k
        held.append(text)
        size += n
    if held:
        yield first, held
