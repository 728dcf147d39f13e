"""Token links between two tokenizers: minimal perfect hashes of id pairs, summed dense counts, a second look at all documents."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm import tokens
from tidewell.llm.text import hand_back
from tidewell.storage import materialize, mounted, work_path

IDS = "doc_id long, a binary, b binary"
VECTOR = "bucket int, part int, counts binary"


# --- two tokenizers ---------------------------------------------------------------


class Pair:
    """A byte-level BPE (A) and a piece model with byte fallback (B), and the bytes of their entries.

    Texts are cut into units where neither tokenizer reaches across: where a piece of A begins and no entry of B holds the two characters
    on both sides, so that no merge of B can join them. The different units of a stretch of texts are found by arrays, and each library is asked
    once for those that are not known, all in one text. Units are known by their characters, with a mark on each further piece of A that begins inside.
    Texts with other characters than those that ``tokens`` sorts are encoded whole by the libraries, and so are all if B's normaliser changes one of these.
    """

    MARK = 1 << 24
    LONGEST = 64  # characters of a unit that is kept, so that memory is bounded

    def __init__(self, path_a: str, path_b: str, most: int = 200_000):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # the strings of special tokens are plain text
        self.b = SentencePieceProcessor(model_file=path_b)
        self.chars = tokens._byte_chars()
        back = {c: b for b, c in self.chars.items()}
        entries = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for entry, k in entries.items():
            self.bytes_a[k] = b"".join(bytes([back[c]]) if c in back else c.encode() for c in entry)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.len_a, self.len_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))
        self.most, self.known, self.older = most, {}, {}
        self.feed = self.b.encode("\n")  # B puts a space before it
        sorted_ = [c for c in map(chr, range(1, tokens._TOP)) if tokens._KIND[ord(c)]]
        self.number = np.zeros(tokens._TOP, np.int64)
        self.number[[ord(c) for c in sorted_]] = np.arange(1, len(sorted_) + 1)
        self.joined = np.zeros((len(sorted_) + 1,) * 2, bool)
        for p in pieces:
            at = [self.number[ord(c)] if ord(c) < tokens._TOP else 0 for c in p.replace("▁", " ")]
            self.joined[at[:-1], at[1:]] = True
        self.joined[0] = self.joined[:, 0] = False
        some = "".join(["  ", *sorted_, "  "])
        line = self.number[10]
        self.by_units = self.b.normalize(some) == "▁" + some.replace(" ", "▁") and len(self.feed) == 2 and not (self.joined[line].any() or self.joined[:, line].any())

    def _spelled(self, a: list[int], b: list[int], want: bytes) -> bool:
        return b"".join(map(self.bytes_a.__getitem__, a)) == want == b"".join(map(self.bytes_b.__getitem__, b))

    def _whole(self, text: str) -> tuple[bytes, bytes]:
        """By the libraries alone."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        return (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if self._spelled(a, b, (" " + text).encode()) else (b"", b"")

    def _unit(self, unit: bytes) -> bytes:
        """One unit: the number of ids of A, these, and the ids of B; a 0 alone if they do not spell it."""
        cp = np.frombuffer(unit, np.uint32)
        parts = [x.tobytes().decode("utf-32-le") for x in np.split(cp & (self.MARK - 1), np.flatnonzero(cp >= self.MARK))]
        a = [t.id for p in parts for t in self.a.model.tokenize(p.encode().decode("latin-1").translate(self.chars))]
        b = self.b.encode("\n" + "".join(parts))[2:]
        return np.array([len(a), *a, *b] if self._spelled(a, b, "".join(parts).encode()) else [0], "<u4").tobytes()

    def _units(self, units: list[bytes]) -> Iterator[bytes]:
        """Units that are one piece of A, not of white space alone. B gets many as lines of one text: it cuts before and after a line feed."""
        text = b"\n\0\0\0".join(units).decode("utf-32-le")
        tokenize, ids_a, n_a = self.a.model.tokenize, [], []
        for piece in text.encode().decode("latin-1").translate(self.chars).split(self.chars[10]):
            found = tokenize(piece)
            n_a.append(len(found))
            ids_a += [t.id for t in found]
        lines, feed = text.split("\n"), self.feed[1]
        ids_b = np.array([k for lo in range(0, len(lines), 256) for k in self.b.encode("\n" + "\n".join(lines[lo : lo + 256]))[1:]], "<u4")
        cut = np.append(np.flatnonzero(ids_b == feed), len(ids_b))
        if len(cut) != len(units) + 1 or not self._spelled(ids_a, ids_b[ids_b != feed].tolist(), text.replace("\n", "").encode()):
            yield from map(self._unit, units)
            return
        n_a, n_b = np.array(n_a), np.diff(cut) - 1
        size = 1 + n_a + n_b
        first = np.cumsum(size) - size
        out = np.empty(size.sum(), "<u4")
        out[first] = n_a
        out[_spread(first + 1, n_a)] = ids_a
        out[_spread(first + 1 + n_a, n_b)] = ids_b[ids_b != feed]
        flat, ends = out.tobytes(), (4 * np.cumsum(size)).tolist()
        yield from (flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False))

    def _look_up(self, units: np.ndarray) -> list[bytes]:
        """Different units. At ``most`` entries the store becomes the older generation and a new one begins."""
        found = [*map(self.known.get, units)]
        left = [k for k, v in enumerate(found) if v is None]
        if len(self.known) + len(left) > self.most:
            self.older, self.known = self.known, {}
        new = []
        for k in left:
            v = found[k] = self.older.get(units[k])
            if v is None:
                new.append(k)
        if new:
            flat = np.frombuffer(b"".join([units[k] for k in new]), np.uint32)
            stop = np.cumsum(np.fromiter((len(units[k]) for k in new), np.int64, len(new)) // 4)
            odd = np.logical_or.reduceat(flat >= self.MARK, np.concatenate([[0], stop[:-1]]))
            last = flat[stop - 1] & (self.MARK - 1)
            odd |= (tokens._KIND[last] == tokens._BLANK) | (last == 0)
            plain = [k for k, o in zip(new, odd.tolist(), strict=True) if not o]
            for k, v in zip(plain, self._units([units[k] for k in plain]) if plain else (), strict=True):
                found[k] = v
            for k in new:
                if found[k] is None:
                    found[k] = self._unit(units[k]) if units[k] != b"\0\0\0\0" else bytes(4)
        self.known.update((units[k], found[k]) for k in left if len(units[k]) <= 4 * self.LONGEST)
        return found

    def encode(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids of A and B of each text as little-endian 32-bit numbers; none where their bytes are not the text's, with a space before it."""
        whole = [bool(t) and not (self.by_units and tokens._OTHER.search(t) is None) for t in texts]
        data = "\0".join([*("" if w or not t else " " + t for t, w in zip(texts, whole, strict=True)), ""]).encode("utf-32-le")
        cp = np.frombuffer(data, np.uint32)
        if not len(cp):
            return
        at = tokens.starts_of_pieces(cp)
        number = self.number[cp[at]]
        inner = self.joined[self.number[cp[at - 1]], number]
        inner[0] = False
        if inner.any():
            cp = cp.copy()
            cp[at[inner]] |= self.MARK
            at = at[~inner]
        edges = np.append(at, len(cp)).astype(np.int64) * 4
        units = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(cp)]).dictionary_encode()
        ids = self._look_up(units.dictionary.to_numpy(zero_copy_only=False))
        place, size = np.asarray(units.indices), np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        first, end = np.cumsum(size) - size, cp[at] == 0
        n_a = flat[first].astype(np.int64)
        streams, stops = [], []
        for start, n in ((first + 1, n_a), (first + 1 + n_a, size - 1 - n_a)):
            count = n[place]
            streams.append(flat[_spread(start[place], count)].tobytes())
            stops.append((4 * np.cumsum(count)[end]).tolist())
        bad = np.diff(np.cumsum((size == 1)[place])[end], prepend=0) > 1  # more than the text's end is without ids
        for text, w, x, lo_a, hi_a, lo_b, hi_b in zip(texts, whole, bad.tolist(), [0, *stops[0]], stops[0], [0, *stops[1]], stops[1], strict=False):
            yield self._whole(text) if w or x else (streams[0][lo_a:hi_a], streams[1][lo_b:hi_b])


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``n`` numbers from each ``first`` on, in a row."""
    stop = np.cumsum(n)
    out = np.repeat(first - (stop - n), n)
    out += np.arange(len(out))
    return out


@lru_cache(maxsize=1)
def pair_of(path_a: str, path_b: str) -> Pair:
    """One a worker; tasks of later stages, which encode nothing, let go of it."""
    return Pair(path_a, path_b)


def _encode(path_a: str, path_b: str, most_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(path_a, path_b)
        for batch in batches:
            for first, texts in tokens.stretches(batch.column(1), most_chars):
                a, b = zip(*pair.encode(texts), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["doc_id", "a", "b"])
        hand_back()

    return run


@dataclass
class Aligned:
    """Documents of a batch laid end to end: their ids, and where A and B tokens end together."""

    a: np.ndarray
    b: np.ndarray
    end_a: np.ndarray  # tokens of A up to the end of each document
    end_b: np.ndarray
    hit_a: np.ndarray  # tokens that end a group
    hit_b: np.ndarray

    def keys(self) -> np.ndarray:
        """Linked pairs, A's id above B's. No entry is without bytes, so an end that is shared links one token of each."""
        return (self.a[self.hit_a].astype(np.int64) << 32) | self.b[self.hit_b]


def align(a: list[bytes], b: list[bytes], len_a: np.ndarray, len_b: np.ndarray) -> Aligned:
    ids_a, ids_b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
    n_a, n_b = (np.cumsum(np.fromiter(map(len, x), np.int64, len(x)) // 4) for x in (a, b))
    stop_a, stop_b = np.cumsum(len_a[ids_a]), np.cumsum(len_b[ids_b])
    place = np.searchsorted(stop_b, stop_a)  # both end with the last document's last byte
    hit_a = stop_b[place] == stop_a if len(stop_b) else np.zeros(0, bool)
    hit_b = np.zeros(len(ids_b), bool)
    hit_b[place[hit_a]] = True
    return Aligned(ids_a, ids_b, n_a, n_b, hit_a, hit_b)


def _lists(batch: pa.RecordBatch, most_bytes: int) -> Iterator[tuple[pa.Array, list[bytes], list[bytes]]]:
    """(doc_id, A's ids, B's ids) of parts of about ``most_bytes``."""
    ids, held_a, held_b, size, first = batch.column(0), [], [], 0, 0
    for k, (a, b) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
        if held_a and size + len(a) + len(b) > most_bytes:
            yield ids.slice(first, k - first), held_a, held_b
            held_a, held_b, size, first = [], [], 0, k
        held_a.append(a)
        held_b.append(b)
        size += len(a) + len(b)
    if held_a:
        yield ids.slice(first), held_a, held_b


# --- minimal perfect hashing ----------------------------------------------------------


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of 64-bit keys, one to one for each seed."""
    h = keys.astype(np.int64).view(np.uint64) ^ np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(keys, 0) % np.uint64(buckets)).astype(np.int32)


class PerfectHash:
    """Different keys to the numbers below their count, each number once, in about three bits a key.

    Levels of bits: a key that meets no other at its place of a level is placed there, the others go on to the next. A key's number
    is the count of set bits before its own. Keys that were not built in may get a number, or -1: compare the key stored there.
    """

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.base = np.cumsum([0, *sizes.tolist()])
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def built(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        sizes, words = [], [np.zeros(0, np.uint64)]
        while len(keys):
            size = -(-int(room * len(keys)) // 64) * 64
            at = mix(keys, len(sizes) + 1) % np.uint64(size)
            alone = np.bincount(at.astype(np.int64), minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            keys = keys[~alone[at.astype(np.int64)]]
        return cls(np.array(sizes, np.int64), np.concatenate(words))

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = (mix(keys[left], level + 1) % np.uint64(size)).astype(np.int64) + self.base[level]
            word, bit = self.words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.rank[at >> 6] + below)[hit]
            left = left[~hit]
        return out


def _put(folder: str, name: str, array: np.ndarray) -> None:
    """Whole or not at all: a task that runs twice writes the same bytes again."""
    at = f"{folder}/{name}.npy"
    with open(f"{at}.{uuid.uuid4().hex}", "wb") as f:
        np.save(f, array)
    os.replace(f.name, at)


@lru_cache(maxsize=4_096)
def _bucket(folder: str, bucket: int) -> tuple[PerfectHash, np.ndarray]:
    sizes, words, keys = (np.load(f"{folder}/{n}-{bucket}.npy", mmap_mode="r") for n in ("sizes", "words", "keys"))
    return PerfectHash(sizes, words), keys


@lru_cache(maxsize=4_096)
def _counts(folder: str, bucket: int) -> np.ndarray:
    return np.load(f"{folder}/counts-{bucket}.npy", mmap_mode="r")


def _numbers(folder: str, bucket: int, keys: np.ndarray) -> np.ndarray:
    """Numbers of keys that are all in the bucket; another key than the one stored at a number is an error, never a count."""
    hash_, stored = _bucket(folder, bucket)
    at = hash_(keys)
    if (at < 0).any() or (stored[at] != keys).any():
        raise RuntimeError(f"bucket {bucket}: a pair that was not collected")
    return at


def _by_bucket(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys)."""
    b = bucket_of(keys, buckets)
    order = np.argsort(b, kind="stable")
    cut = np.flatnonzero(np.diff(b[order])) + 1
    for places in np.split(order, cut) if len(order) else []:
        yield int(b[places[0]]), places


def _distinct(len_a: np.ndarray, len_b: np.ndarray, most_bytes: int, most_known: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_of.cache_clear()
        hand_back()
        known = np.zeros(0, np.int64)
        for batch in batches:
            for _, a, b in _lists(batch, most_bytes):
                new = np.setdiff1d(align(a, b, len_a, len_b).keys(), known)
                if len(new):
                    known = np.union1d(known, new) if len(known) + len(new) <= most_known else new
                    yield pa.RecordBatch.from_arrays([pa.array(new)], ["key"])
        hand_back()

    return run


def _dealt(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(np.asarray(batch.column(0)), buckets)), batch.column(0)], ["bucket", "key"])

    return run


def _build(folder: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        keys, bucket = np.sort(g["key"].to_numpy()), int(g["bucket"].iloc[0])
        made = PerfectHash.built(keys)
        stored = np.empty_like(keys)
        stored[made(keys)] = keys
        for name, x in (("sizes", made.sizes), ("words", made.words), ("keys", stored)):
            _put(folder, f"{name}-{bucket}", x)
        return pd.DataFrame({"bucket": [bucket], "keys": [len(keys)], "bytes": [made.words.nbytes]})

    return run


def _count(folder: str, buckets: int, lo: int, hi: int, len_a: np.ndarray, len_b: np.ndarray, most_bytes: int):
    """Dense counts of the buckets from ``lo`` to ``hi``: one vector a bucket that the task meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair_of.cache_clear()
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, a, b in _lists(batch, most_bytes):
                keys, n = np.unique(align(a, b, len_a, len_b).keys(), return_counts=True)
                for bucket, places in _by_bucket(keys, buckets):
                    if lo <= bucket < hi:
                        vec = held.get(bucket)
                        if vec is None:
                            vec = held[bucket] = np.zeros(len(_bucket(folder, bucket)[1]), np.int64)
                        vec[_numbers(folder, bucket, keys[places])] += n[places]
        part = TaskContext.get().partitionId()
        for bucket, vec in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([part], pa.int32()), pa.array([vec.tobytes()], pa.binary())], ["bucket", "part", "counts"])
        hand_back()

    return run


def _sum(g: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in g["counts"])
    return pd.DataFrame({"bucket": g["bucket"].iloc[:1], "part": g["part"].iloc[:1], "counts": [total.tobytes()]})


def _finish(folder: str):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        bucket, counts = int(g["bucket"].iloc[0]), sum(np.frombuffer(x, np.int64) for x in g["counts"])
        _put(folder, f"counts-{bucket}", counts)
        b = (_bucket(folder, bucket)[1] & 0xFFFFFFFF).astype(np.int64)
        order = np.argsort(b, kind="stable")
        ids, first = np.unique(b[order], return_index=True)
        top = np.maximum.reduceat(counts[order], first)
        return pd.DataFrame({"bucket": bucket, "b": ids, "top": top})

    return run


# --- the operator ------------------------------------------------------------------------


@dataclass
class Alignment:
    """Encoded documents, the counts of linked pairs, and each B id's highest."""

    ids: DataFrame
    folder: str
    buckets: DataFrame  # bucket, keys, bytes
    n_buckets: int
    top: np.ndarray
    len_a: np.ndarray
    len_b: np.ndarray
    most_bytes: int

    def pairs(self) -> DataFrame:
        """``a, b, links, best``: each linked pair of ids with its count, ``best`` where it is its B id's highest."""
        folder, top = self.folder, self.top

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for bucket in batch.column(0).to_pylist():
                    keys, counts = np.asarray(_bucket(folder, bucket)[1]), np.asarray(_counts(folder, bucket))
                    b = keys & 0xFFFFFFFF
                    yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(b), pa.array(counts), pa.array(counts == top[b])], ["a", "b", "links", "best"])

        return self.buckets.select("bucket").mapInArrow(run, "a long, b long, links long, best boolean")

    def documents(self) -> DataFrame:
        """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``: all documents aligned again, their links looked up.

        ``groups`` writes a group's ids of A, a bar and its ids of B, ids parted by commas and groups by semicolons; empty without tokens.
        """
        folder, n_buckets, top, len_a, len_b, most_bytes = self.folder, self.n_buckets, self.top, self.len_a, self.len_b, self.most_bytes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair_of.cache_clear()
            words = [f"{k}{end}" for n, ends in ((len(len_a), ",|"), (len(len_b), ",;")) for end in ends for k in range(n)]
            for batch in batches:
                for ids, a, b in _lists(batch, most_bytes):
                    x = align(a, b, len_a, len_b)
                    keys, back = np.unique(x.keys(), return_inverse=True)
                    count = np.zeros(len(keys), np.int64)
                    for bucket, places in _by_bucket(keys, n_buckets):
                        count[places] = _counts(folder, bucket)[_numbers(folder, bucket, keys[places])]
                    best = count == top[keys & 0xFFFFFFFF]
                    upto = np.concatenate([[0], np.cumsum(x.hit_a)])[x.end_a]  # links up to each document's end
                    sums = [np.diff(np.concatenate([[0], v])[upto], prepend=0) for v in (np.cumsum(best[back]), np.cumsum(count[back]))]
                    links, n_a, n_b = (np.diff(v, prepend=0) for v in (upto, x.end_a, x.end_b))
                    # Each token's group; A's before B's within one.
                    g_a, g_b = (np.cumsum(h) - h for h in (x.hit_a, x.hit_b))
                    order = np.argsort(np.concatenate([2 * g_a, 2 * g_b + 1]), kind="stable")
                    code = np.concatenate([x.a + len(len_a) * x.hit_a, 2 * len(len_a) + x.b + len(len_b) * x.hit_b])[order].tolist()
                    ends = (x.end_a + x.end_b).tolist()
                    groups = ["".join(map(words.__getitem__, code[lo:hi]))[:-1] for lo, hi in zip([0, *ends], ends, strict=False)]
                    yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (n_a, n_b, links, links, *sums)), pa.array(groups, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])
            hand_back()

        return self.ids.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


def align_corpus(docs: DataFrame, path_a: str, path_b: str, bucket_keys: int = 65_536, slice_keys: int = 16_000_000, fan: int = 16, most_chars: int = 400_000) -> Alignment:
    """Encode all texts of ``docs`` with both tokenizers, link tokens that end together, and count each pair of ids over the corpus.

    The ids are written once, and every later look at a document aligns it again from them. Different pairs are told apart within tasks first and
    then by a shuffle, and dealt by hash to buckets of about ``bucket_keys``, each with a minimal perfect hash and its keys in the order of that hash, as files
    in the shared folder that workers map. Each task counts into dense vectors, a bucket each, which are summed up a tree, ``fan`` vectors
    a step; a pair that a third of all links hold is one number of a vector. At most ``slice_keys`` numbers are held by a task: with more pairs the documents
    are looked at once for each slice of buckets. The driver gets a row a B id. A pair whose stored key differs is refused, so no pair is counted as another.

    A text that is null or empty, or whose ids of A or B do not spell the text with a space before it (U+2581, characters
    that B's normaliser changes), has no tokens. Rows repeating an id or without one are documents each for itself; other columns are ignored.
    Tokens of special entries inside a text are plain text.
    """
    spark = docs.sparkSession
    pair = pair_of(path_a, path_b)
    len_a, len_b, most_bytes = pair.len_a, pair.len_b, 4 * most_chars
    if not len_a.all() or not len_b.all():
        raise ValueError("an entry without bytes ends nowhere of its own")
    path = work_path(spark, "alignment")
    folder = mounted(path)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = materialize(texts.mapInArrow(_encode(path_a, path_b, most_chars), IDS), "alignment-ids")
    keys = materialize(ids.mapInArrow(_distinct(len_a, len_b, most_bytes), "key long").distinct(), "alignment-keys")
    n = keys.count()
    n_buckets = max(1, -(-n // bucket_keys))
    built = keys.mapInArrow(_dealt(n_buckets), "bucket int, key long").groupBy("bucket").applyInPandas(_build(folder), "bucket int, keys long, bytes long")
    built = materialize(built, "alignment-hash")
    top = np.zeros(len(len_b), np.int64)
    step = max(1, slice_keys // bucket_keys)
    tasks = ids.rdd.getNumPartitions()
    for lo in range(0, n_buckets, step):
        sums = ids.mapInArrow(_count(folder, n_buckets, lo, lo + step, len_a, len_b, most_bytes), VECTOR)
        left = tasks
        while left > fan:
            sums = sums.withColumn("part", F.floor(F.col("part") / fan).cast("int")).groupBy("bucket", "part").applyInPandas(_sum, VECTOR)
            left = -(-left // fan)
        tops = sums.groupBy("bucket").applyInPandas(_finish(folder), "bucket int, b long, top long")
        for r in materialize(tops, "alignment-tops").groupBy("b").agg(F.max("top").alias("top")).collect():  # a row an id of B
            top[r["b"]] = max(top[r["b"]], r["top"])
    return Alignment(ids, folder, built, n_buckets, top, len_a, len_b, most_bytes)
