"""Interpolated modified Kneser-Ney model of word pairs, memory-mapped by the workers."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import SPACE_BYTES, crc_mod
from tidewell.llm.tokens import stretches
from tidewell.storage import materialize, mounted, work_path

#: Ids that are no word's: a word that was never seen, and what stands before a text.
UNSEEN, BEGIN = 0xFFFFFFFF, 0xFFFFFFFE
#: Written in place of the end of a text; no UTF-8 text holds this byte.
END = b"\xff"
_BLANK = np.isin(np.arange(256), list(SPACE_BYTES))
#: A step of a spreading tree cuts what it holds into this many ranges at most, and merges about as many parts of each.
FAN = 256


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words, then the end."""
    return [*(text or "").encode().lower().split(), END]


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts: different words, the place of each token's word among them, and where texts begin."""

    words: list[bytes]
    place: np.ndarray
    starts: np.ndarray

    @classmethod
    def of(cls, texts: list[str | None]) -> Tokens:
        """Same as ``words_of`` for each text; the different words are found by arrays."""
        data = b"".join([x for t in texts for x in ((t or "").encode(), b" \xff ")]).lower()
        chars = np.frombuffer(data, np.uint8)
        if not len(chars):
            return cls([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        blank = _BLANK[chars]
        at = np.concatenate([[0], np.flatnonzero(blank[1:] != blank[:-1]) + 1])
        edges = np.append(at, len(chars)).astype(np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(data)]).dictionary_encode()
        every = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        is_word = np.array([not _BLANK[p[0]] for p in every])
        number = np.cumsum(is_word) - 1
        inside = np.asarray(pieces.indices)
        inside = inside[~blank[at]]
        ends = np.flatnonzero(chars[at[~blank[at]]] == END[0])
        return cls([p for p, w in zip(every, is_word, strict=True) if w], number[inside], np.concatenate([[0], ends[:-1] + 1]))


def hash_of(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) - (1 << 63)


@dataclass(frozen=True)
class Discounts:
    """What one, two, and three or more sightings lose."""

    one: float
    two: float
    more: float

    @classmethod
    def from_counts(cls, n: list[int]) -> Discounts:
        """From how many entries were seen once, twice, three and four times."""
        n1, n2, n3, n4 = n
        if not n1 or not n2:
            return cls(0.5, 0.5, 0.5) if n1 or n2 or n3 or n4 else cls(0.0, 0.0, 0.0)
        y = n1 / (n1 + 2 * n2)
        d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
        return cls(*(min(max(x, 0.01), k + 0.99) for k, x in enumerate(d)))

    def of(self, c: np.ndarray) -> np.ndarray:
        return np.choose(np.minimum(c, 3), [0.0, self.one, self.two, self.more])


@dataclass(frozen=True)
class Model:
    """Where the arrays lie, and the few numbers that hold for all of them.

    For each range k of ids (a word's id is the place of its hash among all sorted hashes):
    ``hash-k`` the sorted word hashes, ``count-k`` their counts, ``before-k`` the number of different words before
    each, ``after-k`` how many words follow it once, twice and more often. For each range k of pairs (id of the
    first word times 2^32 plus that of the second), which begins at ``first_pair[k]``: ``pair-k`` the sorted pairs,
    ``times-k`` their counts up to 254, ``often-k`` places and counts of the others. A frequent word's pairs are
    several ranges.
    """

    folder: str
    first_hash: np.ndarray
    first_id: np.ndarray
    first_pair: np.ndarray
    tokens: int
    distinct: int
    texts: int
    begin_after: tuple[int, int, int]
    pairs: int
    pair_discounts: Discounts
    word_discounts: Discounts
    before_kinds: tuple[int, int, int]


@lru_cache(maxsize=4_096)
def _array(folder: str, name: str, kind: str) -> np.ndarray:
    """A mapped array; the process keeps those it used last."""
    path = f"{folder}/{name}"
    if not os.path.getsize(path):
        return np.zeros(0, kind)
    return np.memmap(path, kind, "r")


def _save(folder: str, name: str, data: np.ndarray) -> None:
    draft = f"{folder}/{name}.{TaskContext.get().taskAttemptId()}.draft"
    data.tofile(draft)
    os.replace(draft, f"{folder}/{name}")


class _Ids(dict):
    """word -> its id, from the mapped hashes; started anew when it has grown large."""

    def __init__(self, folder: str, first_hash: np.ndarray, first_id: np.ndarray):
        super().__init__()
        self.folder, self.first_hash, self.first_id = folder, first_hash, first_id

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > 400_000:
            self.clear()
        new = [w for w in words if w not in self]
        h = np.array([hash_of(w) for w in new], np.int64)
        part = np.searchsorted(self.first_hash, h, "right") - 1
        ids = np.full(len(new), UNSEEN, np.int64)
        for k in np.unique(part[part >= 0]).tolist():
            held = _array(self.folder, f"hash-{k}", "<i8")
            at = np.flatnonzero(part == k)
            place = np.searchsorted(held, h[at])
            ok = place < len(held)
            ok[ok] = held[place[ok]] == h[at[ok]]
            ids[at[ok]] = self.first_id[k] + place[ok]
        self.update(zip(new, ids.tolist(), strict=True))
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    count: dict[bytes, int] = {}

    def block() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([hash_of(w) for w in count], pa.int64()), pa.array(count.values(), pa.int64())], ["hash", "n"])
        count.clear()
        return out

    for batch in batches:
        for _, texts in stretches(batch.column(0)):
            t = Tokens.of(texts)
            for w, n in zip(t.words, np.bincount(t.place, minlength=len(t.words)).tolist(), strict=True):
                count[w] = count.get(w, 0) + n
            if len(count) > 400_000:
                yield block()
    yield block()


def _save_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n = zip(*((np.asarray(b.column(0)), np.asarray(b.column(1))) for b in batches), strict=True) if (batches := list(batches)) else ((), ())
        h, n = np.concatenate([np.zeros(0, np.int64), *h]), np.concatenate([np.zeros(0, np.int64), *n])
        k = TaskContext.get().partitionId()
        _save(folder, f"words-{k}.hash", h.astype("<i8"))
        _save(folder, f"words-{k}.count", n.astype("<i8"))
        yield pa.RecordBatch.from_pydict({"part": pa.array([k], pa.int64()), "first": pa.array([h[0] if len(h) else None], pa.int64()), "words": pa.array([len(h)], pa.int64()), "tokens": pa.array([int(n.sum())], pa.int64())})

    return run


def _squeeze(x: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte planes apart, so that their zeros lie together."""
    d = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view(np.uint8).reshape(len(x), -1).T.tobytes())


def _swell(data: bytes, kind: str) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel(), dtype=kind)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]], kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Sum of counts by key over sorted parts, two at a time."""
    parts = parts or [(np.zeros(0, kind), np.zeros(0, np.int64))]
    while len(parts) > 1:
        parts = [*(_add(parts[k], parts[k + 1]) for k in range(0, len(parts) - 1, 2)), *(parts[-1:] if len(parts) % 2 else [])]
    return parts[0]


def _add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


def _pack(n: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(n.astype("<u4").tobytes())


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int64)


BLOCK = "range long, part long, keys binary, counts binary"


def _cut(key: np.ndarray, n: np.ndarray, edges: np.ndarray, span: int, part: int, first: int = 0, last: int | None = None) -> list[tuple[int, int, bytes, bytes]]:
    """Rows of BLOCK, one a stretch of ``span`` ranges from ``first`` to ``last`` that holds any of the sorted keys."""
    ranges = np.arange(first, len(edges) if last is None else last, span)
    at = [0, *np.searchsorted(key, edges[ranges[1:]]).tolist(), len(key)]
    return [(int(r), part, _squeeze(key[lo:hi]), _pack(n[lo:hi])) for r, lo, hi in zip(ranges.tolist(), at[:-1], at[1:], strict=True) if hi > lo]


def _tree(ranges: int) -> tuple[int, int]:
    """(fan, span): the least number of steps of at most FAN stretches, all of one fan, and the ranges in a stretch of the first cut."""
    steps = 1
    while FAN**steps < ranges:
        steps += 1
    fan = next(f for f in range(1, FAN + 1) if f**steps >= ranges)
    return fan, fan ** (steps - 1)


def _narrow(edges: np.ndarray, fan: int, span: int):
    """Merges the parts of a stretch of ``span`` ranges and cuts the sum into ``fan`` stretches."""

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        key, n = _merge([(_swell(k, "<u8"), _unpack(c)) for k, c in zip(rows["keys"], rows["counts"], strict=True)], "<u8")
        first = int(rows["range"].iloc[0])
        cut = _cut(key, n, edges, span // fan, int(rows["part"].iloc[0]), first, min(first + span, len(edges)))
        return pd.DataFrame(cut, columns=["range", "part", "keys", "counts"])

    return group


def _spread(blocks: DataFrame, edges: np.ndarray, n_blocks: int) -> DataFrame:
    """Rows of BLOCK whose ranges are stretches become rows by single range, few of each.

    A tree: each step groups the rows of one stretch by about as many blocks as a stretch is cut into, merges their counts, and
    cuts the sum into narrower stretches. So a group holds about what a block held, and each step passes on as many
    rows as it got at most, however many ranges and blocks there are.
    """
    fan, span = _tree(len(edges))
    while span > 1:
        n_blocks = -(-n_blocks // fan)
        blocks = blocks.withColumn("part", F.pmod(F.xxhash64("part"), F.lit(n_blocks)).cast("long"))
        blocks = materialize(blocks.groupBy("range", "part").applyInPandas(_narrow(edges, fan, span), BLOCK), "spread")
        span //= fan
    return blocks


def _count_pairs(folder: str, first_hash: np.ndarray, first_id: np.ndarray, first_pair: np.ndarray, block_tokens: int):
    _, span = _tree(len(first_pair))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _Ids(folder, first_hash, first_id)
        held: list[np.ndarray] = []
        base, made = TaskContext.get().partitionId() << 32, 0

        def block() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
            held.clear()
            col = list(zip(*_cut(key, n, first_pair, span, base + made), strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(col, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["range", "part", "keys", "counts"])

        for batch in batches:
            for _, texts in stretches(batch.column(0)):
                t = Tokens.of(texts)
                now = ids.of(t.words)[t.place].astype(np.uint64)
                before = np.empty_like(now)
                before[1:] = now[:-1]
                before[t.starts] = BEGIN
                held.append(before << np.uint64(32) | now)
                if sum(map(len, held)) >= block_tokens:
                    yield block()
                    made += 1
        yield block()

    return run


AFTER, BEFORE, BEGINS, KINDS = range(4)


def _save_pairs(folder: str, first_id: np.ndarray, first_pair: np.ndarray):
    """A range's pairs as files; what it knows of its first and second words as blocks by range of ids, and its counts of counts."""
    _, span = _tree(len(first_id))

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["range"].iloc[0])
        key, n = _merge([(_swell(a, "<u8"), _unpack(b)) for a, b in zip(rows["keys"], rows["counts"], strict=True)], "<u8")
        _save(folder, f"pair-{k}", key.astype("<u8"))
        _save(folder, f"times-{k}", np.minimum(n, 255).astype(np.uint8))
        often = np.flatnonzero(n >= 255)
        _save(folder, f"often-{k}", np.stack([often, n[often]], 1).astype("<i8") if len(often) else np.zeros((0, 2), "<i8"))
        kinds = [len(key), *(int((n == c).sum()) for c in (1, 2, 3, 4))]
        out = [(KINDS, 0, k, None, None, kinds)]
        one = key >> np.uint64(32)
        if int(first_pair[k]) >> 32 == BEGIN:
            out.append((BEGINS, 0, k, None, None, [int((n == 1).sum()), int((n == 2).sum()), int((n >= 3).sum())]))
        else:
            word, at = np.unique(one, return_index=True)
            after = np.stack([np.add.reduceat(sel.astype(np.int64), at) for sel in (n == 1, n == 2, n >= 3)], 1)
            r = int(np.searchsorted(first_id, word[0], "right")) - 1
            out.append((AFTER, r, k, _squeeze(word), _pack(after.ravel()), None))
        two, m = np.unique(key & np.uint64(0xFFFFFFFF), return_counts=True)
        out += [(BEFORE, *row, None) for row in _cut(two, m, first_id.astype(np.uint64), span, k)]
        return pd.DataFrame(out, columns=["what", "range", "part", "keys", "counts", "kinds"])

    return group


def _words_in_range(first_id: np.ndarray, distinct: int, k: int) -> tuple[int, int]:
    """The first id of range k, and how many there are."""
    first = int(first_id[k])
    return first, (int(first_id[k + 1]) if k + 1 < len(first_id) else distinct) - first


def _save_after(folder: str, first_id: np.ndarray, distinct: int):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["range"].iloc[0])
        first, size = _words_in_range(first_id, distinct, k)
        full = np.zeros((size, 3), np.int64)
        for a, b in zip(rows["keys"], rows["counts"], strict=True):
            full[_swell(a, "<u8").astype(np.int64) - first] += _unpack(b).reshape(-1, 3)
        _save(folder, f"after-{k}", full.astype("<u4"))
        return pd.DataFrame({"range": [k]})

    return group


def _save_before(folder: str, first_id: np.ndarray, distinct: int):
    def group(rows: pd.DataFrame) -> pd.DataFrame:
        k = int(rows["range"].iloc[0])
        key, n = _merge([(_swell(a, "<u8"), _unpack(b)) for a, b in zip(rows["keys"], rows["counts"], strict=True)], "<u8")
        first, size = _words_in_range(first_id, distinct, k)
        full = np.zeros(size, "<u4")
        full[key.astype(np.int64) - first] = n
        _save(folder, f"before-{k}", full)
        return pd.DataFrame({"range": [k], "kinds": [[*(int((n == c).sum()) for c in (1, 2, 3, 4)), int((n >= 3).sum())]]})

    return group


def _pair_ranges(hot: list[tuple[int, int]], first_id: np.ndarray, distinct: int, texts: int, range_tokens: int) -> np.ndarray:
    """Where ranges of pairs begin: with each range of ids, and within and behind a frequent first word, at even steps of its second word.

    ``hot`` has (id, count). Ids lie in the order of hashes, so even steps hold about as many different words.
    """
    edges = {int(i) << 32 for i in first_id}
    for i, n in [*hot, (BEGIN, texts)]:
        parts = max(1, -(-n // range_tokens))
        edges |= {i << 32 | k * distinct // parts for k in range(parts)}
        edges.add(i + 1 << 32)
    edges.discard(BEGIN + 1 << 32)
    if len(first_id):
        edges.discard(distinct << 32)
    return np.array(sorted(edges), np.uint64)


def _sums(rows: DataFrame, width: int) -> list[int]:
    """Sum of the arrays ``kinds``, place by place."""
    return [int(x or 0) for x in rows.agg(*(F.sum(F.col("kinds")[k]) for k in range(width))).first()]


def train(docs: DataFrame, text_col: str = "text", range_tokens: int = 2_500_000) -> Model:
    """Count all texts of ``docs`` and write the model's arrays into the shared folder.

    Tasks count what they read before anything is shuffled, so a word or pair that is a third of the corpus is
    one entry a block of ``range_tokens`` tokens. Words are summed by hash and lie in ranges of ids. Blocks of pairs are merged and
    spread over ranges of pairs by a tree of steps (``_spread``), each a shuffle of about what all blocks hold, so
    rows grow with the tokens and no group with the corpus; a word before more than ``range_tokens`` others has ranges of its own.
    The driver gets a row a range of ids and a frequent word. A null text is an end alone; no rows give a model
    that has seen nothing. Other columns are ignored. A word is told by its 64-bit hash.
    """
    spark = docs.sparkSession
    path = work_path(spark, "kneser-ney")
    folder = mounted(path)
    os.makedirs(folder, exist_ok=True)
    texts = docs.select(F.col(text_col).alias("text"))
    words = materialize(texts.mapInArrow(_count_words, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n")), "words")
    end = F.coalesce(F.max(F.when(F.col("hash") == hash_of(END), F.col("n"))), F.lit(0))
    size = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), end.alias("texts")).first()
    if size["v"] >= BEGIN:
        raise ValueError("more than 2^32 - 2 different words")
    ranges = max(4, -(-size["n"] // range_tokens))
    saved = words.repartitionByRange(ranges, "hash").sortWithinPartitions("hash").mapInArrow(_save_words(folder), "part long, first long, words long, tokens long")
    parts = sorted((r for r in saved.collect() if r["words"]), key=lambda r: r["first"])
    for k, r in enumerate(parts):
        for name in ("hash", "count"):
            os.replace(f"{folder}/words-{r['part']}.{name}", f"{folder}/{name}-{k}")
    first_hash = np.array([r["first"] for r in parts], np.int64)
    first_id = np.cumsum([0, *(r["words"] for r in parts)])[:-1].astype(np.int64) if parts else np.zeros(0, np.int64)
    hot = words.where(F.col("n") > range_tokens // 4).collect()
    places = [(int(np.searchsorted(first_hash, r["hash"], "right")) - 1, r["hash"], r["n"]) for r in hot]
    hot = [(int(first_id[k]) + int(np.searchsorted(_array(folder, f"hash-{k}", "<i8"), h)), n) for k, h, n in places]
    first_pair = _pair_ranges(hot, first_id, size["v"], size["texts"], range_tokens)

    blocks = texts.mapInArrow(_count_pairs(folder, first_hash, first_id, first_pair, range_tokens), BLOCK)
    blocks = _spread(blocks, first_pair, ranges)
    told = materialize(blocks.groupBy("range").applyInPandas(_save_pairs(folder, first_id, first_pair), f"what int, {BLOCK}, kinds array<long>"), "pairs")
    pairs, *kinds = _sums(told.where(F.col("what") == KINDS), 5)
    begin = _sums(told.where(F.col("what") == BEGINS), 3)
    by_word = lambda what: told.where(F.col("what") == what).select("range", "part", "keys", "counts")
    by_word(AFTER).groupBy("range").applyInPandas(_save_after(folder, first_id, size["v"]), "range long").count()
    before = _spread(by_word(BEFORE), first_id.astype(np.uint64), len(first_pair))
    saved = materialize(before.groupBy("range").applyInPandas(_save_before(folder, first_id, size["v"]), "range long, kinds array<long>"), "before")
    b1, b2, b3, b4, b3more = _sums(saved, 5)
    return Model(folder, first_hash, first_id, first_pair, size["n"], size["v"], size["texts"], tuple(begin), pairs, Discounts.from_counts(kinds), Discounts.from_counts([b1, b2, b3, b4]), (b1, b2, b3more))


class Scorer:
    """A worker's view of the mapped arrays."""

    def __init__(self, model: Model):
        self.m = model
        self.ids = _Ids(model.folder, model.first_hash, model.first_id)

    def _take(self, name: str, kind: str, ids: np.ndarray, width: tuple = ()) -> np.ndarray:
        """What the arrays ``name`` hold for the ids; a range that has no array holds zeros."""
        out = np.zeros((len(ids), *width), np.int64)
        part = np.searchsorted(self.m.first_id, ids, "right") - 1
        for k in np.unique(part).tolist():
            at = part == k
            if os.path.exists(f"{self.m.folder}/{name}-{k}"):
                out[at] = _array(self.m.folder, f"{name}-{k}", kind).reshape(-1, *width)[ids[at] - self.m.first_id[k]]
        return out

    def _pair_counts(self, key: np.ndarray) -> np.ndarray:
        """Counts of sorted pairs."""
        out = np.zeros(len(key), np.int64)
        if not len(key):
            return out
        ranges, at = np.unique(np.searchsorted(self.m.first_pair, key, "right") - 1, return_index=True)
        for k, lo, hi in zip(ranges.tolist(), at.tolist(), [*at[1:].tolist(), len(key)], strict=True):
            if not os.path.exists(f"{self.m.folder}/pair-{k}"):  # no pair of this range was seen
                continue
            pair = _array(self.m.folder, f"pair-{k}", "<u8")
            place = np.searchsorted(pair, key[lo:hi])
            ok = np.flatnonzero(place < len(pair))
            ok = ok[pair[place[ok]] == key[lo + ok]]
            n = _array(self.m.folder, f"times-{k}", "u1")[place[ok]].astype(np.int64)
            large = n == 255
            if large.any():
                often = _array(self.m.folder, f"often-{k}", "<i8").reshape(-1, 2)
                n[large] = often[np.searchsorted(often[:, 0], place[ok][large]), 1]
            out[lo + ok] = n
        return out

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, known tokens, score and base score of each text."""
        m, d1, d2 = self.m, self.m.word_discounts, self.m.pair_discounts
        t = Tokens.of(texts)
        ids = self.ids.of(t.words)
        known = ids != UNSEEN
        # By different word, with one more entry for what stands before a text.
        count, prior, after = np.zeros(len(ids) + 1, np.int64), np.zeros(len(ids), np.int64), np.zeros((len(ids) + 1, 3), np.int64)
        at = np.flatnonzero(known)
        count[at], prior[at], after[at] = self._take("count", "<i8", ids[at]), self._take("before", "<u4", ids[at]), self._take("after", "<u4", ids[at], (3,))
        count[-1], after[-1] = m.texts, m.begin_after
        b1, b2, b3 = m.before_kinds
        share = (d1.one * b1 + d1.two * b2 + d1.more * b3) / m.pairs if m.pairs else 1.0
        single = share / (m.distinct + 1) + (prior - d1.of(prior)) / max(m.pairs, 1)
        weight = np.where(count > 0, after @ np.array([d2.one, d2.two, d2.more]) / np.maximum(count, 1), 1.0)
        base = np.log10((count[:-1] + 0.1) / (m.tokens + 0.1 * (m.distinct + 1)))
        before = np.empty_like(t.place)
        before[1:] = t.place[:-1]
        before[t.starts] = len(ids)
        p = single[t.place] * weight[before]
        ask = np.flatnonzero((count[before] > 0) & known[t.place])
        key = np.append(ids, BEGIN).astype(np.uint64)[before[ask]] << np.uint64(32) | ids.astype(np.uint64)[t.place[ask]]
        key, back = np.unique(key, return_inverse=True)
        n = self._pair_counts(key)
        p[ask] += (n - d2.of(n))[back] / count[before[ask]]
        sums = (np.add.reduceat(x, t.starts) for x in (known[t.place].astype(np.int64), np.log10(p), base[t.place]))
        return np.diff(np.append(t.starts, len(t.place))), *sums


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, score, base_score`` of each row's whole text, in log10.

    ``base_score`` is that of single words with 0.1 added to each count. Perplexity is
    10 ** (-score / n_tokens). A null text is an end alone; null and repeated ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            for lo, texts in stretches(batch.column(1)):
                n, known, s, base = scorer.score(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *map(pa.array, (n, known, s, base))], ["doc_id", "n_tokens", "n_known", "score", "base_score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, score double, base_score double")


def held_out(id_col: str = "doc_id"):
    return crc_mod(id_col, 10) == 0


def score_corpus(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and score all."""
    model = train(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
