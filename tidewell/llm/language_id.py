"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from tidewell.llm.text import crc_mod

ORDER = 3
PAD = b"\n" * ORDER
_SLICE = 1 << 19


@dataclass
class PpmModel:
    """Frozen context trees of all languages over one shared alphabet.

    ``symbol`` maps a byte to its column (unseen bytes share the last one), ``node`` maps
    three preceding symbols to the deepest context that any language has seen, and
    ``bits[node, symbol]`` holds the code length in each language. A language
    without that context has escaped to its own shorter one there.
    """

    languages: list[str]
    symbol: np.ndarray
    node: np.ndarray
    bits: np.ndarray

    def code_lengths(self, data: bytes, starts: np.ndarray) -> np.ndarray:
        """Bits in each language of the texts that begin at ``starts``; each begins with PAD, which is free."""
        n, a = len(data), self.bits.shape[1]
        total = np.zeros((len(starts), len(self.languages)))
        s = self.symbol[np.frombuffer(data, np.uint8)]
        for lo in range(ORDER, n, _SLICE):
            hi = min(n, lo + _SLICE)
            ctx = (s[lo - 3 : hi - 3] * a + s[lo - 2 : hi - 2]) * a + s[lo - 1 : hi - 1]
            cost = self.bits[self.node[ctx], s[lo:hi]]
            for k in range(ORDER):  # bytes of the padding cost nothing
                pad = starts + k
                cost[pad[(pad >= lo) & (pad < hi)] - lo] = 0
            first = max(0, int(np.searchsorted(starts, lo, "right")) - 1)
            end = int(np.searchsorted(starts, hi, "left"))
            total[first:end] += np.add.reduceat(cost, np.maximum(starts[first:end] - lo, 0), axis=0, dtype=np.float64)
        return total


def _packed(texts: list[str]) -> tuple[bytes, np.ndarray]:
    parts = [PAD + t.encode() for t in texts]
    return b"".join(parts), np.cumsum([0, *map(len, parts[:-1])], dtype=np.int64)


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, four bytes as a number, count) of each batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            data, starts = _packed([t for x, t in zip(langs, texts, strict=True) if x == lang])
            b = np.frombuffer(data, np.uint8).astype(np.int64)
            gram = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
            keep = np.ones(len(gram), bool)
            for k in range(1, ORDER + 1):  # those that end in the padding of the next text
                at = starts[1:] - k
                keep[at[at >= 0]] = False
            gram, n = np.unique(gram[keep], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


#: The largest model that is broadcast.
MOST_BYTES = 1 << 29


def build(languages: list[str], grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> PpmModel:
    """Context trees from counts of four bytes, with escapes by the number of distinct followers.

    A context that was followed by ``q`` different bytes in ``t`` cases gives
    a byte seen ``n`` times n / (t + q) and escapes with q / (t + q) to the next shorter
    context, whose bytes that were seen here are excluded. Below order 0 all 256 bytes
    are alike. So each context's probabilities add up to 1.
    """
    used = np.zeros(256, bool)
    used[10] = True
    for g, _ in grams.values():
        for k in (0, 8, 16, 24):
            used[np.unique(g >> k & 255)] = True
    symbol = np.full(256, used.sum(), np.int32)
    symbol[used] = np.arange(used.sum())
    a = int(used.sum()) + 1
    prior = np.full(a, 1 / 256)
    prior[-1] = (256 - a + 1) / 256
    coded = {}
    for lang in languages:
        g, n = grams[lang]
        s = [symbol[g >> k & 255].astype(np.int64) for k in (24, 16, 8, 0)]
        coded[lang] = (s, n)
    # Nodes: the root, then all contexts of one, two and three symbols of any language.
    codes = [np.zeros(1, np.int64)]
    for k in range(1, ORDER + 1):
        each = [_code(s[ORDER - k : ORDER], a) for s, _ in coded.values()]
        codes.append(np.unique(np.concatenate(each)) if each else np.zeros(0, np.int64))
    first = np.cumsum([0, *map(len, codes)])
    size = int(first[-1]) * a * len(languages) * 4 + a**ORDER * 4
    if size > MOST_BYTES:
        raise ValueError(f"a model of {len(languages)} languages has {size} bytes; {MOST_BYTES} are sent to tasks at most: learn from fewer sample_docs, or in several models")
    bits = np.zeros((first[-1], a, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        s, n = coded[lang]
        p = None
        for k in range(ORDER + 1):
            count = np.zeros((len(codes[k]), a))
            ctx = _code(s[ORDER - k : ORDER], a) if k else np.zeros(len(n), np.int64)
            np.add.at(count, (np.searchsorted(codes[k], ctx), s[3]), n)
            lower = prior[None] if p is None else p[np.searchsorted(codes[k - 1], codes[k] % a ** (k - 1))]
            t, q = count.sum(1, keepdims=True), (count > 0).sum(1, keepdims=True)
            free = np.where(count > 0, 0, lower).sum(1, keepdims=True)
            escaped = q / np.maximum(t + q, 1) / np.maximum(free, 1e-300)
            p = np.where(count > 0, count / np.maximum(t + q, 1), np.where(t > 0, escaped, 1.0) * lower)
            each = p.copy()
            each[:, -1] /= max(256 - a + 1, 1)  # one byte of those that share the last column
            bits[first[k] : first[k + 1], :, j] = -np.log2(np.maximum(each, 1e-30))
    node = np.zeros(a**ORDER, np.int32)
    for k in range(1, ORDER + 1):
        at = np.arange(a ** (ORDER - k), dtype=np.int64)[:, None] * a**k + codes[k][None]
        node[at.ravel()] = np.tile(np.arange(first[k], first[k + 1], dtype=np.int32), len(at))
    return PpmModel(languages, symbol, node, bits)


def _code(symbols: list[np.ndarray], a: int) -> np.ndarray:
    code = symbols[0] * 0
    for s in symbols:
        code = code * a + s
    return code


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 150) -> PpmModel:
    """Learn from at most ``sample_docs`` whole documents of each language.

    The sample is those with the smallest id hashes among rows with text and language; ``sample_docs``
    is the bound on what is fitted. Counting runs in Spark; the driver gets the distinct
    four-byte strings of the sample and their counts.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")
    )
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    ids = rows.select("id", "lang").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_docs)
    picked = rows.join(F.broadcast(ids.select("id", "lang").distinct()), ["id", "lang"])
    counts = picked.select("lang", "text").mapInArrow(_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    langs = np.array(got["lang"].to_pylist(), object)
    g, n = np.asarray(got["gram"]).astype(np.int64), np.asarray(got["n"]).astype(np.int64)
    names = sorted(set(langs))
    return build(names, {x: (g[langs == x], n[langs == x]) for x in names})


def identify(docs: DataFrame, model: PpmModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; text alone decides.

    The language with the shortest code for the whole text wins, ties to the smaller name;
    ``score`` is its share of the posterior under equal priors. A null text, one without a
    letter, or a model that learned no language gives ``und`` and 0. Columns
    of those two names are replaced; all others are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ppm = shared.value
        for batch in batches:
            for lo, hi in _slices(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                pred, score = ["und"] * len(texts), np.zeros(len(texts))
                ok = [k for k, t in enumerate(texts) if t and ppm.languages and any(map(str.isalpha, t))]
                if ok:
                    length = ppm.code_lengths(*_packed([texts[k] for k in ok]))
                    best = length.argmin(1)
                    share = 1 / np.exp2(np.minimum(0, length.min(1, keepdims=True) - length)).sum(1)
                    for k, b, p in zip(ok, best, share, strict=True):
                        pred[k], score[k] = ppm.languages[b], p
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)], [*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def _slices(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes of text."""
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)
    lo = 0
    while lo < len(size):
        hi = int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "left")) + 1
        yield lo, min(hi, len(size))
        lo = hi


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1: never learned from."""
    return crc_mod(id_col, 3) == 1


def predict_corpus(docs: DataFrame, sample_docs: int = 150) -> DataFrame:
    """Train on the rows that are not held out and identify every row: ``doc_id, held_out, lang_pred, score``."""
    model = train(docs.where(~held_out()), sample_docs=sample_docs)
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
