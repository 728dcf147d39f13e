"""Vector bin packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tidewell.llm.text import hand_back
from tidewell.llm.tokens import Encoder, stretches


@dataclass(frozen=True)
class Limits:
    """What a sequence holds at most, each at least 1.

    Plain documents bear loss on nearly every token, so the default ``loss`` leaves the other two limits to bind;
    instruction data with masked prompts give it a meaning of its own.
    """

    tokens: int = 2048
    segments: int = 256
    loss: int = 2048

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss) < 1:
            raise ValueError(f"limits must be 1 at least: {self}")


class Bin:
    """The open sequence of a task and the room it has left."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.number = -1
        self.reset()

    def reset(self) -> None:
        self.left = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], np.float64)
        self.number += 1

    @property
    def full(self) -> bool:
        return bool((self.left < 1).any())


def pack(n_tokens: np.ndarray, loss: list[np.ndarray], bin_: Bin) -> list[tuple[int, int, int, int, int]]:
    """Place every token of the items, going on with the open ``bin_``: (item, start, length, sequence, offset).

    ``loss[i]`` is the running sum of loss-bearing tokens of item i, with a 0 before the first. The next item
    of a sequence is the one that fits under all limits with the largest dot product of its
    demand (tokens, a segment, loss-bearing tokens, each as a share of its limit) and the room left. If
    none fits, the item with the largest product is cut where the first limit is met, and what
    remains of it stays among the items.
    """
    limit = np.array([bin_.limits.tokens, bin_.limits.segments, bin_.limits.loss], np.float64)
    start = np.zeros(len(n_tokens), np.int64)
    n_tokens = np.asarray(n_tokens, np.int64)
    demand = np.stack([n_tokens, np.ones(len(n_tokens)), [c[-1] for c in loss]], 1).astype(np.float64) if len(n_tokens) else np.zeros((0, 3))
    out, alive = [], np.flatnonzero(n_tokens > 0)
    while len(alive):
        if bin_.full:
            bin_.reset()
        need = demand[alive]
        score = (need / limit) @ (bin_.left / limit)
        fits = (need <= bin_.left).all(1)
        pick = int(np.where(fits, score, -1).argmax()) if fits.any() else int(score.argmax())
        i = int(alive[pick])
        length = int(n_tokens[i] - start[i])
        if not fits[pick]:
            sums = loss[i]
            room = int(np.searchsorted(sums, sums[start[i]] + bin_.left[2], "right")) - 1 - int(start[i])
            length = min(length, int(bin_.left[0]), room)
            if length < 1:  # only its loss-bearing head is in the way
                bin_.reset()
                continue
        used = np.array([length, 1, loss[i][start[i] + length] - loss[i][start[i]]], np.float64)
        out.append((i, int(start[i]), length, bin_.number, int(limit[0] - bin_.left[0])))
        bin_.left -= used
        start[i] += length
        if start[i] == n_tokens[i]:
            alive = np.delete(alive, pick)
        else:
            demand[i] -= [length, 0, used[2]]
    return out


_OUT = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, ids binary"


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, limits: Limits = Limits(), id_col: str = "doc_id", text_col: str = "text", batch_docs: int = 512, with_ids: bool = True) -> DataFrame:
    """Encode whole texts, append ``end_id`` and pack all ids into sequences.

    Returns one row a piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    loss_tokens, ids`` (little-endian unsigned 32-bit). A document bears loss on every id but its
    first, which nothing predicts.

    Each task packs what it reads, ``batch_docs`` documents at a time, and carries its open sequence on, so
    only its last one is left short; nothing is shuffled and no state grows with the input.
    ``sequence_id`` is the task's partition in the upper bits and its own count below; a
    retried task gives the same rows.

    Nulls: a null text is empty and is its end id alone; a null id is kept. Rows repeating an id are
    packed each. Other columns are ignored; no rows give no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bin_ = Encoder(tokenizer).encode, Bin(limits)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo, texts in stretches(batch.column(1)):
                stream, ends = encode(texts, end_id)
                data, n = stream.astype("<u4").tobytes(), np.diff(ends, prepend=0)
                for k in range(0, len(texts), batch_docs):
                    many = n[k : k + batch_docs]
                    rows = pack(many, [np.maximum(np.arange(-1, m), 0) for m in many.tolist()], bin_)
                    item, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True))
                    item += k
                    at = ends[item] - n[item] + start
                    pieces = [data[4 * i : 4 * j] for i, j in zip(at.tolist(), (at + length).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(lo + item)),
                            pa.array(start),
                            pa.array(length),
                            pa.array([zlib.crc32(p) for p in pieces], pa.int64()),
                            pa.array(n[item]),
                            pa.array(base + sequence),
                            pa.array(offset),
                            pa.array(length - (start == 0)),
                            pa.array(pieces if with_ids else [None] * len(pieces), pa.binary()),
                        ],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", "ids"],
                    )
        del encode  # and the pieces it knows
        hand_back()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"doc_id {kind}, {_OUT}")


def pack_examples(examples: DataFrame, limits: Limits = Limits(), batch_rows: int = 512) -> DataFrame:
    """Pack instruction examples ``(example_id, ids array<int>, loss_mask array<boolean>)``.

    Returns ``example_id, start, length, sequence_id, offset, loss_tokens``. A null or short mask
    bears no loss where it says nothing; an example without ids has no piece. Otherwise
    as ``pack_documents``.
    """
    kind = examples.schema["example_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bin_ = Bin(limits)
        base = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, batch_rows):
                part = batch.slice(lo, batch_rows)
                n, loss = [], []
                for ids, mask in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    k = len(ids or ())
                    bears = np.zeros(k, np.int64)
                    given = [bool(x) for x in (mask or ())][:k]
                    bears[: len(given)] = given
                    n.append(k)
                    loss.append(np.concatenate([[0], np.cumsum(bears)]))
                rows = pack(np.array(n, np.int64), loss, bin_)
                col = list(zip(*rows, strict=True)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.array(col[0], np.int64))),
                        *(pa.array(c, pa.int64()) for c in col[1:3]),
                        pa.array([base + k for k in col[3]], pa.int64()),
                        pa.array(col[4], pa.int64()),
                        pa.array([int(loss[i][s + k] - loss[i][s]) for i, s, k, _, _ in rows], pa.int64()),
                    ],
                    ["example_id", "start", "length", "sequence_id", "offset", "loss_tokens"],
                )

    return examples.select("example_id", "ids", "loss_mask").mapInArrow(run, f"example_id {kind}, start long, length long, sequence_id long, offset long, loss_tokens long")
