"""Vector bin packing of token pieces under several limits at once.

A document's ids (with its end id) are cut into pieces of at most `max_tokens`; full pieces stand alone.
The rest fill sequences one after the other. Each piece is a vector (tokens, segments, loss-bearing
tokens), each sequence has a capacity vector, and of the pieces that still fit, the one with the largest
dot product with what is left of the capacity goes in next. When no piece fits, a gap of at least
`min_cut` tokens takes the head of the largest remaining piece. Pieces are grouped by their vector, so one
placement costs a pass over distinct vectors and not over pieces.

Every task packs what it reads, in groups of `group_rows` documents: nothing is shuffled, and a task holds
one group at a time. A sequence is named by its task and its number there, so a task that is run again
names them alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import save, tidy
from .tokens import bears_loss, default_tokenizer, ids_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long, padded_to long"


@dataclass(frozen=True)
class Limits:
    """Of one sequence. `loss_tokens` None: as many as tokens."""

    max_tokens: int = 1024
    max_segments: int = 64
    max_loss_tokens: int | None = None
    min_cut: int = 16

    @property
    def capacity(self) -> np.ndarray:
        return np.array([self.max_tokens, self.max_segments, self.max_tokens if self.max_loss_tokens is None else self.max_loss_tokens], dtype=np.int64)


def place(vectors: np.ndarray, limits: Limits, loss_of_prefix=None) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (item, first token of it, tokens). vectors: an int row (tokens, 1, loss) for
    each item, none above the capacity. loss_of_prefix(item, first, n): loss tokens among n tokens of an
    item; without it nothing is cut."""
    cap = limits.capacity
    kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i, (n, _, loss) in enumerate(vectors.tolist()):
        kinds.setdefault((n, loss), []).append((i, 0))
    rows = np.array(sorted(kinds), dtype=np.int64).reshape(-1, 2)
    stacks = [kinds[tuple(r)] for r in rows.tolist()]
    count = np.array([len(s) for s in stacks], dtype=np.int64)
    where = {tuple(r): k for k, r in enumerate(rows.tolist())}
    scaled = np.column_stack([rows[:, 0] / cap[0], np.full(len(rows), 1 / cap[1]), rows[:, 1] / max(cap[2], 1)])
    left_items, out = int(count.sum()), []
    while left_items:
        left, seq = cap.copy(), []
        while left_items and left[0] > 0 and left[1] > 0:
            fit = (count > 0) & (rows[:, 0] <= left[0]) & (rows[:, 1] <= left[2])
            if not fit.any():
                k = int(np.flatnonzero(count > 0)[-1])
                if loss_of_prefix is None or left[0] < limits.min_cut or rows[k, 0] - left[0] < limits.min_cut:
                    break
                item, first = stacks[k][-1]
                n = int(left[0])
                loss = loss_of_prefix(item, first, n)
                rest = (int(rows[k, 0]) - n, int(rows[k, 1]) - loss)
                if loss > left[2]:
                    break
                stacks[k].pop()
                count[k] -= 1
                seq.append((item, first, n))
                left -= (n, 1, loss)
                if rest not in where:  # a vector seen for the first time
                    where[rest] = len(rows)
                    rows = np.vstack([rows, rest])
                    scaled = np.vstack([scaled, [rest[0] / cap[0], 1 / cap[1], rest[1] / max(cap[2], 1)]])
                    count = np.append(count, 0)
                    stacks.append([])
                stacks[where[rest]].append((item, first + n))
                count[where[rest]] += 1
                break
            score = np.where(fit, scaled @ (left / np.maximum(cap, 1)), -1.0)
            k = int(score.argmax())
            item, first = stacks[k].pop()
            count[k] -= 1
            left_items -= 1
            seq.append((item, first, int(rows[k, 0])))
            left -= (rows[k, 0], 1, rows[k, 1])
        out.append(seq)
    return out


def _pack_group(meta: list[tuple], limits: Limits, first_sequence: int, pad_power: bool) -> tuple[list[tuple], int]:
    """meta: (doc_id, ids, loss mask or None) of each document."""
    cap, sequence, out = limits.capacity, first_sequence, []
    items, vectors = [], []  # (document, start, end)
    sums: dict[int, np.ndarray] = {}

    def loss(d: int, a: int, b: int) -> int:
        mask = meta[d][2]
        if mask is None:
            return b - a
        if d not in sums:
            sums[d] = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return int(sums[d][b] - sums[d][a])

    def emit(d: int, a: int, n: int, offset: int) -> tuple:
        ids = meta[d][1]
        return (meta[d][0], a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids), sequence, offset, loss(d, a, a + n), 0)

    for d, (_, ids, _) in enumerate(meta):
        a = 0
        while a < len(ids):
            b = min(a + int(cap[0]), len(ids))
            while loss(d, a, b) > cap[2]:  # a piece may hold no more loss-bearing tokens than a sequence
                b = a + max(1, (b - a) // 2)
                if b - a == 1 and loss(d, a, b) > cap[2]:
                    raise ValueError("max_loss_tokens must be at least 1")
            if b - a == cap[0]:
                out.append((*emit(d, a, b - a, 0)[:-1], int(cap[0])))
                sequence += 1
            else:
                items.append((d, a, b))
                vectors.append((b - a, 1, loss(d, a, b)))
            a = b
    for seq in place(np.array(vectors, dtype=np.int64).reshape(-1, 3), limits, lambda i, f, n: loss(items[i][0], items[i][1] + f, items[i][1] + f + n)):
        total = sum(n for _, _, n in seq)
        padded = 1 << max(0, total - 1).bit_length() if pad_power else int(cap[0])
        offset = 0
        for i, f, n in seq:
            d, a, _ = items[i]
            out.append((*emit(d, a + f, n, offset)[:-1], min(padded, int(cap[0]))))
            offset += n
        sequence += 1
    return out, sequence


def pack(docs: DataFrame, text: str = "text", key: str = "doc_id", tokenizer: str | None = None, limits: Limits = Limits(), group_rows: int = 8192, group_tokens: int = 8_000_000, loss_mask: Column | None = None, loss_spans: Column | None = None, pad_power: bool = False) -> DataFrame:
    """Pieces of all documents, one row each; see the module for the method.

    `loss_mask`: an expression that is false for documents (prompts, say) none of whose tokens bear loss;
    true for all by default. `loss_spans`: an array of structs (start, end), the ranges of a text's characters whose tokens bear loss (responses,
    say, between prompts); where it is null the mask alone decides. A null or empty text is one piece of one token, its end id. Rows that repeat
    are packed each; a null key stays null; very long texts are encoded whole and cut into full pieces; which of equal pieces goes first is by their order
    in the task. Columns besides `text`, `key` and those of the expressions are not looked at; an empty table gives no row. `padded_to` is the length the
    sequence is padded to: `max_tokens`, or the next power of two with `pad_power`.
    """
    path = tokenizer or default_tokenizer()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0

        def frame(rows: list[tuple]) -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
            return out.astype({c: "Int64" if c == "doc_id" else "int64" for c in out.columns})

        for pdf, ids in ids_batches(frames, "t", path):
            for k, t, bears, spans, own in zip(pdf["k"], pdf["t"], pdf["bears"], pdf["spans"], ids):
                mask = np.zeros(len(own), bool) if not bears else None if spans is None else bears_loss(t, spans, path)
                waiting.append((None if pd.isna(k) else int(k), own, mask))
                held += len(own)
                if len(waiting) >= group_rows or held >= group_tokens:
                    rows, sequence = _pack_group(waiting, limits, sequence, pad_power)
                    waiting, held = [], 0
                    yield frame(rows)
        if waiting:
            rows, sequence = _pack_group(waiting, limits, sequence, pad_power)
            yield frame(rows)

    bears = F.lit(True) if loss_mask is None else F.coalesce(loss_mask.cast("boolean"), F.lit(True))
    spans = (F.lit(None) if loss_spans is None else loss_spans).cast("array<struct<start:int,end:int>>")
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), bears.alias("bears"), spans.alias("spans"))
    return save(rows.mapInPandas(tidy(run), SCHEMA), 1024)
