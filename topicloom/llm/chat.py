"""Chat formatting: whole conversations are rendered and encoded once, and tokens meet the turns' spans by their offsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import list_array, small_batches

#: Before and after a turn's text.
BEFORE, AFTER = "<|im_start|>{role}\n", "<|im_end|>\n"
#: Roles whose text, with the mark of its end, is learnt.
LEARNT = ("assistant",)


def render(turns: list[tuple[str, str]], learnt: tuple[str, ...] = LEARNT) -> tuple[str, list[tuple[int, int]]]:
    """The conversation as one text, and the sorted spans of its UTF-8 bytes that are learnt. Marks inside a turn's text are text like any other."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = BEFORE.format(role=role)
        parts += [head, text, AFTER]
        start = at + _size(head)
        at = start + _size(text) + len(AFTER)
        if role in learnt:
            spans.append((start, at))
    return "".join(parts), spans


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """1 for each token (start, end) that shares a place with one of the spans, which are sorted and don't overlap."""
    if not len(spans) or not len(offsets):
        return np.zeros(len(offsets), np.int8)
    k = np.searchsorted(spans[:, 1], offsets[:, 0], "right")
    inside = k < len(spans)
    return (inside & (spans[np.minimum(k, len(spans) - 1), 0] < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])).astype(np.int8)


def training_rows(turns: DataFrame, path: str = bpe.RANKS, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """(conv_id, n_turns, n_tokens, n_learnt, token_ids, loss_mask) of each conversation.

    Turns are in the order of (turn, role, text), null turns first, repeated ones
    each; a null text is empty and a null role is "unknown". Rows with a null
    conv_id belong to no conversation; an empty table has none. A token that is
    partly in a learnt span is learnt. Texts of any length are encoded whole, one conversation
    at a time, so the longest conversation must fit in a worker. Columns besides
    conv_id, turn, role and text are not looked at, whatever their names. path is
    the vocabulary file of bpe, at this path on every worker.
    """
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("t"), F.coalesce("role", F.lit("unknown")).alias("r"), F.coalesce("text", F.lit("")).alias("x")).alias("s")).filter("conv_id is not null")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s")).select("conv_id", F.col("s.r").alias("r"), F.col("s.x").alias("x"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = bpe.codec(path)
        sizes = np.array(c.size, np.int64)
        for b in batches:
            ids, masks, counts = [], [], []
            for roles, texts in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                text, spans = render(list(zip(roles, texts, strict=True)), learnt)
                own = c.array(text)
                # A token's offsets are those of its bytes, so they follow from the sizes of the tokens before it.
                to = np.cumsum(sizes[own])
                ids.append(own)
                masks.append(mask(np.stack([to - sizes[own], to], 1), np.array(spans, np.int64).reshape(-1, 2)))
                counts.append((len(roles), len(own), int(masks[-1].sum())))
            if counts:
                n, tokens, marked = (np.array(x, np.int32) for x in zip(*counts, strict=True))
                bounds = np.concatenate([[0], np.cumsum(tokens, dtype=np.int64)])
                yield pa.record_batch([b.column(0), pa.array(n), pa.array(tokens), pa.array(marked), list_array(np.concatenate(ids), bounds), list_array(np.concatenate(masks), bounds)], ["conv_id", "n_turns", "n_tokens", "n_learnt", "token_ids", "loss_mask"])

    return whole.mapInArrow(encode, f"conv_id {kind}, n_turns int, n_tokens int, n_learnt int, token_ids array<int>, loss_mask array<tinyint>")
