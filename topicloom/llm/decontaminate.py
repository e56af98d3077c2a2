"""Benchmark decontamination: one Aho-Corasick automaton over normalised test passages, with offsets into the original text."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: An item is found by any run of so many of its words; a shorter item by all of them.
WINDOW = 13
_word = re.compile(r"[^\W_]+")
_automata: dict[int, tuple] = {}


def normalise(text: str) -> str:
    """Lower-case letters and digits, runs joined by one space, with a space at both ends so that only whole words match."""
    return f" {' '.join(_word.findall(text.lower()))} "


def places(text: str) -> tuple[dict[int, int], dict[int, int], list[int], list[int]]:
    """Number of the word that starts, and that ends, at a place of the normalised text; start and end of each word in the original.

    Characters whose lower case is longer than one character are followed one by one.
    """
    low = text.lower()
    back = None
    if len(low) != len(text):
        back = [i for i, c in enumerate(text) for _ in c.lower()]
        low = "".join(c.lower() for c in text)
    at, first, last, starts, ends = 1, {}, {}, [], []
    for k, m in enumerate(_word.finditer(low)):
        first[at] = k
        at += m.end() - m.start()
        last[at] = k
        at += 1
        starts.append(m.start() if back is None else back[m.start()])
        ends.append(m.end() if back is None else back[m.end() - 1] + 1)
    return first, last, starts, ends


def patterns(items: list[tuple[int, str]], window: int = WINDOW) -> dict[str, list[tuple[int, int]]]:
    """Normalised runs of window words, each with the (item, place in words) it comes from."""
    out: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for item, text in items:
        words = _word.findall(text.lower())
        for k in range(max(1, len(words) - window + 1) if words else 0):
            out[f" {' '.join(words[k : k + window])} "].append((item, k))
    return dict(out)


def automaton(items: list[tuple[int, str]], window: int = WINDOW) -> ahocorasick.Automaton | None:
    """None when no item has a word."""
    a = ahocorasick.Automaton()
    for p, sources in patterns(items, window).items():
        a.add_word(p, (len(p), sorted({i for i, _ in sources})))
    if not len(a):
        return None
    a.make_automaton()
    return a


def spans(text: str, a: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """(item, start, end) in the original text; runs of one item that overlap or touch are one span."""
    found: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for end, (size, items) in a.iter(normalise(text)):
        for i in items:
            found[i].append((end - size + 2, end))
    if not found:
        return []
    first, last, starts, ends = places(text)
    out = []
    for i, hits in found.items():
        merged: list[list[int]] = []
        for s, e in sorted((first[s], last[e]) for s, e in hits):
            if merged and s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(i, starts[s], ends[e]) for s, e in merged]
    return sorted(out)


def _items(benchmark: DataFrame) -> list[tuple[int, str]]:
    got = benchmark.select(F.col("item_id").cast("long"), "text").dropna().distinct().toArrow()
    return sorted(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))


def _cached(sent) -> ahocorasick.Automaton | None:
    """Built once in a Python worker, however many tasks it runs."""
    key = id(sent.value)
    if key not in _automata:
        _automata.clear()
        items, window = sent.value
        _automata[key] = (sent.value, automaton(items, window))
    return _automata[key][1]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, item_id, start, end): each passage of a benchmark item in a document, in characters of its text.

    Items with a null id or text or without words are not searched for; items
    with equal text are each reported. Null and empty texts and rows with a null
    id have no passages; repeated rows report theirs each. The items are held in memory on every worker, as the
    automaton needs: a benchmark is a list of test questions, which doesn't grow with the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((_items(benchmark), window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _cached(sent)
        for b in batches:
            ids, items, starts, ends = [], [], [], []
            if a is not None:
                for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    for item, s, e in spans(text.as_py(), a):
                        ids.append(i)
                        items.append(item)
                        starts.append(s)
                        ends.append(e)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(items, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "item_id", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(search, "doc_id long, item_id long, start int, end int")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any passage of the benchmark, with all their columns, in one pass. Null and empty texts stay."""
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((_items(benchmark), window))
    names = docs.columns
    at = names.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = _cached(sent)
        for b in batches:
            if a is None:
                yield b
            else:
                yield b.filter(pa.array([t is None or next(a.iter(normalise(t)), None) is None for t in b.column(at).to_pylist()], pa.bool_()))

    return plain.mapInArrow(clean, plain.schema).toDF(*names)
