"""MinHash near-dedup with tensored banding: keys of tables are pairs from two small collections of minhashes, and candidates are verified.

LEFT groups of LEFT_SIZE minhashes and RIGHT groups of RIGHT_SIZE give LEFT * RIGHT tables with
LEFT_SIZE + RIGHT_SIZE minhashes a key each, from only LEFT * LEFT_SIZE + RIGHT * RIGHT_SIZE
minhashes. Two documents of Jaccard similarity j meet with probability
(1 - (1 - j**LEFT_SIZE)**LEFT) * (1 - (1 - j**RIGHT_SIZE)**RIGHT): 0.90 at 0.5, 0.96 at 0.55, 0.99 at 0.6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, list_array, lists, mix, small_batches, word_hashes, written

WORDS = 3
THRESHOLD = 0.5
LEFT, LEFT_SIZE = 12, 2
RIGHT, RIGHT_SIZE = 20, 3
#: Documents of a bucket outside its largest group up to which each is set against the whole bucket; beyond, prefixes find the pairs.
SMALL = 32
#: The map of the keys that several documents have is of 2 ** MAP_BITS bits at every size of input; a fuller one lets more keys through, never fewer.
MAP_BITS = 27
_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, LEFT * LEFT_SIZE + RIGHT * RIGHT_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, len(_A), dtype=np.uint64)


def shingles(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each WORDS neighbouring words of each row, and their offsets; a row of fewer words has one shingle, one of none has none."""
    w = words.view(np.uint64)
    sizes = np.diff(offsets)
    counts = np.where(sizes > 0, np.maximum(sizes - WORDS + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(counts)])
    at = np.arange(to[-1]) + np.repeat(offsets[:-1] - to[:-1], counts)
    end = np.repeat(offsets[1:], counts)
    h = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(WORDS):
            there = at + k < end
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.where(there, w[np.minimum(at + k, len(w) - 1)], np.uint64(0)) if len(w) else h
    return mix(h), to


def signatures(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, minhashes) of rows that all have shingles."""
    out = np.empty((len(offsets) - 1, len(_A)), np.uint32)
    with np.errstate(over="ignore"):
        for k, (a, b) in enumerate(zip(_A, _B, strict=True)):
            out[:, k] = np.minimum.reduceat((h * a + b) >> np.uint64(32), offsets[:-1])
    return out


def keys(sig: np.ndarray) -> np.ndarray:
    """(rows, LEFT * RIGHT) 64-bit keys, different for each table."""
    with np.errstate(over="ignore"):

        def side(cols: np.ndarray, groups: int, size: int, salt: int) -> np.ndarray:
            out = np.zeros((len(cols), groups), np.uint64)
            for k in range(size):
                out = mix(out * np.uint64(31) + cols[:, k::size].astype(np.uint64) + np.uint64(salt))
            return mix(out + np.arange(groups, dtype=np.uint64)[None, :])

        left = side(sig[:, : LEFT * LEFT_SIZE], LEFT, LEFT_SIZE, 0x51)
        right = side(sig[:, LEFT * LEFT_SIZE :], RIGHT, RIGHT_SIZE, 0xA7)
        return mix(left[:, :, None] * np.uint64(0x9E3779B97F4A7C15) + right[:, None, :]).reshape(len(sig), -1).view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """(id, hi, lo, sig): a digest of the words in order and the minhashes, of every document that has words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, offsets = lists(b.column(1))
            some = np.flatnonzero(np.diff(offsets))
            if not len(some):
                continue
            h, to = shingles(words, offsets)
            sig = signatures(h, to[np.append(some, len(to) - 1)])
            raw = memoryview(np.ascontiguousarray(words)).cast("B")
            digests = b"".join(xxhash.xxh3_128_digest(raw[8 * x : 8 * y]) for x, y in zip(offsets[some].tolist(), offsets[some + 1].tolist(), strict=True))
            both = np.frombuffer(digests, "<i8").reshape(-1, 2)
            each = list_array(sig.ravel().view(np.int32), np.arange(len(some) + 1) * sig.shape[1])
            yield pa.record_batch([b.column(0).take(pa.array(some)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), each], ["id", "hi", "lo", "sig"])

    return docs.select("id", word_hashes(F.col("text")).alias("w")).mapInArrow(sign, "id long, hi long, lo long, sig array<int>")


def _shared_keys(keys: DataFrame) -> np.ndarray:
    """The map of these keys: 64 bits a word, placed by a key's first MAP_BITS bits."""
    bit = f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - MAP_BITS}) & 63 as int))"
    words = keys.groupBy(F.shiftrightunsigned("key", 70 - MAP_BITS).alias("word")).agg(F.expr(f"bit_or({bit})").alias("bits")).toArrow()
    out = np.zeros(1 << (MAP_BITS - 6), np.uint64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return out


def _keyed(signed: DataFrame, extra: str | None = None, shared=None) -> DataFrame:
    """(id, key) of each table, with an extra column of longs carried along; of the keys in the broadcast map shared, if it is given."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values, offsets = lists(b.column(1))
            if b.num_rows:
                k = keys(values.view(np.uint32).reshape(b.num_rows, -1))
                cols = [np.repeat(b.column(i).to_numpy(), k.shape[1]) for i in (0, *([2] if extra else []))]
                cols.append(k.ravel())
                if shared is not None:
                    at = cols[-1].view(np.uint64) >> np.uint64(64 - MAP_BITS)
                    there = (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
                    cols = [c[there] for c in cols]
                yield pa.record_batch([pa.array(c) for c in cols], ["id", *([extra] if extra else []), "key"])

    return signed.select("id", "sig", *([extra] if extra else [])).mapInArrow(spread, f"id long, {extra + ' long, ' if extra else ''}key long")


def _sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, set): sorted 32-bit hashes of the different shingles of these documents."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, to = shingles(*lists(b.column(1)))
            small = (h >> np.uint64(32)).astype(np.uint32)
            own = [np.unique(small[x:y]) for x, y in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]
            if own:
                yield pa.record_batch([b.column(0), list_array(np.concatenate(own).view(np.int32), np.concatenate([[0], np.cumsum([len(x) for x in own])]))], ["id", "set"])

    # The ids are the small side; hashing them spares the texts a sort.
    wanted = docs.join(ids.hint("shuffle_hash"), "id", "left_semi")
    return wanted.select("id", word_hashes(F.col("text")).alias("w")).mapInArrow(gather, "id long, set array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the pairs whose Jaccard similarity is threshold or more. Each set goes to the b of its pairs, where b's own comes first."""
    wanted = pairs.select(F.col("a").alias("id"), F.col("b"), F.lit(1).alias("o")).union(pairs.select(F.col("b").alias("id"), "b", F.lit(0).alias("o")).distinct())
    there = sets.join(wanted.hint("shuffle_hash"), "id").select("b", "o", "id", "set").repartition("b").sortWithinPartitions("b", "o")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(0, np.uint32)
        for batch in batches:
            a, b = [], []
            values, offsets = lists(batch.column(3))
            values = values.view(np.uint32)
            for k, (target, o, i) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                s = values[offsets[k] : offsets[k + 1]]
                if not o:
                    now, own = target, s.copy()
                elif target == now:
                    small, large = (s, own) if len(s) < len(own) else (own, s)
                    if len(small) >= threshold * len(large):
                        at = np.searchsorted(large, small)
                        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        if common >= threshold * (len(s) + len(own) - common):
                            a.append(i)
                            b.append(target)
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return there.mapInArrow(compare, "a long, b long")


def _prefix_pairs(hot: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a > b: pairs of different roots of hot (id, root) that may have Jaccard similarity threshold; none that has is missing.

    The shingles of a set are ordered from the rarest on. Two sets that are
    alike share one of the first |x| - threshold |x| + 1 of the larger and the
    first |y| - 2 threshold / (1 + threshold) |y| + 1 of the smaller. What a
    template gives to many documents comes last, so documents that are below the
    threshold share no such shingle by their template.
    """
    tokens = sets.join(hot, "id").select("id", "root", F.size("set").alias("size"), F.explode("set").alias("t"))
    # A shingle of one document comes first in its order and finds nothing, so only the shared ones are placed.
    often = tokens.groupBy("t").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("id")
    at = F.col("size") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "t")) - 1
    placed = tokens.join(often, "t").withColumn("at", at)
    short = F.col("size") - F.ceil(F.col("size") * (2 * threshold / (1 + threshold)) - 1e-9)
    placed = placed.filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9)).select("t", "id", "root", "size", (F.col("at") <= short).alias("first"))
    placed = written(placed, "prefixes")
    sizes = placed.groupBy("t", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("t").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("groups")).filter("groups > 1").select("t", "most")
    rest = placed.join(mixed, "t")
    few = rest.filter("root <> most").select("t", F.col("id").alias("x"), F.col("root").alias("rx"), F.col("size").alias("sx"), F.col("first").alias("fx"))
    smaller = F.when(F.struct("size", "id") < F.struct("sx", "x"), F.col("first")).otherwise(F.col("fx"))
    alike = smaller & (F.least("size", "sx") >= F.greatest("size", "sx") * threshold)
    return rest.join(few, "t").filter("root <> rx").filter(alike).select(F.least("id", "x").alias("b"), F.greatest("id", "x").alias("a")).distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, group_id) of each document that has near copies: connected by pairs of Jaccard similarity threshold or more over WORDS-word shingles; group_id is the smallest doc_id.

    Documents of the same words are one in the search. Every bucket's
    documents are first compared with its smallest one; then, between all pairs
    of a bucket that these comparisons left in different groups. This gives the
    same groups as comparing every pair of every bucket. Null texts and texts
    without words have no copies; rows with a null id are left out. Rows that
    share an id are one document, for which the text with the least digest stands.
    """
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).dropna()
    signed = written(_signed(plain), "signed")
    alone = signed.groupBy("hi", "lo").agg(F.min("id").alias("rep"))
    same = signed.select("id", "hi", "lo").join(alone, ["hi", "lo"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    same = written(same.distinct(), "same")
    # One row an id, of the least digest; ids that another of the same words stands for are not searched.
    reps = signed.join(same.select(F.col("a").alias("id")).distinct().hint("shuffle_hash"), "id", "left_anti")
    reps = written(reps.groupBy("id").agg(F.min_by("sig", F.struct("hi", "lo")).alias("sig")), "reps")
    # The least id of a bucket is aggregated in part before its shuffle, and the join splits a hot bucket. Most keys are of one document and are left out before the join.
    least = written(_keyed(reps).groupBy("key").agg(F.min("id").alias("m"), F.max("id").alias("n")).filter("m < n").select("key", "m"), "least")
    shared = docs.sparkSession.sparkContext.broadcast(_shared_keys(least))
    first = _keyed(reps, shared=shared).join(least, "key")
    stars = written(first.filter("id <> m").groupBy("id").agg(F.collect_set("m").alias("ms")), "stars")
    searched = stars.select("id").union(stars.select(F.explode("ms").alias("id"))).distinct()
    sets = written(_sets(plain, searched), "sets")
    edges = written(_verified(stars.select(F.col("id").alias("a"), F.array_min("ms").alias("b")), sets, threshold), "near")
    found = components(edges)
    # What is left: pairs of one bucket in different groups. All but the bucket's largest group are set against all, so a large group is never squared.
    label = written(reps.join(searched, "id").join(found, "id", "left").select("id", "sig", F.coalesce("root", "id").alias("root")), "labelled")
    spread = _keyed(label, "root", shared)
    sizes = spread.groupBy("key", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("few")).filter("few > 0")
    rest = written(spread.join(mixed, "key"), "mixed")
    light = rest.filter(F.col("few") <= SMALL)
    few = light.filter("root <> most").select("key", F.col("id").alias("x"), F.col("root").alias("rx"))
    pairs = light.join(few, "key").filter("root <> rx").select(F.least("id", "x").alias("b"), F.greatest("id", "x").alias("a"))
    pairs = pairs.union(_prefix_pairs(rest.filter(F.col("few") > SMALL).select("id", "root").distinct(), sets, threshold)).distinct()
    tried = stars.select(F.col("id").alias("a"), F.array_min("ms").alias("b"))
    more = _verified(written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs"), sets, threshold)
    found = components(edges.union(more).union(same))
    return found.select(F.col("id").alias("doc_id"), F.col("root").alias("group_id"))


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents but for those of a group that aren't its smallest doc_id, in the columns of documents.

    Rows with a null id, null or empty text stay. Rows that share an id stay or go together. Extra columns may have any name.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    i, t = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    gone = groups(plain, i, t, threshold).filter("doc_id <> group_id").select(F.col("doc_id").alias("_gone"))
    return plain.join(gone.hint("shuffle_hash"), F.col(i).cast("long") == F.col("_gone"), "left_anti").toDF(*names)
