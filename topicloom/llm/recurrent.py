"""LM scoring: a gated recurrent word model trained on the corpus, with a class-factored softmax and state carried over windows.

Texts are turned into word ids once, in a written table. Training takes every document once, in ROUNDS hash slices of shards. A shard is of
about SHARD words by the hash of its documents, whatever the table's partitions; in a round each shard
is trained from the same weights by truncated backpropagation, and the results are averaged by words in the cluster, in the order of shards and
a stretch of the weights at a time. The VOCABULARY - 2 most frequent words have weights of their own. Any other word is one token and
its spelling, byte for byte, by counts of byte triples over all such words of the corpus, so no word is unknown. What is scored are the runs of letters and digits.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_kind, list_array, lists, small_batches, written

VOCABULARY, HIDDEN, WINDOW, LANES, ROUNDS = 2048, 16, 16, 512, 4
#: Words of a shard, on the average, and of a lane's stretch in training; a longer document is trained on in several lanes. Scoring never cuts a document.
SHARD, STRETCH_WORDS = 2_000_000, 1024
#: Words held by a task at a time; it bounds memory only.
POOL = 4_000_000
#: Stretch of the weights averaged by one row.
STRETCH = 4096
END, UNKNOWN = 0, 1
_word = re.compile(r"[^\W_]+")
_spellings: dict[int, tuple] = {}


def words(text: str) -> list[str]:
    return _word.findall(text.lower())


class Spelling:
    """Log-likelihoods of words by the two bytes before each byte, backing off to one and none; EDGE stands before and after a word.

    Made from the counts of byte triples, of which there are at most 257 ** 3 in a corpus of any size.
    """

    EDGE, WEIGHT = 256, 4.0

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        self.made_of = codes, counts
        n2 = np.bincount(codes % 257**2, counts, 257**2).reshape(257, 257)
        n1 = n2.sum(0)
        one = (n1 + 1) / (n1.sum() + 257)
        two = (n2 + self.WEIGHT * one) / (n2.sum(1, keepdims=True) + self.WEIGHT)
        before = np.bincount(codes // 257, counts, 257**2)
        rest = self.WEIGHT / (before + self.WEIGHT)
        table = rest.astype(np.float32).reshape(257, 257, 1) * two.astype(np.float32)[None, :, :]
        table = table.ravel()
        table[codes] += (counts / (before[codes // 257] + self.WEIGHT)).astype(np.float32)
        self.table = np.log(table, out=table)

    @classmethod
    def codes(cls, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The triples of several words, one after another, and where each word's begin."""
        if not some:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        # No word holds the byte 0, so it can stand for the edges: two before a word and one after it.
        x = np.frombuffer(("\0\0" + "\0\0\0".join(some) + "\0").encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
        x[x == 0] = cls.EDGE
        code = (x[:-2] * 257 + x[1:-1]) * 257 + x[2:]
        # Triples that span two words: those whose last byte is a word's first or second edge.
        inner = np.ones(len(code), bool)
        ends = np.flatnonzero((x[:-2] != cls.EDGE) & (x[1:-1] == cls.EDGE) & (x[2:] == cls.EDGE))
        inner[ends] = False
        inner[np.minimum(ends + 1, len(code) - 1)] &= ~(x[np.minimum(ends + 3, len(x) - 1)] == cls.EDGE)
        code = code[inner]
        starts = np.flatnonzero(code // 257 == cls.EDGE * 257 + cls.EDGE)
        return code, np.append(starts, len(code))

    def likelihood(self, code: int) -> float:
        """Of the last byte of a triple after the first two."""
        return float(np.exp(self.table[code]))

    def logs(self, some: list[str]) -> np.ndarray:
        """Log-likelihood of each word's bytes and its end."""
        code, at = self.codes(some)
        total = np.concatenate([[0.0], np.cumsum(self.table[code], dtype=np.float64)])
        return total[at[1:]] - total[at[:-1]]


class Net:
    """Weights are one vector; the word of rank r is in class r // width."""

    def __init__(self, vocabulary: int, hidden: int = HIDDEN, seed: int = 5, flat: np.ndarray | None = None):
        self.v, self.h = vocabulary, hidden
        self.spell: Spelling | None = None
        self.width = max(1, int(np.ceil(np.sqrt(vocabulary))))
        self.classes = -(-vocabulary // self.width)
        shapes = {"x": (vocabulary, 3 * hidden), "u": (hidden, 3 * hidden), "bu": (3 * hidden,), "c": (hidden, self.classes), "bc": (self.classes,), "w": (self.classes, hidden, self.width), "bw": (self.classes, self.width)}
        sizes = [int(np.prod(s)) for s in shapes.values()]
        if flat is None:
            rng = np.random.default_rng(seed)
            flat = np.concatenate([np.zeros(n) if k[0] == "b" else rng.normal(0, 0.1 if k == "x" else hidden**-0.5, n) for k, n in zip(shapes, sizes, strict=True)])
        self.flat = flat.astype(np.float32)
        self.at = dict(zip(shapes, np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist(), strict=True))
        self.shapes = shapes
        self.p = self.views(self.flat)
        # Places of a class past the vocabulary are never words.
        if self.classes * self.width > vocabulary:
            self.p["bw"][-1, vocabulary - (self.classes - 1) * self.width :] = -30

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {k: flat[self.at[k] : self.at[k] + int(np.prod(s))].reshape(s) for k, s in self.shapes.items()}

    def forward(self, tokens: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States after each step of (steps, lanes) tokens, and what going back needs."""
        p, n = self.p, self.h
        steps, lanes = tokens.shape
        gx = np.take(p["x"], tokens.ravel(), axis=0).reshape(steps, lanes, 3 * n)
        hs = np.empty((steps + 1, lanes, n), np.float32)
        gates = np.empty((steps, lanes, 2 * n), np.float32)
        cand, inner = np.empty((steps, lanes, n), np.float32), np.empty((steps, lanes, n), np.float32)
        hs[0] = state
        for t in range(steps):
            gh = hs[t] @ p["u"]
            gh += p["bu"]
            g = gates[t]
            np.add(gx[t, :, : 2 * n], gh[:, : 2 * n], out=g)
            np.negative(g, out=g)
            np.exp(g, out=g)
            g += 1
            np.reciprocal(g, out=g)
            inner[t] = gh[:, 2 * n :]
            c = cand[t]
            np.multiply(g[:, :n], inner[t], out=c)
            c += gx[t, :, 2 * n :]
            # tanh by way of exp, which is faster here; it is exact at both ends.
            c *= -2
            np.exp(c, out=c)
            c += 1
            np.divide(2, c, out=c)
            c -= 1
            z = g[:, n:]
            np.subtract(hs[t], c, out=hs[t + 1])
            hs[t + 1] *= z
            hs[t + 1] += c
        return hs, (tokens, gates, cand, inner)

    def losses(self, h: np.ndarray, targets: np.ndarray, grad: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-likelihood of each target given its state; with grad, also the loss's slope by state, and grad is filled, "w" for the targets' classes only."""
        p = self.p
        cls = targets // self.width
        # Sorting by counts is for short integers.
        order = np.argsort(cls.astype(np.uint16) if self.classes <= 1 << 16 else cls, kind="stable")
        bounds = np.searchsorted(cls[order], np.arange(self.classes + 1))
        logits = h @ p["c"]
        logits += p["bc"]
        rows = np.arange(len(h))
        own = logits[rows, cls]
        np.exp(logits, out=logits)
        ones = np.ones(max(self.classes, self.width), h.dtype)
        total = logits @ ones[: self.classes]
        ll = own - np.log(total)
        dh = None
        if grad is not None:
            logits /= total[:, None]
            logits[rows, cls] -= 1
            dh = logits @ p["c"].T
            grad["c"][:] = h.T @ logits
            grad["bc"][:] = logits.sum(0)
        hs, inside = np.take(h, order, axis=0), (targets - cls * self.width)[order]
        there = np.flatnonzero(np.diff(bounds))
        e = np.take(p["bw"], cls[order], axis=0)
        for k in there:
            e[bounds[k] : bounds[k + 1]] += hs[bounds[k] : bounds[k + 1]] @ p["w"][k]
        mine = e[rows, inside]
        np.exp(e, out=e)
        total = e @ ones[: self.width]
        ll[order] += mine - np.log(total)
        if grad is not None:
            e /= total[:, None]
            e[rows, inside] -= 1
            dw = np.empty_like(h)
            grad["bw"][:] = 0
            for k in there:
                a, b = bounds[k], bounds[k + 1]
                np.matmul(e[a:b], p["w"][k].T, out=dw[a:b])
                np.matmul(hs[a:b].T, e[a:b], out=grad["w"][k])
            grad["bw"][there] = np.add.reduceat(e, bounds[there], axis=0)
            dh[order] += dw
        return ll, dh

    def backward(self, hs: np.ndarray, kept: tuple, dh_out: np.ndarray, grad: dict) -> np.ndarray:
        """Slopes of the loss by the recurrent weights, back to the window's start and no further. Returns the words whose rows of "x" are filled."""
        p, n = self.p, self.h
        tokens, gates, cand, inner = kept
        steps, lanes = tokens.shape
        dgh, dc = np.empty((steps, lanes, 3 * n), np.float32), np.empty((steps, lanes, n), np.float32)
        dh = np.zeros((lanes, n), np.float32)
        back = np.ascontiguousarray(p["u"].T)
        # What doesn't depend on the slopes is made for all steps at once.
        r, z = gates[:, :, :n], gates[:, :, n:]
        by_c = (1 - z) * (1 - cand * cand)
        by_z = (hs[:-1] - cand) * z * (1 - z)
        by_r = inner * r * (1 - r)
        for t in range(steps - 1, -1, -1):
            dh += dh_out[t]
            g = dgh[t]
            np.multiply(dh, by_c[t], out=dc[t])
            np.multiply(dc[t], by_r[t], out=g[:, :n])
            np.multiply(dh, by_z[t], out=g[:, n : 2 * n])
            np.multiply(dc[t], r[t], out=g[:, 2 * n :])
            dh *= z[t]
            dh += g @ back
        dgx = dgh.copy()
        dgx[:, :, 2 * n :] = dc
        flat_h, flat_g = hs[:-1].reshape(-1, n), dgh.reshape(-1, 3 * n)
        grad["u"][:] = flat_h.T @ flat_g
        grad["bu"][:] = flat_g.sum(0)
        at = tokens.ravel()
        order = np.argsort(at.astype(np.uint16) if self.v <= 1 << 16 else at, kind="stable")
        at = at[order]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        grad["x"][at[first]] = np.add.reduceat(np.take(dgx.reshape(-1, 3 * n), order, axis=0), first, axis=0)
        return at[first]


def _lanes(sizes: np.ndarray, lanes: int, seed: int) -> list[list[int]]:
    """Documents of each lane, longest lane first; lanes are about as long as each other."""
    heap = [(0, k) for k in range(min(lanes, len(sizes)))]
    out: list[list[int]] = [[] for _ in heap]
    for i in np.argsort(-sizes, kind="stable").tolist():
        total, k = heapq.heappop(heap)
        out[k].append(i)
        heapq.heappush(heap, (total + -(-int(sizes[i]) // WINDOW), k))
    rng = np.random.default_rng(seed)
    for lane in out:
        rng.shuffle(lane)
    return sorted(out, key=lambda lane: -sum(-(-int(sizes[i]) // WINDOW) for i in lane))


def run(net: Net, docs: list[np.ndarray], train: bool, rate: float = 0.01, lanes: int = LANES) -> np.ndarray:
    """Log-likelihood of each document (ids that end with END), whole, its state carried from window to window; with train, the weights follow (Adam).

    A lane holds one document after another and starts each with a new state.
    """
    out = np.zeros(len(docs))
    if not docs:
        return out
    sizes = np.array([len(d) for d in docs])
    plan = _lanes(sizes, lanes, 3)
    windows = [sum(-(-int(sizes[i]) // WINDOW) for i in lane) for lane in plan]
    words, owner, fresh = np.full((len(plan), windows[0] * WINDOW), -1, np.int32), np.zeros((windows[0], len(plan)), np.int64), np.zeros((windows[0], len(plan)), bool)
    for j, lane in enumerate(plan):
        at = 0
        for i in lane:
            n = -(-len(docs[i]) // WINDOW)
            words[j, at * WINDOW : at * WINDOW + len(docs[i])] = docs[i]
            owner[at : at + n, j] = i
            fresh[at, j] = True
            at += n
    live = np.searchsorted(-np.array(windows), -np.arange(1, windows[0] + 1), "right")
    state = np.zeros((len(plan), net.h), np.float32)
    last = np.full(len(plan), END, np.int32)
    if train:
        grad, m1, m2, step = (*(net.views(np.zeros_like(net.flat)) for _ in range(3)), 0)
    for k in range(windows[0]):
        n = live[k]
        targets = np.ascontiguousarray(words[:n, k * WINDOW : (k + 1) * WINDOW].T)
        begun = fresh[k, :n]
        state = state[:n]
        state[begun] = 0
        before = np.where(begun, END, last[:n])
        given = np.maximum(np.concatenate([before[None, :], targets[:-1]]), 0)
        hs, kept = net.forward(given, state)
        real = np.flatnonzero(targets.ravel() >= 0)
        whole = len(real) == targets.size
        h = hs[1:].reshape(-1, net.h)
        ll, dh = net.losses(h if whole else np.take(h, real, axis=0), targets.ravel()[real], grad if train else None)
        full = np.zeros(targets.size)
        full[real] = ll
        out[owner[k, :n]] += full.reshape(targets.shape).sum(0)  # a document is in one lane
        state, last = hs[-1].copy(), np.maximum(targets[-1], 0)
        if train:
            if not whole:
                dh_out = np.zeros((targets.size, net.h), np.float32)
                dh_out[real] = dh
                dh = dh_out
            rows = net.backward(hs, kept, dh.reshape(*targets.shape, net.h), grad)
            classes = np.flatnonzero(np.bincount(targets.ravel()[real] // net.width, minlength=net.classes))
            # Only what the window touches moves, so a step's cost doesn't follow the rows of the vocabulary.
            at = {"x": rows, "w": classes} | {name: slice(None) for name in ("u", "bu", "c", "bc", "bw")}
            slopes = {name: grad[name][i] / np.float32(max(1, len(real))) for name, i in at.items()}
            norm = float(np.sqrt(sum(float(np.vdot(g, g)) for g in slopes.values())))
            step += 1
            # Logits stay where exp is finite without a shift: states are within -1 and 1.
            most = 80 / (net.h + 1)
            for name, i in at.items():
                g = slopes[name]
                if norm > 1:
                    g /= norm
                first, second = m1[name][i] * np.float32(0.9), m2[name][i] * np.float32(0.99)
                first += np.float32(0.1) * g
                g *= g
                g *= 0.01
                second += g
                m1[name][i], m2[name][i] = first, second
                second /= 1 - 0.99**step
                np.sqrt(second, out=second)
                second += 1e-6
                first /= second
                first *= rate / (1 - 0.9**step)
                np.subtract(net.p[name][i], first, out=first)
                if name in ("w", "c", "bw", "bc"):
                    np.clip(first, -30 if name == "bw" else -most, most, out=first)
                net.p[name][i] = first
    return out


def counted(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.record_batch([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return b

        for b in batches:
            for text in b.column(0):
                seen.update(words(text.as_py()))
                if len(seen) > 200_000:
                    yield out()
        yield out()

    return texts.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> list[str]:
    """The size - 2 most frequent words, ties by the word."""
    return [r[0] for r in counts.orderBy(F.desc("n"), "word").limit(size - 2).collect()]


def spelling(counts: DataFrame, known: list[str]) -> Spelling:
    """The spelling of all words but the known ones, each as often as it occurs; triples are counted in the cluster."""
    sent = counts.sparkSession.sparkContext.broadcast(frozenset(known))

    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [(w, n) for w, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if w not in sent.value]
            if keep:
                code, at = Spelling.codes([w for w, _ in keep])
                own, where = np.unique(code, return_inverse=True)
                n = np.bincount(where, np.repeat([float(n) for _, n in keep], np.diff(at)))
                yield pa.record_batch([pa.array(own.astype(np.int32)), pa.array(n.astype(np.int64))], ["code", "n"])

    got = counts.mapInArrow(triples, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    return Spelling(got.column(0).to_numpy().astype(np.int64), got.column(1).to_numpy().astype(float))


def _spelled(sent) -> tuple[dict[str, int], Spelling]:
    """Made once in a Python worker, however many tasks it runs."""
    key = id(sent.value)
    if key not in _spellings:
        _spellings.clear()
        known, codes, counts = sent.value
        _spellings[key] = sent.value, {w: i + 2 for i, w in enumerate(known)}, Spelling(codes, counts)
    return _spellings[key][1:]


def tokenised(docs: DataFrame, known: list[str], spell: Spelling, id_col: str, text_col: str) -> DataFrame:
    """(id, k, ids, spelled) of every row: a hash of id and text, the word ids with END after them, none for a text without words, and the log-likelihood of the spelled words."""
    sent = docs.sparkSession.sparkContext.broadcast((known, *spell.made_of))

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, spell = _spelled(sent)
        for b in batches:
            each, rare, counts = [], [], np.zeros(b.num_rows, np.int64)
            for k, text in enumerate(b.column(2)):
                text = text.as_py()
                own = words(text) if text else []
                ids = np.empty(len(own) + bool(own), np.int32)
                if own:
                    ids[:-1] = np.fromiter(map(index.get, own, repeat(UNKNOWN)), np.int32, len(own))
                    ids[-1] = END
                    other = [own[i] for i in np.flatnonzero(ids == UNKNOWN).tolist()]
                    counts[k] = len(other)
                    rare += other
                each.append(ids)
            total = np.concatenate([[0.0], np.cumsum(spell.logs(rare))])
            to = np.concatenate([[0], np.cumsum(counts)])
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])
            yield pa.record_batch([b.column(0), b.column(1), list_array(np.concatenate(each) if each else np.zeros(0, np.int32), bounds), pa.array(total[to[1:]] - total[to[:-1]])], ["id", "k", "ids", "spelled"])

    return docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("k"), F.col(text_col).alias("text")).mapInArrow(turn, f"id {id_kind(docs, id_col)}, k long, ids array<int>, spelled double")


def fitted(tokens: DataFrame, size: int, hidden: int, rounds: int, rate: float, shard: int) -> Net:
    """The weights after all rounds; without words they are the initial ones. Rows repeated whole are trained on once."""
    spark = tokens.sparkSession
    net = Net(size, hidden)
    total = tokens.agg(F.sum(F.size("ids"))).first()[0] or 0
    shards = max(1, round(total / rounds / shard))
    # Half of the hash's bits choose the round and the rest the shard, so neither depends on the table's partitions.
    parts = tokens.filter(F.size("ids") > 0).select(F.pmod(F.shiftright("k", 32), F.lit(rounds)).alias("turn"), F.pmod("k", F.lit(shards)).alias("shard"), "k", "ids")
    for turn in range(rounds if total else 0):
        sent = spark.sparkContext.broadcast((net.flat, size, hidden))

        def fit(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            flat, v, h = sent.value
            now, last, own, pool, held, total = None, None, None, [], 0, 0

            def train() -> None:
                nonlocal pool, held, total
                run(own, [d[a : a + STRETCH_WORDS] for d in pool for a in range(0, len(d), STRETCH_WORDS)], True, rate / (1 + turn))
                total, pool, held = total + held, [], 0

            def out() -> pa.RecordBatch:
                train()
                parts = [own.flat[a : a + STRETCH].astype(np.float64) * total for a in range(0, len(own.flat), STRETCH)]
                return pa.record_batch([pa.array(range(len(parts)), pa.int32()), pa.array([now] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64())), pa.array([float(total)] * len(parts))], ["part", "shard", "sums", "n"])

            for b in batches:
                values, offsets = lists(b.column(2))
                for i, (s, k) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                    if s != now:
                        if now is not None:
                            yield out()
                        now, last, own, total = s, None, Net(v, h, flat=flat.copy()), 0
                    if k == last:
                        continue
                    last = k
                    pool.append(values[offsets[i] : offsets[i + 1]])
                    held += len(pool[-1])
                    if held >= POOL:
                        train()
            if now is not None:
                yield out()

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, sums, n = None, None, 0.0
            for b in batches:
                for part, s, m in zip(b.column(0).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                    x = s.values.to_numpy()
                    if part == now:
                        sums, n = sums + x, n + m
                    else:
                        if now is not None:
                            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([sums / n], pa.list_(pa.float64()))], ["part", "mean"])
                        now, sums, n = part, x, m
            if now is not None:
                yield pa.record_batch([pa.array([now], pa.int32()), pa.array([sums / n], pa.list_(pa.float64()))], ["part", "mean"])

        placed = parts.filter(F.col("turn") == turn).select("shard", "k", "ids").repartition(shards, "shard").sortWithinPartitions("shard", "k")
        trained = placed.mapInArrow(fit, "part int, shard long, sums array<double>, n double")
        got = trained.repartition("part").sortWithinPartitions("part", "shard").mapInArrow(add, "part int, mean array<double>").orderBy("part").toArrow()
        if got.num_rows:
            net = Net(size, hidden, flat=np.concatenate([m.values.to_numpy().astype(np.float32) for m in got.column(1)]))
    return net


def _prepared(docs: DataFrame, size: int, id_col: str, text_col: str) -> tuple[list[str], Spelling, DataFrame]:
    small_batches(docs.sparkSession)
    counts = written(counted(docs.select(F.col(text_col).alias("text")).filter("text is not null")), "words")
    known = vocabulary(counts, size)
    spell = spelling(counts, known)
    return known, spell, written(tokenised(docs, known, spell, id_col, text_col), "tokens")


def train(docs: DataFrame, size: int = VOCABULARY, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> tuple[list[str], Net]:
    """The vocabulary and the weights, with the spelling of other words. All documents with words are counted and trained on; with none the weights are the initial ones."""
    known, spell, tokens = _prepared(docs, size, id_col, text_col)
    net = fitted(tokens, len(known) + 2, hidden, rounds, rate, shard)
    net.spell = spell
    return known, net


def scored(tokens: DataFrame, net: Net, id_col: str) -> DataFrame:
    """The scores of tokenised rows."""
    kind = id_kind(tokens, "id")
    sent = tokens.sparkSession.sparkContext.broadcast((net.flat, net.v, net.h))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, v, h = sent.value
        own = Net(v, h, flat=flat)

        def out(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            values, offsets = lists(rows.column(1))
            n = np.diff(offsets)
            some = np.flatnonzero(n)
            ll = rows.column(2).to_numpy().copy()
            ll[some] += run(own, [values[offsets[i] : offsets[i + 1]] for i in some], False)
            return pa.record_batch([rows.column(0), pa.array(n), pa.array(ll), pa.array(np.exp(np.minimum(-ll / np.maximum(n, 1), 700)), mask=n == 0)], [id_col, "n_tokens", "log_likelihood", "perplexity"])

        held, total = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                total += len(b.column(1).flatten())
            if total >= POOL:
                yield out(held)
                held, total = [], 0
        if held:
            yield out(held)

    return tokens.select("id", "ids", "spelled").mapInArrow(work, f"`{id_col}` {kind}, n_tokens long, log_likelihood double, perplexity double")


def score(docs: DataFrame, known: list[str], net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_likelihood, perplexity) of every row: the words and the end of its whole text, of any length.

    Null texts and texts without words have 0 tokens, log-likelihood 0 and null
    perplexity. Rows with a null id and repeated rows are scored each; an empty table gives none. Other columns are not looked at, whatever their names.
    """
    small_batches(docs.sparkSession)
    return scored(tokenised(docs, known, net.spell, id_col, text_col), net, id_col)


def log_likelihoods(docs: DataFrame, size: int = VOCABULARY, hidden: int = HIDDEN, rounds: int = ROUNDS, rate: float = 0.01, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """score() of the documents by a model trained on all of them. The result doesn't depend on how the rows are partitioned, but for the rounding of sums."""
    known, spell, tokens = _prepared(docs, size, id_col, text_col)
    return scored(tokens, fitted(tokens, len(known) + 2, hidden, rounds, rate, shard), id_col)
