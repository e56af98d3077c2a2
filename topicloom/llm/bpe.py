"""Byte-level BPE: longest-match backtracking over an Aho-Corasick automaton, with the same ids as the merge rules give."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import list_array, small_batches

#: Default vocabulary file: one token in base64 and its rank a line.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Splits a text before merging; no merge crosses a piece.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pieces of a text of ASCII characters only, in the faster standard expressions.
ASCII_PIECES = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
#: Pieces whose ids a worker remembers; beyond it the later half is forgotten, since frequent pieces are met first. It bounds memory, never results.
REMEMBERED = 500_000


class Codec:
    """Encodes and decodes with a table of ranks, in which a token's id is its rank.

    Bytes are mapped to the characters of Latin-1, since the automaton takes text.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str = PIECES):
        self.ranks = ranks
        self.bytes = {i: t for t, i in ranks.items()}
        self.piece = regex.compile(pattern)
        self.plain = re.compile(ASCII_PIECES) if pattern == PIECES else None
        self.text = {t.decode("latin-1"): i for t, i in ranks.items()}
        a = ahocorasick.Automaton()
        for t, i in self.text.items():
            a.add_word(t, i)
        a.make_automaton()
        self.automaton = a
        self.window = max(map(len, ranks))
        self.ids = max(ranks.values()) + 1
        self.split = self._splits()
        self.size, self.shorter = [0] * self.ids, [-1] * self.ids
        self.longest = self._longest()
        self.fits: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _splits(self) -> dict[int, tuple[int, int]]:
        """The two tokens whose merge makes each token: the last merge when it is encoded by the rules."""
        out = {}
        for t, i in self.ranks.items():
            if len(t) < 2:
                continue
            parts = [t[k : k + 1] for k in range(len(t))]
            while len(parts) > 2:
                best, at = None, -1
                for k in range(len(parts) - 1):
                    r = self.ranks.get(parts[k] + parts[k + 1])
                    if r is not None and r < i and (best is None or r < best):
                        best, at = r, k
                if best is None:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            if len(parts) == 2:
                out[i] = (self.ranks[parts[0]], self.ranks[parts[1]])
        return out

    def _longest(self) -> dict[str, int]:
        """The longest token that each beginning of a token starts with; lengths of the tokens, and the next shorter token of each, -1 for none, are filled in."""
        out: dict[str, int] = {}
        for t, i in sorted(self.text.items()):
            self.size[i] = len(t)
            token = -1
            for k in range(1, len(t) + 1):
                head = t[:k]
                if k == len(t):
                    self.shorter[i] = token
                token = self.text.get(head, token)
                if token != -1:
                    out[head] = token
        return out

    def compatible(self, left: int, right: int) -> bool:
        """Whether the merge rules leave these two tokens side by side; remembered."""
        key = left * self.ids + right
        known = self.fits.get(key)
        if known is None:
            known = self.fits[key] = self._compatible(left, right)
        return known

    def _compatible(self, left: int, right: int) -> bool:
        limit = 1 << 62
        a, b = left, right
        while True:
            made = self.ranks.get(self.bytes[a] + self.bytes[b])
            if made is not None and made < limit and self.split.get(made) == (a, b):
                return False
            if a > b:
                limit = a
                if a not in self.split:
                    limit = b + 1
                    if b not in self.split:
                        return True
                    b = self.split[b][0]
                    continue
                a = self.split[a][1]
                if a == limit:
                    return True
            else:
                limit = b + 1
                if b not in self.split:
                    limit = a
                    if a not in self.split:
                        return True
                    a = self.split[a][1]
                    continue
                b = self.split[b][0]
                if b + 1 == limit:
                    return True

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        n, window, prefix, longest, size, shorter, fits, ids = len(text), self.window, self.automaton.longest_prefix, self.longest, self.size, self.shorter, self.fits, self.ids
        dead = bytearray(n + 1)
        out: list[int] = []
        at, last = 0, -1
        token = longest[text[: prefix(text[:window])]]
        while True:
            # Tokens from the longest on that start here; none of one byte is missing, so one is there at every place.
            while token != -1:
                end = at + size[token]
                if not dead[end]:
                    if last == -1:
                        break
                    fit = fits.get(last * ids + token)
                    if fit or (fit is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token != -1:
                out.append(token)
                if end == n:
                    return out
                at, last = end, token
                rest = text[at : at + window]
                token = longest[rest[: prefix(rest)]]
            else:
                # No token fits here: this place can't be reached, so step back.
                dead[at] = 1
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                token = shorter[token]

    def array(self, text: str) -> np.ndarray:
        """The ids of a text's tokens."""
        pieces = (self.plain if self.plain is not None and text.isascii() else self.piece).findall(text)
        known = self.known
        parts = list(map(known.get, pieces))
        at = -1
        while True:
            try:
                at = parts.index(None, at + 1)
            except ValueError:
                break
            p = pieces[at]
            # The piece may have been met since, further up in this text.
            ids = known.get(p)
            if ids is None:
                if len(known) >= REMEMBERED:
                    known = self.known = dict(islice(known.items(), REMEMBERED // 2))
                ids = np.array(self.encode_piece(p.encode()), np.int32).tobytes()
                if len(p) <= 64:
                    known[p] = ids
            parts[at] = ids
        return np.frombuffer(b"".join(parts), np.int32)

    def encode(self, text: str) -> list[int]:
        return self.array(text).tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def load_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str = RANKS, pattern: str = PIECES) -> Codec:
    """One for each vocabulary in a process. The file must be at this path on every worker."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = RANKS, pattern: str = PIECES) -> DataFrame:
    """(doc_id, n_tokens, token_ids, roundtrip) of every row; roundtrip tells whether decoding the ids gives the text's bytes again.

    A null text has null in the three columns, an empty one an empty list. Rows
    with a null id and repeated rows are encoded as any others.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            counts, flat, same = np.zeros(b.num_rows, np.int32), [], np.ones(b.num_rows, bool)
            for k, x in enumerate(b.column(1)):
                text = x.as_py()
                if text:
                    ids = c.array(text)
                    same[k] = c.decode(ids.tolist()) == text.encode()
                    counts[k] = len(ids)
                    flat.append(ids)
            values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
            null = b.column(1).is_null()
            offsets = np.concatenate([[0], np.cumsum(counts)])
            lists = list_array(values, offsets)
            if null.true_count:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values), mask=null)
            gone = null.to_numpy(zero_copy_only=False)
            yield pa.record_batch([b.column(0), pa.array(counts, mask=gone), lists, pa.array(same, mask=gone)], [id_col, "n_tokens", "token_ids", "roundtrip"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encoded, f"`{id_col}` {id_type}, n_tokens int, token_ids array<int>, roundtrip boolean")


def texts(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "token_ids", path: str = RANKS) -> DataFrame:
    """(doc_id, text): the decoded texts; null for null, and bytes that aren't UTF-8 become U+FFFD. An unknown id is an error."""
    small_batches(encoded.sparkSession)
    id_type = encoded.schema[id_col].dataType.simpleString()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [None if x is None else c.decode(x).decode("utf-8", "replace") for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(out, pa.string())], [id_col, "text"])

    return encoded.select(id_col, ids_col).mapInArrow(decoded, f"`{id_col}` {id_type}, text string")
