"""Substring dedup: lines and paragraphs are normalised, their digests grouped over the corpus, and all but the earliest occurrence removed.

Every line has a digest, of whatever length. Copied passages are often set into the middle of
other lines, where a digest of the whole line misses them, so a line is also split into units
that start like sentences. A paragraph is a unit with as many of the following ones as bring it
to MIN_WORDS words, and, at the end of each line, as many of the units before it as do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lists, small_batches

#: Words of a paragraph: pieces of lines that repeat in fewer words stay, since those repeat by chance and in set phrases.
MIN_WORDS = 25
#: Words of a line that has a digest of its own; 1 takes all.
MIN_LINE_WORDS = 1
_WORD, _UPPER, _SPACE, _STOP, _BREAK = 1, 2, 4, 8, 16


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Class bits and lower case of every character."""
    kinds = np.zeros(0x110000, np.uint8)
    lower = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind[0] in "LN":
            kinds[i] = _WORD | (_UPPER if kind in ("Lu", "Lt") else 0)
            low = c.lower()
            if len(low) == 1:
                lower[i] = ord(low)
        elif kind[0] == "Z" or c in "\t\r\f\v":
            kinds[i] = _SPACE
    kinds[ord("\n")] = _SPACE | _BREAK
    for c in ".!?":
        kinds[ord(c)] = _STOP
    return kinds, lower


def paragraphs(text: str, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Start, end and 16-byte digest of each line and paragraph, by start and end.

    A unit starts at the first word of the text, and at a word if the gap before
    it has a line break, or white space and either one of .!? or a capital
    letter after it. The end takes in what follows the last word up to the next
    word or line break.
    """
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    kinds, lower = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    k = kinds[codes]
    word = np.zeros(len(codes) + 2, np.int8)
    word[1:-1] = k & _WORD
    edge = np.diff(word)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return nothing
    breaks = np.flatnonzero(k & _BREAK)
    before = np.searchsorted(breaks, starts)
    fresh = np.diff(before, prepend=-1) > 0
    line = np.flatnonzero(fresh)
    line_to = np.append(line[1:], len(starts))
    # Only gaps with white space and a stop, or white space and a capital, are units' ends besides breaks.
    stops = np.concatenate([[0], np.cumsum((k & _STOP) > 0)])
    spaces = np.concatenate([[0], np.cumsum((k & _SPACE) > 0)])
    previous = np.concatenate([[0], ends[:-1]])
    spaced = spaces[starts] > spaces[previous]
    fresh |= spaced & ((stops[starts] > stops[previous]) | ((k[starts] & _UPPER) > 0))
    unit = np.flatnonzero(fresh)
    last = np.append(unit[1:], len(starts))
    to = np.searchsorted(last, unit + min_words)
    tail = np.searchsorted(unit, line_to - min_words, side="right") - 1
    long = line_to - line >= min_line_words
    first = np.concatenate([unit[to < len(last)], unit[tail[tail >= 0]], line[long]])
    to = np.concatenate([last[to[to < len(last)]], line_to[tail >= 0], line_to[long]])
    # A line may be its own paragraph; each range of words counts once.
    first, to = np.divmod(np.unique(first * (len(starts) + 1) + to), len(starts) + 1)
    keep = word[1:-1].astype(bool)
    inside = ends[ends < len(codes)]
    keep[inside] = True
    plain = lower[codes]
    plain[inside] = 32
    plain = np.append(plain[keep], np.uint32(32))
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)])
    view = memoryview(plain).cast("B")
    digest = xxhash.xxh3_128_digest
    digests = [digest(view[a:b]) for a, b in zip((offsets[first] * 4).tolist(), (offsets[to] * 4 - 4).tolist(), strict=True)]
    end = ends[to - 1]
    following = np.append(starts, len(codes))[to]
    stop = np.append(breaks, len(codes))[np.searchsorted(breaks, end)]
    return starts[first], np.minimum(following, stop), digests


def _units(docs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """(doc_id, key, start, end, hi, lo) of every line and paragraph; key tells texts with the same id apart."""
    small_batches(docs.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys = b.column(0).to_numpy(), b.column(1).to_numpy()
            counts, starts, ends, digests = [], [], [], []
            for text in b.column(2):
                s, e, d = paragraphs(text.as_py(), min_words, min_line_words)
                counts.append(len(d))
                starts.append(s)
                ends.append(e)
                digests += d
            if digests:
                both = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                cols = [np.repeat(ids, counts), np.repeat(keys, counts), np.concatenate(starts).astype(np.int32), np.concatenate(ends).astype(np.int32), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
                yield pa.record_batch([pa.array(c) for c in cols], ["doc_id", "key", "start", "end", "hi", "lo"])

    rows = docs.select("doc_id", "key", "text").dropna()
    return rows.mapInArrow(split, "doc_id long, key long, start int, end int, hi long, lo long")


def _spans(docs: DataFrame, min_words: int, min_line_words: int) -> DataFrame:
    """(doc_id, key, start, end): what is to be removed, as spans that don't overlap or touch."""
    units = _units(docs, min_words, min_line_words)
    # Grouping is partial before its shuffle and the join splits skewed keys, so a passage that all documents share is no hot spot.
    first = units.groupBy("hi", "lo").agg(F.min(F.struct("doc_id", "key", "start")).alias("f"), F.count("*").alias("n")).filter("n > 1").select("hi", "lo", "f")
    again = units.join(first, ["hi", "lo"]).filter(F.struct("doc_id", "key", "start") != F.col("f")).select("doc_id", "key", "start", "end")
    by_doc = Window.partitionBy("doc_id", "key").orderBy("start", "end")
    so_far = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    runs = again.withColumn("_new", F.when(F.col("start") <= so_far, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "key", "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """(doc_id, start, end): each line or passage that occurs earlier in the corpus, by characters of the original text.

    Earlier is by (doc_id, start); of different texts with one id, by a hash of
    the text; within a text a line that comes again is a later one. Lines of min_line_words
    words or more and passages of min_words or more count. Overlapping and touching spans are
    one. Null and empty texts, texts without words and rows with a null id have none and make
    none. Texts may be of any length, and an empty table has no rows. Ids are integers or cast to them.
    Rows repeated whole count as one row. Extra columns are not looked at.
    """
    return _spans(_keyed(docs, id_col, text_col), min_words, min_line_words).select("doc_id", "start", "end")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, which are sorted and don't overlap."""
    parts, at = [], 0
    for s, e in spans:
        parts.append(text[at:s])
        at = e
    parts.append(text[at:])
    return "".join(parts)


def drop_repeated(docs: DataFrame, min_words: int = MIN_WORDS, min_line_words: int = MIN_LINE_WORDS) -> DataFrame:
    """The documents without the lines and passages that occur earlier, in the columns of documents; n_chars is brought up to date where it is there.

    A document left without any letter or digit goes. Others stay, those with a
    null id or text as they are. Extra columns may have any name, even one twice.
    """
    names = docs.columns
    id_at, text_at = names.index("doc_id"), names.index("text")
    chars_at = names.index("n_chars") if "n_chars" in names else None
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    gone = _spans(_keyed(plain, f"c{id_at}", f"c{text_at}"), min_words, min_line_words).groupBy("doc_id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("s"))
    gone = gone.select(F.col("doc_id").alias("_i"), F.col("key").alias("_k"), F.col("s.start").alias("_s"), F.col("s.end").alias("_e"))
    # The spans are the small side: with them hashed, the texts are neither sorted nor spilled.
    joined = plain.join(gone.hint("shuffle_hash"), (F.col(f"c{id_at}").cast("long") == F.col("_i")) & (F.xxhash64(f"c{text_at}") == F.col("_k")), "left").drop("_i", "_k")
    joined = joined.withColumns({c: F.coalesce(c, F.expr("cast(array() as array<int>)")) for c in ("_s", "_e")})

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_columns - 2
            cols = [b.column(i) for i in range(n)]
            starts, offsets = lists(b.column(n))
            keep = np.ones(b.num_rows, bool)
            if len(starts):
                ends, _ = lists(b.column(n + 1))
                texts = cols[text_at].to_pylist()
                changed = np.flatnonzero(np.diff(offsets))
                for i in changed:
                    texts[i] = cut(texts[i], list(zip(starts[offsets[i] : offsets[i + 1]].tolist(), ends[offsets[i] : offsets[i + 1]].tolist(), strict=True)))
                    keep[i] = any(map(str.isalnum, texts[i]))
                cols[text_at] = pa.array(texts, cols[text_at].type)
                if chars_at is not None:
                    chars = cols[chars_at].to_pylist()
                    for i in changed:
                        chars[i] = len(texts[i])
                    cols[chars_at] = pa.array(chars, cols[chars_at].type)
            yield pa.record_batch(cols, b.schema.names[:n]).filter(pa.array(keep))

    return joined.mapInArrow(apply, plain.schema).toDF(*names)


#: DuckDB SQL for repeated_spans over documents.
ORACLE = f"""
with parts as (
  select doc_id, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') as p
  from (select distinct doc_id, text from documents where doc_id is not null and text is not null)
),
pieces as (select doc_id, unnest(p) as s, generate_subscripts(p, 1) as k from parts),
placed as (
  select *, sum(length(s)) over w - length(s) as pos, sum(length(s)) over w as till, lag(s) over w as gap, lead(s) over w as following,
    regexp_matches(s, '^[\\p{{L}}\\p{{N}}]') as is_word
  from pieces window w as (partition by doc_id order by k)
),
words as (
  select doc_id, s, pos, till, following, row_number() over (partition by doc_id order by k) - 1 as n,
    coalesce(contains(gap, chr(10)) or (regexp_matches(gap, '[\\s\\p{{Z}}]') and (regexp_matches(gap, '[.!?]') or regexp_matches(s, '^[\\p{{Lu}}\\p{{Lt}}]'))), false) as fresh,
    coalesce(contains(gap, chr(10)), false) as broken
  from placed where is_word
),
lens as (select doc_id, count(*) as total from words group by doc_id),
bounded as (select doc_id, n, pos as start, coalesce(lead(n) over (partition by doc_id order by n), total) as stop from words join lens using (doc_id) where n = 0 or fresh),
lined as (select doc_id, n, pos as start, coalesce(lead(n) over (partition by doc_id order by n), total) as stop from words join lens using (doc_id) where n = 0 or broken),
wide as (
  select a.doc_id, a.n, a.start, b.stop from (select *, n + {MIN_WORDS} as least from bounded) a asof join bounded b on a.doc_id = b.doc_id and a.least <= b.stop
),
tails as (
  select l.doc_id, b.n, b.start, l.stop from (select *, stop - {MIN_WORDS} as most from lined) l asof join bounded b on l.doc_id = b.doc_id and l.most >= b.n
),
ranges as (from wide union select doc_id, n, start, stop from lined where stop - n >= {MIN_LINE_WORDS} union from tails),
strings as (select doc_id, list(lower(s) order by n) as ws from words group by doc_id),
paragraphs as (
  select p.doc_id, p.start, l.till + coalesce(length(regexp_extract(l.following, '^[^\\n]*')), 0) as stop, array_to_string(t.ws[p.n + 1 : p.stop], ' ') as norm
  from ranges p join words l on l.doc_id = p.doc_id and l.n = p.stop - 1 join strings t on t.doc_id = p.doc_id
),
ranked as (select doc_id, start, stop, row_number() over (partition by norm order by doc_id, start) as r from paragraphs),
again as (select doc_id, start, stop from ranked where r > 1),
flagged as (select *, case when start <= max(stop) over (partition by doc_id order by start, stop rows between unbounded preceding and 1 preceding) then 0 else 1 end as f from again),
runs as (select *, sum(f) over (partition by doc_id order by start, stop rows between unbounded preceding and current row) as run from flagged)
select doc_id, min(start)::int as start, max(stop)::int as "end" from runs group by doc_id, run
"""
