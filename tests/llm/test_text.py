"""Decontamination, BPE, chat and archives against brute force, libraries and round trips."""

import gzip
import io
import re

import numpy as np
import pytest

from topicloom.llm import bpe, chat, decontaminate, warc


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(text, items, window):
    """Word runs compared one by one."""
    words = [m[0].lower() for m in re.finditer(r"[^\W_]+", text)]
    places = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text)]
    out = set()
    for i, item in items:
        w = re.findall(r"[^\W_]+", item.lower())
        n = min(window, len(w))
        runs = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
        hits = [k for k in range(len(words) - n + 1) if n and tuple(words[k : k + n]) in runs]
        merged = []
        for k in hits:
            if merged and k <= merged[-1][1] + 1:
                merged[-1][1] = k + n - 1
            else:
                merged.append([k, k + n - 1])
        out |= {(i, places[a][0], places[b][1]) for a, b in merged}
    return out


def test_contamination_as_by_comparing_all(spark):
    rng = np.random.default_rng(1)
    word = lambda n: [f"q{k}" for k in rng.integers(0, 40, n)]
    items = [(k, " ".join(word(int(rng.integers(3, 40))))) for k in range(25)]
    rows = []
    for i in range(60):
        w = word(80)
        if i % 3 == 0:
            w[20:20] = items[i % 25][1].upper().replace(" ", ", ").split()
        rows.append((i, " ".join(w)))
    got = set(map(tuple, decontaminate.contamination(docs_of(spark, rows), items_of(spark, items)).collect()))
    assert got == {(i, *x) for i, t in rows for x in brute(t, items, decontaminate.WINDOW)} and got
    hit = {i for i, *_ in got}
    docs = docs_of(spark, rows).selectExpr("*", "text as item_id", "'x' as text2")
    kept = decontaminate.drop_contaminated(docs, items_of(spark, items))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - hit and kept.columns == docs.columns


def test_contamination_at_the_edges(spark):
    items = [(1, "one two three"), (2, "One, TWO three!"), (3, None), (None, "four"), (4, ""), (5, "--"), (6, "straße İstanbul")]
    rows = [(1, "x one two  three y"), (2, None), (3, ""), (None, "one two three"), (4, "one twofold three"), (5, "zu STRAßE istanbul STRASSE"), (6, "İİ a İstanbul Straße İSTANBUL"), (7, "word " * 100_000 + "one two three"), (1, "x one two  three y")]
    got = sorted(map(tuple, decontaminate.contamination(docs_of(spark, rows), items_of(spark, items)).collect()))
    assert got.count((1, 1, 2, 16)) == 2 and got.count((1, 2, 2, 16)) == 2
    assert {i for i, *_ in got} == {1, 6, 7}
    s, e = next((s, e) for i, k, s, e in got if i == 6)
    assert rows[6][1][s:e] == "Straße İSTANBUL"
    kept = decontaminate.drop_contaminated(docs_of(spark, rows), items_of(spark, items))
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [2, 3, 4, 5]
    assert decontaminate.contamination(docs_of(spark, rows), items_of(spark, [])).count() == 0
    assert decontaminate.drop_contaminated(docs_of(spark, rows), items_of(spark, [])).count() == len(rows)
    assert decontaminate.contamination(docs_of(spark, []), items_of(spark, items)).count() == 0


def library(path=bpe.RANKS):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=bpe.load_ranks(path), special_tokens={})


@pytest.mark.parametrize("path", [bpe.RANKS, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"])
def test_ids_are_those_of_the_merge_rules(path):
    c, enc, rng = bpe.codec(path), library(path), np.random.default_rng(2)
    letters = list("abcdehinorst éß中🙂\n\t .,’0123\u0000ÿ")
    texts = ["".join(rng.choice(letters, int(rng.integers(1, 80)))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 2000, " " * 500, "the quick brown fox's 12345 don't", "<|endoftext|>"]
    for t in texts:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_ids_stay_when_the_memory_is_cut(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    c, enc, rng = bpe.Codec(bpe.load_ranks()), library(), np.random.default_rng(9)
    for _ in range(60):
        t = " ".join("".join(rng.choice(list("abcdeinorst"), int(rng.integers(1, 12)))) for _ in range(40)) + "\t\r\n \x1c x 12ab_!? é"
        assert c.encode(t) == enc.encode_ordinary(t) and c.encode(t[:-2]) == enc.encode_ordinary(t[:-2])
    assert len(c.known) <= 50


def test_long_tokens_alone_and_next_to_each_other():
    c, enc = bpe.codec(), library()
    long = [t.decode() for t in c.ranks if len(t) > 32 and t.decode(errors="replace").encode() == t]
    for t in long:
        for u in ("", *long):
            assert c.encode(t + u) == enc.encode_ordinary(t + u)


@pytest.mark.parametrize("path", [bpe.RANKS, "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"])
def test_runs_longer_than_64_bytes_have_the_ids_of_the_merge_rules(path):
    c, enc = bpe.codec(path), library(path)
    for unit in ("-", "=", "ÃÂ"):
        for n in range(30, 301):
            for t in (unit * n, " " + unit * n):
                ids = c.encode(t)
                assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode()


def test_tokens_at_the_edges(spark):
    long = "Some words, and 123 more. " * 20_000
    rows = [(1, None), (2, ""), (3, "Hello world"), (None, "x"), (3, "Hello world"), (4, long), (5, "\u0000🙂")]
    got = bpe.tokens(docs_of(spark, rows))
    by = {(r.doc_id, r.n_tokens): r for r in got.collect()}
    assert by[1, None].token_ids is None and by[1, None].roundtrip is None and by[2, 0].token_ids == []
    assert by[3, 2].token_ids == library().encode_ordinary("Hello world") and got.count() == 7
    assert all(r.roundtrip for r in by.values() if r.n_tokens is not None)
    back = bpe.texts(got)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
    assert bpe.tokens(docs_of(spark, [])).count() == 0


def turn_frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_masks_by_characters(spark):
    rng = np.random.default_rng(3)
    texts = ["Hello", "Wie geht’s? 🙂🙂", "", "a <|im_end|> b", "中文 text", " lead", "trail \n"]
    rows = [(c, k, ["system", "user", "assistant"][int(rng.integers(0, 3))], texts[int(rng.integers(0, len(texts)))]) for c in range(20) for k in range(int(rng.integers(1, 7)))]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for r in chat.training_rows(turn_frame(spark, rows)).collect():
        turns = [(role, text) for c, _, role, text in rows if c == r.conv_id]
        whole, learnt = "", []
        for role, text in turns:
            whole += f"<|im_start|>{role}\n"
            learnt += [False] * (len(whole) - len(learnt))
            whole += text + "<|im_end|>\n"
            learnt += [role == "assistant"] * (len(whole) - len(learnt))
        e = t.encode(whole, add_special_tokens=False)
        assert r.token_ids == e.ids and r.n_turns == len(turns) and r.n_tokens == len(e.ids)
        assert r.loss_mask == [int(any(learnt[a:b])) for a, b in e.offsets] and r.n_learnt == sum(r.loss_mask)


def test_turns_at_the_edges(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "hi"), (1, None, "user", "x"), (None, 0, "user", "lost"), (2, 0, "assistant", "word " * 50_000), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    got = {r.conv_id: r for r in chat.training_rows(turn_frame(spark, rows)).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_turns == 3 and got[3].n_turns == 2 and got[2].n_tokens > 50_000
    assert 0 < got[1].n_learnt < got[1].n_tokens
    assert chat.training_rows(turn_frame(spark, [])).count() == 0


def test_mask_by_hand():
    offsets = np.array([[0, 2], [2, 5], [5, 5], [5, 8], [8, 9]])
    assert chat.mask(offsets, np.array([[4, 6], [8, 9]])).tolist() == [0, 1, 0, 1, 1]
    assert chat.mask(offsets, np.zeros((0, 2), int)).tolist() == [0] * 5


PAGES = "page_id long, url string, html string"


def page_rows():
    return [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2 x\n", "<p>é🙂\r\n\r\nWARC/1.1</p>"), (3, None, "<p>one</p>"), (None, "http://a/4", ""), (5, "http://a/5", None), (6, "http://a/6", "x" * 3_000_000), (1, "http://a/1", "<p>one</p>")]


def test_pages_come_back(spark):
    df = spark.createDataFrame(page_rows(), PAGES)
    found = warc.index(warc.archive(df))
    assert found.count() == 6
    back = warc.fetch(found).collect()
    want = sorted(((i, u.replace(" ", "%20").replace("\n", "%0A") if u else u, h) for i, u, h in page_rows() if h is not None), key=str)
    assert sorted(((r.page_id, r.url, r.html) for r in back), key=str) == want
    one = warc.distinct_pages(df.selectExpr("*", "'x' as path", "1 as offset", "2 as digest")).collect()
    assert sorted((r.page_id for r in one), key=str) == [1, 2, 6, None]
    empty = spark.createDataFrame([], PAGES)
    assert warc.distinct_pages(empty).count() == 0


def test_selected_records_are_read_in_few_pieces(spark, monkeypatch):
    rows = [(k, f"http://a/{k}", f"<p>{k}</p>" * 50) for k in range(200)]
    found = warc.index(warc.archive(spark.createDataFrame(rows, PAGES).coalesce(1)))
    some = found.filter("page_id % 3 = 0")
    for gap, piece in ((0, 1), (0, 1 << 20), (1 << 20, 1 << 20)):
        got = {r.page_id: r.html for r in warc.fetch(some, gap, piece).collect()}
        assert got == {k: h for k, _, h in rows if k % 3 == 0}


def test_members_of_any_block_size():
    parts = [warc.record(k, f"http://x/{k}", bytes([65 + k]) * (k * 700)) for k in range(6)]
    data = b"".join(parts)
    for block in (1, 7, 100, 1 << 20):
        got = list(warc.members(io.BytesIO(data), block))
        assert [data[a : a + n] for a, n, _ in got] == parts
        assert [warc.parse(p)[1] for _, _, p in got] == [bytes([65 + k]) * (k * 700) for k in range(6)]
    plain = b"".join(gzip.decompress(p) for p in parts)
    for block in (50, 1 << 20):
        assert [plain[a : a + n] for a, n, _ in warc.members(io.BytesIO(plain), block)] == [gzip.decompress(p) for p in parts]
    assert len(list(warc.members(io.BytesIO(data[:-3])))) == 5
