"""The pipeline against slow versions of its stages, and the queries against their SQL."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from test_dedup import brute_spans, connected, shingles
from test_text import brute, library
from topicloom.llm import decontaminate, lines, minhash, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


def slow_pipeline(spark):
    """Each stage by comparing everything with everything, on the driver."""
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(docs, labels)
    weights = dict(zip(model.index.tolist(), model.weight.tolist(), strict=True))
    texts = {}
    for r in docs.select("doc_id", "text", toxicity._hashes(docs.text).alias("h")).collect():
        h = np.array(r.h, np.int64)
        _, f = toxicity.features(h, np.array([0, len(h)]))
        p = 1 / (1 + np.exp(-(sum(weights.get(j, 0.0) for j in set(f.tolist())) + model.bias)))
        if not len(h) or p < 0.5:
            texts[r.doc_id] = r.text
    groups = connected({i: shingles(t) for i, t in texts.items()}, minhash.THRESHOLD)
    texts = {i: t for i, t in texts.items() if groups.get(i, i) == i}
    gone = brute_spans(list(texts.items()), lines.MIN_WORDS)
    cut = {i: lines.cut(t, sorted((s, e) for j, s, e in gone if j == i)) for i, t in texts.items()}
    cut = {i: t for i, t in cut.items() if t == texts[i] or any(map(str.isalnum, t))}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    clean = {i: t for i, t in cut.items() if not brute(t, items, decontaminate.WINDOW)}
    enc = library()
    return {i: enc.encode_ordinary(t) for i, t in clean.items()}


def test_as_the_slow_version(spark):
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, FOLDER).collect()}
    want = slow_pipeline(spark)
    # The near-copy search is approximate; nothing else is.
    assert len(set(got) ^ set(want)) <= 0.02 * len(want)
    assert sum(got[i] != want[i] for i in set(got) & set(want)) <= 0.02 * len(want)


def test_odd_rows_pass_every_stage(spark):
    rows = [(None, "some text here", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, "Plain words stay.", "en", "s", 17), (3, "Plain words stay.", "en", "s", 17), (4, "long " * 60_000, "en", "s", 1)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = spark.createDataFrame(given, kinds)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, FOLDER)
            if name != "bpe":
                assert docs.columns == columns
        assert sorted((r.doc_id for r in docs.collect()), key=str) == sorted((r[0] for r in given), key=str)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, FOLDER).toArrow(), c.sql(queries.ORACLE[name]).to_arrow_table()
    names = sorted(got.column_names)
    assert names == sorted(want.column_names)
    a, b = (sorted(zip(*[t.column(k).to_pylist() for k in names], strict=True), key=repr) for t in (got, want))
    assert a == b


def test_ten_queries_and_their_stages(spark):
    assert {q[2:].split("_")[0] for q in queries.QUERIES if q.startswith("op")} == {str(k) for k in range(1, 11)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
