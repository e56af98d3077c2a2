"""DuckDB SQL with the results of the registered queries, over views of the same names as the tables."""

from __future__ import annotations

_TOKEN = r"[\p{L}\p{N}_]{2,}"


def _counts(key: str = "lang", where: str = "true") -> str:
    return f"cnt as (select class, term, count(*) as n from (select {key} as class, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from documents where {where}) group by all)"


_IDF = """
tot as (select term, sum(n)::double as total from cnt group by term),
av as (select floor(sum(n) / count(distinct class)) as a from cnt),
idf as (select term, ln(a / total + 1) as idf from tot, av),
tf as (select class, term, n / sum(n) over (partition by class) as tf from cnt)"""
_SCORES = f"{_counts()}, {_IDF}, scores as (select class, term, tf * idf as score from tf join idf using (term))"


def _words(n: int) -> str:
    return f"{_SCORES}, words as (select class as topic, r::int as rank, term as word, s as score from (select *, round(score, 8) as s, row_number() over (partition by class order by round(score, 8) desc, term) as r from scores) where r <= {n})"


_TIMED = "timed as (select event_id as id, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::int as topic, ts from events)"
# Windows of 100 documents, every 50.
_TREND = f"""
{_TIMED},
num as (select *, row_number() over (order by ts, id) - 1 as rn, count(*) over () as total from timed),
mem as (select *, unnest(generate_series(greatest(0, ceil((rn - 99) / 50.0))::bigint, (rn // 50)::bigint)) as step from num),
inside as (select * from mem where step * 50 < total - 100),
mid as (select step, ts from inside where rn = step * 50 + 50),
top as (select topic from timed where topic >= 0 group by topic order by count(*) desc, topic limit 50),
per as (select step, topic, count(*) as n from inside where topic in (select topic from top) group by all),
trend as (select step::int as step, ts, topic, coalesce(case when sum(n) over (partition by step) > 0 then coalesce(n, 0) / sum(n) over (partition by step) end, 0.0) as proportion
  from mid cross join top left join per using (step, topic))"""
_PLACED = "placed as (select vec_id as doc_id, label as topic, embedding::double[] as e, ts, epoch(date_trunc('second', ts))::bigint as s from embeddings join events on vec_id = event_id)"
_BINS = f"""
{_PLACED},
edge as (select min(s) as lo, max(s) as hi from placed),
bins as (select *, case when hi > lo then least(4, floor((s - lo) / ((hi - lo) / 5)))::int else 0 end as bin from placed, edge),
flat as (select topic, bin, doc_id, unnest(e) as v, generate_subscripts(e, 1)::int - 1 as pos from bins),
size as (select topic, bin, count(*) as n from bins group by all),
cen as (select topic, bin, pos, avg(v) as v from flat join size using (topic, bin) where n >= 8 group by all)"""
_GRID = f"""
{_BINS},
have as (select distinct topic, bin from cen),
grid as (select topic, bin::int as bin, (select count(*) from have h where h.topic = t.topic) as k,
  (select max(bin) from have h where h.topic = t.topic and h.bin <= g.bin) as l, (select min(bin) from have h where h.topic = t.topic and h.bin >= g.bin) as r
  from (select distinct topic from placed) t, range(5) g(bin)),
dims as (select distinct pos from flat),
full_grid as (
  select g.topic, g.bin, p.pos, case when g.l = g.bin then a.v when k < 2 then 0.0 when l is null then b.v when r is null then a.v
    else (1 - (g.bin - l) / (r - l)) * a.v + (g.bin - l) / (r - l) * b.v end as v
  from grid g cross join dims p left join cen a on a.topic = g.topic and a.bin = g.l and a.pos = p.pos left join cen b on b.topic = g.topic and b.bin = g.r and b.pos = p.pos)"""
_DRIFT = f"""
{_GRID},
lens as (select topic, bin, sqrt(sum(v * v) + 1e-8) as l from full_grid group by all),
dots as (select a.topic, a.bin, sum(a.v * b.v) as p from full_grid a join full_grid b on a.topic = b.topic and b.bin = a.bin + 1 and a.pos = b.pos group by all),
drift as (select d.topic, d.bin, 1 - p / x.l / y.l as drift from dots d join lens x on x.topic = d.topic and x.bin = d.bin join lens y on y.topic = d.topic and y.bin = d.bin + 1),
stamp as (select g.bin::int as bin, make_timestamp(((lo + (g.bin + 0.5) * (hi - lo) / 5)::double).floor()::bigint * 1000000) as ts from edge, range(5) g(bin))"""
_WORDVEC = f"""
emb as (select vec_id, label, embedding::double[] as e from embeddings),
has as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as word from documents),
wflat as (select word, unnest(e) as v, generate_subscripts(e, 1) as pos from has join emb on doc_id = vec_id),
wv as (select word, pos, avg(v) as v from wflat group by all),
wl as (select word, sqrt(sum(v * v)) as l from wv group by word)"""
_CENTRES = """
cflat as (select label as topic, unnest(e) as v, generate_subscripts(e, 1) as pos from emb),
cv as (select topic, pos, avg(v) as v from cflat group by all),
cl as (select topic, sqrt(sum(v * v)) as l from cv group by topic)"""


def _outliers(threshold: float) -> str:
    return f"""with {_counts("lang", "doc_id % 7 <> 0")}, {_IDF}, scores as (select class as topic, term, tf * idf as score from tf join idf using (term)),
        dc as (select doc_id, term, count(*) as n from (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from documents where doc_id % 7 = 0) group by all),
        dn as (select doc_id, sqrt(sum(n * n)) as dn from dc group by doc_id), tn as (select topic, sqrt(sum(score * score)) as tn from scores group by topic),
        m as (select doc_id, topic, sum(n * score) / max(dn) / max(tn) as sim from dc join scores using (term) join dn using (doc_id) join tn using (topic) group by all),
        s as (select doc_id, topic, round(coalesce(sim, 0), 8) + 0.0 as sim from (select distinct doc_id from documents where doc_id % 7 = 0) cross join (select topic from tn) left join m using (doc_id, topic))
        select doc_id, case when sim >= {threshold} then topic else '-1' end as topic, sim from s qualify row_number() over (partition by doc_id order by sim desc, topic) = 1"""


def _near(n: int) -> str:
    return f"{_WORDVEC}, {_CENTRES}, sims as (select topic, word, round(sum(wv.v * cv.v) / max(wl.l) / max(cl.l), 6) + 0.0 as score from wv join cv using (pos) join wl using (word) join cl using (topic) group by all), near as (select topic, row_number() over (partition by topic order by score desc, word)::int as rank, word, score from sims qualify rank <= {n})"


_EV = "ev as (select vec_id as id, embedding::double[] as e, list_dot_product(embedding::double[], embedding::double[]) as q from embeddings)"
_DIST = f"{_EV}, dist as materialized (select a.id as a, b.id as b, sqrt(greatest(0, a.q + b.q - 2 * list_dot_product(a.e, b.e))) as d from ev a join ev b on a.id <> b.id)"
_CORE = f"{_DIST}, core as materialized (select a as id, d as core from (select a, d, row_number() over (partition by a order by d, b) as r from dist) where r = 5)"
_LDA = f"""
tok as (select doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from documents),
dfs as (select term, count(distinct doc_id) as df from tok group by term),
terms as (select term from dfs where df >= 2 and df <= 0.95 * (select count(*) from documents)),
cnt as materialized (select doc_id, term, count(*) as n from tok join terms using (term) group by all),
raw as (select term, k.k as topic, ('0x' || substr(md5(term), 1 + 4 * k.k, 4))::int + 1.0 as w from terms, (select unnest([0, 1, 2]) as k) k),
beta as materialized (select term, topic, w / sum(w) over (partition by topic) as b from raw),
ratio as (select doc_id, term, n / greatest(sum(1 / 3.0 * b), 1e-100) as r from cnt join beta using (term) group by doc_id, term, n),
part as (select doc_id, topic, 1 / 3.0 + 1 / 3.0 * sum(r * b) as t from ratio join beta using (term) group by doc_id, topic),
theta as materialized (select doc_id, topic, t / sum(t) over (partition by doc_id) as t from part)"""

ORACLE: dict[str, str] = {
    "class_term_counts": f"with {_counts()} select class, term, n from cnt",
    "doc_frequency_filter": f"with has as (select distinct doc_id, unnest(regexp_extract_all(lower(text), '{_TOKEN}')) as term from documents) select term, count(*) as df from has group by term having count(*) >= 2 and count(*) <= 0.95 * (select count(*) from documents)",
    "ctfidf_idf": f"with {_counts()}, {_IDF} select term, round(idf, 8) as idf from idf",
    "ctfidf_bm25": f"with {_counts()}, {_IDF} select class, term, round(tf * ln(1 + (a - total + 0.5) / (total + 0.5)), 8) + 0.0 as score from tf join tot using (term), av",
    "ctfidf_scores": f"with {_SCORES} select class, term, round(score, 8) as score from scores",
    "ctfidf_reduce_frequent": f"with {_counts()}, {_IDF} select class, term, round(sqrt(tf) * idf, 8) as score from tf join idf using (term)",
    "ctfidf_seed_multiplier": f"with {_SCORES} select class, term, round(score * case term when 'the' then 2.0 when 'la' then 3.0 when 'und' then 0.5 else 1.0 end::double, 8) as score from scores",
    "ctfidf_l2": f"with {_counts()}, {_IDF}, u as (select class, term, tf * ln((select sum(n) / count(distinct class) from cnt) / total + 1) as s from tf join tot using (term)) select class, term, round(s / sqrt(sum(s * s) over (partition by class)), 7) as score from u",
    "topic_top_words": f"with {_words(10)} select topic as class, rank, word as term, score from words",
    "bm25_scores": f"""with {_counts("doc_id")}, num as (select count(*) as d from documents),
        tot as (select term, greatest(sum(n)::double, 0.5) as df from cnt group by term), len as (select class, sum(n) as dl from cnt group by class),
        av as (select sum(n) / (select d from num) as avgdl from cnt)
        select class as doc_id, term, round(n * 2.5 / (n + 1.5 * (0.25 + 0.75 * dl / avgdl)) * ln((d - df + 0.5) / (df + 0.5) + 1), 6) + 0.0 as score from cnt join tot using (term) join len using (class), av, num""",
    "topic_sizes": f"with {_words(4)} select d.topic, d.n, w.words from (select lang as topic, count(*) as n from documents group by lang) d join (select topic, string_agg(word, ' | ' order by rank) as words from words group by topic) w using (topic)",
    "topics_over_time": f"with {_TIMED}, c as (select date_trunc('day', ts) as p, topic, count(*) as n from timed group by all) select strftime(p, '%Y-%m-%d') as period, topic, coalesce(n, 0) as n from (select distinct p from c) cross join (select distinct topic from c) left join c using (p, topic)",
    "topic_proportion_by_period": f"with {_TIMED}, c as (select date_trunc('day', ts) as p, topic, count(*) as n from timed group by all) select strftime(p, '%Y-%m-%d') as period, topic, round(coalesce(n, 0) * 100 / t, 6) as percent from (select p, sum(n) as t from c group by p) cross join (select distinct topic from c) left join c using (p, topic)",
    "temporal_heatmap": "select strftime(date_trunc('day', ts), '%Y-%m-%d') as period, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'error') as error, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'signup') as signup, count(*) filter (event_type = 'view') as view from events group by date_trunc('day', ts)",
    "topic_categories": f"""with {_words(10)}, t as (select topic, string_agg(word, ' ' order by word) as t from words group by topic), s as (select lang as topic, count(*) as n from documents group by lang),
        c as (select * from (values ('the', 'the', 'and'), ('de', 'de', 'que'), ('und', 'und', 'der')) v(category, x, y))
        select category, topic, n from c join t on contains(t, x) or contains(t, y) join s using (topic) qualify row_number() over (partition by category order by n desc, topic) <= 6""",
    "topic_similarity": f"with {_words(20)}, l as (select topic, sqrt(sum(score * score)) as l from words group by topic), p as (select a.topic as a, b.topic as b, sum(a.score * b.score) as p from words a join words b using (word) group by all) select x.topic as a, y.topic as b, round(coalesce(p, 0) / greatest(x.l * y.l, 1e-12), 6) as sim from l x cross join l y left join p on p.a = x.topic and p.b = y.topic",
    "topic_network_edges": f"with {_words(15)}, l as (select topic, sqrt(sum(score * score)) as l from words group by topic), p as (select a.topic as a, b.topic as b, sum(a.score * b.score) as p from words a join words b using (word) group by all) select a, b, round(p / greatest(x.l * y.l, 1e-12), 6) as sim from p join l x on x.topic = a join l y on y.topic = b where a < b and p / greatest(x.l * y.l, 1e-12) > 0.15",
    "word_cloud_sizes": f"with {_words(20)}, s as (select topic, word, score / greatest(max(score) over (partition by topic), 1e-12) as s from words) select topic, word, (14 + floor(s * 28))::int as size, round(0.4 + 0.6 * s, 6) as opacity, s > 0.5 as bold from s",
    "representative_docs": "with t as (select lang as topic from documents group by lang order by count(*) desc, lang limit 20), r as (select lang as topic, row_number() over (partition by lang order by length(text) desc, doc_id) as r, doc_id, text from documents where text is not null) select topic, r::int as rank, doc_id, text[1:200] as text from r join t using (topic) where r <= 5",
    "intertopic_map": "with t as (select label as topic, avg(embedding[1]::double) as x, avg(embedding[2]::double) as y, count(*) as n from embeddings where label >= 0 group by label order by n desc, topic limit 30) select topic, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y, n, round(20 + n * 60 / max(n) over (), 6) as bubble from t",
    "topic_centroids": "with f as (select label as topic, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1)::int - 1 as pos from embeddings) select topic, pos, round(avg(v), 6) + 0.0 as v from f group by all",
    "stabilize_vectors": "with p as (select vec_id as id, list_transform(embedding::double[], lambda x: x * 20) as e from embeddings), s as (select id, e, least(15 / sqrt(list_dot_product(e, e) + 1e-8), 1) as k from p), f as (select id, unnest(e) * k as v, generate_subscripts(e, 1)::int - 1 as pos from s) select id, pos, round(greatest(least(v, 20), -20), 6) + 0.0 as v from f",
    "reduce_outliers_embeddings": """with d as (select vec_id as doc_id, case when vec_id % 7 = 0 then -1 else label end as topic, embedding::double[] as e from embeddings),
        f as (select topic, unnest(e) as v, generate_subscripts(e, 1) as pos from d where topic >= 0), c as (select topic, list(v order by pos) as c from (select topic, pos, avg(v) as v from f group by all) group by topic),
        s as (select doc_id, c.topic, round(list_dot_product(e, c) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(c, c)), 6) + 0.0 as sim from d cross join c where d.topic = -1)
        select doc_id, (case when sim >= 0.1 then topic else -1 end)::int as topic, sim from s qualify row_number() over (partition by doc_id order by sim desc, topic) = 1""",
    "reduce_outliers_ctfidf": _outliers(0.05),
    "reduce_outliers_ctfidf_all": _outliers(0.0),
    "keybert_keywords": f"with {_near(10)} select topic, rank, word, score from near",
    "mmr_keywords": f"""with {_near(20)}, cand as materialized (select near.*, u.u from near join (select word, list(wv.v / wl.l order by pos) as u from wv join wl using (word) group by word) u using (word)),
        p1 as (select * from cand where rank = 1),
        v2 as (select c.*, round(0.7 * c.score - 0.3 * list_dot_product(c.u, p1.u), 6) as val from cand c join p1 using (topic) where c.rank > 1),
        p2 as (select * from v2 qualify row_number() over (partition by topic order by val desc, rank) = 1),
        v3 as (select c.*, round(0.7 * c.score - 0.3 * greatest(list_dot_product(c.u, p1.u), list_dot_product(c.u, p2.u)), 6) as val from cand c join p1 using (topic) join p2 using (topic) where c.rank > 1 and c.rank <> p2.rank),
        p3 as (select * from v3 qualify row_number() over (partition by topic order by val desc, rank) = 1)
        select topic, 1 as rank, word, score from p1 union all select topic, 2, word, score from p2 union all select topic, 3, word, score from p3""",
    "pairwise_distances": f"with {_DIST} select a, b, round(d, 6) as d from dist where a < b",
    "knn_graph": f"with {_DIST}, r as (select a as src, b as dst, round(d, 6) as dist from dist) select src, row_number() over (partition by src order by dist, dst)::int as rank, dst, dist from r qualify rank <= 5",
    "core_distances": f"with {_CORE} select id, round(core, 6) as core from core",
    "mutual_reachability": f"with {_CORE} select a, b, round(greatest(d, x.core, y.core), 6) as w from dist join core x on x.id = a join core y on y.id = b where a < b",
    "lda_e_step": f"with {_LDA} select doc_id, topic, round(t, 7) as share from theta",
    "lda_em_step": f"""with {_LDA}, again as (select doc_id, term, n / greatest(sum(t * b), 1e-100) as r from cnt join beta using (term) join theta using (doc_id, topic) group by doc_id, term, n),
        fresh as (select term, topic, sum(r * t) as s from again join theta using (doc_id) group by term, topic), new as (select term, topic, 0.01 + b * coalesce(s, 0) as w from beta left join fresh using (term, topic))
        select term, topic, round(w / sum(w) over (partition by topic), 10) as weight from new""",
    "lda_perplexity": f"with {_LDA}, p as (select doc_id, term, n, greatest(sum(t * b), 1e-100) as p from cnt join beta using (term) join theta using (doc_id, topic) group by doc_id, term, n) select round(exp(-sum(n * ln(p)) / sum(n)), 3) as perplexity from p",
    "dtm_raw_trends": f"with {_TREND} select step, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, topic, round(proportion, 8) as proportion from trend",
    "dtm_trends_wide": f"with {_TREND} select step, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, " + ", ".join(f"round(max(proportion) filter (topic = {i}), 8) as topic_{i}" for i in range(5)) + " from trend group by step, ts",
    "dtm_trends_long": f"with {_TREND} select step, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, 'topic_' || topic as topic, round(case when sum(proportion) over (partition by step) > 0 then proportion * 100 / sum(proportion) over (partition by step) else 0 end, 6) as percent from trend where topic < 3",
    "dtm_changepoints": f"with {_TREND}, m as (select step, abs(lead(proportion) over (partition by topic order by step) - proportion) as d from trend), c as (select step, sum(d) as change from m where d is not null group by step) select step, round(change, 8) as change from c where change > (select avg(change) + 1.5 * stddev_pop(change) from c)",
    "dtm_time_bins": f"with {_BINS} select doc_id, topic, bin from bins",
    "dtm_bin_centroids": f"with {_BINS} select topic, bin, pos, round(v, 6) + 0.0 as v from cen",
    "dtm_centroids_interpolated": f"with {_GRID} select topic, bin, pos, round(v, 6) + 0.0 as v from full_grid",
    "dtm_centroid_drift": f"with {_DRIFT} select topic, bin, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, round(drift, 6) + 0.0 as drift from drift join stamp using (bin)",
    "dtm_top_drifting": f"with {_DRIFT} select topic, round(sum(drift), 6) as total_drift from drift group by topic order by total_drift desc, topic limit 5",
    "dtm_drift_changepoints": f"with {_DRIFT} select topic, bin, round(drift, 6) + 0.0 as drift from drift qualify drift > avg(drift) over (partition by topic) + stddev_pop(drift) over (partition by topic)",
    "dtm_keywords_over_time": f"""with {_GRID.lstrip()}, {_WORDVEC}, gl as (select topic, bin, greatest(sqrt(sum(v * v)), 1e-9) as l from full_grid group by all),
        sims as (select topic, bin, word, round(sum(wv.v * g.v) / max(wl.l) / max(gl.l), 6) + 0.0 as score from wv join full_grid g on g.pos = wv.pos - 1 join wl using (word) join gl using (topic, bin) group by all)
        select topic, bin, row_number() over (partition by topic, bin order by score desc, word)::int as rank, word, score from sims qualify rank <= 3""",
    "cross_corpus_topic_match": """with f as (select vec_id % 2 as side, label as topic, unnest(embedding::double[]) as v, generate_subscripts(embedding, 1) as pos from embeddings where label >= 0),
        c as (select side, topic, list(v order by pos) as c from (select side, topic, pos, avg(v) as v from f group by all) group by all),
        s as (select a.topic, b.topic as match, round(list_dot_product(a.c, b.c) / sqrt(list_dot_product(a.c, a.c)) / sqrt(list_dot_product(b.c, b.c)), 6) + 0.0 as sim from c a join c b on a.side = 0 and b.side = 1)
        select topic, match, sim, case when sim > 0.85 then 'same' when sim >= 0.7 then 'related' else 'different' end as band from s qualify row_number() over (partition by topic order by sim desc, match) = 1""",
}
