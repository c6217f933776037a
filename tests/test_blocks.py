"""Keyword search in blocks: the same as over all pairs, without a table of them."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memloom.operators import blocks, lexical
from memloom.plans import evidence, retrieval

WORDS = "apple banana cedar date elder fig grape hazel iris jade kale lime".split()


@pytest.fixture
def no_pairs(monkeypatch):
    """Queries may not build the table of all (query, document) pairs."""

    def fail(*args, **kwargs):
        raise AssertionError("scores of all pairs")

    monkeypatch.setattr(lexical, "bm25", fail)


def _texts(n):
    r = np.random.default_rng(1)
    return [(i, " ".join(r.choice(WORDS, r.integers(1, 30), p=np.arange(12, 0, -1) / 78)) if i % 7 else "apple fig") for i in range(n)]


def _write(spark, path, rows):
    rows = [(i, t, "s", "en", len(t)) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")


def test_search_equals_all_pairs(spark):
    docs = spark.createDataFrame(_texts(300), "id long, text string")
    post = lexical.postings(docs, "id", F.col("text"))
    terms = lexical.query_terms(docs.where("id % 20 = 0"), "id", F.col("text"))
    rows = lambda df: sorted((r.query, r.rank, r.doc, r.score) for r in df.collect())
    for flavour in ({}, {"k1": 1.2, "floor": 1e-6, "repeats": False}):
        want = rows(lexical.top_k(lexical.bm25(post, terms, **flavour), 9))
        got = rows(lexical.search(post, terms, 9, **flavour))
        assert [x[:3] for x in got] == [x[:3] for x in want] and [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-9)
    assert lexical.search(lexical.postings(docs.where("false"), "id", F.col("text")), terms, 3).count() == 0


@pytest.mark.parametrize("dense, at_once", [(1536, 512), (3, 5), (0, 64)])
def test_blocks_in_one_process(monkeypatch, dense, at_once):
    # copies, ties at the border, rare terms added one by one, several blocks of documents in a part
    monkeypatch.setattr(blocks, "DENSE", dense)
    monkeypatch.setattr(blocks, "AT_ONCE", at_once)
    r = np.random.default_rng(2)
    table = (r.random((90, 12)) < 0.3) * r.integers(1, 4, (90, 12))
    table[30:60] = table[:30]
    asks = (r.random((8, 12)) < 0.4) * r.random((8, 12))
    asks[5] = asks[2]

    def rows(m, per):
        i, t = np.nonzero(m)
        return pa.RecordBatch.from_pydict({"block": pa.array(i % per, pa.int32()), "id": i + 100, "size": np.zeros(len(i)), "term": [WORDS[x] for x in t], "value": m[i, t].astype(float)})

    packed = [*blocks._packer(1, lambda b: [0])([rows(asks, 1)]), *blocks._packer(0, lambda b: [0])([rows(table, 3)])]
    score = np.round(asks @ table.T, 9)
    got = pa.Table.from_batches(blocks._scorer(blocks.best(7), lambda v, _: v, True)(packed)).to_pandas()
    for q in range(8):
        want = [d for d in np.lexsort((np.arange(90), -score[q])) if score[q][d] > 0][:7]
        mine = got[got["query"] == q + 100].sort_values(["score", "doc"], ascending=[False, True])
        assert [x - 100 for x in mine["doc"]] == want and mine["score"].to_numpy() == pytest.approx(score[q][want])


def test_queries_make_no_table_of_pairs(spark, tmp_path, no_pairs):
    texts = _texts(250)
    _write(spark, tmp_path, texts)
    sets = {i: set(map(str, t.split())) for i, t in texts}
    run = lambda module, name: module.QUERIES[name](spark, str(tmp_path)).collect()
    for name in ("bm25_topk", "bm25_topk_all", "bm25_fts_topk", "budget_pack", "budget_pack_all", "coverage_pack"):
        assert {r.query for r in run(retrieval, name)} == {0, 100, 200}, name
    stems = {i: {x for x in s} for i, s in sets.items()}
    for name in ("bm25_sigmoid", "bm25_sigmoid_all"):
        got = run(retrieval, name)
        assert {q: sum(r.docs for r in got if r.query == q) for q in (0, 100, 200)} == {q: sum(bool(stems[q] & s) for s in stems.values()) for q in (0, 100, 200)}, name
    share = {q: [len(stems[q] & s) for i, s in stems.items() if i != q and len(stems[q] & s) * 3 > len(stems[q])] for q in (0, 100, 200)}
    assert {r.query: (r.partners, r.most_shared) for r in run(retrieval, "token_overlap_join")} == {q: (len(x), max(x)) for q, x in share.items()}
    for name in ("coverage_ratio", "coverage_ratio_all"):
        assert {r.query: r.coverage for r in run(evidence, name)} == {0: 1.0, 100: 1.0, 200: 1.0}, name


def test_additive_routes_search_only_for_near(spark, tmp_path, monkeypatch):
    _write(spark, tmp_path, [(0, "Ann apple"), (100, "Bob apple"), (1, "apple Ann"), (2, "bob fig")])
    vecs = [(0, [1.0, 0.0], 0), (1, [1.0, 0.1], 0)]  # 100 asks, but has no vector
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    asked = []
    inner = lexical.query_terms
    monkeypatch.setattr(lexical, "query_terms", lambda q, *a, **k: asked.append({r.doc_id for r in q.collect()}) or inner(q, *a, **k))
    assert {(r.query, r.doc) for r in retrieval.QUERIES["additive_routes"](spark, str(tmp_path)).collect()} == {(0, 0), (0, 1)} and asked == [{0}]
    names = spark.createDataFrame([("ann",), ("a",), ("",)], "name string")
    docs = spark.createDataFrame([(1, "joanna"), (2, "fig"), (3, None), (1, "joanna")], "doc long, text string")
    few = {(r.doc, r.name) for r in lexical.containing(docs, names).collect()}
    monkeypatch.setattr(lexical, "HELD", 0)
    assert few == {(r.doc, r.name) for r in lexical.containing(docs, names).collect()} == {(1, "ann"), (1, "a")}
