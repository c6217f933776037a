"""Queries do the whole job: brute force on small tables."""

import math
from collections import defaultdict

import duckdb
import pytest

from memloom.plans import registry, retrieval


def test_two_hops_of_every_asking_order(spark, tmp_path):
    # orders 0 and 100 ask; 7 is two parts away from 100
    rows = [(0, 1), (100, 1), (100, 2), (5, 2), (5, 3), (7, 3), (300, 9)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    parts, orders = defaultdict(set), defaultdict(set)
    for o, p in rows:
        parts[o].add(p)
        orders[p].add(o)
    want = {}
    for q in (o for o in parts if o % 100 == 0):
        near = {o for p in parts[q] for o in orders[p]}
        far = {o for n in near for p in parts[n] for o in orders[p]} - near
        want |= {(q, dep): len(x) for dep, x in enumerate((near, far)) if x}
    out = retrieval.QUERIES["two_hop_expansion_all"](spark, str(tmp_path))
    assert {(r.query, r.depth): r.docs for r in out.collect()} == want and {q for q, _ in want} == {0, 100, 300}


def test_fusion_of_real_routes(spark, tmp_path):
    # 7 has no factor of 2 or 3; 9 has no vector; every text is at most three words
    texts = {100: "Alice apple", 7: "apple cedar", 8: "malice plum", 9: "apple Alice", 11: "plum fig"}
    vecs = {100: [1.0, 0.0], 7: [1.0, 1.0], 8: [0.5, 1.0], 11: [-1.0, 0.0], 555: [1.0, 0.0]}
    spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, v, 0) for i, v in vecs.items()], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    toks = {i: t.lower().split() for i, t in texts.items()}
    idf = lambda w: max(math.log((5 - (n := sum(w in t for t in toks.values())) + 0.5) / (n + 0.5)), 1e-6)
    bm = {i: sum(idf(w) * 2.2 / (1 + 1.2) for w in toks[100] if w in t) for i, t in toks.items()}
    key = {i: 1 / (1 + math.exp(-0.7 * (s - 5))) for i, s in bm.items() if s > 0}
    boost = 0.5 / (1 + 0.001 * 2**2)  # "alice" is in 100, 8 (inside a word) and 9
    sem = {100: 1.0, 7: 1 / math.sqrt(2), 8: 0.5 / math.sqrt(1.25)}
    got = {r.doc: r.score for r in retrieval.QUERIES["additive_routes"](spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(min(1, (s + key.get(i, 0) + boost * (i in (100, 8, 9))) / 2.5), abs=1e-5) for i, s in sem.items()}
    got = {r.doc: r.signals for r in retrieval.QUERIES["rrf_routes"](spark, str(tmp_path)).collect()}
    assert got == {100: "entity+lexical+semantic", 7: "lexical+semantic", 8: "entity+semantic", 9: "entity+lexical"}


def test_later_terms_of_a_query_count(spark, tmp_path):
    # the 65th to 80th word of the query are the only ones that 7 has
    texts = {100: " ".join(f"w{i}" for i in range(80)), 7: " ".join(f"w{i}" for i in range(64, 80)), 8: "other"}
    spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda n: registry.QUERIES[n](spark, str(tmp_path)).collect()
    for name in ("bm25_topk_all", "budget_pack_all", "coverage_pack"):
        assert {r.doc for r in run(name)} == {100, 7}, name
    assert sum(r.docs for r in run("bm25_sigmoid_all")) == 2 and {r.doc for r in run("bm25_fts_topk")} == {100}
    assert [r.coverage for r in run("coverage_ratio_all")] == [1.0]


def test_every_fact_meets_every_entity(spark, tmp_path):
    rows = [("a", "Ann likes Oslo", ["Ann"]), ("b", "Joanna saw ann in Li", ["Oslo", ""]), ("b", "no name", ["LI"]), ("c", None, ["Bo"]), ("d", "oslo", None)]
    spark.createDataFrame(rows, "id string, content string, entities array<string>").write.parquet(f"{tmp_path}/facts.parquet")
    names = {e.lower() for *_, es in rows for e in es or [] if e}
    want = {n: len({i for i, t, _ in rows if t and n in t.lower()}) for n in names}
    out = retrieval.QUERIES["entity_contains_all"](spark, str(tmp_path))
    assert {r.entity: r.facts for r in out.collect()} == {n: k for n, k in want.items() if k} == {"ann": 2, "oslo": 2, "li": 2}


def test_history_has_every_change(spark, tmp_path):
    rows = [(i, " M1" if i % 2 else "m1") for i in range(7)] + [(9, "m0")]
    spark.createDataFrame(rows, "id long, memory_id string").write.parquet(f"{tmp_path}/memory_history.parquet")
    out = [(r.memory, r.id) for r in registry.QUERIES["history_rows"](spark, str(tmp_path)).collect()]
    assert out == [("m0", 9)] + [("m1", i) for i in range(6, -1, -1)]


def test_routes_use_the_whole_text(spark, tmp_path):
    # 7 and 9 share only terms and a name from beyond the 64th term of the query
    texts = {100: " ".join(f"w{i}" for i in range(80)) + " Alice", 7: " ".join(f"w{i}" for i in range(64, 80)), 8: "other", 9: "w79 malice", 10: "plum"}
    spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in texts.items()], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.doc: (r.score, r.signals) for r in retrieval.QUERIES["rrf_routes"](spark, str(tmp_path)).collect()}
    assert {i: s for i, (_, s) in got.items()} == {100: "entity+lexical+semantic", 7: "lexical", 9: "entity+lexical"}
    duck = duckdb.connect()
    for name in ("documents", "embeddings"):
        duck.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    want = {doc: (pytest.approx(score, abs=1e-7), signals) for _, doc, score, signals in duck.execute(registry.ORACLES["rrf_routes"]).fetchall()}
    assert got == want
