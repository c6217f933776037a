"""Fusion with an entity route in ranges of documents equals the plain operators and shuffles no pairs."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from memloom.operators import blocks, fuseblocks, fusion
from memloom.plans import retrieval


def _shuffled(plan) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().get("shuffleRecordsWritten")
    below = plan.children()
    return (own.get().value() if own.isDefined() else 0) + sum(_shuffled(below.apply(i)) for i in range(below.size()))


def test_pairs_are_not_shuffled(spark, tmp_path):
    texts = [(i, f"Alice w{i} v{i % 7}", "s", "en", 9) for i in range(1000)]  # ten asking documents, each reaches all
    spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [1.0, float(i)], 0) for i in range(20)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = retrieval.QUERIES["rrf_routes"](spark, str(tmp_path))
    assert len(out.collect()) == 10_000
    assert _shuffled(out._jdf.queryExecution().executedPlan()) < 10_000


def test_fused_ranges_equal_the_plain_operators(spark, monkeypatch):
    monkeypatch.setattr(fuseblocks, "ROWS", 50)
    monkeypatch.setattr(fuseblocks, "ASKING", 9)
    pick = random.Random(5)
    docs = [i * i - 900 for i in range(400)]  # uneven ids, some below zero
    names = [f"n{i}" for i in range(12)]
    found = [(d, n) for d in docs if d % 5 for n in names if pick.random() < 0.9 / (1 + names.index(n))]
    asks = [(q, n) for q in range(30) for n in pick.sample([*names, "nowhere"], pick.randint(1, 6)) if q % 10]  # 0, 10, 20 name nothing
    ranked = lambda k: [(q, d, r + 1) for q in range(31) for r, d in enumerate(pick.sample(docs, k))]
    found, asks = spark.createDataFrame(found, "doc long, name string"), spark.createDataFrame(asks, "query long, name string")
    others = {n: spark.createDataFrame(ranked(k), "query long, doc long, rank int") for n, k in (("semantic", 15), ("lexical", 40))}
    got = fuseblocks.rrf(others, found, asks, spark.createDataFrame([(d,) for d in docs], "doc long")).collect()
    pairs = found.join(asks, "name").groupBy("query", "doc").agg(F.count("*").alias("matches"))
    entity = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("matches"), "doc")))
    want = fusion.rrf(others | {"entity": entity}).select("query", "doc", F.round("score", 8), F.array_join("signals", "+")).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, want)) and {r.signals for r in got} >= {"entity+lexical+semantic", "lexical+semantic", "entity"}
    alone = fuseblocks.rrf(others, found.where("false"), asks.where("false"), found.select("doc").distinct()).collect()
    want = fusion.rrf(others).select("query", "doc", F.round("score", 8), F.array_join("signals", "+")).collect()
    assert Counter(map(tuple, alone)) == Counter(map(tuple, want))


def test_rare_names_count_like_frequent_ones(monkeypatch):
    pick = np.random.default_rng(3)
    has, wants = pick.random((90, 300)) < 0.3, pick.random((4, 300)) < 0.95  # more than 255 names in a query

    def pieces(rows, kind):
        i, n = np.nonzero(rows)
        columns = [np.zeros(len(i), np.int32), i, np.zeros(len(i)), [f"n{x}" for x in n], np.ones(len(i))]
        said = pa.Table.from_batches(blocks._packer(kind, lambda b: [b])(iter([pa.record_batch(columns, names=["block", "id", "size", "term", "value"])])))
        return [{c: said[c][k].as_py() for c in blocks._PACKED_COLUMNS} | {"words": said["words"][k].values} for k in range(said.num_rows)]

    for held in (0, 20, 1000):
        monkeypatch.setattr(fuseblocks, "HELD", held)
        m = fuseblocks.Matches(pieces(has, 0), pieces(wants, 1))
        assert np.array_equal([m.of(q) for q in range(4)], (wants.astype(int) @ has.T.astype(int)))
        assert m.ids.tolist() == list(range(90))


def test_scores_round_as_columns_do(spark):
    score = F.lit(0.5) / (60 + F.col("id"))
    want = spark.range(1, 300_001).select("id", F.round(score, 8).alias("s")).toPandas()
    assert np.array_equal(fuseblocks.rounded(0.5 / (60 + want["id"].to_numpy())), want["s"].to_numpy())
