import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import mixing, packing, tokens


def test_differencing_balances():
    r = np.random.default_rng(0)
    for n, k in ((1, 3), (50, 4), (400, 16)):
        sizes = np.sort(r.integers(1, 500, n))[::-1]
        sums = np.bincount(packing.differencing(sizes, k), weights=sizes, minlength=k)
        assert sums.sum() == sizes.sum()
        if n > 8 * k:
            assert sums.max() - sums.min() <= 0.002 * sums.mean()
    assert packing.differencing(np.zeros(0, np.int64), 3).size == 0


def test_windows_hold_and_are_full():
    r = np.random.default_rng(1)
    # equal sums leave space where most items are near half the capacity, else little
    for capacity, high, over in ((512, 60, 1.01), (512, 120, 1.04), (2048, 400, 1.02), (512, 400, 1.35), (512, 512, 1.06)):
        sizes = np.sort(r.integers(0, high + 1, 600))[::-1]
        w = packing.windows(sizes, capacity)
        sums = np.bincount(w, weights=sizes)
        assert sums.max() <= capacity and len(w) == 600
        least = max(-(-sizes.sum() // capacity), (2 * sizes > capacity).sum())
        assert len(sums) <= least * over + 1
        # the count rose no further than needed: one window less overflows
        if len(sums) > least:
            assert np.bincount(packing.differencing(sizes, len(sums) - 1), weights=sizes).max() > capacity
    assert packing.windows(np.zeros(0, np.int64), 5).size == 0
    assert packing.windows(np.zeros(4, np.int64), 5).tolist() == [0, 0, 0, 0]


def test_every_text_is_packed_once(spark, monkeypatch):
    r = random.Random(5)
    rows = [(i, r.choice([0, 3, 40, 99, 100, 101, 250, 1000])) for i in range(700)] + [(900, None), (None, 7)]
    items = spark.createDataFrame(rows, "doc_id long, tokens long").withColumn("capacity", F.lit("clash"))
    limits = spark.createDataFrame([("a", 100), ("b", 1000), ("bad", 0), (None, 5), ("nil", None)], "limit_id string, capacity_tokens int")
    monkeypatch.setattr(packing, "WINDOWS", 20)
    out = packing.pack(items, limits).cache()
    for limit, cap in (("a", 100), ("b", 1000)):
        part = out.where(F.col("limit_id") == limit)
        per = {x.doc_id: (x.t, x.n, x.d) for x in part.groupBy("doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.countDistinct("piece").alias("d")).collect()}
        assert set(per) == {i for i, _ in rows if i is not None}
        for i, t in rows:
            if i is not None:
                t = t or 0
                assert per[i] == (t, max(1, -(-t // cap)), max(1, -(-t // cap)))
        assert packing.containers(part).where("unused < 0").count() == 0
        assert packing.fill_report(part).first().fill > 0.9
    assert {x.limit_id for x in out.select("limit_id").distinct().collect()} == {"a", "b"}
    assert packing.pack(items.where("false"), limits).count() == 0
    assert packing.pack(items, limits.where("false")).count() == 0


def test_token_counts(spark):
    texts = [("Hello world",), ("",), (None,), ("día " * 20_000,)]
    n = [r[0] for r in spark.createDataFrame(texts, "text string").select(tokens.token_count(F.col("text"))).collect()]
    assert n[0] == 2 and n[1] == n[2] == 0 and n[3] >= 20_000


def sizes(spark, n, seed=1):
    r = random.Random(seed)
    # one source has a third of all documents, "small" a few
    rows = [(i, r.choice(["big", "mid", "mid2"]) if i >= 12 else "small", r.randrange(5, 400)) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, tokens long")


def test_shares_are_met(spark):
    s = sizes(spark, 4000)
    t = spark.createDataFrame([(" BIG", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("small ", 0.0, 9), ("absent", 0.1, 3)], "source string, target_share double, max_repeats int")
    plan = mixing.budgets(s, t)
    chosen = mixing.mix(s, plan).cache()
    rep = {r.source: r for r in mixing.report(chosen, plan).collect()}
    assert rep["mid2"].used == rep["absent"].used == 0
    assert rep["small"].repeats == 4.0 and rep["small"].most_copies == 4
    for name, share in (("big", 0.5), ("mid", 0.3), ("small", 0.1)):
        assert abs(rep[name].share - share / 0.9) < 2e-3
        assert rep[name].most_copies <= rep[name].max_repeats
    assert chosen.count() == chosen.select("doc_id").distinct().count()
    again = mixing.mix(s.repartition(7), plan)
    assert again.exceptAll(chosen.select(*again.columns)).count() == 0


def test_total_beyond_what_there_is(spark):
    s = sizes(spark, 600)
    t = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.budgets(s, t, total_tokens=10**9)
    chosen = mixing.mix(s, plan)
    rep = {r.source: r for r in mixing.report(chosen, plan).collect()}
    assert rep["big"].repeats == 1.0 and rep["small"].repeats == 2.0


def test_empty_mix(spark):
    s = sizes(spark, 20)
    t = spark.createDataFrame([(None, 0.5, 1), ("zzz", None, 1), ("small", 0.5, None)], "source string, target_share double, max_repeats int")
    plan = mixing.budgets(s.where("false"), t)
    assert mixing.mix(s.where("false"), plan).count() == 0
    plan = mixing.budgets(s, t)
    assert {r.source for r in mixing.mix(s, plan).collect()} == {"small"}
