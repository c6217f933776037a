"""Change feed, references and version history against brute force in plain Python."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from memloom.operators import changefeed, history, references

HISTORY = "id long, memory_id string, previous_value string, new_value string, action string, created_at string, updated_at string, is_deleted int, ingested_at timestamp_ntz"
T0 = dt.datetime(2024, 1, 1)


def iso(n):
    return (T0 + dt.timedelta(seconds=n)).isoformat() + "Z"


def feed(spark, rows):
    """rows: (id, memory, previous, new, action, second or None)"""
    return spark.createDataFrame(
        [(i, m, p, n, a, iso(0), None if t is None else iso(t), 0, T0 + dt.timedelta(days=1, seconds=i)) if t is not None else (i, m, p, n, a, None, None, None, T0 + dt.timedelta(days=1, seconds=i)) for i, m, p, n, a, t in rows],
        HISTORY,
    )


def brute(rows):
    """(present state, versions) by replaying the distinct changes in order."""
    first = {}
    for i, m, p, n, a, t in rows:
        if m is None or not m.strip():
            continue
        act = (a or "").strip().upper()
        if act not in ("ADD", "UPDATE", "DELETE") or act != "DELETE" and not (n or "").strip():
            continue
        at = (86400 + i if act != "DELETE" else float("inf")) if t is None else t
        k = (m.strip().lower(), act, n, at)
        if k not in first or i < first[k][0]:
            first[k] = (i, p)
    by = {}
    for (m, act, n, at), (i, p) in first.items():
        by.setdefault(m, []).append((at, i, act, n, p))
    state, versions = {}, set()
    for m, changes in by.items():
        deleted, cur, opened, seen = False, None, None, False
        for at, i, act, n, p in sorted(changes, key=lambda x: x[:2]):
            if act == "UPDATE" and deleted:
                continue
            if not seen and act != "ADD" and (p or "").strip():
                cur, opened = "\0", ""
            seen = True
            if act == "DELETE":
                if cur is not None:
                    versions.add((opened, str(i)))
                cur, deleted = None, True
                state.pop(m, None)
                continue
            deleted = False
            text = " ".join(n.split())
            if cur != text:
                if cur is not None:
                    versions.add((opened, str(i)))
                cur, opened = text, str(i)
            state[m] = i
        if cur is not None:
            versions.add((opened, ""))
    return state, versions


def random_rows(seed, n, memories):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # one memory holds a third of all rows
        m = "hot" if r.random() < 0.34 else f"m{r.randrange(memories)}"
        m = r.choice([m, m.upper(), f" {m} "])
        act = r.choice(["ADD", "UPDATE", "update ", "UPDATE", "Delete", "NONE", None])
        new = r.choice(["a", "b", "a ", "a  b", "a b", "", None, " "])
        old = r.choice([None, "", "x"])
        t = None if act == "Delete" and r.random() < 0.02 else r.randrange(n)
        rows.append((i + 1, m, old, new, act, t))
        if r.random() < 0.1:
            rows.append((n + i + 1, *rows[-1][1:]))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_state_and_versions_equal_replay(spark, seed):
    rows = random_rows(seed, 1500, 40)
    df = feed(spark, rows)
    state, versions = brute(rows)
    got = {r.entity: r.n for r in changefeed.current_state(changefeed.changes(df)).collect()}
    assert got == state
    out = {(r.opened_by, r.closed_by) for r in history.memory_versions(df).collect()}
    assert out == versions


def test_base_and_batch_merge_like_one_feed(spark):
    rows = [(1, "a", None, "x", "ADD", 1), (2, "b", None, "y", "ADD", 2), (3, "a", "x", "z", "UPDATE", 5), (4, "b", "y", None, "DELETE", 6)]
    base = changefeed.carried(changefeed.changes(feed(spark, rows[:2])))
    merged = changefeed.current_state(changefeed.changes(feed(spark, rows[2:])), base)
    assert {(r.entity, r.n) for r in merged.collect()} == {("a", 3)}


def test_empty_null_and_clashing_columns(spark):
    empty = spark.createDataFrame([], HISTORY)
    assert changefeed.current_state(changefeed.changes(empty)).count() == 0
    assert history.memory_versions(empty).count() == 0
    nulls = spark.createDataFrame([(None,) * 9, (1,) + (None,) * 8, (2, "a", None, "v" * 100_000, "ADD", None, None, None, None)], HISTORY)
    clash = nulls.withColumn("entity", F.lit("z")).withColumn("ts", F.lit(1)).withColumn("state", F.lit("q")).withColumn("op", F.lit(0))
    assert [(r.entity, r.n) for r in changefeed.current_state(changefeed.changes(clash)).collect()] == [("a", 2)]
    assert [(r.opened_by, r.closed_by) for r in history.memory_versions(clash).collect()] == [("2", "")]
    assert changefeed.current_rows(clash).first().text == "v" * 100_000


FACTS = "id string, observed_at string, supersedes array<string>, source_ids array<string>, state string, ingested_at timestamp_ntz"


def fact(i, t, sup=(), src=(), state="active", seen=0):
    return (i, None if t is None else iso(t), list(sup), list(src), state, T0 + dt.timedelta(hours=seen))


def test_fact_versions(spark):
    rows = [
        fact("a", 1), fact("a", 1), fact("b", 5, ["A ", "a", None, ""]), fact("c", 5, ["a"]), fact("d", 9, ["b", "nope", "d"]),
        fact("e", 0, ["d"]), fact("f", 9, ["d"]), fact("g", None, ["a"]), fact("h", 3),
    ]
    out = {(r.opened_by, r.closed_by) for r in history.fact_versions(spark.createDataFrame(rows, FACTS)).collect()}
    # e is older than d and f is as old, so neither replaces it; g has no time
    assert out == {("a", "b"), ("b", "d"), ("c", ""), ("d", "")}
    assert history.fact_versions(spark.createDataFrame([], FACTS)).count() == 0


def test_long_runs_cross_words(spark):
    rows = [(i, "m", None, "same", "ADD", i) for i in range(1, 200)] + [(500, "m", None, "other", "UPDATE", 300)]
    out = {(r.opened_by, r.closed_by) for r in history.memory_versions(feed(spark, rows)).collect()}
    assert out == {("1", "500"), ("500", "")}


def test_orphans(spark):
    hour = lambda h: T0 + dt.timedelta(hours=h)
    facts = spark.createDataFrame(
        [
            fact("f1", 0, ["f2", "gone"], [" M1", "m2", "m3", None, ""], seen=10),
            fact("f1", 0, ["f2", "gone"], [" M1", "m2", "m3", None, ""], seen=40),
            fact("f2", 0, [], ["m4", "m4"], "erased", seen=2),
            fact("f3", 0, [], ["m1"], seen=1),
        ],
        FACTS,
    )
    messages = spark.createDataFrame(
        [("m1", False, hour(5)), ("m1", None, hour(3)), ("m2", False, hour(1)), ("m2", True, hour(9)), ("m3", False, hour(30)), ("m4", True, hour(0)), ("m4", False, hour(1)), (None, None, None)],
        "id string, redacted boolean, ingested_at timestamp_ntz",
    )
    memories = spark.createDataFrame([("k1", None, hour(1)), ("k1", hour(50), hour(2)), ("k2", None, hour(900))], "id string, purged_at timestamp_ntz, ingested_at timestamp_ntz")
    feed_rows = spark.createDataFrame([(1, "K1", hour(49)), (2, "k1", hour(50)), (3, "k2", hour(10)), (4, "k3", hour(10)), (5, "", hour(1)), (6, None, None)], "id long, memory_id string, ingested_at timestamp_ntz")
    refs = [references.fact_references(facts, "source_ids", "messages"), references.fact_references(facts, "supersedes", "facts"), references.history_references(feed_rows)]
    tgts = [references.message_targets(messages), references.fact_targets(facts), references.memory_targets(memories)]
    out = {(r.ref_field, r.record_id, r.ref_key, r.reason) for r in references.orphans(refs, tgts).collect()}
    assert out == {
        ("fact.source_ids", "f1", "m2", "removed"), ("fact.source_ids", "f1", "m3", "late"), ("fact.source_ids", "f3", "m1", "late"),
        ("fact.supersedes", "f1", "f2", "removed"), ("fact.supersedes", "f1", "gone", "absent"),
        ("memory_history.memory_id", "2", "k1", "removed"), ("memory_history.memory_id", "3", "k2", "late"), ("memory_history.memory_id", "4", "k3", "absent"),
    }
    counts = references.orphan_counts(references.orphans(refs, tgts)).agg(F.sum("orphans")).first()[0]
    assert counts == 8
    none = [x.where("false") for x in refs], [x.where("false") for x in tgts]
    assert references.orphans(*none).count() == 0
    assert references.orphans(refs, none[1]).where("reason <> 'absent'").count() == 0


def test_orphans_with_a_hot_key_and_many_slices(spark, monkeypatch):
    monkeypatch.setattr(references, "SLICE", 50)
    r = random.Random(3)
    rows = [(i, "hot" if r.random() < 0.4 else f"k{r.randrange(600)}", T0 + dt.timedelta(minutes=r.randrange(40_000))) for i in range(3000)]
    have = [(f"k{i}", None, T0 + dt.timedelta(minutes=r.randrange(40_000))) for i in range(0, 600, 2)]
    h = spark.createDataFrame(rows, "id long, memory_id string, ingested_at timestamp_ntz")
    m = spark.createDataFrame(have, "id string, purged_at timestamp_ntz, ingested_at timestamp_ntz")
    seen = {k: t for k, _, t in have}
    want = {(str(i), k) for i, k, t in rows if k not in seen or seen[k] > t}
    out = {(x.record_id, x.ref_key) for x in references.orphans([references.history_references(h)], [references.memory_targets(m)]).collect()}
    assert out == want


def test_bits_below_a_limit(spark):
    rows = [(had, word) for had in (0, 1, 5, 62, 63, 64, 65, 127, 128, 1000) for word in (0, 1, 2)]
    out = spark.createDataFrame(rows, "had long, word int").withColumn("bits", references.below("had", "word")).collect()
    for r in out:
        assert r.bits & (2**64 - 1) == sum(1 << i for i in range(64) if r.word * 64 + i < r.had)
