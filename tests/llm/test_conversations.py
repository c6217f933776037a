import datetime as dt
import json
import random
import unicodedata

from pyspark.sql import functions as F

from memloom.llm import conversations

SCHEMA = "id string, session_id string, ordinal int, role string, content string, body string, ingested_at timestamp_ntz"
ALIASES = {"user": "user", "human": "user", "assistant": "assistant", "bot": "assistant", "system": "system", "tool": "tool"}
T0 = dt.datetime(2024, 1, 1)


def aliases(spark):
    return spark.createDataFrame([(f" {a.upper()}", s) for a, s in ALIASES.items()], "alias string, speaker string")


def visible(t):
    return any(not (c.isspace() or unicodedata.category(c) in ("Cc", "Cf")) for c in t or "")


def brute(rows):
    last = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k = r[0].strip().lower()
        if k not in last or r[6] > last[k][6]:
            last[k] = r
    by = {}
    for r in last.values():
        by.setdefault(r[1].strip().lower(), []).append(r)
    bad = set()
    for s, rs in by.items():
        turns, seq = {}, []
        for _, _, o, role, text, body, _ in rs:
            try:
                b = json.loads(body) if body else {}
            except ValueError:
                b = {}
            role = b.get("role") if role is None else role
            text = b.get("content") if text is None else text
            who = ALIASES.get((role or "").strip().lower())
            turns.setdefault(o, set()).add((who, None if text is None else text.strip()))
            seq.append((o, who, text))
        spoken = sorted((o, w) for o, w, _ in seq if w in ("user", "assistant"))
        ok = set(turns) == set(range(max(turns) + 1)) and all(len(x) == 1 for x in turns.values())
        ok = ok and all(w for _, w, _ in seq) and all(visible(t) for _, w, t in seq if w in ("user", "assistant"))
        ok = ok and {w for _, w in spoken} == {"user", "assistant"} and spoken[-1][1] == "assistant"
        if not ok:
            bad.add(s)
    return bad, set(by)


def random_rows(seed, sessions):
    r = random.Random(seed)
    rows = []
    for s in range(sessions):
        # lengths around powers of two, and one session with a third of all turns
        n = 400 if s == 0 else r.choice([1, 2, 3, 15, 16, 17, 32, 33])
        for o in range(n):
            if r.random() < 0.004:
                continue
            role = ("user", "bot")[o % 2] if r.random() > 0.05 else r.choice(["system", "tool"])
            text = f"t{o}" if r.random() > 0.004 else r.choice(["", " ", "​", None])
            body = None
            if r.random() < 0.3:
                body, text = json.dumps({"role": role, "content": text}), None
                role = None if r.random() < 0.5 else role
            if r.random() < 0.004:
                body = (body or "{")[:-1]
            row = (f"{s}-{o}", f" S{s}", o, role, text, body, T0 + dt.timedelta(seconds=o))
            rows.append(row)
            if r.random() < 0.05:
                rows.append((row[0].upper(), *row[1:6], T0 - dt.timedelta(days=1)))
            if r.random() < 0.02:
                rows.append((f"{s}-{o}-again", *row[1:4], text and r.choice([text + " ", text + "!"]) if r.random() < 0.2 else text and text + "\n", body, row[6]))
    r.shuffle(rows)
    return rows


def test_excluded_sessions_equal_brute_force(spark):
    for seed in (1, 2):
        rows = random_rows(seed, 120)
        bad, every = brute(rows)
        df = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit("x")).withColumn("speaker", F.lit(1))
        out = {r.session_id for r in conversations.excluded_sessions(df, aliases(spark)).collect()}
        assert out == bad
        kept = conversations.conversations(df, aliases(spark)).collect()
        assert {r.session_id for r in kept} == every - bad
        turns = {}
        for r in kept:
            turns.setdefault(r.session_id, []).append(r.turn)
        assert all(sorted(t) == list(range(len(t))) for t in turns.values())


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.excluded_sessions(empty, aliases(spark)).count() == 0
    rows = [(None,) * 7, ("a", "s", None, "user", "x", None, None), ("b", None, 0, "user", "x", None, None), ("c", "s2", -1, None, None, "nonsense", T0)]
    out = {r.session_id: r for r in conversations.excluded_sessions(spark.createDataFrame(rows, SCHEMA), aliases(spark)).collect()}
    assert set(out) == {"s", "s2"} and out["s"].gap and out["s2"].gap
    assert conversations.conversations(spark.createDataFrame(rows, SCHEMA), aliases(spark)).count() == 0


def test_pointer_jumping(spark):
    rows = [("g", i, i - 1 if i else None) for i in range(100)] + [("h", i, i - 1) for i in range(5, 9)] + [("c", 1, 2), ("c", 2, 3), ("c", 3, 1), ("c", 4, 1)]
    out = {(r.g, r.v): r for r in conversations.chain_roots(spark.createDataFrame(rows, "g string, v long, p long"), "g", "v", "p").collect()}
    assert len(out) == len(rows)
    assert all(out["g", i].status == "rooted" and out["g", i].root == 0 and out["g", i].hops == i for i in range(100))
    assert all(out["h", i].status == "orphan" for i in range(5, 9))
    assert all(out["c", i].status == "cycle" for i in range(1, 5))


def test_gaps_and_turns_come_from_the_paths(spark, monkeypatch):
    rows = [(f"a{o}", "gap", o, ("user", "bot")[o % 2], "x", None, T0) for o in (0, 1, 2, 3, 6, 7)]
    rows += [(f"b{o}", "whole", o, ("user", "bot")[o % 2], "x", None, T0) for o in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.session_id for r in conversations.excluded_sessions(df, aliases(spark)).where("gap").collect()} == {"gap"}

    def reversed_paths(nodes, group, node, parent):
        return nodes.select(group, node, F.lit(0).cast("long").alias("root"), (F.lit(5) - F.col(node)).alias("hops"), F.lit("rooted").alias("status"))

    monkeypatch.setattr(conversations, "chain_roots", reversed_paths)
    assert conversations.excluded_sessions(df, aliases(spark)).count() == 0
    kept = conversations.conversations(df, aliases(spark)).where("session_id = 'whole'").orderBy("turn").collect()
    assert [r.speaker for r in kept] == ["assistant", "user"] * 3


def test_branches_share_a_root(spark):
    rows = [("t", i, i // 2 if i else None) for i in range(64)]
    rows[1] = ("t", 1, 0)
    out = conversations.chain_roots(spark.createDataFrame(rows, "g string, v long, p long"), "g", "v", "p").collect()
    assert len(out) == 64 and all(r.status == "rooted" and r.root == 0 and r.hops == r.v.bit_length() for r in out)
