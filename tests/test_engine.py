"""Search, state, graph, packing, erasure, calendar, extraction, store and stream operators on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from memloom.functions import calendar
from memloom.functions import lexicon as lx
from memloom.operators import erasure, extraction, filters, fusion, graph, lexical, lifecycle, packing, passages, state, store, vectors
from memloom.streaming import events


def one(spark, expr, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(expr.alias("x")).first().x


def test_stems_and_tokens(spark):
    # worked out by hand from the suffix rules
    words = {"parties": "parti", "classes": "class", "kindness": "kind", "shipment": "ship", "relation": "rele", "sitting": "sitt", "meeting": "meet",
             "running": "runn", "wanted": "want", "quickly": "quick", "tester": "test", "fastest": "fast", "cats": "cat", "class": "class", "bed": "bed", "dies": "die"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r.w: r.s for r in df.select("w", lx.stem(F.col("w")).alias("s")).collect()} == words
    toks = one(spark, lx.tokens(F.col("t")), t="I like hiking in 北京")
    assert toks[-3:] == ["北", "北京", "京"] and "hiking" in toks and "like" in toks
    assert one(spark, lx.tokens(F.lit(None).cast("string")), t="x") in ([], None)


def test_text_keys(spark):
    assert one(spark, lx.canonical(F.col("t")), t="  Job__Title-x ") == "job title x"
    assert one(spark, lx.estimate_tokens(F.col("t")), t="abcdefg") == 3
    assert one(spark, lx.estimate_tokens(F.col("t")), t="北京") == 3
    a, b = "[Session time: 1 May]Raj: I like tea!", "i like TEA"
    k = lambda c: lx.evidence_key(F.lit("User"), F.lit(""), c)
    assert one(spark, k(F.col("t")), t=a) == one(spark, k(F.col("t")), t=b) == "user||iliketea"
    names = {"Raj: hi": "Raj", "Dr. Who: hi": "Dr. Who", "Instructions: salt": None, "Please: go": None, "My note: x": None, "no colon": None, "A sentence. Then: x": None}
    for text, want in names.items():
        assert one(spark, lx.speaker_of(F.col("t")), t=text) == want, text
    assert round(one(spark, lx.sigmoid_score(F.lit(5.0), F.lit(3)), t=""), 6) == 0.5
    assert one(spark, lx.overlap(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("b"))), t="") == 0.5


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "apple banana apple"), (2, "banana"), (3, "cherry date"), (4, None), (5, ""), (None, "apple")], "id long, text string")
    post = lexical.postings(docs, "id", F.col("text"))
    q = lexical.query_terms(spark.createDataFrame([(9, "apple apple banana"), (8, "zzz"), (7, None)], "id long, text string"), "id", F.col("text"))
    import math

    out = {(r.query, r.doc): r.score for r in lexical.bm25(post, q).collect()}
    assert set(out) == {(9, 1), (9, 2)}
    idf = lambda df: math.log((3 - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, n: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / 2))
    assert out[9, 1] == pytest.approx(2 * idf(1) * part(2, 3) + idf(2) * part(1, 3))
    assert out[9, 2] == pytest.approx(idf(2) * part(1, 1))
    assert lexical.top_k(lexical.bm25(post, q), 1).count() == 1
    assert lexical.bm25(lexical.postings(docs.where("false"), "id", F.col("text")), q).count() == 0


def test_vectors(spark, monkeypatch):
    import numpy as np

    r = np.random.default_rng(0)
    v = r.normal(size=(300, 8))
    v[7] = 0
    v[9] = v[8]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [1.0])], "doc long, vector array<double>")
    monkeypatch.setattr(vectors, "ROWS", 64)
    monkeypatch.setattr(vectors, "ASKING", 7)
    asks = rows.where("doc % 15 = 0").select(F.col("doc").alias("query"), "vector")
    out = {(x.query, x.doc): (x.score, x.rank) for x in vectors.knn(asks, rows, 5).collect()}
    n = np.linalg.norm(v, axis=1)
    for q in range(0, 300, 15):
        s = np.where(n > 0, v @ v[q] / np.where(n > 0, n, 1) / n[q], -np.inf)
        want = sorted(range(300), key=lambda i: (-round(s[i], 12), i))[:5]
        assert sorted(d for a, d in out if a == q) == sorted(want)
    assert vectors.knn(asks, rows.where("false"), 5).count() == 0
    a, z = F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vectors.cosine(a, z), t="") == -1 and one(spark, vectors.cosine(a, a), t="") == pytest.approx(1)
    assert one(spark, vectors.distance(a, z, "l1"), t="") == 3 and one(spark, vectors.distance(a, z, "l2_squared"), t="") == 5


def test_additive_fusion_literal(spark):
    s = spark.createDataFrame([("q", "a", 0.8), ("q", "b", 0.5), ("q", "c", 0.05)], "query string, doc string, score double")
    k = spark.createDataFrame([("q", "a", 0.6), ("q", "z", 0.9)], s.schema)
    e = spark.createDataFrame([("q", "a", 0.3)], s.schema)
    out = {r.doc: r.score for r in fusion.additive(s, k, e).collect()}
    assert out == {"a": pytest.approx(0.68), "b": pytest.approx(0.2)}
    ranks = lambda *d: spark.createDataFrame([("q", x, i + 1) for i, x in enumerate(d)], "query string, doc string, rank int")
    fused = {r.doc: (r.score, r.signals) for r in fusion.rrf({"semantic": ranks("a", "b"), "entity": ranks("b")}).collect()}
    assert fused["b"] == (pytest.approx(1 / 62 + 0.5 / 61), ["entity", "semantic"])


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "B", None), (3, None, 7)], "id int, s string, n int")
    ids = lambda spec, **kw: sorted(r.id for r in df.where(filters.compile_filter(spec, **kw)).collect())
    assert ids(None) == ids({}) == ids({"s": "*"}) == [1, 2, 3]
    assert ids({"s": {"ne": "a"}}) == [2, 3] and ids({"n": {"nin": [5]}}) == [2, 3]
    assert ids({"n": {"gt": 5}}) == [3] and ids({"NOT": [{"n": {"gt": 5}}]}) == [1, 2]
    assert ids({"s": ["a", None]}) == [1, 3] and ids({"OR": []}) == [] and ids({"$and": []}) == [1, 2, 3]
    assert ids({"s": {"icontains": "b"}}) == [2] and ids({"n": {"lt": 6, "gt": 6}}) == []
    assert ids({"n": {"lt": 6, "gt": 6}}, first_only=True) == [3]
    for bad in ({"n": {"like": 1}}, {"OR": {"n": 1}}, {"x y": 1}, {"n": {}}):
        with pytest.raises(ValueError):
            filters.compile_filter(bad)
    with pytest.raises(ValueError):
        filters.compile_filter({"id": 1}, keys={"n"})
    days = spark.createDataFrame([("2024-01-20",), ("2024-01-19",), ("2024-02-30",), ("soon",), (None,)], "d string")
    assert [r.d for r in days.where(filters.not_expired(F.col("d"), "2024-01-20")).collect()] == ["2024-01-20", "2024-02-30", "soon", None]
    assert filters.identity_scope(user_id=" u ") == {"user_id": "u"}
    for call in (lambda: filters.identity_scope(), lambda: filters.identity_scope("a b"), lambda: filters.check_search(-1), lambda: filters.check_search(1, 2)):
        with pytest.raises(ValueError):
            call()
    filters.check_search(0, 0.5)


def test_state(spark):
    rows = [("u", 1, 10, 1.0), ("u", 2, 30, 2.0), ("u", 3, 20, 2.0), ("v", 4, 5, None)]
    df = spark.createDataFrame(rows, "k string, id int, at int, v double")
    assert {r.id for r in state.latest_per_slot(df, ["k"], ["at", "id"]).collect()} == {2, 4}
    line = state.timeline(df, ["k"], ["at", "id"], "at")
    assert {r.id: r.valid_to for r in line.collect()} == {1: 20, 3: 30, 2: None, 4: None}
    assert {r.id for r in state.as_of(line, "at", F.lit(25)).collect()} == {3, 4}
    assert [r.id for r in state.late_rows(df, ["k"], ["id"], "at").collect()] == [3]
    assert [r.n_values for r in state.conflicts(df, ["k"], F.lit("p"), "v").collect()] == [2]
    req = spark.createDataFrame([("r", "x", 1), ("r", "x", 2), ("r", "y", 3)], "id string, body string, n int")
    assert [r.outcome for r in state.receipts(req, ["id"], F.col("body"), ["n"]).orderBy("n").collect()] == ["accepted", "replayed", "conflict"]
    cards = state.pattern_cards(spark.createDataFrame([("u", "hiking"), ("u", "chess"), ("u", "hiking"), ("v", "tea"), ("v", None)], "k string, v string"), ["k"], F.col("v"))
    assert [(r.k, r["values"], r.n_values) for r in cards.collect()] == [("u", "chess, hiking", 2)]
    nums = state.global_ordinals(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")), ["x"])
    assert nums.where("x <> ordinal").count() == 0 and nums.count() == 1000


def test_graph(spark):
    rows = spark.createDataFrame([("a", True, []), ("b", True, ["a"]), ("c", False, ["a"]), ("d", True, ["c"]), ("e", True, ["d", "b"]), ("f", True, ["nope"]), ("x", True, ["y"]), ("y", True, ["x"]), ("n", None, None)], "id string, ok boolean, depends_on array<string>")
    assert {r.id for r in graph.visible_rows(rows, F.col("ok")).collect()} == {"a", "b", "x", "y"}
    links = spark.createDataFrame([("ab", "Alice"), ("ab", "Bob"), ("bc", "Bob"), ("bc", "Cedar"), ("co", "Cedar"), ("no", "Zed")], "doc string, entity string")
    seeds = spark.createDataFrame([("q", "Alice"), ("q", None)], "query string, entity string")
    assert {(r.doc, r.depth) for r in graph.expand_hops(seeds, links, 3).collect()} == {("ab", 0), ("bc", 1), ("co", 2)}
    assert graph.bounded(graph.expand_hops(seeds, links, 3), 2).count() == 2


def test_packing(spark):
    rows = [("q", "a", 1.0, "k1", 5, "i", "s"), ("q", "dup", 0.99, "k1", 1, "i", "s"), ("q", "big", 0.95, "k2", 100, "i", "s"), ("q", "b", 0.9, "k3", 4, "i", "s"), ("q", "c", 0.8, "k4", 4, "j", "t"), ("p", "n", None, "k", None, None, None)]
    df = spark.createDataFrame(rows, "query string, doc string, score double, key string, cost long, item string, source string")
    took = lambda **kw: [r.doc for r in packing.pack(df, **kw).where("query = 'q'").orderBy("place").collect()]
    assert took(budget=10) == ["a", "b"] and took(budget=200) == ["a", "big", "b", "c"]
    assert took(budget=10, coverage=True) == ["a", "c"] and took(budget=200, rows=2) == ["a", "big"]
    assert packing.pack(df.where("false")).count() == 0


def test_erasure(spark):
    docs = spark.createDataFrame([(1, "My code is ZX-482, ok"), (2, "zx 482!"), (3, "zx 4820"), (4, None), (5, "")], "id int, text string")
    marks = erasure.markers(spark.createDataFrame([("ZX-482",), (" ",), (None,)], "v string"), F.col("v"))
    assert marks.count() == 1
    assert {r.id for r in erasure.containing(docs, "id", F.col("text"), marks).collect()} == {1, 2}
    assert {r.id for r in erasure.without_marked(docs, "id", F.col("text"), marks).collect()} == {3, 4, 5}
    assert one(spark, erasure.redact_value(F.col("t"), F.lit("a.b")), t="A.b, xa.b a.b") == "[redacted], xa.b [redacted]"


def test_calendar(spark):
    cases = [  # expression, anchor, start, end, precision, resolution
        ("yesterday", "1 March 2024", "2024-02-29", "2024-03-01", "day", "resolved"),
        ("last Monday", "2026-01-05", "2025-12-29", "2025-12-30", "day", "resolved"),
        ("next Monday", "2026-01-05", "2026-01-12", "2026-01-13", "day", "resolved"),
        ("March 2024", None, "2024-03-01", "2024-04-01", "month", "resolved"),
        ("last year", "2026-05-10", "2025-01-01", "2026-01-01", "year", "resolved"),
        ("last week", "2026-01-05", "2025-12-29", "2026-01-05", "week", "resolved"),
        ("3 days ago", "May 8, 2023", "2023-05-05", "2023-05-06", "day", "resolved"),
        ("去年", "2026-05-10", "2025-01-01", "2026-01-01", "year", "resolved"),
        ("2026-02-30", None, None, None, "unknown", "unresolved"),
        ("May 2024 or June 2024", None, None, None, "unknown", "unresolved"),
        ("yesterday", "synthetic ordering", None, None, "unknown", "ordering"),
        ("yesterday", None, None, None, "unknown", "unresolved"),
        (None, None, None, None, "unknown", "unresolved"),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "i int, e string, a string")
    out = calendar.with_resolution(df, "e", "a", "t").orderBy("i").select("i", "t.*").collect()
    for r, c in zip(out, cases):
        got = (r.start and str(r.start), r.end_exclusive and str(r.end_exclusive), r.precision, r.resolution)
        assert got == c[2:], c


def test_extraction(spark):
    m = spark.createDataFrame(
        [
            ("1", "user", "[Session time: 8 May 2023] Hi. I now live in Portland, not Seattle anymore. My manager is Ann!"),
            ("2", "assistant", "I live in Rome."), ("3", "assistant", "Raj: I enjoy chess."), ("4", "user", "Forget my access code. I work as an analyst, maybe."),
            ("5", "user", None), ("6", None, "I live in Oslo."), ("7", "user", "Do not forget that I live in Bonn."),
        ],
        "id string, role string, content string",
    )
    out = {(r.source_id, r.subject, r.predicate, r.value, r.modality) for r in extraction.extract(m).collect()}
    assert out == {
        ("1", "user", "current city", "Portland", "confirmed"), ("1", "user", "manager", "Ann", "confirmed"),
        ("3", "Raj", "hobby", "chess", "confirmed"), ("4", "user", "job title", "analyst", "tentative"),
    }
    rules = ((None, r"(\w+) := (\w+)"),)
    assert one(spark, extraction.attributes(F.col("t"), rules), t="x := y") == ("x", "y")
    text = "One. Two!  Three\n" + "x" * 2000
    s = extraction.sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, t string"), "id", "t").collect()
    assert all(text[r.start :].startswith(r.quote) for r in s) and "".join(r.quote for r in s) == "One.Two!Three" + "x" * 2000
    # a long sentence is cut at its last space after half the length
    long = "word " * 400 + "end"
    parts = extraction.pieces(spark.createDataFrame([(1, long)], "id int, t string"), "id", "t").orderBy("start").collect()
    assert "".join(r.piece for r in parts) == long and [len(r.piece) for r in parts] == [900, 900, 203]
    kinds = {"Please forget my code.": "forget", "Remember again: my code is X.": "restore", "She said forget it.": "blocked", "Don't forget milk.": "blocked", "I ate.": "none"}
    for t, k in kinds.items():
        assert one(spark, extraction.intent_of(F.col("t")), t=t) == k, t


def test_store(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "id string, revision int, v string")
    new = spark.createDataFrame([("a", 1, "z"), ("c", 0, "w")], old.schema)
    assert {(r.id, r.v) for r in store.upsert(old, new).collect()} == {("a", "z"), ("b", "y"), ("c", "w")}
    assert {r.id for r in store.delete(old, new).collect()} == {"b"}
    with pytest.raises(Exception, match="vector length"):
        store.checked_vectors(spark.createDataFrame([(1, [1.0])], "id int, vector array<double>"), 2).collect()
    assert store.page(old, [F.asc("id")], 1).first().total == 2
    assert one(spark, store.scope_text({"u": F.lit("a&b"), "a": F.lit("1=%")}), t="") == "a=1%3D%25&u=a%26b"
    none = spark.createDataFrame([], "entity string, type string, linked array<string>")
    mentions = spark.createDataFrame([("m1", " New  York", "PROPER"), ("m2", "new york", "TOPIC"), (None, "x", "T"), ("m3", None, "T")], "memory_id string, text string, type string")
    linked = store.link_entities(mentions, none)
    assert [(r.entity, r.type, r.linked) for r in linked.collect()] == [("new york", "PROPER", ["m1", "m2"])]
    assert store.unlink(linked, spark.createDataFrame([("m1",), ("m2",)], "id string")).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=(i * 37) % 600), f"u{i % 3}", float(i % 4)) for i in range(90)]
    df = spark.createDataFrame(rows, "seq long, ts timestamp_ntz, k string, value double")
    df.write.parquet(f"{tmp_path}/t.parquet")
    src = events.source(spark, str(tmp_path), "t")
    n = [F.count("*").alias("n")]
    for make in (lambda d: events.windowed(d, "ts", ["k"], n, "1 hour"), lambda d: events.windowed(d, "ts", ["k"], n, "2 hours", "1 hour"), lambda d: events.sessions(d, "ts", ["k"], n, "20 minutes")):
        a = events.run(make(events.timed(src, late="1 hour")))
        # what the watermark, an hour behind the latest event, has closed
        b = make(events.timed(df)).where(F.col("stop") <= F.lit(str(max(r[1] for r in rows) - dt.timedelta(hours=1))).cast("timestamp"))
        assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.count() > 0
    slots = events.slot_updates(src.withColumn("ts", F.col("ts").cast("timestamp")), ["k"])
    held, want = {}, {}
    for seq, ts, k, v in rows:
        if k not in held or ts > held[k][0]:
            want[seq] = "new" if k not in held else "same" if held[k][1] == v else "update"
            held[k] = (ts, v)
        else:
            want[seq] = "late" if ts < held[k][0] else "same" if held[k][1] == v else "conflict"
    assert {r.seq: r.outcome for r in slots.collect()} == want
    # state goes from batch to batch: two files, one per batch
    df.where("seq < 40").coalesce(1).write.parquet(f"{tmp_path}/two.parquet")
    df.where("seq >= 40").coalesce(1).write.mode("append").parquet(f"{tmp_path}/two.parquet")
    two = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/two.parquet")
    slots = events.slot_updates(two.withColumn("ts", F.col("ts").cast("timestamp")), ["k"])
    assert {r.seq: r.outcome for r in slots.collect()} == want
    sparse = two.withColumn("v", F.when(F.col("value") == 3, F.col("seq")))
    filled = {r.seq: r.v for r in events.carried(sparse, ["k"], ["seq"], "v").collect()}
    last = {}
    for seq, _, k, v in rows:
        last[k] = seq if v == 3 else last.get(k)
        assert filled[seq] == last[k]
    none = src.where("seq < 0").withColumn("ts", F.col("ts").cast("timestamp"))
    assert events.slot_updates(none, ["k"]).count() == 0


def test_intents_and_names(spark):
    from memloom.functions.intent import intent, named

    cases = {
        "Show how my job changed": "trajectory", "What did I ask you to forget?": "operation", "List my hobbies": "list",
        "Where did I use to live? I used to like Oslo": "historical", "What is my city?": "current",
    }
    for q, mode in cases.items():
        assert one(spark, intent(F.col("q")), q=q).mode == mode, q
    i = one(spark, intent(F.col("q")), q="My city as of 2026-01-01, and when?")
    assert i.as_of == "2026-01-01" and i.temporal and i.entities == []
    assert one(spark, intent(F.col("q")), q="When did Ann Lee say that?").entities == ["Ann Lee"]
    assert one(spark, intent(F.lit(None).cast("string")), q="").mode == "current"
    assert one(spark, named(F.col("t")), t="My friend Alice Van lives near Oslo, code ZX-482. I know Alice Van") == ["My", "Alice Van", "Oslo", "ZX-482"][1:]


def test_lifecycle_and_rendering(spark):
    from memloom.operators import lifecycle

    rows = [
        ("a", 1, "Seattle"), ("b", 1, "Boston"), ("c", 3, "Portland"), ("d", 2, "Rome"), ("e", 3, " portland"), ("n", None, "x"), ("m", 4, None),
    ]
    df = spark.createDataFrame([("u", *r) for r in rows], "k string, id string, at int, value string")
    out = {r.id: (r.verdict, r.ended) for r in lifecycle.settle(df, ["k"], "at", "value").collect()}
    assert out == {"a": ("superseded", 2), "b": ("superseded", 2), "d": ("superseded", 3), "c": ("active", None), "e": ("active", None)}
    out = {r.id: r.verdict for r in lifecycle.settle(df.where("at = 1"), ["k"], "at", "value").collect()}
    assert out == {"a": "conflicted", "b": "conflicted"}
    f = spark.createDataFrame(
        [("u", "o", "I live in Oslo", "user", "city", "Oslo", "superseded", "confirmed", "2026-01-01T00:00:00Z", "2026-08-01", "source", ["m1"]),
         ("u", "b", "I live in Bergen", "user", "city", "Bergen", "active", "confirmed", None, None, "ordering", ["m2"]),
         ("v", "p", "Paris", "user", "city", "Paris", "conflicted", "confirmed", "2026-01-02", None, "source", ["m1", "m2", "m1"])],
        "k string, id string, content string, subject string, predicate string, value string, state string, modality string, observed_at string, valid_to string, time_basis string, source_ids array<string>",
    )
    shown = {r.id: r.shown for r in lifecycle.render(lifecycle.with_successor(f, ["k"])).collect()}
    assert shown["o"] == '[2026-01-01 | user] Former city: "Oslo" (superseded on 2026-08-01; current city: "Bergen"). Original statement: I live in Oslo'
    assert shown["b"] == "[time: session order only] I live in Bergen"
    assert "corroborated by 2 independent" in shown["p"]
    lvl = lambda a, b, c: one(spark, lifecycle.match_level(F.lit(a), F.lit(b), F.lit(c)), t="")
    assert lvl("60148", "60148", "") == 1 and lvl("60143", "60148", "zip 60148") == 0 and lvl("ab", "", "xaby") == 0


def test_typed_paths(spark):
    e = [("ab", "Alice", "Bob", 1, 9), ("bc", "Bob", "Cedar", 3, None), ("old", "Bob", "Dune", 0, 1), ("co", "Cedar", "Oslo", None, None), ("back", "Bob", "Alice", None, None), ("nn", None, "Bob", None, None)]
    edges = spark.createDataFrame(e, "id string, src string, dst string, begins int, ends int")
    seeds = spark.createDataFrame([("q", "Alice"), ("r", "Nobody"), ("s", None)], "query string, node string")
    out = {(r.id, r.depth, r.begins, r.ends) for r in graph.typed_paths(seeds, edges, 3).collect()}
    # "old" ended before the friendship began
    assert out == {("ab", 0, 1, 9), ("bc", 1, 3, 9), ("back", 1, 1, 9), ("co", 2, 3, 9)}
    assert graph.typed_paths(seeds, edges, 2, per_node=1).count() == 2
    assert graph.typed_paths(seeds, edges, 3, most=2).count() == 2
    fan = spark.createDataFrame([(f"e{i:03}", "Alice", f"n{i}", None, None) for i in range(100)], edges.schema)
    assert graph.typed_paths(seeds, fan, 2).count() == 8


def test_passages(spark):
    text = "I like tea. My code is X-9, my code is X-9! Bye"
    m = spark.createDataFrame([("m", text), ("e", ""), ("n", None)], "source string, text string")
    q = spark.createDataFrame([("f", "m", "code is X-9"), ("g", "m", "like tea"), ("h", "m", "absent"), ("i", "m", ""), ("j", "zz", "x"), ("k", "m", None), ("l", "m", ".")], "fact string, source string, quote string")
    spans = passages.source_spans(q, m)
    got = {(r.fact, text[r.start : r.stop], r.start) for r in spans.collect()}
    assert got == {("f", "code is X-9", 15), ("f", "code is X-9", 31), ("g", "like tea", 2), ("l", ".", 10)}
    parts = passages.passages(m)
    assert [text[r.start : r.stop] for r in parts.orderBy("start").collect()] == ["I like tea. ", "My code is X-9, my code is X-9! ", "Bye"]
    seen = spark.createDataFrame([("g",), ("l",)], "fact string")
    shown = {r.start: (r.facts, r.hidden, r.shown) for r in passages.visibility(parts, spans, seen).collect()}
    assert shown == {0: (2, 0, True), 12: (1, 1, False), 44: (0, 0, True)}
    out = passages.redacted(parts, spans.where("fact in ('f', 'g')"), m).collect()
    assert {(r.start, r.text, r.state) for r in out} == {(0, "I ", "active"), (12, "My  […] , my ", "active")}
    whole = spark.createDataFrame([("m", 0, 12), ("m", 3, 5), ("m", 8, 20)], "source string, start int, stop int")
    out = {r.start: (r.fragments, r.text, r.state) for r in passages.redacted(parts, whole, m).collect()}
    assert out[0] == (0, "", "erased") and out[12][0] == 1
    assert passages.visibility(passages.passages(m.where("false")), spans.where("false"), seen).count() == 0


def test_replays_and_mentions(spark):
    facts = spark.createDataFrame(
        [("a", "u", "s", "ZX 482", "the code is ZX-482", 5), ("b", "u", "t", "", "says zx 482 again", 5), ("c", "u", "s", "NEW", "the code is NEW", 5),
         ("d", "v", "s", "ZX 482", "ZX 482", 5), ("e", "u", "s", "ZX 482", "x", 1), ("f", "u", "s", "zx_482", "x", 9), ("g", None, "s", "ZX 482", None, None)],
        "id string, tenant string, slot string, value string, content string, arrived long",
    )
    marks = spark.createDataFrame([("u", "s", "ZX 482", 3, 8), (None, "s", "ZX 482", 0, None), ("u", "s", "", 0, None)], "tenant string, slot string, v string, made long, lifted long")
    marks = marks.select("tenant", "slot", lx.value_digest(F.col("v")).alias("value_hash"), F.size(lx.value_words(F.col("v"))).alias("words"), "made", "lifted")
    assert {(r.id, r.markers) for r in erasure.blocked(facts, marks).collect()} == {("a", 1), ("b", 1)}
    docs = spark.createDataFrame([(1, "u", "plum cake with cream"), (2, "u", "a cake"), (3, "v", "cake plum"), (4, "u", None)], "doc int, tenant string, text string")
    phrases = spark.createDataFrame([("p", "u", ["cake", "plum"]), ("q", "u", ["cake"]), ("r", "u", []), ("s", "u", ["fig"])], "phrase string, tenant string, words array<string>")
    assert {tuple(r) for r in erasure.mentioning(docs, phrases).collect()} == {(1, "p"), (1, "q"), (2, "q")}


def test_interval_verdicts(spark):
    rows = [("s", "Oslo", 0, None, "1"), ("s", "Bergen", 10, None, "2"), ("s", "bergen ", 12, None, "3"), ("t", "A", 0, 20, "4"), ("t", "B", 10, 30, "5"), ("t", "C", 40, 39, "6"), ("u", "A", None, 3, "7"), ("u", "", 1, 3, "8"), ("v", "A", 5, 9, "9"), ("v", "B", 9, 12, "10")]
    df = spark.createDataFrame(rows, "slot string, v string, a long, z long, id string").withColumn("next", F.lit("clash"))
    out = {r.id: (r.verdict, r.ended) for r in lifecycle.overlaps(df, ["slot"], "v", "a", "z").collect()}
    assert out == {"1": ("superseded", 10), "2": ("active", None), "4": ("conflicted", None), "5": ("conflicted", None), "6": ("active", None), "9": ("superseded", 9), "10": ("active", None)}


def test_events_options_and_demotion(spark):
    facts = spark.createDataFrame([("a", "likes tea", "confirmed", "active"), ("b", "old", "confirmed", "erased"), ("c", "hid", "confirmed", "active")], "fact string, content string, modality string, state string")
    events = spark.createDataFrame([("1", "update", ["b", "a"], ["a"]), ("2", "forget", ["c"], []), ("3", "remember", None, ["zz"])], "id string, type string, before array<string>, after array<string>")
    seen = spark.createDataFrame([("a",), ("b",)], "fact string")
    out = {r.id: r.shown for r in lifecycle.project_events(events, facts, seen).collect()}
    assert out == {
        "1": "update before: [unavailable] | likes tea (confirmed; active) after: likes tea (confirmed; active)",
        "2": "forget before: [unavailable] after: [none]", "3": "remember before: [none] after: [unavailable]",
    }
    assert one(spark, lifecycle.options(F.col("t")), t="Which would you choose: 60143, or 60148?") == ["60143", "60148"]
    assert one(spark, lifecycle.options(F.col("t")), t="How are you?") == []
    level = lambda c, v, t: one(spark, lifecycle.match_level(F.lit(c), F.lit(v), F.col("t")), t=t)
    assert level("60148", "60148", "") == 1 and level("60143", "60148", "lives at 60148") == 0 and level("60148", "", "lives at 60148") == 1
    assert level("the red bicycle near the old bridge", "", "a red bicycle stands near that old bridge") == 4
    d = lambda s, names, own: one(spark, fusion.demotion(F.col("t"), F.array(*map(F.lit, names)).cast("array<string>"), F.lit(own)), t=s)
    assert (d("user", ["ann"], False), d("user", ["ann"], True), d("ann", ["ann"], True), d("bob", ["ann"], True), d("bob", [], True), d("bob", [], False), d("assistant", [], True)) == (0.3, 1.0, 1.0, 0.3, 0.3, 1.0, 0.3)


def test_mixed_range_operators():
    with pytest.raises(ValueError):
        filters.compile_filter({"n": {"gte": 1, "ne": 2}}, strict=True)
    filters.compile_filter({"n": {"gte": 1, "lt": 2}}, strict=True)


def test_optimistic_writes(spark):
    held = spark.createDataFrame([("a", 3), ("b", 1)], "id string, held long")
    writes = spark.createDataFrame([("a", 3), ("a", 3), ("a", 2), ("b", 0), ("c", 0), ("d", None)], "id string, expected long")
    out = {r.id: (r.accepted, r.conflicts) for r in store.compare_and_set(held, writes).collect()}
    assert out == {"a": (1, 2), "b": (0, 1), "c": (1, 0), "d": (0, 1)}


def test_index_upsert(spark):
    docs = spark.createDataFrame([(1, "red house"), (2, "blue house"), (3, None)], "id int, t string")
    index = lexical.postings(docs, "id", F.col("t"))
    new = spark.createDataFrame([(2, "green garden"), (4, "red"), (1, None), (None, "x")], "id int, t string")
    got = {(r.doc, r.term) for r in lexical.upsert_postings(index, new, "id", F.col("t")).collect()}
    assert got == {(2, "green"), (2, "garden"), (4, "red")}


def test_long_dependency_chain(spark):
    needs = spark.createDataFrame([(str(i + 1), str(i)) for i in range(5)] + [("x", "y"), ("y", "x")], "id string, needs string")
    got = {r.id for r in graph.invisible_closure(spark.createDataFrame([("0",), ("x",)], "id string"), needs).collect()}
    assert got == {str(i) for i in range(6)} | {"x", "y"}


def test_chunks_of_a_hot_key(spark):
    # one key has most rows and crosses many chunks; null is a key, too
    rows = [("hot" if i % 5 else None if i % 2 else "cold", i, (i * 7) % 100, float(i) if i % 9 == 0 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, made long, v double").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        line = {r.seq: r.valid_to for r in state.timeline(df, ["k"], ["seq"], "made").collect()}
        fill = {r.seq: r.x for r in state.forward_fill(df, ["k"], ["seq"], F.col("v"), "x").collect()}
        late = {r.seq: r.newest for r in state.late_rows(df, ["k"], ["seq"], "made").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    top, last, nxt = {}, {}, {}
    for k, seq, made, v in rows:
        last[k] = v if v is not None else last.get(k)
        assert fill[seq] == last[k]
        assert late.get(seq) == (top[k] if k in top and made < top[k] else None)
        top[k] = max(made, top.get(k, made))
    for k, seq, made, _ in reversed(rows):
        assert line[seq] == nxt.get(k)
        nxt[k] = made
