import random

import pytest
from pyspark.sql import functions as F

from memloom.llm import pii, pii_field
from memloom.llm.pii_candidates import Names, fold, units

GIVEN = "Orla Bram Ilse Maren Petra Anselm Idris Svea Grace Will Rose May Hope".split()
FAMILY = "Venn Brisko Dubrel Almeno Straaten Skelmer Zielbrand Lantern Harrow".split()
LEXICON = [(n, "given") for n in GIVEN] + [(n, "family") for n in FAMILY]


def sample(n=3000, seed=4):
    """Texts of templates with their spans; names outside the directory occur too."""
    r = random.Random(seed)
    given, family = GIVEN + ["Quorin", "Tessaly"], FAMILY + ["Dornach", "Ulvestad"]
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    texts = []
    for _ in range(n):
        name = f"{r.choice(given)} {r.choice(family)}"
        name = r.choice([name, name.upper(), name.lower(), ", ".join(name.split()[::-1])])
        phone = r.choice([f"+1 415-555-{d(4)}", f"(617) 555-{d(4)}", f"07700 {d(6)}", "three oh five, five five five, oh one three one"])
        ssn = r.choice([f"9{d(2)}-{d(2)}-{d(4)}", f"K{d(8)}", f"QQ {d(2)} {d(2)} {d(2)} C"])
        mail = r.choice([f"{fold(name.split()[0]).strip(',')}{d(2)}@example.org", "rose+notes AT inbox DOT test", "m.venn[at]mail.example"])
        place = r.choice([f"{d(2)} Old Quarry Street", f"Ahorngasse {d(3)}", f"Calle Mayor {d(2)}", f"{d(2)}, rue des Tilleuls"])
        pick = r.randrange(9)
        parts, spans = [], []
        forms = [
            ["My passport number is ", ("id_number", ssn), "."], ["Call ", ("person_name", name), " at ", ("phone", phone), " today."],
            ["Write to ", ("email", mail), " please."], ["We now live at ", ("address", place), "."], ["Mrs ", ("person_name", name), " rang twice."],
            [f"The order number is {d(4)} {d(4)} {d(4)}."], [f"Ticket INC-{d(6)} is open, page {d(3)}-{d(3)}."],
            ["Rose said hello. The May Day parade starts at gate 23."], ["Contact: ", ("person_name", name), ", ", ("address", place), ", ", ("phone", phone)],
        ]
        for p in ["We spoke. "] * r.randrange(2) + forms[pick]:
            if isinstance(p, tuple):
                at = sum(map(len, parts))
                spans.append((p[0], at))
                p = p[1]
            parts.append(p)
        texts.append(("".join(parts), spans))
    return texts


@pytest.fixture(scope="module")
def model():
    return pii.train([t for t, _ in sample()], LEXICON)


def test_names_outside_the_directory_are_learned(model):
    assert {"quorin", "tessaly"} <= model.names.given and {"dornach", "ulvestad"} <= model.names.family
    assert "said" not in model.names.known and "day" not in model.names.known


def test_held_out_accuracy(model):
    rows = sample(2000, seed=99)
    found = pii.tag([t for t, _ in rows], model)
    want = {(i, *s) for i, (_, spans) in enumerate(rows) for s in spans}
    got = {(i, k, a) for i, spans in enumerate(found) for k, a, _ in spans}
    hit = len(want & got)
    assert hit / len(want) > 0.97 and hit / len(got) > 0.97


def test_skip_links_carry_a_label(model):
    # a bare number gets its label from an equal one far away that has a cue
    text = "My passport number is K12345678. " + "We spoke about it. " * 30 + "K12345678"
    kinds = [k for k, _, _ in pii.tag([text], model)[0]]
    assert kinds == ["id_number", "id_number"]


NUMBER = ["My passport number is 47110815.", "We noted 47110815 again.", "We noted 47110815 again."]


def test_a_label_flips_only_through_the_skip_edge(model):
    # the second text shares its document with the first, the third, which is equal, does not
    kinds = lambda **kw: [[k for k, _, _ in r] for r in pii.tag(NUMBER, model, ["a", "a", "b"], **kw)]
    assert kinds() == [["id_number"], ["id_number"], []]
    assert kinds(skips=False) == [["id_number"], [], []]


def test_group_messages_equal_all_pairs(model):
    texts = [t for t, _ in sample(60, seed=3)]
    b = pii_field.Batch(texts, model, [i % 3 for i in range(len(texts))])
    at = pii_field.beliefs(b, model)
    sent = pii_field.messages(b, model, at)
    got = pii_field.sums(sent, b.group, b.groups)[b.group] - sent
    for i in range(len(b.member)):
        want = sum((sent[j] for j in range(len(b.member)) if j != i and b.group[j] == b.group[i]), 0 * sent[i])
        assert abs(got[i] - want).max() < 1e-6


def test_inner_tags_follow_their_first(model):
    b = pii_field.Batch([t for t, _ in sample(400, seed=6)], model)
    tags = pii_field.infer(b, model).argmax(axis=1)
    for i in (tags >= pii_field.T).nonzero()[0]:
        assert b.gap[i] == pii_field.INSIDE and pii_field.TYPE_OF[tags[i - 1]] == pii_field.TYPE_OF[tags[i]]


def test_odd_texts(model):
    long = "word " * 200_000 + "Call Orla Venn at +1 415-555-0101."
    rows = ["", " \n", "@@@ [at] (at) 12", "(415-555-0199)", long, "\u0000￿", "a" * 300_000]
    out = pii.tag([*rows, *rows[:2]], model)
    assert [len(x) for x in out[:3]] == [0, 0, 0]
    assert {k for k, _, _ in out[4]} == {"person_name", "phone"}
    assert pii.tag([], model) == []
    assert pii.tag(["Call Orla Venn."], pii.train([], LEXICON)) is not None


def test_units_do_not_overlap():
    names = Names(frozenset(map(fold, GIVEN)), frozenset(map(fold, FAMILY)))
    for t, _ in sample(300, seed=8):
        u = units(t, names)
        assert all(a.end <= b.start for a, b in zip(u, u[1:]))
        assert all(t[x.start : x.end] == x.text for x in u)


def test_tables(spark):
    texts = [t for t, _ in sample(400, seed=5)]
    messages = spark.createDataFrame(
        [(f"m{i}", t, None) for i, t in enumerate(texts)] + [("b", None, '{"content": "Write to orla.venn@example.org please."}'), ("bad", None, '{"content": "x@y.zz'), (None, None, None), ("m0", texts[0], None)],
        "id string, content string, body string",
    ).withColumn("text", F.lit("clash"))
    facts = spark.createDataFrame([("f", [None, "", "Call Orla Venn at +1 415-555-0101."]), ("g", None), ("h", [])], "id string, source_quotes array<string>")
    lexicon = spark.createDataFrame([*LEXICON, (None, "given"), ("X", None)], "name string, name_kind string")
    out = pii.found(messages, facts, lexicon).collect()
    assert len(out) == len(set(out))
    assert ("facts", "f", "source_quotes", 2, "person_name", 5) in {tuple(r) for r in out}
    assert ("messages", "b", "body", 0, "email", 9) in {tuple(r) for r in out}
    clean = {(r.record_id, r.elem): r.text for r in pii.redacted(messages, facts, lexicon).collect()}
    assert clean["f", 2] == "Call [PERSON_NAME] at [PHONE]."
    assert clean["b", 0] == "Write to [EMAIL] please."
    assert pii.found(messages.where("false"), facts.where("false"), lexicon).count() == 0


def test_sessions_share_evidence(spark, model):
    rows = [("m1", "S ", NUMBER[0]), ("m2", "s", NUMBER[1]), ("m2", "s", NUMBER[1]), ("m3", "other", NUMBER[2]), ("m4", None, NUMBER[2])]
    messages = spark.createDataFrame(rows, "id string, session_id string, content string").withColumn("body", F.lit(None).cast("string"))
    facts = spark.createDataFrame([("f", NUMBER[1:])], "id string, source_quotes array<string>")
    texts = pii.texts_of(messages, facts).withColumn("h", F.xxhash64("text")).withColumn("x", pii.tagger(model, spark)("text"))
    looked = texts.select(*pii.ROW, "text", "x.spans", "x.mentions")
    alone = {r.record_id: len(r.spans) for r in looked.collect()}
    assert alone == {"m1": 1, "m2": 0, "m3": 0, "m4": 0, "f": 0}
    agreed = {r.doc: [s.pii_type for s in r.spans] for r in pii.share_evidence(looked, model).where("size(spans) > 0").collect()}
    assert agreed == {"s:s": ["id_number"]}
    both = pii.share_evidence(looked, model).where("doc = 's:s'").collect()
    assert len(both) == 2 and all(len(r.spans) == 1 for r in both)


def test_names_are_learned_from_all_texts(spark):
    texts = [f"I met {g} Okonwe {n} times" for n, g in enumerate(("Ann", "Bob", "Cid"))] + [f"Nothing here {i}" for i in range(40)]
    m = spark.createDataFrame([(str(i), t, None) for i, t in enumerate(texts)], "id string, content string, body string")
    f = spark.createDataFrame([], "id string, source_quotes array<string>")
    lexicon = spark.createDataFrame([(n, "given") for n in ("Ann", "Bob", "Cid")], "name string, name_kind string")
    names = pii.fit_model(pii.texts_of(m, f), 99, lexicon, sample=2).names  # the draw of two texts cannot hold three partners
    assert "okonwe" in names.family
    same = pii.learn_names(texts, *pii.directory([(n, "given") for n in ("Ann", "Bob", "Cid")]))
    assert names == same and "nothing" in names.common
