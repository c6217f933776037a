import random

import numpy as np
from pyspark.sql import functions as F

from memloom.llm import subjects

TERMS = {
    "en": {"law": "court judge contract appeal clause statute", "food": "bread soup oven recipe dough spice", "sport": "match goal relay coach league striker"},
    "de": {"law": "Gericht Richter Vertrag Berufung Klausel Gesetz", "food": "Brot Suppe Ofen Rezept Teig Gewürz", "sport": "Spiel Tor Staffel Trainer Liga Stürmer"},
}
SHAPES = {
    "en": ["Last week I told you about the {} and the {}.", "Do you remember our {}?", "The {} again, with another {}."],
    "de": ["Letzte Woche ging es um {} und {}.", "Hast du noch etwas über {}?", "Schon wieder {}, dazu {}."],
}
TALK = {"en": ["No rush at all.", "Let me think about it.", "Thanks, that is all for now."], "de": ["Es eilt nicht.", "Machen wir morgen weiter.", "Danke, das war alles."]}


def corpus(n, seed):
    r = random.Random(seed)
    docs = []
    for _ in range(n):
        lang = "de" if r.random() < 0.25 else "en"
        areas = r.sample(sorted(TERMS[lang]), r.choice([0, 1, 1, 1, 2]))
        lines = [r.choice(SHAPES[lang]).format(*[r.choice(TERMS[lang][a].split()) for _ in range(2)]) for a in areas for _ in range(r.randrange(5, 8))]
        lines += [r.choice(TALK[lang]) for _ in range(r.randrange(2, 6))]
        r.shuffle(lines)
        docs.append((" ".join(lines), set(areas), lang))
    return docs


def learned(texts, labels, names, langs=None):
    """A function from texts to their subjects."""
    sample = subjects.Sample(texts, langs)
    model = subjects.fit(sample, labels, names)
    return lambda new: subjects.assign(subjects.encode(new, sample.vocabulary), model)


def fitted(labelled=400, noise=0.05, seed=1):
    r = random.Random(seed)
    docs = corpus(1200, seed)
    names = sorted(TERMS["en"])
    labels = [(set([r.choice(names)]) if r.random() < noise else a) if i < labelled else set() for i, (_, a, _) in enumerate(docs)]
    return learned([t for t, _, _ in docs], labels, names, [g for _, _, g in docs])


def test_held_out_accuracy():
    model = fitted()
    docs = corpus(600, 77)
    out = model([t for t, _, _ in docs])
    want, got = [a for _, a, _ in docs], [set(o) for o in out]
    hit = sum(len(a & b) for a, b in zip(want, got))
    assert hit / sum(map(len, got)) > 0.97 and hit / sum(map(len, want)) > 0.97
    assert all(not o for o, a in zip(out, want) if not a)


def test_odd_texts():
    model = fitted(200)
    out = model(["", None, " \n ", "zzz qqq.", "1234 !!", "The court and the judge. " * 20_000])
    assert out[:5] == [[], [], [], [], []] and out[5] == ["law"]
    assert model([]) == []
    assert learned([], [], ["law"], [])(["The court."]) == [[]]
    assert learned(["The court."], [set()], [], ["en"])(["The court."]) == [[]]


def test_background_is_interpolated():
    p = subjects.word_model(np.array([0, 0, 2.0, 1, 0]), None)
    assert abs(p.sum() - 1) < 1e-9 and p.min() > 0
    q = subjects.word_model(np.array([0, 0, 0, 1.0, 0]), p)
    assert abs(q.sum() - 1) < 1e-9 and q[3] > p[3]
    # pairs that repeat get weight, pairs that occur once do not predict themselves
    low = np.array([0.1, 0.1])
    assert (subjects.interpolated(np.array([9.0, 1.0]), np.array([10.0, 10.0]), low) > low * 0.9).all()
    assert np.allclose(subjects.interpolated(np.array([1.0, 1.0]), np.array([2.0, 2.0]), low), low)


def test_background_counts_all_documents(spark):
    docs = corpus(300, 9)
    sample = subjects.Sample([t for t, _, _ in docs[:60]], [g for _, _, g in docs[:60]])
    df = spark.createDataFrame([(i, t, g, "s") for i, (t, _, g) in enumerate(docs)], "doc_id long, text string, lang string, source string").repartition(5)
    subjects.count_background(subjects.encoded_documents(df, sample.vocabulary), sample)
    c = subjects.Corpus(subjects.encode([t for t, _, _ in docs], sample.vocabulary))
    lang = subjects.spoken(c, sample.tongue)[c.sent]
    for l, t in enumerate(sample.tongues):
        assert np.allclose(t.words, subjects.word_model(np.bincount(c.w[lang == l], minlength=sample.n).astype(float), None))


def test_tables(spark):
    docs = corpus(500, 5)
    df = spark.createDataFrame([(i, t, g.upper() if i % 9 == 0 else g, "Src " if i % 2 else "src") for i, (t, _, g) in enumerate(docs)] + [(900, None, None, None), (901, " ", "en", "x"), (None, "The court.", "en", "x")], "doc_id long, text string, lang string, source string")
    df = df.withColumn("areas", F.lit("clash"))
    labels = spark.createDataFrame([(i, f" {a.upper()}", "ann") for i, (_, s, _) in enumerate(docs[:300]) for a in s] * 2 + [(None, "law", "x"), (5, None, "x")], "doc_id long, subject string, annotator string")
    names = spark.createDataFrame([(s,) for s in TERMS["en"]] + [(None,)], "subject string")
    out = subjects.document_subjects(df, labels, names).cache()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(got.get(i, set()) == s for i, (_, s, _) in enumerate(docs)) > 485
    assert not {900, 901} & set(got)
    assert {r.source for r in subjects.composition(out).collect()} == {"src"}
    assert subjects.document_subjects(df.where("false"), labels, names).count() == 0
    assert subjects.document_subjects(df, labels.where("false"), names).count() == 0
