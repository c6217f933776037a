"""Personal data in free text, found by the skip-chain field of ``pii_field``.

``pii_candidates`` proposes units (mail-like strings, numbers, street phrases, name phrases), whose
tokens the field tags. The document of a message is its session, that of a quote its fact: what one
message says of a number or a name reaches its repeats in all others of the session.

Texts are first tagged where they lie. Mentions then send their messages to their group in the document
by an aggregate, only groups with several mentions stay, and the texts those link are tagged again with
what they receive, twice. So no step gathers a session.

There are no hand labels, so the weights are trained on weak ones: cue words next to a unit label it
in a bounded sample of texts (``SAMPLE``, whole documents), and rounds of self-training add the tokens the
model is sure of. Name words are learned from the counts of all texts. The trained model is small (its
vocabulary is that of the sample and the names) and goes to the tasks as a broadcast.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import key
from ..sources.tables import materialize, spread
from .pii_candidates import LABELS, LETTERS, MAIL, Names, fold
from .pii_field import SKIP_ROUNDS, T, Batch, Model, beliefs, decode, fit, infer, messages as sent_messages, softmax, sums

#: Texts that the model is trained on: those of the documents with the smallest hashes, at most so many.
SAMPLE = 30_000
#: Marginals from which a token without a weak label joins the training set, by round of self-training.
SURE = (0.9, 0.8)


def company(texts: Iterable[str], given: set[str], family: set[str]) -> Counter:
    """Counts by (kind, word, partner): ``t`` of each word, ``f`` and ``g`` of a word beside a directory name of the other
    kind, ``F`` and ``G`` of one beside a name of its own kind, ``n`` of the texts."""
    known = given | family
    out: Counter = Counter()
    for t in texts:
        out["n", "", ""] += 1
        mails = [m.span() for m in MAIL.finditer(t)] if "@" in t or "\uff20" in t or "[" in t else []
        toks = [(m.start(), m.end(), fold(m[0])) for m in LETTERS.finditer(t) if not any(a <= m.start() < b for a, b in mails)]
        out.update(("t", w, "") for _, _, w in toks)
        for (_, e, a), (s, _, b) in zip(toks, toks[1:]):
            if a not in known and b not in known or t[e:s] not in (" ", ", ", "-"):
                continue
            if b not in known:
                out[("f", b, a) if a in given else ("F", b, "")] += 1
            if a not in known:
                out[("g", a, b) if b in family else ("G", a, "")] += 1
    return out


def corpus_names(texts: DataFrame, given: set[str], family: set[str]) -> Names:
    """The directory's names, name words that keep company with many of them, and common words of all texts (text).

    A word counts as a family name if it often follows given names of the directory, at least three different
    ones (and as a given name the other way round): a fixed phrase with one name word teaches nothing. A word
    that meets the other kind as often introduces or follows whole names and is none itself. Words are common
    from 3 uses in ``SAMPLE`` texts on, so their list is bounded whatever the number of texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(*k, n) for k, n in company(pdf["text"], given, family).items()], columns=["kind", "word", "partner", "n"])

    pairs = texts.mapInPandas(count, "kind string, word string, partner string, n long").groupBy("kind", "word", "partner").agg(F.sum("n").alias("n"))
    of = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")).otherwise(0))
    cols = [of("t").alias("total"), of("n").alias("texts")]
    for side in "fg":
        cols += [of(side).alias(side), of(side.upper()).alias(f"{side}_outside"), F.count(F.when(F.col("kind") == side, 1)).alias(f"{side}_partners")]
    words = materialize(pairs.groupBy("word").agg(*cols))
    n = words.agg(F.sum("texts")).first()[0] or 0
    new = lambda side: (F.length("word") > 2) & (F.col(f"{side}_partners") >= 3) & (F.col(side) >= 0.2 * F.col("total")) & (F.col(side) > 2 * F.col(f"{side}_outside"))
    words = words.select("word", new("g").alias("given"), new("f").alias("family"), (F.col("total") >= 3 * max(1.0, n / SAMPLE)).alias("common"))
    rows = words.where("given or family or common").collect()
    given, family = given | {r.word for r in rows if r.given}, family | {r.word for r in rows if r.family}
    return Names(frozenset(given), frozenset(family), frozenset({r.word for r in rows if r.common} - given - family))


def learn_names(texts: list[str], given: set[str], family: set[str]) -> Names:
    """``corpus_names`` of a list of texts."""
    total, outside = Counter(), Counter()
    beside: dict[tuple[str, str], Counter] = defaultdict(Counter)
    for (kind, w, partner), n in company(texts, given, family).items():
        if kind == "t":
            total[w] = n
        elif kind in "fg":
            beside[kind, w][partner] = n
        elif kind != "n":
            outside[kind.lower(), w] = n
    new = {"g": set(), "f": set()}
    for (side, w), partners in beside.items():
        n = sum(partners.values())
        if len(w) > 2 and len(partners) >= 3 and n >= 0.2 * total[w] and n > 2 * outside[side, w]:
            new[side].add(w)
    given, family = given | new["g"], family | new["f"]
    common = {w for w, n in total.items() if n >= 3} - given - family
    return Names(frozenset(given), frozenset(family), frozenset(common))


def directory(lexicon: list[tuple[str, str]]) -> tuple[set[str], set[str]]:
    """Folded given and family names of the directory."""
    return {fold(n) for n, k in lexicon if n and k == "given"}, {fold(n) for n, k in lexicon if n and k == "family"}


def train(texts: list[str], lexicon: list[tuple[str, str]], names: Names | None = None, docs: list | None = None) -> Model:
    """Model from sample texts and the name directory; without texts it still knows fixed forms' absence.

    ``names`` are those of the whole corpus; without them they are learned from the sample texts.
    ``docs`` tells which texts form a document.
    """
    names = names or learn_names(texts, *directory(lexicon))
    model = Model(names, {}, {}, *(np.zeros(0) for _ in range(4)))
    b = Batch(texts, model, docs, grow=True)
    model = fit(b, b.weak, model)
    for least in SURE if (b.weak >= 0).any() else ():
        sure = softmax(infer(b, model))
        model = fit(b, np.where(b.weak >= 0, b.weak, np.where(sure.max(axis=1) >= least, sure.argmax(axis=1), -1)), model)
    return model


def tag(texts: list[str], model: Model, docs: list | None = None, skips: bool = True) -> list[list[tuple[str, int, int]]]:
    """(type, start, end) of the personal data in each text; texts of one document (``docs``) share evidence.

    Equal texts of a document are one. Without ``skips`` the skip potentials are left out.
    """
    of = list(zip(docs, texts)) if docs else [(t, t) for t in texts]
    order = {x: i for i, x in enumerate(dict.fromkeys(x for x in of if x[1]))}
    b = Batch([t for _, t in order], model, [d for d, _ in order])
    found = decode(b, infer(b, model, skips)) if b.n else [[] for _ in order]
    return [found[order[x]] if x[1] else [] for x in of]


SPANS = "array<struct<pii_type: string, start_pos: bigint, end_pos: bigint>>"
MENTIONS = "array<struct<n: int, mark: string, told: array<double>>>"
#: What tells a text of the tables from all others but copies of its row.
ROW = ["source_table", "record_id", "field", "elem", "doc", "h"]


def texts_of(messages: DataFrame, facts: DataFrame) -> DataFrame:
    """Every text to search, one row each: source_table, record_id, field, elem, doc, text.

    Null texts, unreadable JSON and null elements have none; an empty table adds no rows. ``doc`` is the
    session of a message (the message itself if it has none) and the fact of a quote.
    """
    part = lambda f, t: F.struct(F.lit(f).alias("field"), t.alias("text"))
    session = key(F.col("session_id")) if "session_id" in messages.columns else F.lit(None).cast("string")
    own = lambda kind: F.concat(F.lit(kind), F.coalesce(F.col("id").cast("string"), F.lit("")))
    m = messages.select(
        F.col("id").alias("record_id"), F.coalesce(F.concat(F.lit("s:"), session), own("m:")).alias("doc"),
        F.explode(F.array(part("content", F.col("content")), part("body", F.get_json_object("body", "$.content")))).alias("p"),
    )
    m = m.select(F.lit("messages").alias("source_table"), "record_id", "p.field", F.lit(0).cast("long").alias("elem"), "doc", "p.text")
    q = facts.select(F.col("id").alias("record_id"), own("f:").alias("doc"), F.posexplode("source_quotes").alias("elem", "text"))
    q = q.select(F.lit("facts").alias("source_table"), "record_id", F.lit("source_quotes").alias("field"), F.col("elem").cast("long").alias("elem"), "doc", "text")
    return m.unionByName(q).where("text is not null and text <> ''")


def fit_model(texts: DataFrame, rows: int, lexicon: DataFrame, sample: int = SAMPLE) -> Model:
    """Train on at most ``sample`` texts of whole documents, drawn by hash; names are learned from all distinct texts.

    ``rows`` is an upper estimate of the number of texts; the share of hashes to take follows from it, so every task
    passes on only its part of about twice the sample however many tasks there are.
    """
    share = min(1.0, 2 * sample / max(1, rows))
    h = F.xxhash64("doc")
    picked = texts.select("doc", "text").where(F.pmod(h, F.lit(1_000_000)) < int(share * 1_000_000) + 1).distinct()
    got = sorted((r[0], r[1]) for r in picked.orderBy(h, "doc", F.xxhash64("text"), "text").limit(sample).collect())
    pairs = [(r[0], (r[1] or "").strip().lower()) for r in lexicon.select("name", "name_kind").collect()]
    return train([t for _, t in got], pairs, corpus_names(texts.select("text").distinct(), *directory(pairs)), [d for d, _ in got])


def tagger(model: Model, spark) -> callable:
    """Column function text -> struct of spans (array of pii_type, start_pos, end_pos) and mentions with their messages.

    Each text is tagged by itself here; equal texts of an Arrow batch once.
    """
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(f"struct<spans: {SPANS}, mentions: {MENTIONS}>")
    def look(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            order = {t: i for i, t in enumerate(dict.fromkeys(s))}
            spans, mentions = once(list(order), shared.value)
            at = [order[t] for t in s]
            yield pd.DataFrame({"spans": [spans[i] for i in at], "mentions": [mentions[i] for i in at]})

    return look


def once(texts: list[str], model: Model, incoming: list[dict[int, np.ndarray]] | None = None) -> tuple[list, list]:
    """Spans and mentions of each text, given the messages that its mentions received (by number)."""
    b = Batch(texts, model)
    mentions: list[list] = [[] for _ in texts]
    if not b.n:
        return [[] for _ in texts], mentions
    first: dict[int, int] = {}
    number = []
    for d, _ in b.marks:
        number.append(first.get(d, 0))
        first[d] = number[-1] + 1
    received = None
    if incoming is not None:
        zero = np.zeros(T)
        received = np.array([incoming[d].get(n, zero) for (d, _), n in zip(b.marks, number)]).reshape(-1, T)
    log_belief = beliefs(b, model, None if received is None else sums(received, b.member, b.n))
    told = sent_messages(b, model, log_belief, received) if len(b.member) else []
    for (d, mark), n, row in zip(b.marks, number, told):
        mentions[d].append({"n": n, "mark": mark, "told": row.tolist()})
    spans = [[{"pii_type": k, "start_pos": x, "end_pos": y} for k, x, y in r] for r in decode(b, log_belief)]
    return spans, mentions


def share_evidence(looked: DataFrame, model: Model) -> DataFrame:
    """Spans of the texts whose mentions repeat in their document, after all rounds: doc, h, spans.

    ``looked`` has doc, h (hash of the text), text, and mentions. Copies of a text in a document count once.
    A group of mentions is an aggregate with map-side combine, so a number that a third of all rows
    repeat costs a row per task; only its mentions then meet the group's sum.
    """
    shared = looked.sparkSession.sparkContext.broadcast(model)
    of = ["doc", "h"]
    one = looked.where(F.size("mentions") > 0).groupBy(*of).agg(F.first("text").alias("text"), F.first("mentions").alias("mentions"))
    told = [F.element_at("m.told", k + 1).alias(f"t{k}") for k in range(T)]
    flat = lambda df: df.select(*of, F.explode("mentions").alias("m")).select(*of, "m.n", "m.mark", *told)
    first = materialize(flat(one))
    repeated = materialize(first.groupBy("doc", "mark").agg(F.count("*").alias("c")).where("c > 1").select("doc", "mark"))
    said = materialize(first.join(repeated, ["doc", "mark"]))
    linked = materialize(one.select(*of, "text").join(said.select(*of).distinct(), of, "left_semi"))

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [{r["n"]: np.array(r["v"]) for r in rows} for rows in pdf["incoming"]]
            spans, mentions = once(pdf["text"].tolist(), shared.value, got)
            yield pd.DataFrame({"doc": pdf["doc"], "h": pdf["h"], "text": pdf["text"], "spans": spans, "mentions": mentions})

    out = linked
    for _ in range(SKIP_ROUNDS):
        whole = said.groupBy("doc", "mark").agg(*[F.sum(f"t{k}").alias(f"s{k}") for k in range(T)])
        # the group's sum less the mention's own part is what the others tell it
        heard = said.join(whole, ["doc", "mark"]).select(*of, "n", F.array(*[F.col(f"s{k}") - F.col(f"t{k}") for k in range(T)]).alias("v"))
        heard = heard.groupBy(*of).agg(F.collect_list(F.struct("n", "v")).alias("incoming"))
        out = materialize(linked.join(heard, of).mapInPandas(again, f"doc string, h long, text string, spans {SPANS}, mentions {MENTIONS}"))
        said = flat(out).join(repeated, ["doc", "mark"])
    return out.select(*of, "spans")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its type in brackets and nothing else changed.

    Spans must not overlap and be in order; positions are characters, counted from 0.
    """
    n = F.size(spans)
    pieces = F.transform(
        spans,
        lambda s, i: F.concat(
            F.substring(text, F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end_pos"] + 1).cast("int"), (s["start_pos"] - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end_pos"])).cast("int")),
            F.lit("["), F.upper(s["pii_type"]), F.lit("]"),
        ),
    )
    tail = F.substring(text, (F.get(spans, n - 1)["end_pos"] + 1).cast("int"), F.length(text))
    return F.when(n > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)


def tagged(messages: DataFrame, facts: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, Model]:
    """All texts, and those in which something was looked at: ``ROW`` columns, text and ``spans``.

    Also gives the model.
    """
    texts = texts_of(messages, facts)
    model = fit_model(texts, 2 * messages.count() + facts.count(), lexicon, sample)
    kept = [c for c in ("id", "session_id", "content", "body") if c in messages.columns]
    rows = texts_of(spread(messages.select(*kept)), spread(facts.select("id", "source_quotes"))).withColumn("h", F.xxhash64("text"))
    looked = rows.withColumn("x", tagger(model, messages.sparkSession)("text")).select(*ROW, "text", "x.spans", "x.mentions")
    looked = materialize(looked.where(F.size("spans") + F.size("mentions") > 0))
    linked = share_evidence(looked, model).withColumnRenamed("spans", "agreed")
    every = looked.join(linked, ["doc", "h"], "left")
    return rows, every.select(*ROW, F.coalesce("agreed", "spans").alias("spans")), model


def found(messages: DataFrame, facts: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per item: source_table, record_id, field, elem, pii_type, start_pos.

    Versions of a record that hold the same text give the same rows; those collapse.
    """
    _, rows, _ = tagged(messages, facts, lexicon, sample)
    rows = rows.select("source_table", F.col("record_id"), "field", "elem", F.explode("spans").alias("s"))
    return rows.select("source_table", "record_id", "field", "elem", "s.pii_type", "s.start_pos").distinct()


def redacted(messages: DataFrame, facts: DataFrame, lexicon: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Every text with typed placeholders: source_table, record_id, field, elem, text.

    Texts without findings pass as they are; equal rows stay as many as there were.
    """
    texts, rows, _ = tagged(messages, facts, lexicon, sample)
    hits = rows.where(F.size("spans") > 0).dropDuplicates(["doc", "h"]).select("doc", "h", "spans")
    out = texts.join(hits, ["doc", "h"], "left")
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("spans")))
    return out.select("source_table", "record_id", "field", "elem", clean.alias("text"))
