"""Subject areas of documents by per-subject n-gram language models.

Every subject has an interpolated bigram model of its sentences, small talk has one too, and a background
model covers all sentences of all documents. A sentence belongs to the subject whose per-token cross-entropy
on it is lowest, if that beats the background by a calibrated margin; a document gets every subject that a
calibrated share of its sentences belongs to, so it can have none, one or several.

The subject models are fitted on a bounded sample of documents (``LABELLED`` with hand labels, ``OTHERS``
without), which also fixes the vocabulary and the pairs that the models tell apart. Every document is then
encoded once in that vocabulary, the background is counted over all of them by an aggregate, and the
fitted models go to the tasks as one broadcast to score the encoded documents.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, spread

#: Bounds of the training sample, in documents (those with the smallest hashes).
LABELLED = 6_000
OTHERS = 3_000
ROUNDS = 5
#: Pseudo-count by which a subject's word estimates lean on the background's.
WORD_PRIOR = 200.0
#: A model never trusts its pairs alone, however well they predict.
MOST_PAIR_WEIGHT = 0.9
#: Log gain from which a sentence trains its subject's model.
SURE = 0.7
#: A language that fewer documents of the sample name is taken for a mistake.
LEAST_LANGUAGE = 5
#: One in so many labelled documents is held out of the fit for the calibration.
HELD_OUT = 5
#: Least gains over the background per token that the calibration tries.
MARGINS = (0.01, 0.02, 0.04, 0.06, 0.09, 0.12, 0.16, 0.2)
#: Shares of sentences that it tries. The statement of the problem says that no subject makes up between a tenth
#: and a quarter of a document, so they lie in that gap.
SHARES = (0.15, 0.175, 0.2)
#: Documents that are encoded or scored together.
CHUNK = 2_000

WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
HEADER = re.compile(r"^\s*(?:\[[^\]\n]*\]\s*)*(?:[-*•]\s+)?(?:\w{2,12}:\s+)?")
# a closing bracket ends a sentence only before a capital letter
ENDS = re.compile(r"(?<=[.!?…])[\s]+|(?<=\))\s+(?=[A-ZÀ-Ý¿¡(])|\n+")


@dataclass
class Model:
    """Log gains over the background, per language: of single words, and of known pairs (sorted codes).

    One column per subject and a last one for small talk, which also has a model.

    ``tongue`` has the log probability of each word in each language; a sentence is read in the
    language that makes it likeliest, so a subject is never mistaken for a language.
    """

    subjects: list[str]
    tongue: np.ndarray
    single: np.ndarray
    codes: np.ndarray
    pairs: np.ndarray
    margin: float
    share: float


def encode(texts: list[str | None], vocabulary: dict[str, int], grow: bool = False) -> list[list[int]]:
    """Word ids of each text, with 1 before each sentence; 0 is a word that is not in the vocabulary."""
    known: dict[str, list[int]] = {}
    out = []
    for t in texts:
        ids: list[int] = []
        for raw in ENDS.split(t or ""):
            got = known.get(raw)
            if got is None:
                words = WORD.findall(HEADER.sub("", raw, count=1).lower())
                got = [vocabulary.setdefault(w, len(vocabulary)) if grow else vocabulary.get(w, 0) for w in words]
                got = known[raw] = [1, *got] if got else got
            ids += got
        out.append(ids)
    return out


class Corpus:
    """Sentences of encoded documents as arrays of word ids."""

    def __init__(self, ids: list):
        flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if len(ids) else np.zeros(0, np.int64)
        opens = flat == 1
        inner = np.flatnonzero(~opens)
        self.w = flat[inner]
        # the word before; 1 stands for the start of a sentence
        self.v = flat[inner - 1]
        self.sent = (np.cumsum(opens) - 1)[inner]
        self.doc = np.repeat(np.arange(len(ids)), [len(x) for x in ids])[opens]
        self.size = np.bincount(self.sent, minlength=int(opens.sum()))
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]]).astype(np.int64) if len(self.size) else np.zeros(0, np.int64)


def languages(c: Corpus, langs: list[str | None], n: int) -> np.ndarray:
    """Log probability of each word in each language that enough documents name."""
    tidy = [(x or "").strip().lower() for x in langs]
    names = sorted({x for x in tidy if x and tidy.count(x) >= LEAST_LANGUAGE}) or [""]
    which = np.array([names.index(x) if x in names else -1 for x in tidy])[c.doc][c.sent]
    out = np.empty((n, len(names)))
    for l in range(len(names)):
        m = which == l if names != [""] else slice(None)
        counts = np.bincount(c.w[m], minlength=n)
        out[:, l] = np.log((counts + 0.05) / (counts.sum() + 0.05 * n))
    return out.astype(np.float32)


def spoken(c: Corpus, tongue: np.ndarray) -> np.ndarray:
    """Likeliest language of each sentence."""
    return np.add.reduceat(tongue[c.w], c.start).argmax(axis=1)


def word_model(counts: np.ndarray, base: np.ndarray | None) -> np.ndarray:
    """Word probabilities, interpolated with those of ``base`` (or with equal ones)."""
    prior = np.full(len(counts), 1 / len(counts)) if base is None else base
    size = 1.0 if base is None else WORD_PRIOR
    return (counts + size * prior) / (counts.sum() + size)


def interpolated(pairs: np.ndarray, context: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Probability of each pair's second word after its first, from counts of pairs and of their first words.

    The weight of the pair estimate comes from deleted interpolation: the part of all pair occurrences
    that the pair estimate, with the occurrence itself taken out, predicts better than ``low``.
    """
    seen = pairs / np.maximum(context, 1e-9)
    without = np.maximum(pairs - 1, 0) / np.maximum(context - 1, 1e-9)
    weight = min(MOST_PAIR_WEIGHT, pairs[(without > low) & (pairs > 1)].sum() / max(pairs.sum(), 1e-9))
    return weight * np.where(context > 0, seen, low) + (1 - weight) * low


class Tongue:
    """The sentences of one language: their words and pairs, and the background model."""

    def __init__(self, c: Corpus, rows: np.ndarray, n: int):
        mask = rows[c.sent]
        self.w, self.v, self.sent, self.n = c.w[mask], c.v[mask], c.sent[mask], n
        self.codes, self.pair = np.unique(self.v * n + self.w, return_inverse=True)
        self.pv, self.pw = self.codes // n, self.codes % n
        ones = np.ones(len(self.w))
        self.background(np.bincount(self.w, minlength=n), np.bincount(self.pair, weights=ones, minlength=len(self.codes)), np.bincount(self.v, minlength=n))

    def background(self, words: np.ndarray, pairs: np.ndarray, first: np.ndarray) -> None:
        """Set the background model from counts of words, of the known pairs, and of words as the first of a pair."""
        self.words = word_model(words.astype(float), None)
        self.pairs = interpolated(pairs.astype(float), first.astype(float)[self.pv], self.words[self.pw])

    def gains(self, weight: np.ndarray, with_pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Log gains of the model of the weighted sentences: of words and of pairs."""
        t = weight[self.sent]
        words = word_model(np.bincount(self.w, weights=t, minlength=self.n), self.words)
        if not with_pairs:
            return np.log(words) - np.log(self.words), None
        pairs = interpolated(np.bincount(self.pair, weights=t, minlength=len(self.codes)), np.bincount(self.v, weights=t, minlength=self.n)[self.pv], words[self.pw])
        return np.log(words) - np.log(self.words), np.log(pairs) - np.log(self.pairs)


class Sample:
    """Training documents: their vocabulary, languages, sentences and pairs."""

    def __init__(self, texts: list[str | None], langs: list[str | None] | None = None):
        self.vocabulary: dict[str, int] = {"": 0, "\n": 1}
        self.c = Corpus(encode(texts, self.vocabulary, grow=True))
        self.docs, self.n = len(texts), len(self.vocabulary)
        self.tongue = languages(self.c, langs or [None] * len(texts), self.n) if len(self.c.w) else np.zeros((self.n, 1), np.float32)
        lang = spoken(self.c, self.tongue) if len(self.c.w) else np.zeros(0, np.int64)
        self.tongues = [Tongue(self.c, lang == l, self.n) for l in range(self.tongue.shape[1])]
        self.codes = np.concatenate([l * self.n * self.n + t.codes for l, t in enumerate(self.tongues)])


def coded(c: Corpus, tongue: np.ndarray) -> np.ndarray:
    """Code of language, word before and word, for each word."""
    n = len(tongue)
    return (spoken(c, tongue)[c.sent] * n + c.v) * n + c.w


def fit(sample: Sample, labels: list[set[str]], subjects: list[str]) -> Model:
    """Model of all labelled documents, with margin and share calibrated on labels that a first fit did not see."""
    labelled = [d for d, x in enumerate(labels) if x & set(subjects)]
    if len(labelled) < 10 * HELD_OUT:
        return fit_on(sample, labels, subjects, labelled)
    held = labelled[::HELD_OUT]
    seen = set(labelled) - set(held)
    trial = fit_on(sample, [x if d in seen else set() for d, x in enumerate(labels)], subjects, held, labels)
    return replace(fit_on(sample, labels, subjects, []), margin=trial.margin, share=trial.share)


def fit_on(sample: Sample, labels: list[set[str]], subjects: list[str], tests: list[int], truth: list[set[str]] | None = None) -> Model:
    """Models from the sample's documents, of which some have labels (an empty set: none are known).

    The first models are those of the sentences of all documents with the label. Then sentences are
    reassigned to the subject that gains most over the background (in labelled documents mostly their labels,
    in others any subject the whole document favours) and the models re-estimated, so that small
    talk and wrongly labelled documents drop out. Margin and share are then set for the best F1 on the
    documents ``tests``, whose labels are ``truth``.
    """
    c, tongues = sample.c, sample.tongues
    n, k = sample.n, len(subjects)
    if not len(c.w) or not k:
        none = np.zeros((0, k + 1), np.float32)
        return Model(subjects, sample.tongue, np.zeros((1, n, k + 1), np.float32), np.zeros(0, np.int64), none, 0.1, 0.175)
    flags = lambda of: np.array([[s in x for s in subjects] for x in of], dtype=float)
    given = flags(labels)
    known = given.sum(axis=1) > 0
    weight = (given / np.maximum(given.sum(axis=1, keepdims=True), 1))[c.doc]
    # log prior of a sentence's subject from the document's labels; the last column is small talk
    prior = np.where(known[:, None], np.log(np.where(given > 0, 1.0, 0.01)), 0.0)
    weight = np.concatenate([weight, np.zeros((len(weight), 1))], axis=1)
    for r in range(ROUNDS):
        single = np.zeros((len(tongues), n, k + 1))
        pairs = [np.zeros((len(t.codes), k + 1)) for t in tongues]
        gain = np.zeros((len(c.size), k + 1))
        for l, t in enumerate(tongues):
            for s in range(k + 1):
                # words alone guide the first rounds: a pair seen once would only confirm itself
                single[l, :, s], by_pair = t.gains(weight[:, s], r >= ROUNDS - 2)
                if by_pair is not None:
                    pairs[l][:, s] = by_pair
                table = single[l, t.w, s] if by_pair is None else by_pair[t.pair]
                gain[:, s] += np.bincount(t.sent, weights=table, minlength=len(gain))
        if r == ROUNDS - 1:
            break
        # what the sentences of the document say together, in moderation
        votes = np.zeros((sample.docs, k))
        np.add.at(votes, c.doc, np.clip(gain[:, :k], 0, 3))
        support = np.log((votes + 0.5) / (votes + 0.5).sum(axis=1, keepdims=True))
        score = np.empty_like(gain)
        score[:, :k] = gain[:, :k] + (prior + support)[c.doc]
        # the first round has no model of small talk: what gains nothing is taken for it
        score[:, k] = (gain[:, k] if r else SURE) + np.log(0.3)
        best = score.argmax(axis=1)
        rows = np.arange(len(best))
        sure = (best == k) | (gain[rows, best] > SURE)
        if r == 0:
            # the first models know little beyond the labelled documents
            sure &= known[c.doc]
        weight = np.zeros_like(gain)
        weight[rows[sure], best[sure]] = 1
    model = Model(subjects, sample.tongue, single.astype(np.float32), sample.codes, np.concatenate(pairs).astype(np.float32), 0.1, 0.175)
    if len(tests):
        calibrate(model, c, gain / c.size[:, None], flags(truth or labels), np.isin(np.arange(sample.docs), tests))
    return model


def shares(gain: np.ndarray, doc: np.ndarray, n_docs: int, margin: float) -> np.ndarray:
    """Share of each document's sentences that belong to each subject, from gains per token (the last column is small talk)."""
    k = gain.shape[1] - 1
    best = gain.argmax(axis=1) if len(gain) else np.zeros(0, np.int64)
    hit = (best < k) & (gain[np.arange(len(best)), best] > margin)
    out = np.zeros((n_docs, k))
    np.add.at(out, (doc[hit], best[hit]), 1)
    return out / np.maximum(np.bincount(doc, minlength=n_docs), 1)[:, None]


def calibrate(model: Model, c: Corpus, gain: np.ndarray, given: np.ndarray, known: np.ndarray) -> float:
    """Set margin and share to those with the best F1 over the documents marked ``known``; returns it."""
    best = -1.0
    for m in MARGINS:
        part = shares(gain, c.doc, len(given), m)[known]
        for s in SHARES:
            hit, want = part >= s, given[known] > 0
            f1 = 2 * (hit & want).sum() / max(1, hit.sum() + want.sum())
            # ties go to the middle of the gap that the definition of a subject leaves, and of the margins
            f1 -= 1e-3 * abs(s - 0.175) + 1e-4 * abs(m - MARGINS[len(MARGINS) // 2])
            if f1 > best:
                best, model.margin, model.share = f1, m, s
    return best


def assign(ids: list, model: Model) -> list[list[str]]:
    """Subjects of each encoded text, in the order of the model's list."""
    c = Corpus(ids)
    if not len(c.w) or not model.subjects or not len(model.codes):
        return [[] for _ in ids]
    code, where = np.unique(coded(c, model.tongue), return_inverse=True)
    at = np.minimum(np.searchsorted(model.codes, code), len(model.codes) - 1)
    n = len(model.tongue)
    rows = np.where((model.codes[at] == code)[:, None], model.pairs[at], model.single[code // (n * n), code % n])
    rows[code % n == 0] = 0  # a word that no model knows tells nothing
    gain = np.add.reduceat(rows[where], c.start) / c.size[:, None]
    part = shares(gain, c.doc, len(ids), model.margin)
    return [[model.subjects[j] for j in np.flatnonzero(p >= model.share)] for p in part]


def training_sample(documents: DataFrame, labels: DataFrame, labelled: int, others: int) -> tuple[list, list, list]:
    """Texts, label sets and languages of at most ``labelled`` + ``others`` documents, drawn by hash.

    The share of hashes to take follows from the counts, so tasks pass on only their part of it.
    """
    tidy = labels.select("doc_id", F.lower(F.trim("subject")).alias("subject")).where("doc_id is not null and subject is not null")
    marks = tidy.groupBy("doc_id").agg(F.collect_set("subject").alias("labels"))
    docs = documents.select("doc_id", "text", "lang").where("doc_id is not null and text is not null")
    h = F.xxhash64(F.lit(3), "doc_id")

    def drawn(df: DataFrame, most: int, count: int) -> DataFrame:
        return df.where(F.pmod(h, F.lit(1_000_000)) < int(min(1.0, 1.2 * most / max(1, count)) * 1_000_000) + 1)

    chosen = drawn(marks, labelled, marks.count())
    some = docs.join(chosen, "doc_id").orderBy(h, "doc_id").limit(labelled).collect()
    rest = drawn(docs, others, documents.count()).orderBy(h, "doc_id").limit(others).collect()
    got = defaultdict(set)
    texts = {}
    for r in rest:
        texts[r["doc_id"]] = (r["text"], r["lang"])
    for r in some:
        texts[r["doc_id"]] = (r["text"], r["lang"])
        got[r["doc_id"]] = set(r["labels"])
    ids = sorted(texts)
    return [texts[i][0] for i in ids], [got[i] for i in ids], [texts[i][1] for i in ids]


def count_background(encoded: DataFrame, sample: Sample) -> None:
    """Set the background models of the sample's languages from the counts of all encoded documents.

    Each task adds up its documents' counts of the sample's words and pairs, so what is shuffled and collected
    is bounded by the sample's vocabulary, not by the data.
    """
    n, codes, tongue = sample.n, sample.codes, sample.tongue
    shared = encoded.sparkSession.sparkContext.broadcast((codes, tongue))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes, tongue = shared.value
        words, first = (np.zeros(tongue.shape[1] * n, np.int64) for _ in range(2))
        pairs = np.zeros(len(codes), np.int64)
        for pdf in batches:
            for i in range(0, len(pdf), CHUNK):
                c = Corpus(pdf["ids"].iloc[i : i + CHUNK].tolist())
                if not len(c.w):
                    continue
                code, times = np.unique(coded(c, tongue), return_counts=True)
                lang = code // (n * n)
                np.add.at(words, lang * n + code % n, times)
                np.add.at(first, lang * n + code // n % n, times)
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                hit = codes[at] == code
                np.add.at(pairs, at[hit], times[hit])
        for kind, counts in enumerate((words, first, pairs)):
            i = np.flatnonzero(counts)
            yield pd.DataFrame({"kind": kind, "i": i, "n": counts[i]})

    got = encoded.select("ids").mapInPandas(count, "kind int, i long, n long").groupBy("kind", "i").agg(F.sum("n").alias("n")).toPandas()
    total = [np.zeros(tongue.shape[1] * n), np.zeros(tongue.shape[1] * n), np.zeros(len(codes))]
    for kind, part in got.groupby("kind"):
        total[kind][part["i"].to_numpy()] = part["n"].to_numpy()
    done = 0
    for l, t in enumerate(sample.tongues):
        t.background(total[0][l * n : (l + 1) * n], total[2][done : done + len(t.codes)], total[1][l * n : (l + 1) * n])
        done += len(t.codes)


def encoded_documents(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """doc_id, lang, source and word ids of every document with an id."""
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(encode(b.tolist(), shared.value))

    rows = spread(documents.select("doc_id", "lang", "source", "text").where("doc_id is not null"))
    return materialize(rows.select("doc_id", "lang", "source", ids("text").alias("ids")))


def document_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame, labelled: int = LABELLED, others: int = OTHERS) -> DataFrame:
    """doc_id, lang, source and subject, one row per subject of a document.

    Blank and null texts and small talk have no subject and give no row; without labels nothing is
    known and the result is empty. ``subjects`` is the fixed list of areas.
    """
    names = sorted({r[0].strip().lower() for r in subjects.select("subject").collect() if r[0] and r[0].strip()})
    texts, marks, langs = training_sample(documents, labels, labelled, others)
    sample = Sample(texts, langs)
    encoded = encoded_documents(documents, sample.vocabulary)
    if len(sample.codes):
        count_background(encoded, sample)
    shared = documents.sparkSession.sparkContext.broadcast(fit(sample, marks, names))

    @F.pandas_udf("array<string>")
    def areas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            out: list = []
            for i in range(0, len(b), CHUNK):
                out += assign(b.iloc[i : i + CHUNK].tolist(), shared.value)
            yield pd.Series(out)

    # else the filter that the explode implies would run the models a second time
    areas = areas.asNondeterministic()
    rows = encoded.select("doc_id", "lang", "source", areas("ids").alias("areas"))
    return rows.select("doc_id", "lang", "source", F.explode("areas").alias("subject"))


def composition(assigned: DataFrame) -> DataFrame:
    """Documents per subject, language and source (names trimmed and in lower case)."""
    tidy = lambda c: F.lower(F.trim(c)).alias(c)
    return assigned.groupBy("subject", tidy("lang"), tidy("source")).agg(F.count("*").alias("documents"))
