"""A skip-chain conditional random field over the tokens of candidate units.

Every token has a tag: O, B of a type, or I of a type that spans tokens. A token's own score is the
sum of what its unit's features say of the type and its own features of the tag. Neighbouring tokens
share a chain potential by how far they are apart. Tokens of one document that repeat (same digits,
same word) or resemble each other (same shape) are all tied pairwise by a skip potential, however far
apart. A token sends every other token of its group the same message, so what a token receives is the
group's sum less its own: the work is linear in the mentions and the sum is an ordinary aggregate.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .pii_candidates import ADDRESS, ALLOWED, EMAIL, EN_STREET_SET, ID, LABELS, LETTERS, NAME, NONE, PHONE, STREETS, WORD, Names, Unit, fold, units

#: Tags: outside, the first token of each type, further tokens of the two types that have some.
TYPE_OF = np.array([NONE, EMAIL, PHONE, ID, ADDRESS, NAME, ADDRESS, NAME])
INNER = {ADDRESS: 6, NAME: 7}
K, T = len(TYPE_OF), len(LABELS)
#: Kinds of likeness with the agreement that the skip potentials expect before they see data.
DIGITS, SAME_WORD, SHAPE = range(3)
AGREE = (2.0, 1.0, 0.5)
#: How neighbouring tokens lie: within a unit, units of one kind close by (as in a list), other units close by, units
#: further apart. Those of one kind in a list are expected to agree, too.
INSIDE, LISTED, CLOSE, FAR = range(4)
LIST_AGREES = 1.0
NEAR = 6
CHAIN_ROUNDS = 6
#: Part of the units whose own features are hidden in steps that learn from neighbours and repeats.
HIDDEN = 0.2
#: Rounds of skip messages.
SKIP_ROUNDS = 2
NEVER = -1e4

# Cue words of the weak labels (folded, lower case). They only label training units.
CUES = {
    PHONE: "phone telephone tel telefon telefono mobile cell call ring llama ruf appelle dial fax handy movil reach erreichbar "
    "contact laisse dejo an au",
    ID: "social security passport tax steuer ausweis documento document identity dni nif nie nin insurance identidad national "
    "card border securite sociale id pasaporte passeport reisepass ssn piece",
    NONE: "order invoice ticket batch serial reservation chapter page score version price room gate terminal highway port hall "
    "units build code rechnung bestellung factura pedido commande facture kapitel seite tramo tram line entry note time "
    "isbn lot regex source ext budget hits regal",
}
CUE = {w: lab for lab, ws in CUES.items() for w in ws.split()}
UNIT_WORDS = frozenset("eur usd euro euros dollars units tokens total percent prozent".split())
INTRO = frozenset(
    "mr mrs ms dr herr frau senor senora monsieur madame mme call ask heisse llamo appelle appelez contact cousin neighbour "
    "holder name regards best gruss saludos cordialement an chez c o am llama ruf wife doctor".split()
)
BORDER = re.compile(r"(?<=[.!?\]])\s|\n")
PIECE = re.compile(r"\d+\w*|[^\W\d_]+(?:['’-][^\W\d_]+)*")

# tags that a token of each kind may have, and tag pairs that may follow each other at each distance
OPEN = {kind: np.array([0.0 if t in types else NEVER for t in TYPE_OF]) for kind, types in ALLOWED.items()}
FOLLOW = np.zeros((4, K, K))
for _type, _tag in INNER.items():
    FOLLOW[:, :, _tag] = NEVER
    FOLLOW[INSIDE, [_type, _tag], _tag] = 0.0


@dataclass
class Model:
    """Weights of unit features by type and of token features by tag, chain and skip potentials, name words."""

    names: Names
    unit_index: dict[str, int]
    token_index: dict[str, int]
    by_type: np.ndarray
    by_tag: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def shape(text: str) -> str:
    return re.sub(r"[A-Z]", "A", re.sub(r"\d", "9", text))


def is_short(u: Unit) -> bool:
    """Numbers too short for personal data; they have features of their own."""
    return u.kind == "number" and not u.marks and sum(map(str.isdigit, u.text)) < 4


def context(text: str, u: Unit) -> tuple[list[str], list[str]]:
    """Folded words before (nearest first) and after a unit, within its sentence."""
    before = LETTERS.findall(BORDER.split(text[max(0, u.start - 48) : u.start])[-1])[-4:][::-1]
    after = LETTERS.findall(BORDER.split(text[u.end : u.end + 24], maxsplit=1)[0])[:2]
    return [fold(w) for w in before], [fold(w) for w in after]


def unit_features(text: str, u: Unit, before: list[str], after: list[str]) -> list[str]:
    """Features of a unit; those that name context words start with ``c:``."""
    k = "t" if is_short(u) else u.kind[0]
    out = [k, f"{k}<{text[u.start - 1 : u.start]}", f"{k}>{text[u.end : u.end + 1]}"]
    out += [f"{k}{m}" for m in u.marks if m]
    out += [f"c:{k}-{i}{w}" for i, w in enumerate(before[:3])] + [f"c:{k}+{i}{w}" for i, w in enumerate(after)]
    out += [f"c:{k}~{w}" for w in before]
    if k == "n":
        digits, s = sum(map(str.isdigit, u.text)), shape(u.text)
        out += [f"ns{s}", f"nd{digits}", f"nsep{''.join(sorted(set(re.sub('[A9]', '', s))))}", f"np{u.text[:2]}{digits}", f"nh{s[:4]}", f"nt{s[-4:]}"]
        out.append("nplus" if u.text[0] == "+" or u.text.startswith("00") else "n0" if u.text[0] == "0" else "nx")
        if re.match(r"(?:19|20)\d\d[-/]\d\d[-/]\d\d$|\d\d?[-/.]\d\d?[-/.](?:19|20)\d\d$", u.text):
            out.append("ndate")
        out.append(f"nletters{bool(re.search('[A-Z]', s))}")
    elif u.kind == "place":
        words = [w.lower() for w in LETTERS.findall(u.text)]
        out += [f"pw{w}" for w in words] + [f"p{len(words)}{u.text.islower()}"]
    return out


def pieces(u: Unit) -> list[tuple[int, int, list[str], list[tuple[int, str]]]]:
    """Tokens of a unit: start, end, features and (likeness, mark)."""
    if u.kind == "mail":
        return [(u.start, u.end, [], [])]
    if u.kind == "number":
        digits = re.sub("[^0-9]", "", u.text)
        long = len(digits) >= 6 and "spoken" not in u.marks
        return [(u.start, u.end, [], [(DIGITS, f"d{digits[-7:]}"), (SHAPE, f"s{shape(u.text)}")] if long else [])]
    found = list((WORD if u.kind == "name" else PIECE).finditer(u.text))
    out, k, last = [], u.kind[0], len(found) - 1
    kinds = u.marks[0] if u.kind == "name" else ""
    for i, m in enumerate(found):
        at = "f" if i == 0 else "l" if i == last else "m"
        w = fold(m[0].rstrip("."))
        if u.kind == "name":
            what = kinds[i] if i < len(kinds) else "u"
            feats = [f"{k}{at}{what}", f"{k}{at}{kinds[max(0, i - 1) : i + 2]}"]
            marks = [(SAME_WORD, f"n{w}")] if len(w) > 2 else []
        else:
            street = w in STREETS or w in EN_STREET_SET
            what = "d" if m[0][0].isdigit() else "s" if street else "w"
            feats = [f"{k}{at}{what}", f"{k}{at}{u.marks[0]}{what}"]
            marks = [(SAME_WORD, f"p{w}")] if what == "w" and len(w) > 2 else []
        out.append((u.start + m.start(), u.end if i == last else u.start + m.end(), feats, marks))
    return out


def weak_label(text: str, u: Unit, before: list[str], after: list[str]) -> int | None:
    """Type that cue words and unmistakable forms give a unit, or None."""
    if u.kind == "mail":
        return EMAIL
    if u.kind == "place":
        if before[:1] and CUE.get(before[0]) == NONE:
            return NONE
        return None if u.text.islower() else ADDRESS
    if u.kind == "name":
        kinds = set(u.marks[0])
        if {"g", "b"} & kinds and {"f", "b"} & kinds:
            return NAME
        if "u" in kinds and before and before[0] in INTRO:
            return NAME
        return NONE if kinds <= {"u", "i"} else None
    if "spoken" in u.marks or u.text[0] == "+":
        return PHONE
    if sum(ch.isalnum() for ch in u.text) <= 5 or after[:1] and after[0] in UNIT_WORDS:
        return NONE
    if text[u.start - 1 : u.start] == "-":
        return NONE
    if {"my", "mon", "mi", "meine"} & set(before) and {"number", "numero", "nummer"} & set(before[:2]) and not CUE.keys() & set(before):
        return PHONE
    votes = [CUE[w] for w in before[:3] if w in CUE]
    return votes[0] if votes else None


class Batch:
    """Tokens of the units of many texts, with features, chain edges and skip groups, as arrays.

    ``docs`` tells which texts form a document; without it every text is one.
    """

    def __init__(self, texts: list[str], model: Model, docs: list | None = None, grow: bool = False):
        self.spans: list[tuple[int, int, int, str, bool]] = []  # text, start, end, kind, counts as a word of a name
        self.marks: list[tuple[int, str]] = []
        feats, sizes, unit_of, tfeats, tsizes, kinds, gap, member, weak = [], [], [], [], [], [], [], [], []
        groups: dict[tuple, int] = {}
        self.cue: list[bool] = []
        n_units = 0
        for d, t in enumerate(texts):
            end = kind = None
            for u in units(t, model.names):
                before, after = context(t, u)
                short = "short " if is_short(u) else ""
                n = 0
                for f in unit_features(t, u, before, after):
                    i = model.unit_index.setdefault(f, len(model.unit_index)) if grow else model.unit_index.get(f)
                    if i is not None:
                        feats.append(i)
                        self.cue.append(f[0] == "c")
                        n += 1
                sizes.append(n)
                label = weak_label(t, u, before, after) if grow else None
                for j, (a, b, fs, marks) in enumerate(pieces(u)):
                    n = 0
                    for f in fs:
                        i = model.token_index.setdefault(f, len(model.token_index)) if grow else model.token_index.get(f)
                        if i is not None:
                            tfeats.append(i)
                            n += 1
                    tsizes.append(n)
                    for like, m in marks:
                        group = groups.setdefault((docs[d] if docs else d, like, m), len(groups))
                        member.append((len(self.spans), group, like))
                        self.marks.append((d, m))
                    gap.append(-1 if end is None else INSIDE if j else FAR if a - end > NEAR else LISTED if short + u.kind == kind else CLOSE)
                    unit_of.append(n_units)
                    kinds.append(u.kind)
                    weak.append(-1 if label is None else label if j == 0 else INNER.get(label, label))
                    self.spans.append((d, a, b, u.kind, not t[a:b].endswith(".") and b - a > 1))
                    end, kind = b, short + u.kind
                n_units += 1
        self.n, self.texts = len(self.spans), len(texts)
        ints = lambda x: np.array(x, dtype=np.int64)
        self.feats, self.unit = ints(feats), np.repeat(np.arange(n_units), ints(sizes))
        self.tfeats, self.token = ints(tfeats), np.repeat(np.arange(self.n), ints(tsizes))
        self.unit_of, self.units, self.weak = ints(unit_of), n_units, ints(weak)
        self.gap = ints(gap)
        self.dst = np.flatnonzero(self.gap >= 0)
        self.near = self.gap[self.dst]
        self.bar = np.array([OPEN[k] for k in kinds]).reshape(-1, K)
        self.bar[self.gap != INSIDE, min(INNER.values()) :] = NEVER
        self.member, self.group, self.like = ints(member).reshape(-1, 3).T
        self.groups = len(groups)

    def scores(self, by_type: np.ndarray, by_tag: np.ndarray, keep: np.ndarray | None = None) -> np.ndarray:
        f, u = (self.feats, self.unit) if keep is None else (self.feats[keep], self.unit[keep])
        of_unit = sums(by_type[f], u, self.units)
        return of_unit[self.unit_of][:, TYPE_OF] + sums(by_tag[self.tfeats], self.token, self.n) + self.bar


def sums(rows: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by target."""
    return np.stack([np.bincount(to, weights=rows[:, c], minlength=n) for c in range(rows.shape[1])], axis=1)


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def beliefs(b: Batch, model: Model, incoming: np.ndarray | None = None) -> np.ndarray:
    """Log beliefs of all tags by message passing along the chains; ``incoming`` are skip messages by type."""
    local = b.scores(model.by_type, model.by_tag)
    if incoming is not None:
        local = local + incoming[:, TYPE_OF]
    if not len(b.dst):
        return local
    src, n = b.dst - 1, len(b.dst)
    pots = (model.chain + FOLLOW)[b.near]
    ahead, back = np.zeros((n, K)), np.zeros((n, K))
    for _ in range(CHAIN_ROUNDS):
        at = local.copy()
        at[b.dst] += ahead
        at[src] += back
        ahead, back = logsum((at[src] - back)[:, :, None] + pots, 1), logsum((at[b.dst] - ahead)[:, None, :] + pots, 2)
        ahead -= ahead.max(axis=1, keepdims=True)
        back -= back.max(axis=1, keepdims=True)
    local[b.dst] += ahead
    local[src] += back
    return local


def by_types(log_belief: np.ndarray) -> np.ndarray:
    """Normalized log beliefs of the types."""
    out = log_belief[:, :T].copy()
    for t, tag in INNER.items():
        out[:, t] = np.logaddexp(out[:, t], log_belief[:, tag])
    return out - logsum(out, 1)[:, None]


def messages(b: Batch, model: Model, log_belief: np.ndarray, received: np.ndarray | None = None) -> np.ndarray:
    """What each mention tells the others of its group: by type, from its belief less what the group told it."""
    at = by_types(log_belief)[b.member]
    if received is not None:
        at = at - received
    out = logsum(at[:, :, None] + model.skip[b.like], 1)
    return out - out.max(axis=1, keepdims=True)


def infer(b: Batch, model: Model, skips: bool = True) -> np.ndarray:
    """Log beliefs after all rounds, for documents that lie in the batch as a whole."""
    log_belief, received = beliefs(b, model), None
    for _ in range(SKIP_ROUNDS if skips and len(b.member) else 0):
        sent = messages(b, model, log_belief, received)
        received = sums(sent, b.group, b.groups)[b.group] - sent
        log_belief = beliefs(b, model, sums(received, b.member, b.n))
    return log_belief


def decode(b: Batch, log_belief: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """(type, start, end) of the personal data in each text of the batch.

    A name has two words at least and an address a number; tokens that were tagged short of that give none.
    """
    found: list[list[tuple[str, int, int]]] = [[] for _ in range(b.texts)]
    tags = log_belief.argmax(axis=1).tolist() if b.n else []
    run: list[int] = []

    def close() -> None:
        if run:
            kind = int(TYPE_OF[tags[run[0]]])
            ok = kind not in INNER or (sum(b.spans[i][4] for i in run) > 1 if kind == NAME else len(run) > 1)
            if ok:
                found[b.spans[run[0]][0]].append((LABELS[kind], b.spans[run[0]][1], b.spans[run[-1]][2]))
        run.clear()

    for i, tag in enumerate(tags):
        if not (run and tag >= T and b.gap[i] == INSIDE):
            close()
        if tag:
            run.append(i)
    close()
    return found


def fit(b: Batch, y: np.ndarray, model: Model, steps: int = 150, ridge: float = 2e-4) -> Model:
    """The model with weights and potentials of maximal pseudo-likelihood of the labels known so far (y >= 0).

    Every other step a token sees its neighbours' labels and those of its groups, which may be given or
    inferred, while half of the units lack their cue features and some all of their own, so that chain and
    repeats are learned besides them; in the other steps half of the cue features are left out at random. Skip potentials lean on the agreement that ``AGREE`` expects.
    """
    by_type, by_tag, chain = np.zeros((max(1, len(model.unit_index)), T)), np.zeros((max(1, len(model.token_index)), K)), np.zeros((4, K, K))
    expected = np.array([a * np.eye(T) for a in AGREE])
    skip = expected.copy()
    listed = np.zeros_like(chain)
    listed[LISTED] = LIST_AGREES * np.eye(K)
    chain += listed
    known = y >= 0
    target = np.zeros((b.n, K))
    target[np.flatnonzero(known), y[known]] = 1
    pair = known[b.dst] & known[b.dst - 1] if len(b.dst) else np.zeros(0, bool)
    dst, near = b.dst[pair], b.near[pair]
    src = dst - 1
    # how often each type occurs among the other members of a mention's group
    own = np.zeros((len(b.member), T))
    told = known[b.member]
    own[np.flatnonzero(told), TYPE_OF[y[b.member[told]]]] = 1
    others = sums(own, b.group, b.groups)[b.group] - own if len(own) else own
    linked = others.sum(axis=1) > 0
    member, like, others = b.member[linked], b.like[linked], others[linked]
    params = [by_type, by_tag, chain, skip]
    pulls = [(ridge / 10, 0.0), (ridge / 10, 0.0), (ridge, listed), (ridge, expected)]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in params]
    bare = ~np.array(b.cue, dtype=bool)
    rng = np.random.default_rng(11)
    m = max(1, int(known.sum()))
    for t in range(1, steps + 1):
        keep = bare | (rng.random(len(bare)) < 0.5)
        if t % 2:
            hidden, plain = rng.random(b.units) < HIDDEN, rng.random(b.units) < 0.5
            keep = (bare | ~plain[b.unit]) & ~hidden[b.unit]
        s = b.scores(by_type, by_tag, keep)
        if t % 2:
            pots = chain + FOLLOW
            np.add.at(s, dst, pots[near, y[src]])
            np.add.at(s, src, pots[near, :, y[dst]])
            if len(member):
                np.add.at(s, member, np.einsum("mx,mxy->my", others, skip[like])[:, TYPE_OF])
        g = np.where(known[:, None], softmax(s) - target, 0.0)
        g_type = g[:, :T].copy()
        for kind, tag in INNER.items():
            g_type[:, kind] += g[:, tag]
        f, of_unit = b.feats[keep], sums(g_type, b.unit_of, b.units)
        grads = [sums(of_unit[b.unit[keep]], f, len(by_type)), sums(g[b.token], b.tfeats, len(by_tag)), np.zeros_like(chain), np.zeros_like(skip)]
        if t % 2:
            np.add.at(grads[2], (near, y[src]), g[dst])
            np.add.at(grads[2], (near, slice(None), y[dst]), g[src])
            for c in range(len(AGREE)):
                at = like == c
                pull = others[at].T @ g_type[member[at]]
                grads[3][c] = (pull + pull.T) / 2
        for p, grad, (m1, m2), (weight, centre) in zip(params, grads, moments, pulls):
            grad = grad / m + weight * (p - centre)
            m1 *= 0.9
            m1 += 0.1 * grad
            m2 *= 0.99
            m2 += 0.01 * grad**2
            p -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    return Model(model.names, model.unit_index, model.token_index, by_type, by_tag, chain, skip)
