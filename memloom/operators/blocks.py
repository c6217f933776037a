"""Keyword scores of many queries over many documents in blocks, without a table of all pairs.

Postings travel packed (arrays of codes with a small dictionary per piece); each part of the documents meets each block of
queries in one task, one block of documents after the other. There a matrix product in single precision finds which pairs
can matter, with a bound of its error, and only those are scored again in double, so results are exact. Documents of a
block that say the same are scored once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ship

#: Documents and queries of a block, documents scored at once, terms that go through the matrix product (rarer ones are added pair by pair).
ROWS, ASKING, AT_ONCE, DENSE = 20_000, 12_000, 512, 1536
#: Documents under which a part is not split further, most documents of a part, postings of a packed piece.
FEW, PART, PIECE = 2_000, 200_000, 1_000_000

OUT = "query long, doc long, score double, tenth long, n long"
_PACKED = "part int, kind int, block int, ids binary, sizes binary, counts binary, words array<string>, codes binary, values binary"
_PACKED_COLUMNS = ("part", "kind", "block", "ids", "sizes", "counts", "codes", "values")
_TYPES = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("block", pa.int32()), *[(c, pa.binary()) for c in ("ids", "sizes", "counts")], ("words", pa.list_(pa.string())), ("codes", pa.binary()), ("values", pa.binary())])
_OUT = pa.schema([("query", pa.int64()), ("doc", pa.int64()), ("score", pa.float64()), ("tenth", pa.int64()), ("n", pa.int64())])


def _packer(kind: int, parts: Callable[[int], list[int]]) -> Callable:
    """Turns rows (block, id, size, term, value) into packed pieces, one for each part that the block meets."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        terms = t["term"].combine_chunks().dictionary_encode()
        terms = terms.combine_chunks() if isinstance(terms, pa.ChunkedArray) else terms
        block, ids, sizes, values = (t[c].to_numpy() for c in ("block", "id", "size", "value"))
        order = np.lexsort((ids, block))
        block, ids, sizes, values, codes = block[order], ids[order], sizes[order], values[order], terms.indices.to_numpy()[order]
        edges = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
        for a, z in zip(edges, edges[1:]):
            first = np.flatnonzero(np.r_[True, np.diff(ids[a:z]) != 0])
            local, c = np.unique(codes[a:z], return_inverse=True)
            v = values[a:z]
            small = bool(((v >= 0) & (v < 256) & (v == np.floor(v))).all())
            words = terms.dictionary.take(pa.array(local))
            blobs = [
                ids[a:z][first].astype("<i8"), sizes[a:z][first].astype("<f8"), np.diff(np.r_[first, z - a]).astype("<i4"),
                c.astype("<u2" if len(local) < 65536 else "<u4"), v.astype("u1" if small else "<f8"),
            ]
            ids_, sizes_, counts_, codes_, values_ = [pa.array([x.tobytes()], pa.binary()) for x in blobs]
            said = pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string()))
            for part in parts(int(block[a])):
                numbers = [pa.array([x], pa.int32()) for x in (part, kind, block[a])]
                yield pa.RecordBatch.from_arrays([*numbers, ids_, sizes_, counts_, said, codes_, values_], schema=_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= PIECE:
                yield from cut(held)
                held, n = [], 0
        if n:
            yield from cut(held)

    return run


class Sparse:
    """Rows of (code, value) in row order: ids, sizes, ``at`` (begin of each row), codes and values; equal rows are one row with several ids."""

    def __init__(self, pieces: list[dict], look: Callable[[str], int], value: Callable, apart: Callable = np.zeros_like):
        get = lambda c, kind: np.concatenate([np.frombuffer(p[c], kind) for p in pieces])
        ids, sizes, counts = get("ids", "<i8"), get("sizes", "<f8"), get("counts", "<i4")
        codes, values = [], []
        for p in pieces:
            n = int(np.frombuffer(p["counts"], "<i4").sum())
            to = np.array([look(w) for w in p["words"].to_pylist()], np.int32)
            codes.append(to[np.frombuffer(p["codes"], "<u2" if len(p["codes"]) == 2 * n else "<u4")])
            values.append(np.frombuffer(p["values"], "u1" if len(p["values"]) == n else "<f8").astype(float))
        codes, values = np.concatenate(codes), np.concatenate(values)
        u, first, inverse = np.unique(ids, return_index=True, return_inverse=True)  # a document may lie in two pieces
        row = np.repeat(inverse, counts)
        values = value(values, sizes[first][row])
        known = codes >= 0
        row, codes, values = row[known], codes[known], values[known]
        order = np.lexsort((codes, row))
        row, codes, values = row[order], codes[order], values[order]
        at = np.searchsorted(row, np.arange(len(u) + 1))
        seen: dict[tuple, int] = {}
        label, kept = np.full(len(u), -1), []
        c, v, s = codes.tobytes(), values.tobytes(), sizes[first]
        also = apart(s).tolist()  # rows that differ here are not equal
        for i, (a, z) in enumerate(zip(at.tolist(), at[1:].tolist())):
            if a < z:
                k = (c[4 * a : 4 * z], v[8 * a : 8 * z], also[i])
                label[i] = seen.setdefault(k, len(seen))
                if label[i] == len(kept):
                    kept.append(i)
        self.n, kept = len(kept), np.array(kept, int)
        lens = at[kept + 1] - at[kept]
        pos = spans(at[kept], lens)
        self.at, self.codes, self.values, self.size = np.r_[0, np.cumsum(lens)], codes[pos], values[pos], s[kept]
        order = np.argsort(label, kind="stable")
        order = order[label[order] >= 0]
        self.ids, self.count = u[order], np.bincount(label[order], minlength=self.n)
        self.begin = np.cumsum(self.count) - self.count


def spans(begin: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions of all runs of ``lens`` from ``begin``, one after the other."""
    return np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


class Asks:
    """A block of queries with the table of their frequent terms (terms x queries) and the others by term."""

    def __init__(self, rows: Sparse, terms: int):
        self.rows, self.terms, self.n = rows, terms, rows.n
        self.qf = np.bincount(rows.codes, minlength=terms)
        order = np.argsort(-self.qf, kind="stable")[:DENSE]
        self.col = np.full(terms, -1)
        self.col[order] = np.arange(len(order))
        row, c = np.repeat(np.arange(rows.n), np.diff(rows.at)), self.col[rows.codes]
        self.table = np.zeros((len(order), rows.n), np.float32)
        self.table[c[c >= 0], row[c >= 0]] = rows.values[c >= 0]
        by = np.argsort(rows.codes, kind="stable")
        self.begin, self.by_term, self.weights = np.searchsorted(rows.codes[by], np.arange(terms)), row[by], rows.values[by]
        #: Bound of the relative error of a score in single precision: all summands are positive.
        self.error = (np.diff(rows.at) + 8) * 2.0**-23


def products(docs: Sparse, asks: Asks) -> Iterator[tuple[int, np.ndarray]]:
    """Scores in single precision, ``AT_ONCE`` documents at a time: (first document, documents x queries)."""
    for a in range(0, docs.n, AT_ONCE):
        z = min(docs.n, a + AT_ONCE)
        part = slice(docs.at[a], docs.at[z])
        r, code, v = np.repeat(np.arange(z - a), np.diff(docs.at[a : z + 1])), docs.codes[part], docs.values[part]
        c = asks.col[code]
        dense = c >= 0
        used, inner = np.unique(c[dense], return_inverse=True)
        m = np.zeros((z - a, len(used)), np.float32)
        m[r[dense], inner] = v[dense]
        s = m @ (asks.table if len(used) == len(asks.table) else asks.table[used])
        if not dense.all():
            r, code, v = r[~dense], code[~dense], v[~dense]
            n = asks.qf[code]
            pos = spans(asks.begin[code], n)
            np.add.at(s.reshape(-1), np.repeat(r, n) * asks.n + asks.by_term[pos], (np.repeat(v, n) * asks.weights[pos]).astype(np.float32))
        yield a, s


def exact(docs: Sparse, asks: Sparse, q: np.ndarray, d: np.ndarray, terms: int) -> np.ndarray:
    """Scores in double of pairs that are ordered by query."""
    out, w = np.empty(len(q)), np.zeros(terms)
    edges = [0, *(np.flatnonzero(np.diff(q)) + 1), len(q)] if len(q) else []
    lens = docs.at[1:] - docs.at[:-1]
    for a, z in zip(edges, edges[1:]):
        own = slice(asks.at[q[a]], asks.at[q[a] + 1])
        w[asks.codes[own]] = asks.values[own]
        n = lens[d[a:z]]
        pos = spans(docs.at[d[a:z]], n)
        out[a:z] = np.add.reduceat(w[docs.codes[pos]] * docs.values[pos], np.cumsum(n) - n)
        w[asks.codes[own]] = 0
    return out


def _batch(query: np.ndarray, doc=None, score=None, tenth=None, n=None) -> pa.RecordBatch:
    null = lambda t: pa.nulls(len(query), t)
    return pa.RecordBatch.from_arrays([null(f.type) if x is None else pa.array(x, f.type) for f, x in zip(_OUT, (query, doc, score, tenth, n))], schema=_OUT)


def best(k: int) -> Callable:
    """The k best documents of each query in a part (query, doc, score), ties by document."""

    def run(blocks: Iterator[Sparse], asks: Asks) -> Iterator[pa.RecordBatch]:
        slack = 1 - 2.5 * asks.error
        least = np.full(asks.n, np.float32(1e-37))
        top = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

        def narrow(held: list[tuple]) -> tuple[np.ndarray, ...]:
            """Pairs that can still be among the k best; a query's own k-th says which others can not."""
            q, d, s = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((-s, q))
            q, d, s = q[order], d[order], s[order]
            begin = np.searchsorted(q, np.arange(asks.n + 1))
            full = np.flatnonzero(np.diff(begin) >= k)
            least[full] = np.maximum(least[full], s[begin[full] + k - 1] * slack[full])
            ok = s >= least[q]
            return q[ok], d[ok], s[ok]

        for docs in blocks:
            held, n = [], 0
            for a, s in products(docs, asks):
                if not a and len(s) > k:
                    least = np.maximum(least, np.partition(s.T, len(s) - k, axis=1)[:, len(s) - k] * slack).astype(np.float32)
                x = np.flatnonzero(s >= least)
                held.append((x % asks.n, a + x // asks.n, s.reshape(-1)[x]))
                n += len(x)
                if n > max(2 * k * asks.n, 1_000_000):
                    held = [narrow(held)]
                    n = len(held[0][0])
            if not n:
                continue
            q, d, _ = narrow(held)
            s = np.round(exact(docs, asks.rows, q, d, asks.terms), 9)
            order = np.lexsort((-s, q))
            q, d, s = q[order], d[order], s[order]
            size = docs.count[d]
            before = np.cumsum(size) - size
            level = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(s) != 0)])  # equal scores of one query
            group = np.flatnonzero(np.r_[True, np.diff(q) != 0])
            better = np.repeat(before[level], np.diff(np.r_[level, len(q)])) - np.repeat(before[group], np.diff(np.r_[group, len(q)]))
            q, d, s = (x[better < k] for x in (q, d, s))
            take = np.minimum(docs.count[d], k)
            found = np.repeat(q, take), docs.ids[spans(docs.begin[d], take)], np.repeat(s, take)
            q, d, s = (np.concatenate(x) for x in zip(top, found))
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            begin = np.searchsorted(q, np.arange(asks.n + 1))
            ok = np.arange(len(q)) - begin[q] < k
            full = np.flatnonzero(np.diff(begin) >= k)
            least[full] = np.maximum(least[full], s[begin[full] + k - 1] * slack[full])
            top = q[ok], d[ok], s[ok]
        q, d, s = top
        yield from _spread(asks.rows, q, doc=d, score=s)

    return run


def _spread(asks: Sparse, q: np.ndarray, **columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of each query for all ids that ask it."""
    for a in range(0, len(q), 500_000):
        at = q[a : a + 500_000]
        many = asks.count[at]
        yield _batch(asks.ids[spans(asks.begin[at], many)], **{c: np.repeat(x[a : a + 500_000], many) for c, x in columns.items()})


def tenths(scale: list[tuple]) -> Callable:
    """Matches of each query by tenth of the sigmoid of their score: (query, tenth, n), or (query, doc, score, n) where a score lies at a border.

    ``scale``: (terms up to, midpoint, steepness); the size of a query is its number of terms.
    """

    def run(blocks: Iterator[Sparse], asks: Asks) -> Iterator[pa.RecordBatch]:
        p = np.arange(1, 11) / 10 - 5e-7  # sigmoids are rounded to six places
        borders = np.log(p / (1 - p))
        pick = np.searchsorted([m for m, _, _ in scale if m is not None], asks.rows.size)
        mid, steep = np.array([m for _, m, _ in scale])[pick], np.array([s for _, _, s in scale])[pick]
        err = 2 * asks.error
        low = ((mid + borders[0] / steep) * (1 - err) - 2e-6).astype(np.float32) * np.float32(1 - 1e-6)
        counts = np.zeros((asks.n, 11))
        for docs in blocks:
            weight, found = docs.count.astype(np.float32), []
            for a, s in products(docs, asks):
                w = weight[a : a + len(s)]
                counts[:, 0] += w @ (s > 0).astype(np.float32)
                x = np.flatnonzero((s >= low) & (s > 0))
                q, d, s = x % asks.n, x // asks.n, s.reshape(-1)[x].astype(float)
                z = steep[q] * (s - mid[q])
                at = np.searchsorted(borders, z, "right")
                near = steep[q] * (s * err[q] + 2e-6)
                close = (np.abs(z - borders[np.minimum(at, 9)]) <= near) | (np.abs(z - borders[np.maximum(at - 1, 0)]) <= near)
                found.append((q[close], a + d[close]))
                counts += np.bincount(q * 11 + at, np.where(close, 0, w[d]), asks.n * 11).reshape(-1, 11)
                counts[:, 0] -= np.bincount(q, w[d], asks.n)
            if found:
                q, d = (np.concatenate(x) for x in zip(*found))
                order = np.argsort(q, kind="stable")
                q, d = q[order], d[order]
                yield from _spread(asks.rows, q, score=np.round(exact(docs, asks.rows, q, d, asks.terms), 9), n=docs.count[d])
        q, t = np.nonzero(counts)
        yield from _spread(asks.rows, q, tenth=t, n=counts[q, t].astype(np.int64))

    return run


def partners(blocks: Iterator[Sparse], asks: Asks) -> Iterator[pa.RecordBatch]:
    """Documents that share over a third of a query's terms, itself left out: (query, n, most shared in ``tenth``). All values are 1, so counts are exact."""
    least = np.floor(asks.rows.size / 3).astype(np.float32) + 1
    n, most = np.zeros(asks.n), np.zeros(asks.n, np.int64)
    for docs in blocks:
        order = np.argsort(docs.ids, kind="stable")
        at = np.minimum(np.searchsorted(docs.ids[order], asks.rows.ids), len(order) - 1)
        own = np.where(docs.ids[order][at] == asks.rows.ids, np.repeat(np.arange(docs.n), docs.count)[order][at], -1)
        for a, s in products(docs, asks):
            x = np.flatnonzero(s >= least)
            q, d, s = x % asks.n, a + x // asks.n, s.reshape(-1)[x].astype(np.int64)
            w = docs.count[d] - (own[q] == d)
            n += np.bincount(q, w, asks.n)
            np.maximum.at(most, q[w > 0], s[w > 0])
    q = np.flatnonzero(n)
    yield _batch(asks.rows.ids[q], tenth=most[q], n=n[q].astype(np.int64))


def _scorer(use: Callable, value: Callable, merge: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[dict[int, list], dict[int, list]]] = {}
        for b in batches:
            for i in range(b.num_rows):
                p = {c: b.column(c)[i].as_py() for c in _PACKED_COLUMNS} | {"words": b.column("words")[i].values}
                held.setdefault(p["part"], ({}, {}))[p["kind"]].setdefault(p["block"], []).append(p)
        for part in sorted(held):
            docs, asks = held.pop(part)
            if docs and asks:
                vocabulary: dict[str, int] = {}
                (said,) = asks.values()
                rows = Sparse(said, lambda w: vocabulary.setdefault(w, len(vocabulary)), lambda v, _: v, (lambda s: s) if merge else (lambda s: np.arange(len(s))))
                blocks = (Sparse(docs.pop(b), lambda w: vocabulary.get(w, -1), value) for b in sorted(docs))
                yield from use((x for x in blocks if x.n), Asks(rows, len(vocabulary)))

    return run


def meet(docs: DataFrame, asks: DataFrame, n: int, m: int, use: Callable, value: Callable = lambda v, _: v, merge: bool = True) -> DataFrame:
    """What ``use`` finds in every part of ``docs`` for every block of ``asks`` (``OUT``).

    Both are (id, size, term, value) with whole-numbered ids; ``n`` and ``m`` are their numbers of ids. ``value`` turns a document's
    values and sizes into factors. Queries of equal terms are scored once if ``merge``.
    """
    spark = docs.sparkSession
    ship(spark)
    cores = spark.sparkContext.defaultParallelism
    parts = max(1, min(cores, -(-n // FEW)) if n <= PART * cores else cores * -(-n // (PART * cores)))
    rb, qb = parts * max(1, -(-n // (ROWS * parts))), max(1, -(-m // ASKING))
    block = lambda df, b: df.select(F.pmod(F.xxhash64("id"), F.lit(b)).cast("int").alias("block"), F.col("id").cast("long").alias("id"), F.col("size").cast("double").alias("size"), "term", F.col("value").cast("double").alias("value"))
    left = block(docs, rb).mapInArrow(_packer(0, lambda b: [b % parts * qb + q for q in range(qb)]), _PACKED)
    right = block(asks, qb).mapInArrow(_packer(1, lambda b: [r * qb + b for r in range(parts)]), _PACKED)
    both = left.unionByName(right).repartitionById(parts * qb, F.col("part"))
    return both.mapInArrow(_scorer(use, value, merge), OUT)
