"""Reciprocal-rank fusion with an entity route that reaches most documents, without a shuffle of its pairs.

A document's rank in the entity route is the number of documents with more matches, plus those with as many and a smaller
id. So documents are cut into ranges of ids, each range counts its documents per query and number of matches, and the sums
over ranges say where each range begins. Then each range ranks its own documents, adds the scores of the other routes,
which are short lists, and returns finished rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize, ship
from . import blocks
from .fusion import RANK_OFFSET, WEIGHTS

#: Documents of a range, queries of a block, names held as a table of documents, rows of a returned batch.
ROWS, ASKING, HELD, BATCH = 20_000, 5_000, 1_536, 200_000
#: Bits of a route in ``signals``; in order of their names.
ROUTES = ("entity", "lexical", "semantic")
#: Places that scores are rounded to.
PLACES = 8

_SAID = "part int, kind int, block int, ids binary, sizes binary, counts binary, words array<string>, codes binary, values binary"
_COUNTED = "asks int, block int, sizes binary, counts binary"
_COUNTED_TYPES = pa.schema([("asks", pa.int32()), ("block", pa.int32()), ("sizes", pa.binary()), ("counts", pa.binary())])
_OUT = pa.schema([("query", pa.int64()), ("doc", pa.int64()), ("score", pa.float64()), ("routes", pa.int8())])
_DOCS, _ASKS, _BEGIN, _OTHERS = range(4)


def rounded(x: np.ndarray) -> np.ndarray:
    """Half up at ``PLACES``, as ``round`` of a column does it."""
    return np.floor(x * 10.0**PLACES + 0.5) / 10.0**PLACES


def _with_block(borders: np.ndarray, then):
    """Adds the range of each document, ``block``, in front of ``then``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def placed():
            for b in batches:
                at = np.searchsorted(borders, b.column("id").to_numpy(), "right")
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *b.columns], names=["block", *b.schema.names])

        yield from then(placed())

    return run


def _pack_others(borders: np.ndarray, qb: int):
    """Rows (asks, query, doc, score, routes) as one packed row per part of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            asks, query, doc, score, routes = (b.column(c).to_numpy() for c in ("asks", "query", "doc", "score", "routes"))
            block = np.searchsorted(borders, doc, "right")
            part = block * qb + asks
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0, True]) if len(part) else []
            for a, z in zip(edges, edges[1:]):
                x = order[a:z]
                blobs = [pa.array([v[x].astype(t).tobytes()], pa.binary()) for v, t in ((query, "<i8"), (score, "<f8"), (doc, "<i8"), (routes, "u1"))]
                numbers = [pa.array([int(v)], pa.int32()) for v in (part[x[0]], _OTHERS, block[x[0]])]
                none = pa.array([[]], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([*numbers, *blobs[:3], none, blobs[3], pa.array([b""], pa.binary())], schema=blocks._TYPES)

    return run


class Matches:
    """How many names of a query each document of a range has."""

    def __init__(self, docs: list[dict], asks: list[dict]):
        known: dict[str, int] = {}
        apart = lambda s: np.arange(len(s))
        self.asks = blocks.Sparse(asks, lambda w: known.setdefault(w, len(known)), lambda v, _: v, apart)
        d = blocks.Sparse(docs, lambda w: known.get(w, -1), lambda v, _: v, apart)
        self.ids, self.n = d.ids, d.n
        row = np.repeat(np.arange(d.n, dtype=np.int32), np.diff(d.at))
        by = np.argsort(d.codes, kind="stable")
        self.rows, self.begin = row[by], np.searchsorted(d.codes[by], np.arange(len(known) + 1))
        often = np.argsort(-np.diff(self.begin), kind="stable")[:HELD]
        self.line = np.full(len(known), -1)
        self.line[often] = np.arange(len(often))
        self.table = np.zeros((len(often), d.n), np.uint8)
        held = self.line[d.codes] >= 0
        self.table[self.line[d.codes[held]], row[held]] = 1

    def of(self, q: int) -> np.ndarray:
        """Of the q-th query, for each document."""
        names = self.asks.codes[self.asks.at[q] : self.asks.at[q + 1]]
        line = self.line[names]
        m = self.table[line[line >= 0]].sum(0, dtype=np.uint8 if len(names) < 256 else np.uint16 if len(names) < 65536 else np.int64)
        for c in names[line < 0]:
            m[self.rows[self.begin[c] : self.begin[c + 1]]] += 1
        return m


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[dict]]]]:
    """The packed pieces of each part by kind."""
    held: dict[int, dict[int, list]] = {}
    for b in batches:
        for i in range(b.num_rows):
            p = {c: b.column(c)[i].as_py() for c in blocks._PACKED_COLUMNS} | {"words": b.column("words")[i].values}
            held.setdefault(p["part"], {}).setdefault(p["kind"], []).append(p)
    for part in sorted(held):
        yield part, held.pop(part)


def _count(qb: int):
    """Documents of a range per query and number of matches: for a query of n names the counts of 1 to n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, said in _parts(batches):
            if _DOCS in said and _ASKS in said:
                m = Matches(said[_DOCS], said[_ASKS])
                at = m.asks.at
                counts = np.zeros(at[-1], "<i4")
                for q in range(m.asks.n):
                    counts[at[q] : at[q + 1]] = np.bincount(m.of(q), minlength=at[q + 1] - at[q] + 1)[1:]
                row = [[part % qb], [part // qb], [np.diff(at).astype("<i4").tobytes()], [counts.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, _COUNTED_TYPES)], schema=_COUNTED_TYPES)

    return run


def _begin(counted: pa.Table) -> pa.Table:
    """Documents ahead of each range's first one, per query and number of matches; the ranges of one block of queries come in."""
    t = counted.sort_by("block")
    counts = [np.frombuffer(x.as_buffer(), "<i4") for x in t["counts"]]
    ends = np.cumsum(np.frombuffer(t["sizes"][0].as_buffer(), "<i4"))
    total = np.zeros(len(counts[0]), np.int64)
    for x in counts:
        total += x
    ahead = np.cumsum(total)
    ahead = np.repeat(ahead[ends - 1], np.diff(np.r_[0, ends])) - ahead  # those with more matches
    out = []
    for x in counts:
        out.append(ahead.astype("<i8").tobytes())
        ahead = ahead + x
    return t.set_column(t.schema.get_field_index("counts"), "counts", pa.array(out, pa.binary()))


def _others(pieces: list[dict]) -> tuple[np.ndarray, ...]:
    """(query, doc, score, routes) of the other routes, a pair once, ordered by query and document."""
    q, s, d, r = (np.concatenate([np.frombuffer(p[c], t) for p in pieces] or [np.empty(0, t)]) for c, t in (("ids", "<i8"), ("sizes", "<f8"), ("counts", "<i8"), ("codes", "u1")))
    order = np.lexsort((-r.astype(int), d, q))
    q, d, s, r = q[order], d[order], s[order], r[order]
    first = np.flatnonzero(np.r_[True, (np.diff(q) != 0) | (np.diff(d) != 0)]) if len(q) else np.empty(0, int)
    return (q[first], d[first], np.add.reduceat(s, first), np.bitwise_or.reduceat(r, first)) if len(q) else (q, d, s, r)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fused rows of each part."""
    for _, said in _parts(batches):
        oq, od, os_, orr = _others(said.get(_OTHERS, []))
        alone = np.ones(len(oq), bool)  # pairs that the entity route does not have
        held, n = [], 0
        if _DOCS in said and _ASKS in said:
            m = Matches(said[_DOCS], said[_ASKS])
            at, ids = m.asks.at, m.asks.ids
            begin = np.frombuffer(said[_BEGIN][0]["counts"], "<i8")
            first, last = np.searchsorted(oq, ids, "left"), np.searchsorted(oq, ids, "right")
            place = np.minimum(np.searchsorted(m.ids, od), max(m.n - 1, 0))
            there = (m.ids[place] == od) if m.n else np.zeros(len(od), bool)
            where = np.empty(m.n, np.int64)
            for q in range(m.asks.n):
                of = m.of(q)
                many = np.bincount(of, minlength=at[q + 1] - at[q] + 1)[:0:-1]  # most matches first
                size = int(many.sum())
                if not size:
                    continue
                row = np.argsort(of.max() - of, kind="stable")[:size]
                rank = np.repeat(begin[at[q] : at[q + 1]][::-1] - (np.cumsum(many) - many), many) + np.arange(1, size + 1)
                score, routes = WEIGHTS["entity"] / (RANK_OFFSET + rank), np.ones(size, np.int8)
                if first[q] < last[q]:
                    x = np.arange(first[q], last[q])[there[first[q] : last[q]]]
                    x = x[of[place[x]] > 0]
                    where[row] = np.arange(size)
                    score[where[place[x]]] += os_[x]
                    routes[where[place[x]]] |= orr[x].astype(np.int8)
                    alone[x] = False
                held.append((np.full(size, ids[q]), m.ids[row], score, routes))
                n += size
                if n >= BATCH:
                    yield _batch(held)
                    held, n = [], 0
        held.append((oq[alone], od[alone], os_[alone], orr[alone].astype(np.int8)))
        yield _batch(held)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    q, d, s, r = (np.concatenate(x) for x in zip(*held))
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((q, d, rounded(s), r), _OUT)], schema=_OUT)


def rrf(others: dict[str, DataFrame], found: DataFrame, names: DataFrame, ids: DataFrame) -> DataFrame:
    """``fusion.rrf`` of ranked routes and the entity route: (query, doc, score rounded, signals joined by +).

    ``others``: (query, doc, rank) per route, few rows per query. ``found``: distinct (doc, name). ``names``: distinct
    (query, name). ``ids``: (doc) of all documents. The entity route ranks by number of names found, then by document. All ids
    are whole numbers.
    """
    spark = found.sparkSession
    ship(spark)
    names = materialize(names)
    n, m = ids.count(), names.select("query").distinct().count()
    cores = spark.sparkContext.defaultParallelism
    rb, qb = max(1, -(-n // ROWS), min(2 * cores, n // 2_000)), max(1, -(-m // ASKING))
    cuts = ids.select(F.col("doc").cast("double").alias("doc")).approxQuantile("doc", [i / rb for i in range(1, rb)], 0.1 / rb) if rb > 1 else []
    borders = np.unique(np.array(cuts, float).astype(np.int64))  # any borders do; a document's range follows from them alone
    rb = len(borders) + 1

    asks = F.pmod(F.xxhash64(F.col("query").cast("long")), F.lit(qb)).cast("int")
    row = lambda c: (F.col(c).cast("long").alias("id"), F.lit(0.0).alias("size"), F.col("name").alias("term"), F.lit(1.0).alias("value"))
    # a document's names lie together, so that a piece names it once
    docs = found.repartition("doc").select(*row("doc")).mapInArrow(_with_block(borders, blocks._packer(_DOCS, lambda b: [b])), _SAID)
    docs = materialize(docs)
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    docs = docs.withColumn("q", every(qb)).withColumn("part", (F.col("block") * qb + F.col("q")).cast("int")).drop("q")
    asked = names.select(asks.alias("block"), *row("query")).mapInArrow(blocks._packer(_ASKS, lambda b: [b]), _SAID)
    asked = asked.withColumn("r", every(rb)).withColumn("part", (F.col("r") * qb + F.col("block")).cast("int")).drop("r")
    both = docs.unionByName(asked)

    counted = both.repartitionById(rb * qb, F.col("part")).mapInArrow(_count(qb), _COUNTED)
    begin = counted.groupBy("asks").applyInArrow(_begin, _COUNTED)
    none = F.lit(b"")
    begin = begin.select(
        (F.col("block") * qb + F.col("asks")).cast("int").alias("part"), F.lit(_BEGIN).alias("kind"), "block", none.alias("ids"), none.alias("sizes"), "counts",
        F.array().cast("array<string>").alias("words"), none.alias("codes"), none.alias("values"),
    )
    hits = None
    for name, df in others.items():
        score = F.lit(WEIGHTS[name]) / (RANK_OFFSET + F.col("rank"))
        part = df.select(asks.alias("asks"), F.col("query").cast("long").alias("query"), F.col("doc").cast("long").alias("doc"), score.alias("score"), F.lit(1 << ROUTES.index(name)).alias("routes"))
        hits = part if hits is None else hits.unionByName(part)
    both = both.unionByName(begin).unionByName(hits.mapInArrow(_pack_others(borders, qb), _SAID))
    out = both.repartitionById(rb * qb, F.col("part")).mapInArrow(_rows, "query long, doc long, score double, routes tinyint")
    said = ["+".join(r for i, r in enumerate(ROUTES) if bits >> i & 1) for bits in range(1, 1 << len(ROUTES))]
    return out.select("query", "doc", "score", F.element_at(F.array(*map(F.lit, said)), F.col("routes").cast("int")).alias("signals"))
