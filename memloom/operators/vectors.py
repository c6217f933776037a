"""Vector search over a table of (id, vector) for batches of queries, exact and in blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexical import top_k

#: Rows of a block on the searched and on the asking side.
ROWS, ASKING = 20_000, 2_000


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; -1 where lengths differ or a vector is zero or null."""
    size = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(-1.0)


def unit(v: Column) -> Column:
    """The vector at length one (as it is if its length is zero)."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)


# How a distance of each metric becomes a score in which more is nearer.
SCORES = {
    "cosine": lambda d: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d)),
    "l2": lambda d: 1 / (1 + d),
    "l2_squared": lambda d: 1 / (1 + d),
    "l1": lambda d: 1 / (1 + d),
    "dot": lambda d: -d,
    "hamming": lambda d: 1 / (1 + d),
}


def distance(a: Column, b: Column, metric: str) -> Column:
    """Distance of two arrays under a metric of ``SCORES``."""
    gap = lambda f: F.aggregate(F.zip_with(a, b, lambda x, y: f(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return {
        "cosine": lambda: 1 - cosine(a, b),
        "l2": lambda: F.sqrt(gap(lambda d: d * d)),
        "l2_squared": lambda: gap(lambda d: d * d),
        "l1": lambda: gap(F.abs),
        "dot": lambda: -dot(a, b),
        "hamming": lambda: gap(lambda d: F.when(d != 0, 1.0).otherwise(0.0)),
    }[metric]()


def knn(queries: DataFrame, rows: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """Exact cosine top-k: (query, doc, score, rank). Inputs are (query, vector) and (doc, vector).

    Both sides are cut into hash blocks whose number follows their counts; every pair of blocks meets
    in one task as a matrix product that keeps only its top k per query, so a task holds
    ``ROWS`` + ``ASKING`` vectors whatever the table size. Null, empty or zero vectors are no neighbours;
    vectors of another length than the query's are none either; ties go to the smaller id.
    """
    n, m = rows.count(), queries.count()
    rb, qb = max(1, -(-n // ROWS)), max(1, -(-m // ASKING))
    blocks = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = rows.where("vector is not null").select("doc", "vector", F.pmod(F.xxhash64("doc"), F.lit(rb)).cast("int").alias("rb"), blocks(qb).alias("qb"))
    right = queries.where("vector is not null").select("query", "vector", F.pmod(F.xxhash64("query"), F.lit(qb)).cast("int").alias("qb"), blocks(rb).alias("rb"))

    def block(key: tuple, docs: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim, part in docs.groupby(docs["vector"].map(len)):
            q = asks[asks["vector"].map(len) == dim]
            if not dim or q.empty:
                continue
            part = part.sort_values("doc", kind="stable")
            a, b = np.stack(q["vector"]).astype(float), np.stack(part["vector"]).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                s = (a @ b.T) / np.sqrt((a * a).sum(1)[:, None] * (b * b).sum(1)[None, :])
            s = np.where(np.isfinite(s), s, -np.inf)
            for i, qid in enumerate(q["query"]):
                best = np.argsort(-s[i], kind="stable")[:k]
                best = best[s[i][best] > least] if least > -1 else best[np.isfinite(s[i][best])]
                out.append(pd.DataFrame({"query": qid, "doc": part["doc"].to_numpy()[best], "score": s[i][best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "doc": [], "score": []})

    types = dict(queries.dtypes)["query"], dict(rows.dtypes)["doc"]
    scored = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(block, f"query {types[0]}, doc {types[1]}, score double")
    return top_k(scored, k)
