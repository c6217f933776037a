"""Filling an answer with ranked evidence under a token budget."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

# Most rows of an answer, tokens of an answer, bonus of an unseen item and of an unseen source.
ROWS, BUDGET = 100, 6000
NEW_ITEM, NEW_SOURCE = 0.35, 0.15

OUT = "query {q}, doc {d}, place int, cost long, spent long"


def pack(ranked: DataFrame, budget: int = BUDGET, rows: int = ROWS, coverage: bool = False) -> DataFrame:
    """Greedy packing per query: (query, doc, place, cost, spent).

    ``ranked``: (query, doc, score, key, cost) and for ``coverage`` also (item, source). Candidates are
    taken by score (ties by doc); one whose key was taken already or whose cost no longer fits is skipped and
    smaller later ones may still fit. With ``coverage`` the next is the one whose score, raised for an
    item or source not yet shown, is highest. Selection is sequential within a query, so a query's
    candidates meet in one task: search routes bound them (candidate limits), so the group is bounded too.
    Null costs count as 0, null scores last.
    """
    types = dict(ranked.dtypes)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc"], ascending=[False, True], kind="stable", na_position="last")
        left = list(pdf.fillna({"cost": 0, "score": 0.0}).itertuples(index=False))
        keys, items, sources, out, spent = set(), set(), set(), [], 0
        while left and len(out) < rows:
            at = 0
            if coverage:
                worth = [c.score * (1 + NEW_ITEM * (c.item not in items) + NEW_SOURCE * (c.source not in sources)) for c in left]
                at = max(range(len(left)), key=lambda i: worth[i])
            c = left.pop(at)
            if c.key in keys or spent + c.cost > budget:
                continue
            spent += int(c.cost)
            keys.add(c.key)
            if coverage:
                items.add(c.item)
                sources.add(c.source)
            out.append((c.query, c.doc, len(out) + 1, int(c.cost), spent))
        return pd.DataFrame(out, columns=["query", "doc", "place", "cost", "spent"])

    return ranked.groupBy("query").applyInPandas(one, OUT.format(q=types["query"], d=types["doc"]))
