"""Maximal cliques of pair graphs, cluster by cluster."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def enumerate_cliques(near: dict[int, set[int]]) -> list[list[int]]:
    """Sorted members of every maximal clique of two nodes or more, by search with a pivot of most open neighbours."""
    out: list[list[int]] = []
    stack = [([], set(near), set())]
    while stack:
        chosen, open_, shut = stack.pop()
        if not open_:
            if not shut and len(chosen) > 1:
                out.append(sorted(chosen))
            continue
        pivot = max(open_ | shut, key=lambda x: len(near[x] & open_))
        for x in sorted(open_ - near[pivot]):
            stack.append(([*chosen, x], open_ & near[x], shut & near[x]))
            open_ = open_ - {x}
            shut = shut | {x}
    return sorted(out)


def maximal_cliques(pairs: DataFrame) -> DataFrame:
    """(label, members array<long>) of the pair graph (label, i, j); clusters are bounded by the split of oversize ones."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        near: dict[int, set[int]] = {}
        for a, b in p[["i", "j"]].itertuples(index=False):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        found = enumerate_cliques(near)
        return pd.DataFrame({"label": [p.label.iloc[0]] * len(found), "members": found})

    return pairs.select("label", "i", "j").where(F.col("i") != F.col("j")).groupBy("label").applyInPandas(run, "label long, members array<long>")
