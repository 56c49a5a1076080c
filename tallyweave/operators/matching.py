"""Greedy one-to-one matching of reference rows to extracted rows."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

from tallyweave.functions import fuzzy

LEAST = 55.0


def match_page(gold: list[tuple[int, str]], got: list[tuple[int, str]]) -> list[tuple[int, int, float]]:
    """Exact labels reserve their rows first; then each gold row in order takes the best free one above the limit."""
    free = dict(got)
    out: dict[int, tuple[int, float]] = {}
    by_label: dict[str, list[int]] = {}
    for i, label in got:
        by_label.setdefault(label, []).append(i)
    for i, label in gold:
        if twins := [t for t in by_label.get(label, ()) if t in free]:
            out[i] = (twins[0], 100.0)
            del free[twins[0]]
    for i, label in gold:
        if i not in out and free:
            best, score = max(((j, fuzzy.ratio(label, other)) for j, other in free.items()), key=lambda x: (x[1], -x[0]))
            if score >= LEAST:
                out[i] = (best, score)
                del free[best]
    return [(i, *out[i]) for i, _ in gold if i in out]


def greedy_match(gold: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """``key, gold_id, row_id, score``; a page is one group, its rows are tens."""

    def run(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        a = list(left.sort_values("gold_id")[["gold_id", "label"]].itertuples(index=False, name=None))
        b = list(right.sort_values("row_id")[["row_id", "label"]].itertuples(index=False, name=None))
        return pd.DataFrame([(k[0], *m) for m in match_page(a, b)], columns=[key, "gold_id", "row_id", "score"])

    left = gold.select(key, "gold_id", "label")
    right = got.toDF(*[f"r_{c}" for c in got.columns]).selectExpr(f"r_{key}", "r_row_id AS row_id", "r_label AS label")
    return left.groupBy(key).cogroup(right.groupBy(f"r_{key}")).applyInPandas(run, f"{key} bigint, gold_id bigint, row_id bigint, score double")
