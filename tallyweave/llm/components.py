"""Connected components of an edge table, by minimum labels and pointer jumping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import materialize

_SIGN = ("count(*) AS n", "bit_xor(xxhash64(u, v)) AS x", "sum(pmod(xxhash64(v, u, 1), 2147483647)) AS s")


def forest(pairs: Iterator[tuple[int, int]], parent: dict[int, int] | None = None) -> dict[int, int]:
    """Each node of ``pairs`` with the smallest node it is connected with, by union-find."""
    parent = {} if parent is None else parent

    def root(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in list(parent)}


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each task as stars: one edge for each node but the smallest of what it is connected with.

    A task holds the nodes of its own edges; edges stay where they are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}
        for batch in batches:
            forest(zip(batch["u"].tolist(), batch["v"].tolist(), strict=True), parent)
        stars = [(x, r) for x, r in forest(iter(()), parent).items() if x != r]
        for at in range(0, len(stars), 100_000):
            yield pd.DataFrame(stars[at : at + 100_000], columns=["u", "v"])

    return edges.mapInPandas(run, "u bigint, v bigint")


def connected(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b``: the smallest node it is connected with.

    Each task first turns its own edges into stars.  Then large-star and small-star alternate: each round
    hangs a node's larger neighbours, then its smaller ones, on the smallest it knows, until a round
    changes nothing.  A round is one aggregation and one join for either; a node with very many edges is
    summed per task first and its join is split by AQE.  Without edges there is no round.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = materialize(_contracted(pairs).distinct())
    told = edges.selectExpr(*_SIGN).first()
    while told.n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        # Stars only once a round changes nothing; the edge set is told by its size and two hash sums.
        before, told = told, edges.selectExpr(*_SIGN).first()
        if before == told:
            break
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
