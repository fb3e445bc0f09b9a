"""Shared pieces: whole groups out of Arrow batches, stars, and connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import materialize


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, pd.DataFrame]]:
    """Groups of a partition that is sorted by key; only the open group is held between batches."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        values = b[key].to_numpy()
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        bounds = [0, *cuts.tolist(), len(b)]
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            part = b.iloc[lo:hi]
            if held and held[0][key].iloc[0] != values[lo]:
                yield held[0][key].iloc[0], held[0] if len(held) == 1 else pd.concat(held)
                held = []
            held.append(part)
    if held:
        yield held[0][key].iloc[0], held[0] if len(held) == 1 else pd.concat(held)


def stars(names: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least name of the group, other name) for each other member of the groups that label tells apart.

    The centre does not depend on any order, so stars of overlapping groups coincide."""
    order = np.lexsort((names, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]])
    centre = names[order][first][np.cumsum(first) - 1]
    other = centre != names[order]
    return centre[other], names[order][other]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its least node) for every node of the edges.

    Least labels pass along the edges, then jump to the label's own label; each round is written
    to the shared folder. Rounds grow with the logarithm of a component's diameter.
    """
    both = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).unionByName(edges.select(F.col(b).alias("u"), F.col(a).alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.u == labels.node).groupBy("v").agg(F.min("component").alias("near"))
        moved = labels.join(near, labels.node == near.v).select("node", "component", F.least("component", "near").alias("next"))
        own = labels.select(F.col("node").alias("at"), F.col("component").alias("jump"))
        new = materialize(moved.join(own, F.col("next") == F.col("at")).select("node", F.col("component").alias("old"), F.least("next", "jump").alias("component")), "labels")
        labels = new.select("node", "component")
        if new.filter("component <> old").isEmpty():
            return labels
