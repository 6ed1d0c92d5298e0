"""Least-squares placement and levelling of tiles from links between them, one group (a core, a deck, a slide) per task."""

from __future__ import annotations

from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _anchored(n: int, i: np.ndarray, j: np.ndarray, shift: np.ndarray, w: np.ndarray, anchor: float, prior: float) -> np.ndarray:
    """Positions p with p[j] - p[i] near shift: node 0 held at 0 with weight anchor, every node drawn to 0 by prior.

    Conjugate gradients on the normal equations, of which only the links are stored; from a start at 0 they end at the
    solution of least length where the links alone leave it open.
    """
    w2, own = w * w, np.full(n, prior * prior)
    own[0] += anchor * anchor

    def times(p: np.ndarray) -> np.ndarray:
        pull = w2 * (p[j] - p[i])
        return np.bincount(j, pull, n) - np.bincount(i, pull, n) + own * p

    pull = w2 * shift
    rest = np.bincount(j, pull, n) - np.bincount(i, pull, n)
    p, step, size = np.zeros(n), rest.copy(), float(rest @ rest)
    least = 1e-26 * size
    for _ in range(20 * n + 100):
        if size <= least:
            return p
        onto = times(step)
        by = size / float(step @ onto)
        p, rest = p + by * step, rest - by * onto
        size, before = float(rest @ rest), size
        step = rest + size / before * step
    if size > 1e-16 * max(1.0, least * 1e26):
        raise ArithmeticError("the placement did not converge")
    return p


def positions(links: DataFrame, group: str, anchor: float = 1.0, prior: float = 0.0) -> DataFrame:
    """group, node, y, x. links: group, i, j, dy, dx, weight (its square root weighs the equation); the lowest node is at 0."""

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(frame[["i", "j"]].to_numpy())
        i, j = np.searchsorted(nodes, frame["i"]), np.searchsorted(nodes, frame["j"])
        w = np.sqrt(np.maximum(frame["weight"].to_numpy(float), 0))
        y, x = (_anchored(len(nodes), i, j, frame[c].to_numpy(float), w, anchor, prior) for c in ("dy", "dx"))
        return pd.DataFrame({group: frame[group].iloc[0], "node": nodes, "y": y, "x": x})

    kind = dict(links.dtypes)[group]
    return links.select(group, "i", "j", "dy", "dx", "weight").groupBy(group).applyInPandas(solve, f"{group} {kind}, node long, y double, x double")


def gains(ratios: DataFrame, group: str, ridge: float = 0.1) -> DataFrame:
    """group, node, gain: factors whose logs differ as the links say, kept small by the ridge, with a mean log of 0.

    ratios: group, i, j, log_ratio (ln of j over i on what both show), weight.
    """

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(frame[["i", "j"]].to_numpy())
        i, j = np.searchsorted(nodes, frame["i"]), np.searchsorted(nodes, frame["j"])
        g = _anchored(len(nodes), i, j, -frame["log_ratio"].to_numpy(float), np.sqrt(frame["weight"].to_numpy(float)), 0.0, ridge)
        return pd.DataFrame({group: frame[group].iloc[0], "node": nodes, "gain": np.exp(g - g.mean())})

    kind = dict(ratios.dtypes)[group]
    return ratios.select(group, "i", "j", "log_ratio", "weight").groupBy(group).applyInPandas(solve, f"{group} {kind}, node long, gain double")


def grow(edges: DataFrame, group: str) -> DataFrame:
    """group, node, via, step: placement that starts at the lowest node and always adds the best edge to what is placed.

    edges: group, i, j, good (boolean), ncc. Best: good ones first, then ncc, then the lower ids. Nodes that no edge
    reaches are absent.
    """

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        edges: dict[int, list[tuple]] = {}
        for i, j, g, r in frame[["i", "j", "good", "ncc"]].itertuples(index=False):
            row = (not g, -r, int(min(i, j)), int(max(i, j)))
            edges.setdefault(row[2], []).append(row)
            edges.setdefault(row[3], []).append(row)
        start = min(edges)
        placed, out, front = {start}, [(start, -1, 0)], edges[start][:]
        heapify(front)
        while front:
            best = heappop(front)
            if best[2] in placed and best[3] in placed:
                continue
            old, new = (best[2], best[3]) if best[2] in placed else (best[3], best[2])
            placed.add(new)
            out.append((new, old, len(out)))
            for row in edges[new]:
                heappush(front, row)
        got = pd.DataFrame(out, columns=["node", "via", "step"])
        got.insert(0, group, frame[group].iloc[0])
        return got

    kind = dict(edges.dtypes)[group]
    return edges.select(group, "i", "j", "good", "ncc").groupBy(group).applyInPandas(place, f"{group} {kind}, node long, via long, step long")


def components(edges: DataFrame, nodes: DataFrame, store, most_rounds: int = 40) -> DataFrame:
    """id, component (its lowest id): labels sink along the edges, and each label jumps to its own label's label.

    store(df) writes a round's labels and reads them back, so that the plan does not grow.
    """
    both = store(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = store(nodes.select("id", F.col("id").alias("component")))
    for _ in range(most_rounds):
        low = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("component").alias("_m"))
        sunk = labels.join(low, F.col("id") == F.col("a"), "left").select("id", F.col("component").alias("_old"), F.least("component", F.coalesce("_m", "component")).alias("_l"))
        jump = labels.select(F.col("id").alias("_i"), F.col("component").alias("_j"))
        new = store(sunk.join(jump, F.col("_l") == F.col("_i"), "left").select("id", "_old", F.least("_l", F.coalesce("_j", "_l")).alias("component")))
        changed = new.where("component <> _old").limit(1).count()
        labels = new.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components aren't complete after {most_rounds} rounds")
