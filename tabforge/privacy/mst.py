"""The maximum-spanning-tree marginal mechanism (McKenna, Miklau and Sheldon 2021) under zCDP.

A third of rho measures one-way marginals, a third selects a tree of pairs by the exponential mechanism, a third measures those.
Marginals are counted in Spark; only noisy ones leave ``fit``.  Rows are sampled from the noisy tree, in Spark.
"""

from __future__ import annotations

import math
import secrets
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.operators.synth import uniform
from tabforge.privacy.accounting import rho_of, sigma_of
from tabforge.privacy.codebook import Codebook, admit
from tabforge.schema import CANDIDATE_INDEX


def _marginals(coded: DataFrame, groups: list[tuple[str, ...]], domain: dict[str, int]) -> dict[tuple[str, ...], np.ndarray]:
    """Counts over each group's cells, all groups in one shuffle; their size is bounded by the public domain."""
    cell = lambda g: sum((F.col(f"`{c}`") * int(np.prod([domain[x] for x in g[i + 1 :]], dtype=int)) for i, c in enumerate(g)), F.lit(0))
    rows = coded.select(F.explode(F.array(*(F.struct(F.lit(i).alias("g"), cell(g).cast("long").alias("cell")) for i, g in enumerate(groups)))).alias("r")).select("r.*").groupBy("g", "cell").count().collect()
    out = {g: np.zeros(int(np.prod([domain[c] for c in g]))) for g in groups}
    for r in rows:
        out[groups[r["g"]]][r["cell"]] = r["count"]
    return {g: v.reshape([domain[c] for c in g]) for g, v in out.items()}


def _shares(noisy: np.ndarray) -> np.ndarray:
    """A distribution from noisy counts: negatives are 0, and nothing at all is uniform."""
    p = np.maximum(noisy, 0)
    return p / p.sum() if p.sum() > 0 else np.full(p.shape, 1 / p.size)


@dataclass(frozen=True)
class TreeModel:
    """A distribution for the root and one of each other column given its parent."""

    codebook: Codebook
    order: tuple[tuple[str, str | None], ...]
    tables: dict[str, np.ndarray]

    def sample(self, spark: SparkSession, start: int, stop: int, seed: int) -> DataFrame:
        """(index, codes...) of rows start up to stop: each column by the inverse of its distribution given its parent's code."""
        out = spark.range(start, stop).withColumnRenamed("id", CANDIDATE_INDEX)
        for name, parent in self.order:
            cum = np.cumsum(self.tables[name], axis=-1)
            u = uniform(F.col(CANDIDATE_INDEX), f"code/{name}", seed)
            rows = F.array(*(F.array(*map(F.lit, map(float, r[:-1]))) if len(r) > 1 else F.array().cast("array<double>") for r in np.atleast_2d(cum)))
            row = F.get(rows, F.lit(0) if parent is None else F.col(f"`{parent}`"))
            out = out.withColumn("__u", u).withColumn(name, F.size(F.filter(row, lambda e: e <= F.col("__u"))).cast("int")).drop("__u")
        return out.select(CANDIDATE_INDEX, *(F.col(f"`{c.name}`") for c in self.codebook.columns))


def fit(df: DataFrame, codebook: Codebook, epsilon: float, delta: float) -> TreeModel:
    """Fits on private rows; noise comes from the operating system's generator, and no seed is kept."""
    domain = codebook.domain()
    admit(domain)
    names = list(domain)
    rho = rho_of(epsilon, delta)
    draw = np.random.Generator(np.random.PCG64(secrets.randbits(256)))
    # d one-way marginals share a third of rho: each gets noise for d / 3 of them
    one_sigma = sigma_of(rho) * math.sqrt(len(names))
    coded = codebook.encode(df).persist()
    one = {g[0]: v + draw.normal(0, one_sigma, v.shape) for g, v in _marginals(coded, [(c,) for c in names], domain).items()}
    edges: list[tuple[str, str]] = []
    pairs: dict[tuple[str, ...], np.ndarray] = {}
    if len(names) > 1:
        every = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
        true = _marginals(coded, every, domain)
        total = max(1.0, float(np.mean([v.sum() for v in one.values()])))
        score = {e: np.abs(true[e] - np.outer(_shares(one[e[0]]), _shares(one[e[1]])) * total).sum() for e in every}
        step = math.sqrt(8 * (rho / 3) / (len(names) - 1))
        group = {c: c for c in names}
        for _ in range(len(names) - 1):
            open_ = [e for e in every if group[e[0]] != group[e[1]]]
            z = np.array([score[e] for e in open_]) * step / 2
            p = np.exp(z - z.max())
            a, b = chosen = open_[draw.choice(len(open_), p=p / p.sum())]
            edges.append(chosen)
            group = {c: group[a] if g == group[b] else g for c, g in group.items()}
        sigma = sigma_of(rho) * math.sqrt(len(edges))
        pairs = {e: true[e] + draw.normal(0, sigma, true[e].shape) for e in edges}
        del true, score
    coded.unpersist()
    root = names[0]
    order, tables, seen, todo = [(root, None)], {root: _shares(one[root])}, {root}, list(edges)
    while todo:
        e = next(e for e in todo if (e[0] in seen) != (e[1] in seen))
        todo.remove(e)
        parent, child = e if e[0] in seen else e[::-1]
        joint = pairs[e] if e[0] == parent else pairs[e].T
        tables[child] = np.stack([_shares(r) for r in joint])
        order.append((child, parent))
        seen.add(child)
    return TreeModel(codebook, tuple(order), tables)


def synthesize(df: DataFrame, codebook: Codebook, epsilon: float, delta: float, n: int, seed: int) -> DataFrame:
    """n rows with declared values; ``seed`` is public and only drives sampling after the noise."""
    model = fit(df, codebook, epsilon, delta)
    return codebook.decode(model.sample(df.sparkSession, 0, n, seed), CANDIDATE_INDEX, seed)
