"""Rankings from paired comparisons, and resampled intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regularised(edges: DataFrame, extra: float = 0.1) -> DataFrame:
    """Every ordered pair of methods, with `extra` on its weight. Methods are few: the pairs are the square of their number."""
    methods = edges.select(F.explode(F.array("winner", "loser")).alias("m")).distinct()
    a, b = methods.withColumnRenamed("m", "winner"), methods.withColumnRenamed("m", "loser")
    return a.join(b, F.col("winner") != F.col("loser")).join(edges, ["winner", "loser"], "left").select("winner", "loser", (F.coalesce("weight", F.lit(0.0)) + extra).alias("weight"))


def reaches(edges: DataFrame, rounds: int = 16) -> DataFrame:
    """(a, b): b can be reached from a over positive edges, by doubling paths; `rounds` doublings reach 2 ** rounds methods."""
    found = edges.where("weight > 0").select(F.col("winner").alias("a"), F.col("loser").alias("b")).distinct()
    n, before = -1, None
    for _ in range(rounds):
        step = found.join(found.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b"))
        found = found.union(step).distinct().cache()
        now = found.count()
        if before:
            before.unpersist()
        if now == n:
            break
        n, before = now, found
    return found


def strongly_connected(edges: DataFrame) -> DataFrame:
    """One row: whether every method reaches every other."""
    methods = edges.select(F.explode(F.array("winner", "loser")).alias("m")).distinct().agg(F.count("*").alias("n"))
    pairs = reaches(edges).where("a <> b").agg(F.count("*").alias("pairs"))
    return methods.crossJoin(pairs).select("n", "pairs", (F.col("pairs") == F.col("n") * (F.col("n") - 1)).alias("connected"))


def bradley_terry(edges: DataFrame, extra: float = 0.1, tolerance: float = 1e-9, rounds: int = 1000) -> DataFrame:
    """Strengths of geometric mean 1 by the minorise-maximise fit of the regularised win graph, with Fisher standard errors and ranks.

    The graph has a row for each pair of methods; one grouped task holds it.
    """

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(pdf.winner) | set(pdf.loser))
        if len(names) < 2:
            raise ValueError("at least two methods are needed")
        at = {m: i for i, m in enumerate(names)}
        wins = np.zeros((len(names), len(names)))
        for r in pdf.itertuples():
            wins[at[r.winner], at[r.loser]] = r.weight
        games, won, p, done = wins + wins.T, wins.sum(1), np.ones(len(names)), False
        for _ in range(rounds):
            new = won / (games / (p[:, None] + p[None, :])).sum(1)
            new /= np.exp(np.log(new).mean())
            done = bool(np.abs(new - p).max() < tolerance)
            p = new
            if done:
                break
        info = (games * p[:, None] * p[None, :] / (p[:, None] + p[None, :]) ** 2).sum(1)
        error = np.where(info > 0, 1 / np.sqrt(np.where(info > 0, info, 1)), np.inf)
        out = pd.DataFrame({"method": names, "strength": p, "log_strength": np.log(p), "stderr": error, "converged": done}).sort_values(["strength", "method"], ascending=[False, True])
        return out.assign(rank=np.arange(1, len(out) + 1))

    return regularised(edges, extra).withColumn("_all", F.lit(1)).groupBy("_all").applyInPandas(fit, "method string, strength double, log_strength double, stderr double, converged boolean, rank bigint")


def resampled_means(v: np.ndarray, resamples: int, seed: int, draws: int = 1 << 17) -> np.ndarray:
    """Means of resamples of v, as default_rng(seed).integers(0, len(v), (resamples, len(v))) draws them, `draws` numbers at a time: a generator goes on where it stopped."""
    rng, n = np.random.default_rng(seed), len(v)
    if n > draws:
        return np.array([sum(float(v[rng.integers(0, n, min(draws, n - i))].sum()) for i in range(0, n, draws)) / n for _ in range(resamples)])
    step = draws // n
    return np.concatenate([v[rng.integers(0, n, (min(step, resamples - i), n))].mean(1) for i in range(0, resamples, step)])


def bootstrap_numpy(values: DataFrame, group: str, value: str, resamples: int = 2000, seed: int = 12345) -> DataFrame:
    """Percentile interval of the mean over resampled rows of a group, with numpy's generator.

    A group's task holds its values once, from their distinct ones and how often each occurs, and draws one after the other, as the generator does.
    Groups are dealt over 64 parts of a few rows each, which must not be put together again, as their work is not in their rows.
    """
    import pyarrow as pa

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x, n = table.column("_x").to_numpy(), table.column("_n").to_numpy()
        order = np.argsort(x)
        v = np.repeat(x[order], n[order])
        low, high = np.percentile(resampled_means(v, resamples, seed), [2.5, 97.5])
        return pa.table({group: pa.array([key[0].as_py()], pa.string()), "mean": [float(v.mean())], "low": [float(low)], "high": [float(high)]})

    each = values.where(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    return each.repartition(64, group).groupBy(group).applyInArrow(run, f"{group} string, mean double, low double, high double")


def bootstrap_hash(values: DataFrame, group: str, key: str, value: str, resamples: int = 100) -> DataFrame:
    """Interval of the mean by weights that follow from md5 of row and resample: exact reruns, any number of rows, no Python.

    A row's weight in a resample is Poisson(1), from its inverse distribution function.
    """
    u = F.conv(F.substring(F.md5(F.concat_ws("-", F.col(key).cast("string"), F.col("b").cast("string"))), 1, 7), 16, 10).cast("double") / float(1 << 28)
    weight = sum((F.when(u >= c, 1.0).otherwise(0.0) for c in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015)), F.lit(0.0))
    rows = values.where(F.col(value).isNotNull()).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight)
    means = rows.groupBy(group, "b").agg((F.sum(F.col("w") * F.col(value)) / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    p = means.groupBy(group).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return p.select(group, F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
