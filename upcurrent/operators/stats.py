"""Effect sizes, strata and correlations.

Point estimates are relational. Intervals come from a bootstrap in grouped pandas functions, which see counts of distinct values or cells
rather than rows: drawing from counts is the same resampling, and a group's size follows the number of distinct values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

#: The levels that count, in their order.
DIMENSION_LEVELS = {
    "source": ("dependabot", "renovate", "human", "other-bot"),
    "outcome": ("merged", "closed-unmerged", "open", "superseded"),
    "security": ("security", "non-security"),
    "semver_tier": ("major", "minor", "patch", "prerelease", "calver", "sha-pin", "unknown"),
    "direct_transitive": ("direct", "transitive"),
}
STRATIFIER_LEVELS = {"ecosystem": ("maven", "npm", "cargo", "pip", "go"), "source": ("dependabot", "renovate", "human", "other-bot")}
PR_DIMENSIONS, CHANGE_DIMENSIONS = ("source", "outcome", "security"), ("semver_tier", "direct_transitive")
LEAST_N, SUBSTANTIVE = 30, 0.10
RESAMPLES, SEED = 10_000, 42
STRATA = (("ecosystem",), ("semver_tier",), ("is_security_any",), ("source_mix",), ("ecosystem", "semver_tier"), ("ecosystem", "source_mix"), ("semver_tier", "is_security_any"), ("semver_tier", "source_mix"))
STRATUM_COLUMNS = ["ecosystem", "semver_tier", "is_security_any", "source_mix"]


def modal(label: str) -> Column:
    """The most frequent value, the smallest of equals."""
    return F.mode(label, True)


def pr_records(change: DataFrame, pr: DataFrame, labels: DataFrame) -> DataFrame:
    """pr_id, ecosystem (the first by name), n_ecosystems and the modal source, outcome and security of its changes."""
    rows = change.join(pr.select(F.col("id").alias("pr_id")), "pr_id", "left_semi").select("change_id", "pr_id", "ecosystem")
    rows = rows.join(labels.select("change_id", *PR_DIMENSIONS).dropna(subset=list(PR_DIMENSIONS)), "change_id")
    return rows.groupBy("pr_id").agg(F.min("ecosystem").alias("ecosystem"), F.count_distinct("ecosystem").alias("n_ecosystems"), *(modal(d).alias(d) for d in PR_DIMENSIONS))


def change_records(change: DataFrame, labels: DataFrame) -> DataFrame:
    wide = labels.select("change_id", "source", *CHANGE_DIMENSIONS).dropna()
    return change.select("change_id", "ecosystem").join(wide, "change_id")


def cells(prs: DataFrame, changes: DataFrame) -> DataFrame:
    """dimension, stratifier, unit, row, col, n: all contingency tables as counted cells; rows out of the levels are dropped."""
    out = None
    for unit, records, dims in (("pr", prs, PR_DIMENSIONS), ("change", changes, CHANGE_DIMENSIONS)):
        each = [F.struct(F.lit(d).alias("dimension"), F.lit(s).alias("stratifier"), F.col(s).alias("row"), F.col(d).alias("col")) for d in dims for s in STRATIFIER_LEVELS]
        long = records.select(F.explode(F.array(*each)).alias("x")).select("x.*")
        known = F.lit(False)
        for d in dims:
            for s in STRATIFIER_LEVELS:
                known |= (F.col("dimension") == d) & (F.col("stratifier") == s) & F.col("col").isin(*DIMENSION_LEVELS[d]) & F.col("row").isin(*STRATIFIER_LEVELS[s])
        n = long.where(known).groupBy("dimension", "stratifier", F.lit(unit).alias("unit"), "row", "col").agg(F.count(F.lit(1)).alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def cramers_v(cell: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, v of each table of counted cells: chi2 = n * (sum o^2 / (r c) - 1). 0 below two levels on a side, at most 1."""
    by = lambda *c: Window.partitionBy(*keys, *c)
    m = cell.where("n > 0").withColumns({"r": F.sum("n").over(by("row")), "c": F.sum("n").over(by("col"))})
    t = m.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") / F.col("r") * (F.col("n") / F.col("c"))).alias("s"), F.count_distinct("row").alias("k"), F.count_distinct("col").alias("l"))
    small = F.least("k", "l")
    v = F.sqrt(F.greatest(F.col("s") - 1.0, F.lit(0.0)) / F.nullif(small - 1, F.lit(0)))
    return t.select(*keys, "n", F.round(F.when(small >= 2, F.least(v, F.lit(1.0))).otherwise(0.0), 9).alias("v"))


def pairwise_cells(cell: DataFrame, least: int = LEAST_N) -> DataFrame:
    """cells with the pair (a, b) of row levels they belong to, for pairs whose levels both have at least `least` rows.

    A table has no more rows than its stratifier has levels, so the pairs are few however many rows were counted.
    """
    keys = ["dimension", "stratifier", "unit"]
    order = F.create_map(*(F.lit(x) for s in STRATIFIER_LEVELS.values() for i, level in enumerate(s) for x in (level, i)))
    levels = cell.groupBy(*keys, "row").agg(F.sum("n").alias("n")).where(F.col("n") >= least).withColumn("ord", order[F.col("row")])
    a = levels.select(*keys, F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("ord").alias("oa"))
    b = levels.select(*keys, F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("ord").alias("ob"))
    pairs = a.join(b, keys).where("oa < ob").drop("oa", "ob")
    sides = pairs.select(*keys, "a", "b", "n_a", "n_b", F.explode(F.array("a", "b")).alias("row"))
    return cell.join(sides, [*keys, "row"])


def pairwise_v(cell: DataFrame, least: int = LEAST_N) -> DataFrame:
    v = cramers_v(pairwise_cells(cell, least), ["dimension", "stratifier", "unit", "a", "b", "n_a", "n_b"]).drop("n")
    return v.withColumn("substantive", F.col("v") >= SUBSTANTIVE)


def strongest_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """The pairs of levels with the largest v, ties in the order of their names; the order and the limit meet in each task's own top rows."""
    return pairs.orderBy(F.desc("v"), "a", "b", "dimension", "stratifier", "unit").limit(most).select("dimension", "stratifier", "unit", "a", "b", "v")


def excluded_levels(cell: DataFrame, least: int = LEAST_N) -> DataFrame:
    """dimension, stratifier, unit, level, n of the levels too rare for pairs."""
    return cell.groupBy("dimension", "stratifier", "unit", F.col("row").alias("level")).agg(F.sum("n").alias("n")).where(F.col("n") < least)


def table_v(o: np.ndarray) -> float:
    o = o[o.sum(1) > 0][:, o.sum(0) > 0].astype(float)
    n = o.sum()
    if n == 0 or min(o.shape) < 2:
        return 0.0
    e = np.outer(o.sum(1), o.sum(0)) / n
    return float(min(1.0, np.sqrt(((o - e) ** 2 / e).sum() / (n * (min(o.shape) - 1)))))


def bootstrap_v(cell: DataFrame, keys: list[str], resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """keys, ci_lo, ci_hi: multinomial bootstrap of each table, whose cells are few. Levels keep their fixed order."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        order = [x for levels in (*STRATIFIER_LEVELS.values(), *DIMENSION_LEVELS.values()) for x in levels]
        rank = {x: i for i, x in reversed(list(enumerate(order)))}
        t = pdf.pivot_table(index="row", columns="col", values="n", aggfunc="sum", fill_value=0)
        t = t.loc[sorted(t.index, key=rank.get), sorted(t.columns, key=rank.get)].to_numpy()
        draws = np.random.default_rng(seed).multinomial(int(t.sum()), (t / t.sum()).ravel(), size=resamples).reshape(-1, *t.shape)
        r, c, n = draws.sum(2, keepdims=True), draws.sum(1, keepdims=True), t.sum()
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.where(draws > 0, draws / r * (draws / c), 0.0).sum((1, 2))
        small = np.minimum((r > 0).sum((1, 2)), (c > 0).sum((1, 2)))
        v = np.where(small >= 2, np.sqrt(np.maximum(s - 1, 0) / np.maximum(small - 1, 1)), 0.0)
        lo, hi = np.percentile(np.minimum(v, 1.0), [2.5, 97.5])
        return pdf.iloc[:1][keys].assign(ci_lo=lo, ci_hi=hi) if n else pdf.iloc[:0]

    types = dict(cell.dtypes)
    return cell.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + ", ci_lo double, ci_hi double")


def strata(alignment: DataFrame, least: int = 5) -> DataFrame:
    """scope, the stratum columns (null: all), n, mean, median, reportable of the alignment score: one pass of grouping sets."""
    rows = alignment.where(F.col("k_projects_decided") >= least).withColumn("is_security_any", F.col("is_security_any").cast("string"))
    sets = [[F.col(c) for c in s] for s in ((), *STRATA)]
    g = rows.groupingSets(sets, *STRATUM_COLUMNS).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.round(F.avg("alignment"), 9).alias("mean"), F.round(F.median("alignment"), 9).alias("median"))
    bits = {sum(1 << (3 - STRATUM_COLUMNS.index(c)) for c in STRATUM_COLUMNS if c not in s): "_x_".join(s) or "overall" for s in ((), *STRATA)}
    scope = F.create_map(*(F.lit(x) for kv in bits.items() for x in kv))[F.col("g").cast("int")]
    return g.select(scope.alias("scope"), *STRATUM_COLUMNS, "n", "mean", "median", (F.col("n") >= LEAST_N).alias("reportable")).where("n > 0")


def strata_intervals(alignment: DataFrame, least: int = 5, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """scope, stratum, ci_mean_lo, ci_mean_hi, ci_median_lo, ci_median_hi, ci_note; strata below LEAST_N rows get none."""
    rows = alignment.where(F.col("k_projects_decided") >= least)
    each = F.array(*(F.struct(F.lit("_x_".join(s) or "overall").alias("scope"), F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in s)).alias("stratum")) for s in ((), *STRATA)))
    n = rows.select(F.explode(each).alias("x"), "alignment").groupBy("x.scope", "x.stratum", "alignment").agg(F.count(F.lit(1)).alias("n"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("alignment")
        x, c = pdf["alignment"].to_numpy(float), pdf["n"].to_numpy()
        out = pdf.iloc[:1][["scope", "stratum"]].assign(ci_mean_lo=None, ci_mean_hi=None, ci_median_lo=None, ci_median_hi=None, ci_note="n too small")
        total = int(c.sum())
        if total < LEAST_N and out["scope"].iloc[0] != "overall":
            return out
        rng, means, medians = np.random.default_rng(seed), [], []
        for k in range(0, resamples, 500):
            d = rng.multinomial(total, c / total, size=min(500, resamples - k))
            means.append(d @ x / total)
            run = d.cumsum(1)
            low, high = (run > (total - 1) // 2).argmax(1), (run > total // 2).argmax(1)
            medians.append((x[low] + x[high]) / 2)
        m, d = np.concatenate(means), np.concatenate(medians)
        return out.assign(ci_mean_lo=np.percentile(m, 2.5), ci_mean_hi=np.percentile(m, 97.5), ci_median_lo=np.percentile(d, 2.5), ci_median_hi=np.percentile(d, 97.5), ci_note=None)

    return n.groupBy("scope", "stratum").applyInPandas(one, "scope string, stratum string, ci_mean_lo double, ci_mean_hi double, ci_median_lo double, ci_median_hi double, ci_note string")


def average_rank(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """counts (keys, value, n) with the average rank of each value's rows."""
    w = Window.partitionBy(*keys).orderBy(value)
    below = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("rank", F.coalesce(below, F.lit(0)) + (F.col("n") + 1) / 2)


def correlations(alignment: DataFrame, least: int = 5) -> DataFrame:
    """ecosystem (null: all), n, pearson, spearman of mean group size and alignment; null below three rows or without variance.

    Ranks are taken over counted distinct values, so the window never holds rows.
    """
    rows = alignment.where(F.col("k_projects_decided") >= least).select(F.explode(F.array(F.lit("all"), "ecosystem")).alias("scope"), F.col("mean_group_size").alias("x"), F.col("alignment").alias("y"))
    rows = rows.where("scope IS NOT NULL")
    rank = lambda c: average_rank(rows.groupBy("scope", c).agg(F.count(F.lit(1)).alias("n")), c, ["scope"]).select("scope", c, F.col("rank").alias(f"r{c}"))
    pairs = rows.groupBy("scope", "x", "y").agg(F.count(F.lit(1)).alias("n")).join(rank("x"), ["scope", "x"]).join(rank("y"), ["scope", "y"])
    n = F.sum("n")

    def corr(a: str, b: str) -> Column:
        mean = lambda e: F.sum(F.col("n") * e) / n
        ma, mb = mean(F.col(a)), mean(F.col(b))
        va, vb = mean(F.col(a) * F.col(a)) - ma * ma, mean(F.col(b) * F.col(b)) - mb * mb
        enough = (n >= 3) & (F.count_distinct(a) > 1) & (F.count_distinct(b) > 1)
        return F.when(enough, F.round((mean(F.col(a) * F.col(b)) - ma * mb) / F.sqrt(F.greatest(va * vb, F.lit(1e-300))), 6))

    return pairs.groupBy("scope").agg(n.alias("n"), corr("x", "y").alias("pearson"), corr("rx", "ry").alias("spearman"))


def correlation_intervals(alignment: DataFrame, least: int = 5, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """scope, intervals of both correlations and ci_note; resamples without variance are left out and noted."""
    rows = alignment.where(F.col("k_projects_decided") >= least)
    n = rows.select(F.explode(F.array(F.lit("all"), "ecosystem")).alias("scope"), "mean_group_size", "alignment").where("scope IS NOT NULL").groupBy("scope", "mean_group_size", "alignment").agg(F.count(F.lit(1)).alias("n"))

    def grouped(w: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Counts of each distinct value in each resample."""
        order = np.argsort(at, kind="stable")
        return np.add.reduceat(w[:, order], np.flatnonzero(np.diff(at[order], prepend=-1)), axis=1)

    def both(w: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Weighted correlation in each resample of values that are centred nearly."""
        t = w.sum(1)
        mx, my = (w * x).sum(1) / t, (w * y).sum(1) / t
        return ((w * x * y).sum(1) / t - mx * my) / np.sqrt(((w * x * x).sum(1) / t - mx * mx) * ((w * y * y).sum(1) / t - my * my))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mean_group_size", "alignment"])
        x, y, c = (pdf[k].to_numpy(float) for k in ("mean_group_size", "alignment", "n"))
        total = int(c.sum())
        cols = ["pearson_ci_lo", "pearson_ci_hi", "spearman_ci_lo", "spearman_ci_hi"]
        out = pdf.iloc[:1][["scope"]].assign(**dict.fromkeys(cols), ci_note="n too small or no variance")
        if total < 3 or len(set(x)) < 2 or len(set(y)) < 2:
            return out
        rng, p, s = np.random.default_rng(seed), [], []
        at = [np.unique(v, return_inverse=True)[1] for v in (x, y)]
        x, y = (v - v @ c / total for v in (x, y))
        size = max(1, 1_000_000 // len(c))
        for k in range(0, resamples, size):
            w = rng.multinomial(total, c / total, size=min(size, resamples - k))
            counts = [grouped(w, a) for a in at]
            varied = np.logical_and(*((n > 0).sum(1) > 1 for n in counts))
            w, counts = w[varied].astype(float), [n[varied] for n in counts]
            ranks = [(np.cumsum(n, 1) - n + (n + 1) / 2 - (total + 1) / 2)[:, a] for n, a in zip(counts, at)]
            p += both(w, x, y).tolist()
            s += both(w, *ranks).tolist()
        values = [*np.percentile(p, [2.5, 97.5]), *np.percentile(s, [2.5, 97.5])] if p else [None] * 4
        return out.assign(**dict(zip(cols, values)), ci_note=None if len(p) == resamples else "some resamples skipped")

    return n.groupBy("scope").applyInPandas(one, "scope string, pearson_ci_lo double, pearson_ci_hi double, spearman_ci_lo double, spearman_ci_hi double, ci_note string")
