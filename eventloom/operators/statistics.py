"""Paired-run statistics on long metric tables ``(episode, camera, version, kind, metric, value)``."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions import counter
from eventloom.operators import chunked
from eventloom.operators import events as ev
from eventloom.session import cut_lineage

# fixed values: which way each metric improves; the others are neutral
DIRECTIONS = {
    "polarity_imbalance": "lower",
    "count_cv": "lower",
    "phase_imbalance": "lower",
    "harmonic_power_ratio": "lower",
    "line_db": "lower",
    "boundary_coverage": "higher",
    "boundary_density": "higher",
    "halo_ratio": "lower",
    "static_rate": "lower",
}


def direction(metric: Column, rules: dict[str, str] | None = None) -> Column:
    rules = rules or DIRECTIONS
    e = F.lit("neutral")
    for name, way in rules.items():
        e = F.when(metric == name, way).otherwise(e)
    return e


def episode_mean(reports: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Mean over cameras of the finite values inside an episode; NULL when there are none."""
    keys = [*(extra or []), "episode", "version", "metric"]
    value = F.when(ev.finite("value"), F.col("value"))
    return reports.groupBy(*keys).agg(F.avg(value).alias("value"))


def pair_runs(values: DataFrame, keys: list[str], a: str = "a", b: str = "b") -> DataFrame:
    """Baseline and candidate side by side; a pair with a missing or non-finite side is dropped.

    Both versions meet in one aggregation on the pair key instead of a self join.
    """
    side = lambda s: F.max(F.when((F.col("version") == s) & ev.finite("value"), F.col("value")))
    p = values.where(F.col("version").isin(a, b)).groupBy(*keys).agg(side(a).alias("base"), side(b).alias("cand"))
    return p.where("base IS NOT NULL AND cand IS NOT NULL").withColumn("delta", F.col("cand") - F.col("base"))


def paired_summary(pairs: DataFrame, keys: list[str], rules: dict[str, str] | None = None, width: float = 1.0) -> DataFrame:
    """Means, mean/median/relative change, and how many pairs rose, fell or improved."""
    c = F.col
    g = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg("base").alias("base_mean"), F.avg("cand").alias("cand_mean"), F.avg("delta").alias("mean_delta"),
        F.count_if(c("delta") > 0).alias("increased"), F.count_if(c("delta") < 0).alias("decreased"))
    med = ev.exact_quantiles(pairs, keys, "delta", [0.5], width, levels=1).withColumnRenamed("q0", "median_delta")
    way = direction(c("metric"), rules)
    return g.join(med, keys).select(
        *keys, "pairs", "base_mean", "cand_mean", "mean_delta", "median_delta",
        F.when(c("base_mean") != 0, c("mean_delta") / c("base_mean")).alias("relative_delta"),
        way.alias("direction"), F.when(way == "lower", c("decreased")).when(way == "higher", c("increased")).alias("improved"), "increased", "decreased")


def candidate_summary(values: DataFrame, keys: list[str], version: str = "b") -> DataFrame:
    """Metrics that exist for the candidate only (agreement with the baseline): mean and count."""
    v = values.where(F.col("version") == version)
    return v.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.when(ev.finite("value"), F.col("value"))).alias("cand_mean"))


def fairness(checks: DataFrame, cols: list[str]) -> DataFrame:
    return checks.agg(*[F.bool_and(c).alias(f"{c}_all") for c in cols])


# -- t interval ---------------------------------------------------------------------------

def t_quantiles(df, level: float = 0.975):
    """Student t quantiles of many degrees of freedom (array): bisection on the distribution function.

    With t = tan(u) both tails lie on one short interval. The distribution function is the
    ratio of two Simpson sums of the density there, so no norm is needed, and one method
    serves every df.
    """
    import numpy as np

    df = np.asarray(df, float)[:, None]
    n = 2000
    weights = np.ones(n + 1)
    weights[1:-1:2], weights[2:-1:2] = 4, 2

    def mass(x):
        u = np.arctan(x) * (np.arange(n + 1) / n)
        # log of density times dt/du; near pi/2 the density of df = 1 stays constant
        f = np.exp(-(df + 1) / 2 * np.log1p(np.tan(u) ** 2 / df) - 2 * np.log(np.cos(u)))
        return (f * weights).sum(axis=1, keepdims=True) * np.arctan(x) / n

    half = mass(np.full_like(df, np.inf))
    lo, hi = np.zeros_like(df), np.full_like(df, 1e3)
    for _ in range(70):
        mid = (lo + hi) / 2
        below = 0.5 + mass(mid) / (2 * half) < level
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid)
    return ((lo + hi) / 2).ravel()


@functools.lru_cache(None)
def t_critical(df: int, level: float = 0.975) -> float:
    return float(t_quantiles([df], level)[0])


def with_t(g: DataFrame, n: str = "n", out: str = "_t") -> DataFrame:
    """``g`` with the two-sided 95 % critical value for its sample sizes, found once for each different size."""

    def find(it):
        for pdf in it:
            pdf[out] = t_quantiles(pdf["_n"] - 1)
            yield pdf

    sizes = g.select(F.col(n).alias("_n")).where(F.col(n) > 1).distinct().mapInPandas(find, f"_n long, {out} double")
    return g.join(sizes, F.col(n) == F.col("_n"), "left").drop("_n")


def t_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample std, range and the 95 % t interval of the mean."""
    c = F.col
    g = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    half = F.when(c("n") > 1, c("_t") * c("std") / F.sqrt(c("n"))).otherwise(F.lit(0.0))
    return with_t(g).withColumns({"ci_low": c("mean") - half, "ci_high": c("mean") + half}).drop("_t")


# -- resampling and ranks -------------------------------------------------------------------

#: Values of a key that one array holds, resamples one task draws in a row, and frequencies of one task.
BLOCK, RESAMPLES, FREQUENCIES = 4096, 1000, 1 << 19


def _width(df: DataFrame) -> int:
    """Tasks for rows that are few and light but stand for much work, so that they are not put together by size."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bootstrap_ci(pairs: DataFrame, keys: list[str], order: list[str], b: int, seed: int, width: int = 100_000) -> DataFrame:
    """Percentile interval of the mean change over b resamples, reproducible from the seed.

    Draw i of resample r is a counter-based index. The numbered values of a key lie in
    blocks; a block adds up what the draws of a resample find in it, and the sums of the
    blocks are combined. So there are keys x blocks x resamples rows and no lookup join.
    """
    c = F.col
    p = chunked.positions(pairs.select(*keys, *order, "delta"), keys, order, width, "_i").select(*keys, "_i", "delta")
    n = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = p.groupBy(*keys, F.floor(c("_i") / BLOCK).alias("_block")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "delta"))), lambda x: x["delta"]).alias("_values"))
    d = blocks.join(n, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((b - 1) // RESAMPLES)))).repartition(_width(pairs), *keys, "_block", "_part")
    d = d.withColumn("_r", F.explode(F.sequence(c("_part") * RESAMPLES, F.least(c("_part") * RESAMPLES + RESAMPLES, F.lit(b)) - 1)))
    ids = [c(k) for k in keys]
    # draws are only ever rows of a pipeline that ends in the sums of a resample
    d = d.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), c("_n") - 1)))
    found = F.get("_values", (counter.pick(seed, "boot", c("_n"), *ids, c("_r"), c("_k")) - c("_block") * BLOCK).cast("int"))
    sums = d.select(*keys, "_r", "_n", found.alias("_x")).groupBy(*keys, "_r", "_n").agg(F.sum("_x").alias("_sum"))
    means = sums.select(*keys, "_r", (c("_sum") / c("_n")).alias("_m"))
    # b values per key, set by the caller
    q = F.percentile("_m", F.array(F.lit(0.025), F.lit(0.975)))
    return means.groupBy(*keys).agg(q.alias("_q")).select(*keys, c("_q")[0].alias("ci_low"), c("_q")[1].alias("ci_high"))


def _tail_part(ranks, counts, w: int, low: int, high: int) -> float:
    """Frequencies low..high-1 of the Fourier inversion of P(W <= w), W the sum of a random half of ranks.

    The transform of W is a product of cosines, which vanishes but near a few frequencies:
    one is dropped as soon as its product cannot count any more. Angles are reduced as
    integers, so they stay exact however long the distribution is.
    """
    import numpy as np

    total = int((ranks * counts).sum())
    m = total + 1
    j = np.arange(max(low, 1), min(high, m // 2 + 1), dtype=np.int64)
    product = np.ones(len(j))
    # spread ranks: near ones hardly differ in what they drop
    for i in np.argsort((np.arange(len(ranks)) * 0.6180339887498949) % 1.0):
        product *= np.cos(np.pi * ((j * ranks[i]) % (2 * m)) / m) ** int(counts[i])
        if i % 8 == 0:
            keep = np.abs(product) > 1e-25
            if not keep.all():
                j, product = j[keep], product[keep]
        if not len(j):
            return 0.0
    turn = np.sin(np.pi * ((j * (w + 1)) % (2 * m)) / m) / np.sin(np.pi * j / m) * np.cos(np.pi * ((j * (total - w)) % (2 * m)) / m)
    return float((product * turn * np.where(2 * j == m, 1.0, 2.0)).sum())


def wilcoxon(pairs: DataFrame, keys: list[str], method: str = "exact", width: float = 1.0) -> DataFrame:
    """Two-sided signed-rank test with zeros dropped and mid-ranks for ties.

    ``method`` is the caller's choice, never the data's: "exact" inverts the Fourier transform
    of the null distribution, whose frequencies are dealt out in blocks and added up (exact
    to about 1e-12); "normal" is the approximation with tie correction. Ranks come from
    chunked running counts of distinct sizes, so a metric with very many pairs splits.
    """
    if method not in ("exact", "normal"):
        raise ValueError("method is exact or normal")
    c = F.col
    d = pairs.where("delta <> 0").select(*keys, F.abs("delta").alias("_a"), (F.col("delta") > 0).alias("_pos"))
    g = d.groupBy(*keys, "_a").agg(F.count(F.lit(1)).alias("_c"), F.count_if("_pos").alias("_cp"))
    g = chunked.running_sum(g, keys, ["_a"], {"_upto": c("_c")}, width)
    g = g.withColumn("_rank2", 2 * c("_upto") - c("_c") + 1)  # twice the mid-rank
    n, w2, ties = F.sum("_c"), F.sum(c("_rank2") * c("_cp")), F.sum(c("_c") * c("_c") * c("_c") - c("_c"))
    if method == "normal":
        s = g.groupBy(*keys).agg(n.alias("n"), w2.alias("_w2"), ties.alias("_ties"))
        var = c("n") * (c("n") + 1) * (2 * c("n") + 1) / 24.0 - c("_ties") / 48.0
        p = _two_sided(F.abs(c("_w2") / 2.0 - c("n") * (c("n") + 1) / 4.0) / F.sqrt(var))
        return s.select(*keys, "n", (c("_w2") / 2.0).alias("w_plus"), p.alias("p_value"))
    unit = F.when(F.bool_and(c("_rank2") % 2 == 0), 2).otherwise(1)  # without ties all are even
    s = g.groupBy(*keys).agg(n.alias("n"), w2.alias("_w2"), unit.alias("_unit"), F.array_sort(F.collect_list(F.struct("_rank2", "_c"))).alias("_ranks"))
    s = s.withColumns({"_total": (c("n") * (c("n") + 1) / c("_unit")).cast("long"), "_w": (c("_w2") / c("_unit")).cast("long")})
    s = s.withColumn("_least", F.least("_w", c("_total") - c("_w")))  # the distribution is symmetric
    parts = s.select(*keys, "_least", F.transform("_ranks", lambda x: (x["_rank2"] / c("_unit")).cast("long")).alias("_r"), F.transform("_ranks", lambda x: x["_c"]).alias("_n"),
                     F.explode(F.sequence(F.lit(0).cast("long"), F.floor((c("_total") + 1) / (2 * FREQUENCIES)))).alias("_block"))
    kinds = ", ".join(f"`{k}` {g.schema[k].dataType.simpleString()}" for k in keys)

    def run(frames):
        for pdf in frames:
            pdf["_part"] = [_tail_part(r, k, int(w), b * FREQUENCIES, (b + 1) * FREQUENCIES) for r, k, w, b in zip(pdf["_r"], pdf["_n"], pdf["_least"], pdf["_block"])]
            yield pdf[[*keys, "_part"]]

    part = parts.repartition(_width(pairs), *keys, "_block").mapInPandas(run, f"{kinds}, _part double").groupBy(*keys).agg(F.sum("_part").alias("_part"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * (c("_least") + 1 + c("_part")) / (c("_total") + 1)))
    return s.join(part, keys).select(*keys, "n", (c("_w2") / 2.0).alias("w_plus"), p.alias("p_value"))


def _two_sided(z: Column) -> Column:
    """2 * (1 - Phi(z)) by the continued fraction / series of erfc, from elementary functions."""
    x = z / math.sqrt(2)
    # series for small x: erf(x) = 2/sqrt(pi) * exp(-x^2) * sum 2^n x^(2n+1) / (2n+1)!!
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(60)), F.struct(x.alias("t"), x.alias("s")),
        lambda a, n: F.struct((a["t"] * 2 * x * x / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * x * x / (2 * n + 1)).alias("s")), lambda a: a["s"])
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * terms
    # continued fraction for larger x
    cf = F.aggregate(F.sequence(F.lit(60), F.lit(1), F.lit(-1)), x, lambda a, n: x + (n / 2.0) / a)
    tail = F.exp(-x * x) / (cf * math.sqrt(math.pi))
    return F.greatest(F.when(x < 2.5, series).otherwise(tail), F.lit(0.0))


# -- reports ----------------------------------------------------------------------------------

def long_metrics(wide: DataFrame, keys: list[str], metrics: list[str], kind: str, version: str) -> DataFrame:
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("_m")
    return wide.select(*keys, F.lit(version).alias("version"), F.lit(kind).alias("kind"), rows).select(*keys, "version", "kind", "_m.metric", "_m.value")


def event_metrics(events: DataFrame, keys: list[str], bin_us: int, n_bins: int, spectrum_bin_us: int, spectrum_bins: int) -> DataFrame:
    """Count, imbalance, bin spread, phase imbalance and line power of every stream, one row each."""
    hist = ev.time_histogram(events, keys, bin_us, n_bins)
    g = ev.event_stats(events, keys, bin_us * n_bins).select(*keys, "events", "polarity_imbalance")
    for part in (ev.bin_spread(hist, keys), ev.phase_imbalance(hist, keys).select(*keys, "phase_imbalance"),
                 ev.harmonic_power(events, keys, spectrum_bin_us, spectrum_bins, 1e-3)):
        g = g.join(part, keys)
    return g


EVENT_METRICS = ["events", "polarity_imbalance", "count_cv", "phase_imbalance", "harmonic_power_ratio", "line_db"]
REGION_METRICS = ["boundary_coverage", "boundary_density", "halo_ratio", "static_rate"]


CONSISTENCY = ("_exact", "_mae", "_equal_share")


def evaluate_pair(a: DataFrame, b: DataFrame, keys: list[str], bin_us: int, n_bins: int, spectrum_bin_us: int, spectrum_bins: int, cells: list[tuple[int, int]],
                  regions_a: DataFrame | None = None, regions_b: DataFrame | None = None, consistency: DataFrame | None = None) -> DataFrame:
    """All metrics of two runs as one long table; agreement and consistency rows belong to the candidate.

    Both runs are measured in one pass with the version as part of the key. ``cells`` are the
    resolutions (pixels, microseconds) at which occupied cells are compared; a metric's name
    carries the pixels. ``regions_*``: region metrics of the runs, ``consistency``: equality
    of their recordings, each with one row per ``keys``.
    """
    both = a.withColumn("version", F.lit("a")).unionByName(b.withColumn("version", F.lit("b")))
    m = event_metrics(both, [*keys, "version"], bin_us, n_bins, spectrum_bin_us, spectrum_bins)
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).cast("double").alias("value")) for x in EVENT_METRICS])).alias("_m")
    out = m.select(*keys, "version", F.lit("event").alias("kind"), rows).select(*keys, "version", "kind", "_m.metric", "_m.value")
    vox = ev.voxel_agreement(a, b, keys, cells, bin_us * n_bins)
    named = F.concat("metric", F.lit("_"), "px").alias("metric")
    out = out.unionByName(long_metrics(vox, [*keys, "px"], ["f1", "precision", "recall"], "voxel", "b").select(*keys, "version", "kind", named, "value"))
    for version, r in (("a", regions_a), ("b", regions_b)):
        if r is not None:
            out = out.unionByName(long_metrics(r, keys, REGION_METRICS, "region", version))
    if consistency is not None:
        out = out.unionByName(long_metrics(consistency, keys, [c for c in consistency.columns if c.endswith(CONSISTENCY)], "consistency", "b"))
    return out


def aggregate_pairs(reports: DataFrame, extra: list[str], b: int, seed: int, rules: dict[str, str] | None = None, width: float = 1.0) -> DataFrame:
    """Multi-episode report: paired summary, bootstrap interval and signed-rank test per metric."""
    keys = [*extra, "metric"]
    means = episode_mean(reports.where("kind <> 'voxel'"), extra)
    # one row per episode and metric, read by three statistics
    pairs = cut_lineage(pair_runs(means, [*extra, "episode", "metric"]), "pairs")
    s = paired_summary(pairs, keys, rules, width)
    s = s.join(bootstrap_ci(pairs, keys, ["episode"], b, seed), keys, "left").join(wilcoxon(pairs, keys, width=width).select(*keys, "p_value"), keys, "left")
    vox = candidate_summary(episode_mean(reports.where("kind = 'voxel'"), extra), keys)
    return s.unionByName(vox.withColumn("direction", direction(F.col("metric"), rules)), allowMissingColumns=True)
