"""Thresholds, boxes, contrast, fits and comparisons of intensities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_FIT_SAMPLES = 128


def strided(voxels: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th voxel along z, y and x."""
    for axis in "zyx":
        voxels = voxels.where(F.pmod(F.col(axis), F.lit(step)) == 0)
    return voxels


def otsu_thresholds(voxels: DataFrame, keys: list[str], step: int = 4) -> DataFrame:
    """Threshold of largest between-class variance, one bin per value.

    Counts are summed first, so windows run over distinct values only; of
    equal variances the smallest value wins.
    """
    counts = strided(voxels, step).groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy(*keys).orderBy("v")
    whole = Window.partitionBy(*keys)
    cut = (
        counts.withColumn("w0", F.sum("n").over(run).cast("double"))
        .withColumn("s0", F.sum(F.col("n") * F.col("v")).over(run).cast("double"))
        .withColumn("w", F.sum("n").over(whole).cast("double"))
        .withColumn("s", F.sum(F.col("n") * F.col("v")).over(whole).cast("double"))
        .withColumn("w1", F.col("w") - F.col("w0"))
    )
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.col("w1")
    between = F.when(F.col("w1") > 0, F.round(F.col("w0") * F.col("w1") * gap * gap, 3)).otherwise(-1.0)
    best = cut.withColumn("_b", between).groupBy(*keys).agg(F.max(F.struct("_b", (-F.col("v")).alias("_v"))).alias("m"))
    return best.select(*keys, (-F.col("m._v")).cast("int").alias("threshold"))


def noise_normalized(voxels: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """(v - t) over the population deviation of v - t."""
    spread = voxels.groupBy(*keys).agg(F.stddev_pop("v").alias("_sd"))
    facts = thresholds.join(spread, keys)
    return voxels.join(facts, keys).withColumn("v", (F.col("v") - F.col("threshold")) / F.col("_sd")).drop("threshold", "_sd")


def minimal_box(voxels: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """Box around the voxels above the threshold; stops are exclusive."""
    above = voxels.join(thresholds, keys).where("v > threshold")
    sides = [x for a in "zyx" for x in (F.min(a).alias(f"{a}_start"), (F.max(a) + 1).alias(f"{a}_stop"))]
    return above.groupBy(*keys).agg(*sides)


def robust_box(voxels: DataFrame, thresholds: DataFrame, keys: list[str], low: float = 0.1, high: float = 99.9) -> DataFrame:
    """Box from cumulative marginal counts of the voxels above the threshold."""
    above = voxels.join(thresholds, keys).where("v > threshold")
    marks = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("i")) for a in "zyx"]))
    marginal = above.select(*keys, marks.alias("m")).groupBy(*keys, "m.axis", "m.i").agg(F.count(F.lit(1)).alias("n"))
    by_axis = Window.partitionBy(*keys, "axis")
    run = marginal.withColumn("cum", F.sum("n").over(by_axis.orderBy("i"))).withColumn("total", F.sum("n").over(by_axis))

    def reached(percent: float) -> Column:
        return F.min(F.when(F.col("cum") >= F.col("total") * percent / 100, F.col("i")))

    return run.groupBy(*keys, "axis").agg(reached(low).alias("start"), (reached(high) + 1).alias("stop"))


def contrast_limits(voxels: DataFrame, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """Interpolated percentiles of each channel."""
    pair = F.percentile("v", F.array(F.lit(low), F.lit(high)))
    return voxels.groupBy("c").agg(pair.alias("q")).select("c", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def intensity_fit(pairs: DataFrame, keys: list[str], clip: tuple[float, float] = (0.25, 4.0)) -> DataFrame:
    """Gain and offset that map ``moving`` onto ``fixed``.

    Positive values only; both sides are trimmed to their 1-99 percentiles if
    enough samples remain; the gain is the covariance ratio, or the ratio of
    means without variance, clipped.
    """
    both = pairs.where("fixed > 0 AND moving > 0")
    q = F.array(F.lit(0.01), F.lit(0.99))
    limits = both.groupBy(*keys).agg(F.percentile("moving", q).alias("m"), F.percentile("fixed", q).alias("f"), F.count(F.lit(1)).alias("all"))
    marked = both.join(limits, keys).withColumn(
        "in", (F.col("moving").between(F.col("m")[0], F.col("m")[1]) & F.col("fixed").between(F.col("f")[0], F.col("f")[1])).cast("int")
    )
    sums = []
    for name, w in (("t", F.col("in")), ("a", F.lit(1))):
        m, f = F.col("moving").cast("double"), F.col("fixed").cast("double")
        sums += [F.sum(w).alias(f"{name}_n"), F.sum(w * m).alias(f"{name}_m"), F.sum(w * f).alias(f"{name}_f"), F.sum(w * m * m).alias(f"{name}_mm"), F.sum(w * m * f).alias(f"{name}_mf")]
    facts = marked.groupBy(*keys).agg(*sums)
    trimmed = F.col("t_n") >= MIN_FIT_SAMPLES
    for s in ("n", "m", "f", "mm", "mf"):
        facts = facts.withColumn(s, F.when(trimmed, F.col(f"t_{s}")).otherwise(F.col(f"a_{s}")))
    mean_m, mean_f = F.col("m") / F.col("n"), F.col("f") / F.col("n")
    var = F.col("mm") / F.col("n") - mean_m * mean_m
    cov = F.col("mf") / F.col("n") - mean_m * mean_f
    raw = F.when(var <= 1e-12, mean_f / F.greatest(mean_m, F.lit(1e-6))).otherwise(cov / var)
    ok = (F.col("n") >= MIN_FIT_SAMPLES) & (raw > 0)
    gain = F.when(ok, F.least(F.lit(clip[1]), F.greatest(F.lit(clip[0]), raw))).otherwise(1.0)
    return facts.select(
        *keys, ok.alias("ok"), gain.alias("gain"), F.when(ok, mean_f - gain * mean_m).otherwise(0.0).alias("offset"),
        F.col("n").cast("long").alias("n"),
    )


def compare_distributions(samples: DataFrame, keys: list[str], bins: int = 256) -> DataFrame:
    """Kolmogorov-Smirnov D and histogram Wasserstein distance.

    ``samples`` hold ``v`` and ``side`` (0 or 1).  Values are counted first,
    so ties share a value and windows run over distinct values.
    """
    counts = samples.groupBy(*keys, "v").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).alias("a"), F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).alias("b")
    )
    whole, run = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("v")
    na, nb = F.sum("a").over(whole), F.sum("b").over(whole)
    low, high = F.min("v").over(whole), F.max("v").over(whole)
    width = (high - low) / F.lit(float(bins))
    index = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("v") - low) / width))).otherwise(0)
    steps = (
        counts.withColumn("d", F.abs(F.sum("a").over(run) / na - F.sum("b").over(run) / nb))
        .withColumn("pa", F.col("a") / na).withColumn("pb", F.col("b") / nb)
        .withColumn("width", width).withColumn("bin", index.cast("int"))
    )
    ks = steps.groupBy(*keys).agg(F.max("d").alias("ks_d"))
    cells = steps.groupBy(*keys, "bin", "width").agg(F.sum(F.col("pa") - F.col("pb")).alias("g"))
    after = Window.partitionBy(*keys).orderBy("bin")
    cells = cells.withColumn("cdf", F.sum("g").over(after)).withColumn("span", F.coalesce(F.lead("bin").over(after), F.lit(bins)) - F.col("bin"))
    emd = cells.groupBy(*keys).agg(F.sum(F.abs("cdf") * F.col("width") * F.col("span")).alias("wasserstein"))
    return ks.join(emd, keys)


def significant(points: DataFrame, voxels: DataFrame, keys: list[str]) -> DataFrame:
    """Points whose voxel reaches the chunk's mean plus two deviations.

    Coordinates are truncated, deviations are of the population.
    """
    stats = voxels.groupBy(*keys).agg((F.avg("v") + 2 * F.stddev_pop("v")).alias("_limit"))
    at = points
    for axis in "zyx":
        at = at.withColumn(f"_{axis}", F.col(axis).cast("int"))
    pixel = voxels.select(*keys, *[F.col(a).alias(f"_{a}") for a in "zyx"], F.col("v").alias("value"))
    joined = at.join(pixel, [*keys, "_z", "_y", "_x"]).join(stats, keys)
    return joined.where("value >= _limit").drop("_z", "_y", "_x", "_limit")


def residual_summary(points: DataFrame, keys: list[str]) -> DataFrame:
    """RMS, median and 95th percentile of the distance d."""
    return points.groupBy(*keys).agg(
        F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rms"),
        F.percentile("d", F.lit(0.5)).alias("median"),
        F.percentile("d", F.lit(0.95)).alias("p95"),
        F.count(F.lit(1)).alias("n"),
    )


def displacement_summary(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, extremes and population deviation of displacement lengths."""
    size = F.sqrt(F.col("dz") ** 2 + F.col("dy") ** 2 + F.col("dx") ** 2)
    rows = vectors.withColumn("_d", size)
    return rows.groupBy(*keys).agg(
        F.avg("_d").alias("mean"), F.min("_d").alias("min"), F.stddev_pop("_d").alias("std"), F.max("_d").alias("max"), F.count(F.lit(1)).alias("n")
    )


def weighted_centroids(points: DataFrame, voxels: DataFrame, keys: list[str], radius: int, percent: float = 0.2) -> DataFrame:
    """Intensity-weighted centre in a window of the plane around each point.

    The window is generated from the point and joined by position; its lower
    percentile is the background.
    """
    steps = F.sequence(F.lit(-radius), F.lit(radius))
    window = points.withColumn("_dy", F.explode(steps)).withColumn("_dx", F.explode(steps))
    window = window.withColumn("_y", F.col("y") + F.col("_dy")).withColumn("_x", F.col("x") + F.col("_dx"))
    pixel = voxels.select(*keys, F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("_v"))
    ids = [*keys, "y", "x"]
    seen = window.join(pixel, [*keys, "_y", "_x"])
    base = seen.groupBy(*ids).agg(F.percentile("_v", F.lit(percent)).alias("_base"))
    w = F.greatest(F.lit(0.0), F.col("_v") - F.col("_base"))
    sums = seen.join(base, ids).groupBy(*ids).agg(F.sum(w).alias("w"), F.sum(w * F.col("_y")).alias("wy"), F.sum(w * F.col("_x")).alias("wx"))
    return sums.select(
        *ids, F.when(F.col("w") > 0, F.col("wy") / F.col("w")).otherwise(F.col("y")).alias("cy"),
        F.when(F.col("w") > 0, F.col("wx") / F.col("w")).otherwise(F.col("x")).alias("cx"),
    )


def histogram(voxels: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Counts in bins of equal width."""
    return voxels.groupBy(*keys, (F.floor(F.col("v") / width) * width).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def percentile_gain(pairs: DataFrame, keys: list[str], least: int = 1024) -> DataFrame:
    """Gain by the ratio of 5-95 percentile spans, clipped to 0.1-10; offset by
    medians, clipped to five spans.  Too few samples: 1 and 0."""
    q = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    facts = pairs.where("fixed > 0 AND moving > 0").groupBy(*keys).agg(
        F.percentile("fixed", q).alias("f"), F.percentile("moving", q).alias("m"), F.count(F.lit(1)).alias("n")
    )
    span_f, span_m = F.col("f")[2] - F.col("f")[0], F.col("m")[2] - F.col("m")[0]
    enough = (F.col("n") >= least) & (span_m > 0)
    gain = F.when(enough, F.least(F.lit(10.0), F.greatest(F.lit(0.1), span_f / span_m))).otherwise(1.0)
    offset = F.least(5 * span_f, F.greatest(-5 * span_f, F.col("f")[1] - gain * F.col("m")[1]))
    return facts.select(*keys, gain.alias("gain"), F.when(enough, offset).otherwise(0.0).alias("offset"), "n")
