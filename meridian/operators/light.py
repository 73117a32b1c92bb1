"""Histograms, quantiles and block statistics of measured light."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import colour

#: Bins of a picture's histogram, and stops that a tile's histogram reaches down.
BINS, DEPTH = 4096, 12.0


def bin_counts(values: DataFrame, key: str, value: str, bins: int = BINS) -> DataFrame:
    """``key, bin, n`` of values from 0 to 1."""
    return values.groupBy(key, F.floor(F.col(value) * bins).alias("bin")).agg(F.count("*").alias("n"))


def bin_quantiles(values: DataFrame, key: str, value: str, shares: dict[str, float], bins: int = BINS) -> DataFrame:
    """Per key the centre, in stops, of the first bin at which more than a share of the values is reached."""
    w = Window.partitionBy(key).orderBy("bin")
    run = bin_counts(values, key, value, bins).select(key, "bin", F.sum("n").over(w).alias("seen"), F.sum("n").over(Window.partitionBy(key)).alias("n"))
    at = [F.round(F.log2((F.min(F.when(F.col("seen") > F.floor(F.col("n") * q), F.col("bin"))) + 0.5) / bins), 6).alias(name) for name, q in shares.items()]
    return run.groupBy(key).agg(*at)


def kept_quantile(counts: DataFrame, key: str, share: float, bins: int, depth: float = DEPTH) -> DataFrame:
    """Light in stops under white below which ``share`` of a kept histogram ``key, bin, n`` lies, evenly within a bin; ``-depth`` where it is empty."""
    w = Window.partitionBy(key).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    d = counts.select(key, "bin", "n", F.sum("n").over(w).alias("upto"), F.sum("n").over(Window.partitionBy(key)).alias("total"))
    wanted = F.lit(min(max(share, 0.0), 1.0)) * F.col("total")
    hit = F.when((F.col("n") > 0) & (F.col("upto") >= wanted), F.struct("bin", ((wanted - (F.col("upto") - F.col("n"))) / F.when(F.col("n") > 0, F.col("n"))).alias("into")))
    at = F.min(hit)
    return d.groupBy(key).agg(F.when(F.max("total") <= 0, F.lit(-depth)).when(at.isNotNull(), (at["bin"] + at["into"]) / bins * depth - depth).otherwise(F.lit(0.0)).alias("light"))


def kept_share(counts: DataFrame, key: str, stops: float, bins: int, depth: float = DEPTH) -> DataFrame:
    """The share of a kept histogram under a light in stops under white, with the part of the bin it falls into; 0 where it is empty."""
    at = min(max((stops + depth) / depth * bins, 0.0), float(bins))
    whole = int(at)
    below, total = F.sum(F.when(F.col("bin") < whole, F.col("n")).when(F.col("bin") == whole, F.col("n") * (at - whole)).otherwise(0.0)), F.sum("n")
    return counts.groupBy(key).agg(F.when(total > 0, below / total).otherwise(F.lit(0.0)).alias("share"))


def block_means(texels: DataFrame, keys: list[str], linear_first: bool, darkest: int = 6, brightest: int = 250) -> DataFrame:
    """Per block the mean colour of the texels ``r, g, b`` (0 to 255) neither too dark nor too bright, and their share.

    With ``linear_first`` linear light is averaged; else stored values are, and their mean is made linear. 0 where no texel counts.
    """
    counts = (F.greatest("r", "g", "b") > darkest) & (F.least("r", "g", "b") < brightest)

    def mean(c):
        if linear_first:
            return F.coalesce(F.avg(F.when(counts, colour.linear(F.col(c)))), F.lit(0.0))
        return F.coalesce(colour.linear(F.avg(F.when(counts, F.col(c)))), F.lit(0.0))

    return texels.groupBy(*keys).agg(*[mean(c).alias(c) for c in "rgb"], F.avg(counts.cast("double")).alias("valid"))


def block_gains(child: DataFrame, parent: DataFrame, key: str, min_valid: float = 0.5) -> DataFrame:
    """``key, block, g_r, g_g, g_b, valid, l_child, l_parent`` of usable blocks: the gains in stops that bring the child to its parent."""
    p = parent.select(key, "block", *[F.col(c).alias(f"p_{c}") for c in "rgb"], F.col("valid").alias("p_valid"))
    both = child.join(p, [key, "block"]).where((F.col("valid") >= min_valid) & (F.col("p_valid") >= min_valid) & (F.least("r", "g", "b", "p_r", "p_g", "p_b") > 0))
    gains = [F.log2(F.col(f"p_{c}") / F.col(c)).alias(f"g_{c}") for c in "rgb"]
    return both.select(key, "block", *gains, F.least("valid", "p_valid").alias("valid"), F.ln(colour.luma([F.col(c) for c in "rgb"])).alias("l_child"), F.ln(colour.luma([F.col(f"p_{c}") for c in "rgb"])).alias("l_parent"))


def transfers(gains: DataFrame, key: str, dead_zone: float = 0.06, dead_agreement: float = 0.98) -> tuple[DataFrame, DataFrame]:
    """(per key the overall gains, agreement and whether both are one source; per block its confidence).

    Overall gains are medians; a block's confidence falls with its distance from them over 2.5 times the median distance. Agreement is the
    correlation of the lights: 0 under eight blocks, 1 where a tile is flat.
    """
    overall = gains.groupBy(key).agg(*[F.percentile(f"g_{c}", 0.5).alias(f"o_{c}") for c in "rgb"])
    far = F.greatest(*[F.abs(F.col(f"g_{c}") - F.col(f"o_{c}")) for c in "rgb"])
    off = gains.join(overall, key).withColumn("off", far)
    flat = (F.var_pop("l_child") * F.count("*") <= 1.1920929e-7) | (F.var_pop("l_parent") * F.count("*") <= 1.1920929e-7)
    agreement = F.when(F.count("*") < 8, 0.0).when(flat, 1.0).otherwise(F.corr("l_child", "l_parent"))
    whole = off.groupBy(key).agg(*[F.first(f"o_{c}").alias(f"o_{c}") for c in "rgb"], F.percentile("off", 0.5).alias("spread"), F.max("off").alias("furthest"), agreement.alias("agreement"))
    same = (F.greatest(*[F.abs(f"o_{c}") for c in "rgb"]) < dead_zone) & (F.col("agreement") >= dead_agreement) & (F.col("furthest") < 2 * dead_zone)
    scale = F.greatest(F.col("spread") * 2.5, F.lit(0.05))
    confidence = off.join(whole.select(key, "spread"), key).select(key, "block", (F.col("valid") / (1 + F.pow(F.col("off") / scale, 2))).alias("confidence"))
    return whole.select(key, *[f"o_{c}" for c in "rgb"], "agreement", same.alias("same_source")), confidence


def merged_grades(parts: DataFrame) -> DataFrame:
    """One grade a level of ``level, weight, black, gain, contrast, saturation`` rows: black is averaged, the rest geometrically; weights of 0 and less don't count."""
    w = F.sum("weight")

    def geometric(c):
        return F.exp(F.sum(F.col("weight") * F.ln(c)) / w)

    return parts.where("weight > 0").groupBy("level").agg((F.sum(F.col("weight") * F.col("black")) / w).alias("black"), *[geometric(c).alias(c) for c in ("gain", "contrast", "saturation")])


def observed(parts: DataFrame) -> DataFrame:
    """Observations of several parts as one: usage is summed, of a tile's payloads the first part's is kept."""
    return parts.groupBy("level", "x", "y").agg(F.sum("drapes").alias("drapes"), F.min_by("payload", "part").alias("payload"))
