"""Statistics per variant, population and sample, with their means and histograms."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..frame import VariantFrame
from ..functions import genotypes as G


def histogram_edges(num_bins: int = config.NUM_BINS, range: tuple = config.HIST_RANGE, bin_type="lineal") -> list[float]:  # noqa: A002
    kind = bin_type.value if isinstance(bin_type, config.BinType) else bin_type
    if kind == "lineal":
        return np.linspace(range[0], range[1], num_bins + 1).tolist()
    if kind == "logarithmic":
        if range[0] == 0:
            raise ValueError("a logarithmic histogram can't begin at exponent 0")
        return np.logspace(range[0], range[1], num_bins + 1).tolist()
    raise ValueError(f"unknown bin type {bin_type}")


def mean_by_pop(values: DataFrame, column: str) -> DataFrame:
    return values.groupBy("pop").agg(F.avg(column).alias("mean"))


def histogram_by_pop(values: DataFrame, column: str, pops: list[str], **hist_kwargs) -> DataFrame:
    """pop, bin, lo, hi, n with a row for each bin; the last bin includes its end."""
    edges = histogram_edges(**(hist_kwargs or {}))
    spark = values.sparkSession
    last = len(edges) - 2
    # the number of edges passed tells the bin, by the edges' own double values
    passed = sum((F.when(F.col(column) >= F.lit(e), 1).otherwise(0) for e in edges[1:-1]), F.lit(0))
    inside = values.where((F.col(column) >= edges[0]) & (F.col(column) <= edges[-1]))
    counts = inside.groupBy("pop", passed.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = spark.createDataFrame([(p, b, edges[b], edges[b + 1]) for p in pops for b in range(last + 1)], "pop string, bin int, lo double, hi double")
    return bins.join(F.broadcast(counts), ["pop", "bin"], "left").select("pop", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _stats(variants: VariantFrame, values: DataFrame, column: str, pops, hist_kwargs) -> dict:
    names = [str(p) for p in variants.pop_indexes(pops)]
    return {"mean": mean_by_pop(values, column), "hist": histogram_by_pop(values, column, names, **(hist_kwargs or {}))}


def enough(min_num_samples: float, ploidy: int) -> Column:
    return F.col("n_alleles") / F.lit(ploidy) >= F.lit(min_num_samples)


def obs_het_per_var(variants: VariantFrame, pops=None) -> DataFrame:
    """Observed heterozygosity: heterozygous among called genotypes."""
    rows = G.pop_summaries(variants, pops)
    return rows.select("var_id", "pop", "n_called", G.ratio(F.col("n_het"), F.col("n_called")).alias("obs_het"))


def check_alleles(variants: VariantFrame, alleles: Sequence[int] | None) -> None:
    """Genotypes with other alleles than those given, if any are, are an error."""
    if alleles is not None:
        known = F.array(*[F.lit(int(a)) for a in (config.MISSING_ALLELE, *alleles)])
        if not variants.df.where(F.exists("gts", lambda a: ~F.array_contains(known, a.cast("int")))).isEmpty():
            raise ValueError("the genotypes have alleles that are not among the given ones")


def allele_freqs_per_var(variants: VariantFrame, pops=None, min_num_samples: float = config.MIN_NUM_SAMPLES, alleles: Sequence[int] | None = None) -> DataFrame:
    """var_id, pop, allele, n, freq and missing_alleles for each allele the variant has in any population.

    Genotypes with other alleles than those given, if any are, are an error.
    """
    check_alleles(variants, alleles)
    seen = F.array_join(F.transform(G.allele_counts(F.col("gts")), lambda c: c["allele"].cast("string")), ",")
    summaries = G.pop_summaries(variants.with_df(variants.df.withColumn("seen", seen)), pops)
    listed = summaries.select("var_id", "pop", "n_alleles", "missing_alleles", "counts", F.explode(F.split("seen", ",")).alias("allele")).where("allele <> ''")
    n = F.aggregate(F.filter("counts", lambda c: c["allele"] == F.col("allele").cast("int")), F.lit(0).cast("long"), lambda s, c: s + c["n"])
    freq = F.when(enough(min_num_samples, variants.ploidy), G.ratio(n, F.col("n_alleles")))
    return listed.select("var_id", "pop", F.col("allele").cast("int").alias("allele"), n.alias("n"), freq.alias("freq"), "missing_alleles")


def major_freq_per_var(variants: VariantFrame, pops=None, min_num_samples: float = config.MIN_NUM_SAMPLES) -> DataFrame:
    """Frequency of the MAJOR allele (the reference's "maf")."""
    rows = G.pop_summaries(variants, pops)
    return rows.select("var_id", "pop", F.when(enough(min_num_samples, variants.ploidy), G.major_freq(F.col("counts"))).alias("major_freq"))


def expected_het(ploidy: int) -> Column:
    """1 - sum of the frequencies to the power of the ploidy, of the columns counts and n_alleles."""
    power = F.aggregate(F.col("counts"), F.lit(0.0), lambda s, c: s + F.power(G.ratio(c["n"], F.col("n_alleles")), F.lit(float(ploidy))))
    return F.when(F.col("n_alleles") > 0, F.lit(1.0) - power)


def exp_het_per_var(variants: VariantFrame, pops=None, min_num_samples: float = config.MIN_NUM_SAMPLES, ploidy: int | None = None, unbiased: bool = True) -> DataFrame:
    """Expected heterozygosity, corrected for the number of called individuals if unbiased."""
    rows = G.pop_summaries(variants, pops)
    value = expected_het(ploidy or variants.ploidy)
    if unbiased:
        n = F.col("n_alleles") / F.lit(variants.ploidy)
        value = G.ratio(2 * n, 2 * n - 1) * value
    return rows.select("var_id", "pop", F.when(enough(min_num_samples, variants.ploidy), value).alias("exp_het"))


def calc_obs_het_stats_per_var(variants: VariantFrame, pops=None, hist_kwargs=None) -> dict:
    return _stats(variants, obs_het_per_var(variants, pops), "obs_het", pops, hist_kwargs)


def calc_major_allele_stats_per_var(variants: VariantFrame, pops=None, min_num_samples=config.MIN_NUM_SAMPLES, hist_kwargs=None) -> dict:
    return _stats(variants, major_freq_per_var(variants, pops, min_num_samples), "major_freq", pops, hist_kwargs)


def calc_exp_het_stats_per_var(variants: VariantFrame, pops=None, min_num_samples=config.MIN_NUM_SAMPLES, ploidy=None, hist_kwargs=None, unbiased=True) -> dict:
    return _stats(variants, exp_het_per_var(variants, pops, min_num_samples, ploidy, unbiased), "exp_het", pops, hist_kwargs)


def calc_poly_vars_ratio_per_var(variants: VariantFrame, poly_threshold=config.POLY_THRESHOLD, pops=None, min_num_samples=config.MIN_NUM_SAMPLES) -> DataFrame:
    """Per population: variants below the threshold, variable ones, those with data, and ratios."""
    freq = F.col("major_freq")
    sums = major_freq_per_var(variants, pops, min_num_samples).groupBy("pop").agg(
        F.count_if(freq < poly_threshold).alias("num_poly"),
        F.count_if(freq < 1.0).alias("num_variable"),
        F.count("major_freq").alias("tot_num_variants_with_data"),
    )
    return sums.select(
        "*",
        G.ratio(F.col("num_poly"), F.col("tot_num_variants_with_data")).alias("poly_ratio"),
        G.ratio(F.col("num_poly"), F.col("num_variable")).alias("poly_ratio_over_variables"),
    )


def calc_per_sample_stats(variants: VariantFrame) -> DataFrame:
    """Per sample: rates of missing and of heterozygous genotypes over all variants.

    A row for each genotype meets its sample's sums within the task; one row a sample and task
    is shuffled.
    """
    names = variants.df.sparkSession.createDataFrame([(i, str(s)) for i, s in enumerate(variants.samples)], "sample_idx int, sample string")
    each = variants.df.select(F.posexplode(G.genotypes(F.col("gts"), variants.num_samples, variants.ploidy)).alias("sample_idx", "gt"))
    each = each.select("sample_idx", G.is_missing(F.col("gt")).alias("miss"), G.is_het(F.col("gt")).alias("het"))
    sums = each.groupBy("sample_idx").agg(F.count(F.lit(1)).alias("n"), F.count_if("miss").alias("miss"), F.count_if("het").alias("het"))
    rates = sums.select("sample_idx", G.ratio(F.col("miss"), F.col("n")).alias("missing_gt_rate"), G.ratio(F.col("het"), F.col("n")).alias("obs_het_rate"))
    return names.join(rates, "sample_idx", "left")


def genotype_flags(variants: VariantFrame) -> DataFrame:
    """var_id, sample_idx, is_missing, is_het: a row for each genotype."""
    each = variants.df.select("var_id", F.posexplode(G.genotypes(F.col("gts"), variants.num_samples, variants.ploidy)).alias("sample_idx", "gt"))
    return each.select("var_id", "sample_idx", G.is_missing(F.col("gt")).alias("is_missing"), G.is_het(F.col("gt")).alias("is_het"))
