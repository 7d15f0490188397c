"""Genotype kernels as Spark expressions on the gts array of a variant's own row: no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MISSING_ALLELE
from ..frame import VariantFrame

NO_INTS = "cast(array() as array<int>)"


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom as a double, NULL over zero."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row: inside a lambda it would be evaluated for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def genotype(gts: Column, sample: Column, ploidy: int) -> Column:
    return F.slice(gts, sample * ploidy + 1, F.lit(ploidy))


def gathered(gts: Column, indexes: list[int], ploidy: int) -> Column:
    """Alleles of the given samples only, in that order."""
    if not indexes:
        return F.expr(NO_INTS)
    return F.flatten(F.transform(F.array(*[F.lit(i) for i in indexes]), lambda s: genotype(gts, s, ploidy)))


def genotypes(gts: Column, num_samples: int, ploidy: int) -> Column:
    """An array with one allele array a sample."""
    if not num_samples:
        return F.expr("cast(array() as array<array<int>>)")
    return F.transform(F.sequence(F.lit(0), F.lit(num_samples - 1)), lambda s: genotype(gts, s, ploidy))


def is_missing(gt: Column) -> Column:
    return F.array_contains(gt, MISSING_ALLELE)


def is_het(gt: Column) -> Column:
    return ~is_missing(gt) & (F.size(F.array_distinct(gt)) > 1)


def num_missing(gts: Column, num_samples: int, ploidy: int) -> Column:
    return F.size(F.filter(genotypes(gts, num_samples, ploidy), is_missing)).cast("long")


def num_het(gts: Column, num_samples: int, ploidy: int) -> Column:
    return F.size(F.filter(genotypes(gts, num_samples, ploidy), is_het)).cast("long")


def allele_counts(gts: Column) -> Column:
    """array of (allele, n), alleles in order, missing ones left out."""

    def counted(called: Column) -> Column:
        each = lambda allele: F.struct(allele.alias("allele"), F.size(F.filter(called, lambda x: x == allele)).cast("long").alias("n"))
        return F.transform(F.array_sort(F.array_distinct(called)), each)

    return bound(F.filter(gts, lambda a: a != MISSING_ALLELE), counted)


def major_allele(counts: Column) -> Column:
    """The most frequent allele, the lowest among equals; NULL if none is called."""
    return F.element_at(F.array_sort(F.transform(counts, lambda c: F.struct((-c["n"]).alias("k"), c["allele"].alias("allele")))), 1)["allele"]


def major_freq(counts: Column) -> Column:
    """Frequency of the most frequent allele among the called ones."""
    return ratio(F.array_max(F.transform(counts, lambda c: c["n"])), total(counts))


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, c: s + c["n"])


def first_or_null(counts: Column, value: Column) -> Column:
    return F.when(F.size(counts) > 0, value)


def coded_012(gts: Column, num_samples: int, ploidy: int, major: Column, keep_missing: bool = True) -> Column:
    """Alleles that differ from the major one in each genotype.

    With keep_missing a genotype with a missing allele is -1; else missing alleles count as
    different from the major one.
    """

    def coded(known: Column) -> Column:
        def code(gt: Column) -> Column:
            other = F.size(F.filter(gt, lambda a: a != known))
            return F.when(is_missing(gt), F.lit(-1)).otherwise(other) if keep_missing else other

        return F.transform(genotypes(gts, num_samples, ploidy), code)

    return bound(major, coded)


def pop_summaries(variants: VariantFrame, pops=None) -> DataFrame:
    """A row for each variant and population with the counts that all statistics derive from.

    var_id, pop, n_samples, n_called (full genotypes), n_het, n_alleles (called alleles),
    missing_alleles, counts. Each row comes from its variant's own row.
    """
    indexes, p = variants.pop_indexes(pops), variants.ploidy

    def summary(pop: str, held: list[int]) -> Column:
        own = gathered(F.col("gts"), held, p)
        counts = allele_counts(own)
        n = len(held)
        return F.struct(
            F.lit(str(pop)).alias("pop"),
            F.lit(n).cast("long").alias("n_samples"),
            (F.lit(n) - num_missing(own, n, p)).cast("long").alias("n_called"),
            num_het(own, n, p).alias("n_het"),
            total(counts).alias("n_alleles"),
            (F.lit(n * p) - total(counts)).cast("long").alias("missing_alleles"),
            counts.alias("counts"),
        )

    info = [c for c in variants.df.columns if c not in ("gts", "alleles")]
    rows = variants.df.select(*info, F.explode(F.array(*[summary(k, v) for k, v in indexes.items()])).alias("s"))
    return rows.select(*info, "s.*")
