"""VariantFrame: variants as a DataFrame, one row each, with its samples and ploidy."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import config

#: Places of a list up to which they are broadcast.
MOST_BROADCAST = 1_000_000
INFO_TYPES = (T.StringType, T.FloatType, T.DoubleType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class VariantFrame:
    """variants: var_id (input order), gts (sample-major alleles, -1 missing), and info columns
    such as chrom, pos, id, qual and alleles.

    steps lists the filters applied so far as (kind, frame before, frame after, condition on a row
    or None), for gather_filtering_stats; counts and watch are those of a frame whose filters count while they run.
    """

    df: DataFrame
    samples: tuple
    ploidy: int = 2
    steps: tuple = ()
    counts: object = None
    watch: object = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "samples", tuple(self.samples))
        repeated = [s for s, n in Counter(self.samples).items() if n > 1]
        if repeated:
            raise ValueError(f"repeated sample names: {repeated[:5]}")
        kind = dict(self.df.dtypes).get("gts")
        if kind not in ("array<int>", "array<smallint>", "array<tinyint>"):
            raise ValueError("gts must be an array of integers")
        for field in self.df.schema.fields:
            if field.name not in ("gts", "alleles", "var_id") and not isinstance(field.dataType, INFO_TYPES):
                raise ValueError(f"column {field.name} must hold strings, floats or integers")

    @property
    def num_samples(self) -> int:
        return len(self.samples)

    @property
    def has_positions(self) -> bool:
        return {config.CHROM_COL, config.POS_COL} <= set(self.df.columns)

    def with_df(self, df: DataFrame, step: tuple | None = None) -> VariantFrame:
        watch = None
        if self.counts is not None:
            watch = Observation()
            df = df.observe(watch, F.count(F.lit(1)).alias("n"))
        return replace(self, df=df, watch=watch, steps=self.steps + ((step,) if step else ()))

    @classmethod
    def from_gt_array(cls, spark: SparkSession, gts, samples: Sequence | None = None, vars_info=None, alleles=None) -> VariantFrame:
        """From a variants x samples x ploidy array (or nested lists); masked and -1 are missing."""
        if isinstance(gts, np.ma.MaskedArray):
            gts = gts.filled(config.MISSING_ALLELE)
        gts = np.asarray(gts)
        if gts.ndim != 3:
            raise ValueError("genotypes need three dimensions: variants, samples, ploidy")
        if not np.issubdtype(gts.dtype, np.integer):
            raise ValueError("genotypes must be integers")
        samples = tuple(range(gts.shape[1])) if samples is None else tuple(samples)
        if len(samples) != gts.shape[1]:
            raise ValueError("as many sample names as samples are needed")
        info = {} if vars_info is None else {c: list(vars_info[c]) for c in vars_info}
        if any(len(v) != len(gts) for v in info.values()) or (alleles is not None and len(alleles) != len(gts)):
            raise ValueError("info and alleles need a row for each variant")
        kinds = {c: _info_type(v) for c, v in info.items()}
        fields = [T.StructField("var_id", T.LongType()), *(T.StructField(c, k) for c, k in kinds.items())]
        if alleles is not None:
            fields.append(T.StructField("alleles", T.ArrayType(T.StringType())))
        fields.append(T.StructField("gts", T.ArrayType(T.IntegerType())))
        rows = []
        for i, flat in enumerate(gts.reshape(len(gts), -1).tolist()):
            row = [i, *(_plain(info[c][i], kinds[c]) for c in info)]
            if alleles is not None:
                row.append([a for a in alleles[i] if a not in ("", None)])
            rows.append((*row, flat))
        return cls(spark.createDataFrame(rows, T.StructType(fields)), samples, gts.shape[2])

    def first_chunks(self, num_chunks: int, chunk_size: int = config.VARS_PER_CHUNK) -> VariantFrame:
        """The first num_chunks chunks in input order."""
        return self.with_df(self.df.orderBy("var_id").limit(num_chunks * chunk_size))

    def get_vars(self, index) -> VariantFrame:
        """Rows by a Column condition, or by place in the order of var_id: a slice, a mask, or a list of places.

        Slices and negative places count as Python's do; a mask has a value for each row. Rows keep
        their var_id, so a list's order and repeats leave no trace; a place beyond the rows is an
        IndexError. Frames whose var_id is 0..n-1, as sources give them, need no numbering for it;
        others (after a filter, say) are numbered by counts of ranges.
        """
        if isinstance(index, Column):
            return self.with_df(self.df.where(index))
        df, place, rows = self.with_place()
        if isinstance(index, slice):
            chosen = range(rows)[index]
            low, high = (min(chosen[0], chosen[-1]), max(chosen[0], chosen[-1])) if len(chosen) else (0, -1)
            kept = df.where(place.between(low, high) & (F.pmod(place - low, F.lit(abs(chosen.step))) == 0))
        else:
            wanted = self._places(index, rows)
            few = self.df.sparkSession.createDataFrame(pd.DataFrame({"wanted_place": wanted}), "wanted_place long")
            kept = df.join(F.broadcast(few) if len(wanted) <= MOST_BROADCAST else few, place == F.col("wanted_place"), "left_semi")
        return self.with_df(kept.select(*self.df.columns))

    @staticmethod
    def _places(index, rows: int) -> np.ndarray:
        """Distinct places from 0 of a mask or a list, which is the caller's own and so fits here."""
        given = np.asarray(index)
        if given.ndim != 1 or (given.size and given.dtype != bool and not np.issubdtype(given.dtype, np.integer)):
            raise TypeError("rows are chosen by a condition, a slice, a mask or a list of whole numbers")
        if given.dtype == bool:
            if len(given) != rows:
                raise IndexError(f"the mask has {len(given)} values for {rows} rows")
            return np.flatnonzero(given)
        if given.size and (given.min() < -rows or given.max() >= rows):
            raise IndexError(f"a place is outside of the {rows} rows")
        return np.unique(np.where(given < 0, given + rows, given).astype(np.int64))

    def with_place(self) -> tuple[DataFrame, Column, int]:
        """The rows with their place in the order of var_id, and how many there are."""
        found = self.df.agg(F.count(F.lit(1)).alias("n"), F.min("var_id").alias("low"), F.max("var_id").alias("high")).first()
        if not found.n or (found.low == 0 and found.high == found.n - 1):
            return self.df, F.col("var_id"), found.n
        numbered = numbered_in_order(self.df, "var_id", "place_")
        return numbered, F.col("place_"), found.n

    def sample_indexes(self, names: Sequence | slice) -> list[int]:
        """Indexes of the samples in their own order; unknown names are passed over."""
        if isinstance(names, slice):
            return list(range(self.num_samples))[names]
        if isinstance(names, str) or not isinstance(names, Sequence):
            raise ValueError("samples must be a sequence of names")
        wanted = set(names)
        return [i for i, s in enumerate(self.samples) if s in wanted]

    def pop_indexes(self, pops: Mapping[str, Sequence] | None) -> dict[str, list[int]]:
        """Sample indexes of each population, populations by name; an unknown sample is a KeyError."""
        if pops is None:
            return {config.POP_NAME: list(range(self.num_samples))}
        at = {s: i for i, s in enumerate(self.samples)}
        return {pop: [at[s] for s in pops[pop]] for pop in sorted(pops, key=str)}


def numbered_in_order(df: DataFrame, by: str, name: str, width: int = 65_536) -> DataFrame:
    """df with a column name: 0..n-1 in the order of by, a column of distinct numbers.

    Rows are counted by stretches of width numbers; the counts' running sum, over a row a stretch,
    says where each stretch begins, and rows are numbered within their own.
    """
    stretch = F.floor(F.col(by) / width)
    counts = df.groupBy(stretch.alias("stretch_")).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1))  # two numbers a stretch
    starts = counts.select("stretch_", F.coalesce(before, F.lit(0)).alias("before_"))
    within = F.row_number().over(Window.partitionBy("stretch_").orderBy(by))
    each = df.withColumn("stretch_", stretch).join(starts, "stretch_")
    return each.withColumn(name, F.col("before_") + within - 1).drop("stretch_", "before_")


def _info_type(values: list) -> T.DataType:
    held = [v for v in values if v is not None and v == v]
    if all(isinstance(v, str) for v in held):
        return T.StringType()
    if all(isinstance(v, (int, np.integer)) and not isinstance(v, bool) for v in held):
        return T.LongType()
    if all(isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) for v in held):
        return T.DoubleType()
    raise ValueError("info columns must hold strings, floats or integers")


def _plain(value, kind: T.DataType):
    if value is None or value != value:
        return None
    return {T.StringType: str, T.LongType: int, T.DoubleType: float}[type(kind)](value)
