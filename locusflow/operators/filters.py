"""Variant and sample filters, lazy and counted."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..frame import VariantFrame
from ..functions import genotypes as G
from ..scratch import discard, materialise
from ..shipping import ship_package

#: Ids in a stretch of the linkage scan.
SCAN_CHUNK = 10_000
SCAN_SCHEMA = "lane string, chunk long, entry array<int>, kept array<long>, exit array<int>"


@dataclass
class FilterCounts:
    """Counts of the filters of a frame that is being counted, filled by the run of an action on it."""

    seen: list[tuple[str, Observation, Observation]] = field(default_factory=list)

    def stats(self) -> dict[str, dict[str, int]]:
        """vars_processed and vars_kept of each kind; waits for an action on the frame, and takes the first one's counts."""
        found: dict[str, dict[str, int]] = {}
        for kind, before, after in self.seen:
            held = found.setdefault(kind, {"vars_processed": 0, "vars_kept": 0})
            held["vars_processed"] += before.get["n"]
            held["vars_kept"] += after.get["n"]
        return found


def counting(variants: VariantFrame) -> tuple[VariantFrame, FilterCounts]:
    """variants whose filters from here on count rows while they run: no pass of their own.

    Counts are of what the action on the filtered frame reads: one that stops early, as limit
    does, counts what it has seen.
    """
    counts = FilterCounts()
    return replace(variants, counts=counts).with_df(variants.df), counts


def _kept(variants: VariantFrame, kind: str, after: DataFrame, condition, samples=None) -> VariantFrame:
    """The frame after a filter, which is noted, and counted if the frame is one that counts."""
    held = variants if samples is None else replace(variants, samples=samples)
    held = held.with_df(after, (kind, variants.df, after, condition))
    if variants.counts is not None:
        variants.counts.seen.append((kind, variants.watch, held.watch))
    return held


def _keep(variants: VariantFrame, kind: str, condition) -> VariantFrame:
    return _kept(variants, kind, variants.df.where(condition), condition)


def filter_by_missing_data(variants: VariantFrame, max_allowed_missing_rate: float = 0.0) -> VariantFrame:
    missing = G.num_missing(F.col("gts"), variants.num_samples, variants.ploidy)
    return _keep(variants, "missing_data", missing / F.lit(variants.num_samples) <= max_allowed_missing_rate)


def filter_by_maf(variants: VariantFrame, max_allowed_maf: float) -> VariantFrame:
    """Keep variants whose MAJOR allele is at most this frequent; those without alleles go."""
    return _keep(variants, "maf", G.major_freq(G.allele_counts(F.col("gts"))) <= max_allowed_maf)


def filter_by_obs_het(variants: VariantFrame, max_allowed_obs_het: float) -> VariantFrame:
    n, p = variants.num_samples, variants.ploidy
    het = G.ratio(G.num_het(F.col("gts"), n, p), F.lit(n) - G.num_missing(F.col("gts"), n, p))
    return _keep(variants, "obs_het", het <= max_allowed_obs_het)


def filter_samples(variants: VariantFrame, samples) -> VariantFrame:
    """Keep samples by name or slice, in their own order; unknown names are passed over."""
    kept = variants.sample_indexes(samples)
    if not kept:
        raise ValueError("no samples are left")
    after = variants.df.withColumn("gts", G.gathered(F.col("gts"), kept, variants.ploidy))
    return _kept(variants, "sample", after, None, [variants.samples[i] for i in kept])


def signed_r(x: np.ndarray, y: np.ndarray) -> float | None:
    """Pearson's r of two integer vectors from exact sums; None without variance."""
    n = len(x)
    top = n * int(x @ y) - int(x.sum()) * int(y.sum())
    bottom = (n * int(x @ x) - int(x.sum()) ** 2) * (n * int(y @ y) - int(y.sum()) ** 2)
    return top / bottom**0.5 if bottom > 0 else None


def _scan_chunk(group: pd.DataFrame, min_allowed_r2: float) -> pd.DataFrame:
    """The greedy scan over one stretch, from what was kept last before it (entry), if there is anything."""
    rows = group.sort_values("var_id")
    entry = rows["entry"].iloc[0]
    last, kept = None if entry is None else np.asarray(entry, dtype=np.int64), []
    for var_id, held in zip(rows["var_id"].tolist(), rows["coded"], strict=True):
        held = np.asarray(held, dtype=np.int64)
        if last is not None:
            r = signed_r(last, held)
            if r is None or abs(r) >= min_allowed_r2:
                continue
        last = held
        kept.append(var_id)
    return pd.DataFrame({"lane": [rows["lane"].iloc[0]], "chunk": [rows["chunk"].iloc[0]], "entry": [entry], "kept": [kept], "exit": [last.tolist() if kept else None]})


def greedy_scan(coded: DataFrame, min_allowed_r2: float) -> tuple[DataFrame, int]:
    """lane and kept ids of each stretch of coded (lane, chunk, var_id, coded), as one scan of each lane would keep them; and the rounds it took.

    What a scan keeps in a stretch depends only on the genotypes of what was kept last before it. All
    stretches are scanned side by side. In a round each stretch looks back to the nearest one before it that has
    kept something, past all those that have kept nothing, and is scanned again if that ends with other genotypes
    than the ones it was scanned from. A round makes at least one more stretch final, in the order of the
    lane; because the way back is one step, chains of stretches that keep nothing, and changes
    that leave an end's genotypes as they are, need no round each.
    """

    def scan(rows: DataFrame) -> DataFrame:
        return rows.groupBy("lane", "chunk").applyInPandas(lambda group: _scan_chunk(group, min_allowed_r2), SCAN_SCHEMA)

    state = materialise(scan(coded.withColumn("entry", F.lit(None).cast("array<int>"))), "ld-scan")
    most = state.count() + 1
    for turn in range(1, most + 1):
        earlier = Window.partitionBy("lane").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # a few numbers a stretch
        origin = F.last(F.when(F.col("some"), F.col("chunk")), ignorenulls=True).over(earlier)
        looking = state.select("lane", "chunk", (F.size("kept") > 0).alias("some")).select("lane", "chunk", origin.alias("origin")).where("origin is not null")
        ends = state.where("exit is not null").select("lane", F.col("chunk").alias("origin"), F.col("exit").alias("next_entry"))
        due = looking.join(ends, ["lane", "origin"]).join(state.select("lane", "chunk", F.col("entry").alias("old")), ["lane", "chunk"])
        due = materialise(due.where(~F.col("old").eqNullSafe(F.col("next_entry"))).select("lane", "chunk", F.col("next_entry").alias("entry")), "ld-due")
        if due.isEmpty():
            discard(due)
            return state.select("lane", "kept"), turn
        again = scan(coded.join(due, ["lane", "chunk"]))
        after = materialise(again.unionByName(state.join(due, ["lane", "chunk"], "left_anti")), "ld-scan")
        discard(due)
        discard(state)
        state = after
    raise RuntimeError(f"the scan of {most - 1} stretches isn't final after as many rounds")


def filter_by_ld_and_maf(
    variants: VariantFrame, min_allowed_r2: float = 0.1, max_allowed_maf: float = 0.95, by_chrom: bool = False, chunk_size: int = SCAN_CHUNK
) -> VariantFrame:
    """Major-allele filter, then the greedy scan in input order; by_chrom starts anew on each chromosome.

    The scan is a fold over the whole order, made in parallel by rounds (see greedy_scan) over
    stretches of chunk_size ids. Coded genotypes and the state between rounds are stored as Parquet.
    """
    ship_package(variants.df.sparkSession)
    within = filter_by_maf(replace(variants, counts=None), max_allowed_maf)
    n, p = variants.num_samples, variants.ploidy
    major = G.major_allele(G.allele_counts(F.col("gts")))
    lane = F.coalesce(F.col("chrom").cast("string"), F.lit("")) if by_chrom else F.lit("")
    chunk = F.floor(F.col("var_id") / chunk_size).cast("long")
    coded = within.df.select(lane.alias("lane"), chunk.alias("chunk"), F.col("var_id").cast("long").alias("var_id"), G.coded_012(F.col("gts"), n, p, major).alias("coded"))
    coded = materialise(coded, "ld-coded")
    state, _ = greedy_scan(coded, min_allowed_r2)
    discard(coded)
    kept = state.select(F.explode("kept").alias("kept_id"))
    after = within.df.join(kept, within.df.var_id == kept.kept_id, "left_semi")
    return _kept(variants, "ld_and_maf", after, None)


def gather_filtering_stats(variants: VariantFrame) -> DataFrame:
    """kind, vars_processed, vars_kept: what each kind of filter has seen and kept, summed over steps.

    Steps that follow one another and are conditions on a variant's own row are counted in one
    pass over the first one's rows.
    """
    spark = variants.df.sparkSession
    runs: list[list[tuple]] = []
    for step in variants.steps:
        if runs and step[3] is not None and runs[-1][-1][3] is not None and runs[-1][-1][2] is step[1]:
            runs[-1].append(step)
        else:
            runs.append([step])
    counted = None
    for run in runs:
        if run[0][3] is None:
            kind, before, after, _ = run[0]
            row = before.agg(F.count(F.lit(1)).alias("n0")).crossJoin(after.agg(F.count(F.lit(1)).alias("n1")))  # one row each
        else:
            passed, sums = F.lit(True), [F.count(F.lit(1)).alias("n0")]
            for k, step in enumerate(run, 1):
                passed = passed & F.coalesce(step[3], F.lit(False))
                sums.append(F.count(F.when(passed, 1)).alias(f"n{k}"))
            row = run[0][1].agg(*sums)
        each = [F.struct(F.lit(step[0]).alias("kind"), F.col(f"n{k}").alias("vars_processed"), F.col(f"n{k + 1}").alias("vars_kept")) for k, step in enumerate(run)]
        row = row.select(F.inline(F.array(*each)))
        counted = row if counted is None else counted.unionByName(row)
    if counted is None:
        return spark.createDataFrame([], "kind string, vars_processed long, vars_kept long")
    return counted.groupBy("kind").agg(F.sum("vars_processed").alias("vars_processed"), F.sum("vars_kept").alias("vars_kept"))
