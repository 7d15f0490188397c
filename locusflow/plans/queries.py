"""Queries over the genotype view of the embeddings table: 32 diploid samples, a variant a vector."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import BinType, LDCalcMethod
from ..frame import VariantFrame
from ..functions import genotypes as G
from ..operators import dists, filters, ld, ordination, stats
from ..operators.pipeline import Pipeline
from ..scratch import scratch_path
from ..sources import array_folder, native, vcf, vcf_format

NUM_SAMPLES, PLOIDY = 32, 2
SAMPLES = tuple(f"s{i}" for i in range(NUM_SAMPLES))
TWO_POPS = {"p1": SAMPLES[:16], "p2": SAMPLES[16:]}
THREE_POPS = {f"q{k}": tuple(s for i, s in enumerate(SAMPLES) if i % 3 == k) for k in range(3)}
OVERLAPPING = {"o1": SAMPLES[:20], "o2": SAMPLES[12:]}
MIN_SAMPLES, MAX_MAF, MAX_DIST, MIN_SNPS = 5, 0.65, 2_000, 455
LOG_RANGE, SAMPLED = (-2.0, 0.0), 20
MATRIX_ROWS, REGION, SEEDS = (3, 30, 300), ("chr3", 5_001, 30_001), (2, 11, 29)


def variants(spark: SparkSession, sf_dir: str) -> VariantFrame:
    """Alleles by thresholds on the vector's components, cast to double first."""
    v = lambda x: x.cast("double")
    allele = lambda x: F.when(v(x) < -0.25, -1).when(v(x) < 0.05, 0).when(v(x) < 0.2, 1).otherwise(2)
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.col("vec_id").cast("long").alias("var_id"),
        F.concat(F.lit("chr"), F.col("label").cast("string")).alias("chrom"),
        (F.col("vec_id") * 100 + 1).cast("long").alias("pos"),
        F.transform("embedding", allele).alias("gts"),
    )
    return VariantFrame(df, SAMPLES, PLOIDY)


def _rounded(c: str) -> Column:
    """To six digits in doubles, halves away from zero, as DuckDB does; F.round goes through decimals, at more than the cost of the pair itself."""
    near = lambda x: F.floor(x * 1e6 + 0.5)
    return F.when(F.col(c) < 0, -near(-F.col(c))).otherwise(near(F.col(c))) / 1e6


def genotype_scan(spark, d):
    return variants(spark, d).df.select("var_id", "chrom", "pos", F.array_join(F.transform("gts", lambda a: a.cast("string")), ",").alias("gts"))


def genotype_long_filter_chrom(spark, d):
    held = variants(spark, d).get_vars(F.col("chrom") == "chr3")
    long = held.df.select("var_id", "pos", F.posexplode("gts").alias("i", "allele"))
    return long.select("var_id", "pos", F.floor(F.col("i") / 2).cast("int").alias("sample_idx"), (F.col("i") % 2).alias("hap"), "allele")


def gt_missing_het(spark, d):
    return stats.genotype_flags(variants(spark, d))


def allele_counts_per_var(spark, d):
    rows = G.pop_summaries(variants(spark, d), TWO_POPS).select("var_id", "pop", F.explode("counts").alias("c"))
    return rows.select("var_id", "pop", F.col("c.allele").alias("allele"), F.col("c.n").alias("n"))


def allele_freqs_per_pop(spark, d):
    return stats.allele_freqs_per_var(variants(spark, d), THREE_POPS, MIN_SAMPLES)


def obs_het_per_var(spark, d):
    return stats.obs_het_per_var(variants(spark, d), TWO_POPS)


def obs_het_mean(spark, d):
    return stats.calc_obs_het_stats_per_var(variants(spark, d), OVERLAPPING)["mean"].withColumn("mean", F.round("mean", 6))


def obs_het_hist(spark, d):
    return stats.calc_obs_het_stats_per_var(variants(spark, d), OVERLAPPING)["hist"].select("pop", "bin", "n")


def obs_het_log_hist(spark, d):
    kwargs = {"num_bins": 12, "range": LOG_RANGE, "bin_type": BinType.LOGARITHMIC}
    return stats.calc_obs_het_stats_per_var(variants(spark, d), OVERLAPPING, hist_kwargs=kwargs)["hist"].select("pop", "bin", "n")


def major_allele_freq_per_pop(spark, d):
    return stats.major_freq_per_var(variants(spark, d), THREE_POPS, MIN_SAMPLES)


def maf_mean(spark, d):
    return stats.calc_major_allele_stats_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES)["mean"].withColumn("mean", F.round("mean", 6))


def maf_hist(spark, d):
    return stats.calc_major_allele_stats_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES)["hist"].select("pop", "bin", "n")


def exp_het_per_var(spark, d):
    return stats.exp_het_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES, unbiased=False).withColumn("exp_het", F.round("exp_het", 6))


def unbiased_exp_het_per_var(spark, d):
    return stats.exp_het_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES).withColumn("exp_het", F.round("exp_het", 6))


def exp_het_mean(spark, d):
    return stats.calc_exp_het_stats_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES)["mean"].withColumn("mean", F.round("mean", 6))


def exp_het_hist(spark, d):
    found = stats.exp_het_per_var(variants(spark, d), TWO_POPS, MIN_SAMPLES).withColumn("exp_het", F.round("exp_het", 6))
    return stats.histogram_by_pop(found, "exp_het", list(TWO_POPS), num_bins=20).select("pop", "bin", "n")


def poly_ratio_per_pop(spark, d):
    return stats.calc_poly_vars_ratio_per_var(variants(spark, d), 0.7, THREE_POPS, MIN_SAMPLES)


def per_sample_stats(spark, d):
    return stats.calc_per_sample_stats(variants(spark, d))


def filter_missing(spark, d):
    return filters.filter_by_missing_data(variants(spark, d), 0.05).df.select("var_id", "chrom", "pos")


def filter_maf(spark, d):
    return filters.filter_by_maf(variants(spark, d), MAX_MAF).df.select("var_id", "chrom", "pos")


def filter_obs_het(spark, d):
    return filters.filter_by_obs_het(variants(spark, d), 0.4).df.select("var_id", "chrom", "pos")


def filter_samples(spark, d):
    held = filters.filter_samples(variants(spark, d), ["s3", "s9", "s1", "unknown"])
    return held.df.select("var_id", F.array_join(F.transform("gts", lambda a: a.cast("string")), ",").alias("gts"))


def _chain_of(held: VariantFrame) -> VariantFrame:
    held = filters.filter_by_missing_data(held, 0.1)
    return filters.filter_by_obs_het(filters.filter_by_maf(held, MAX_MAF), 0.5)


def _chain(spark, d) -> VariantFrame:
    return _chain_of(variants(spark, d))


def filter_chain(spark, d):
    return _chain(spark, d).df.select("var_id", "chrom", "pos")


def filtering_stats(spark, d):
    return filters.gather_filtering_stats(_chain(spark, d))


def filtering_stats_of_the_run(spark, d):
    """What the filters have counted while the filtered variants were written, without passes of their own."""
    held, counts = filters.counting(variants(spark, d))
    _chain_of(held).df.write.format("noop").mode("overwrite").save()
    rows = [(kind, n["vars_processed"], n["vars_kept"]) for kind, n in counts.stats().items()]
    return spark.createDataFrame(rows, "kind string, vars_processed long, vars_kept long")


def limit_first_chunks(spark, d):
    return variants(spark, d).first_chunks(2, 100).df.select("var_id", "chrom", "pos")


def _coded(df: DataFrame) -> DataFrame:
    return df.select("var_id", F.posexplode("coded").alias("sample_idx", "g012"))


def gt_012(spark, d):
    return _coded(ld.coded_variants(variants(spark, d)))


def gt_012_pca(spark, d):
    return _coded(ordination.create_012_gt_matrix(variants(spark, d), transform_to_biallelic=True))


def ld_pairwise(spark, d):
    return ld.calc_pairwise_rogers_huff_r2(variants(spark, d)).withColumn("r2", _rounded("r2"))


def ld_max_dist(spark, d):
    return ld.calc_pairwise_rogers_huff_r2(variants(spark, d), max_dist=MAX_DIST).withColumn("r2", F.round("r2", 6))


def ld_matrix(spark, d):
    return ld.calc_rogers_huff_r2_matrix(variants(spark, d)).withColumn("r2", _rounded("r2"))


def ld_matrix_rows(spark, d):
    """Rows of the matrix on demand, against all variants: only blocks that hold them meet the others."""
    return ld.linkage_matrix(variants(spark, d), block=200).cells(rows=MATRIX_ROWS).withColumn("r2", _rounded("r2"))


def ld_per_pop_min_dist(spark, d):
    found = ld.get_ld_and_dist_for_pops(variants(spark, d), TWO_POPS, max_dist=MAX_DIST, min_dist=500, max_allowed_maf=0.8, max_num_measures_to_keep=None)
    return found.withColumn("r2", F.round("r2", 6))


def ld_per_pop_sampled(spark, d):
    found = ld.get_ld_and_dist_for_pops(variants(spark, d), TWO_POPS, max_dist=MAX_DIST, max_allowed_maf=0.8, method=LDCalcMethod.MATRIX, max_num_measures_to_keep=50)
    return found.withColumn("r2", F.round("r2", 6))


def ld_sample_sizes(spark, d):
    """How many pairs the sample of each population holds, and their range of distances."""
    found = ld.get_ld_and_dist_for_pops(variants(spark, d), TWO_POPS, max_dist=300, min_dist=0, max_num_measures_to_keep=SAMPLED)
    return found.groupBy("pop").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("dist_in_bp") > 300).cast("int")).alias("n_far"))


def ld_filter(spark, d):
    return filters.filter_by_ld_and_maf(variants(spark, d), 0.1, 0.95).df.select("var_id", "chrom", "pos")


def kosman_dists(spark, d):
    return dists.calc_pairwise_kosman_dists(variants(spark, d)).df


def kosman_min_snps(spark, d):
    return dists.calc_pairwise_kosman_dists(variants(spark, d), min_num_snps=MIN_SNPS).df


def kosman_rect(spark, d):
    held = dists.kosman_sums(variants(spark, d), list(range(4)), list(range(16, 32)))
    return held.select("i", "j", G.ratio(F.col("total"), F.col("n")).alias("dist"))


def kosman_tiles(spark, d):
    """The same sums through tiles of a few samples each, as cohorts of many samples take them."""
    held = dists.kosman_sums(variants(spark, d), block=5)
    return held.select("i", "j", "n", G.ratio(F.col("total"), F.col("n")).alias("dist"))


def kosman_embedding_of_seeds(spark, d):
    """Seeds are given, and one round adds the samples that are farthest from them and from these."""
    held = dists.kosman_by_embedding(variants(spark, d), max_rounds=1, seeds=SEEDS)
    return held.df.withColumn("dist", F.round("dist", 6))


def jost_dest_per_var(spark, d):
    found = dists.dest_per_var(variants(spark, d), THREE_POPS, MIN_SAMPLES)
    return found.select("var_id", "pop1", "pop2", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("hs", "ht", "dest")])


def jost_dest(spark, d):
    return dists.jost_dest(variants(spark, d), THREE_POPS, MIN_SAMPLES).withColumn("dest", F.round("dest", 6))


def euclidean_dists(spark, d):
    rows = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("features"))
    return dists.euclidean_pairs(rows).withColumn("dist", _rounded("dist"))


def dist_square_form(spark, d):
    return dists.calc_pairwise_kosman_dists(variants(spark, d)).square_form()


def dist_triangle(spark, d):
    held = dists.calc_pairwise_kosman_dists(variants(spark, d)).square_form()
    return held.where("i >= j").groupBy("i").agg(F.round(F.sum("dist"), 6).alias("row_sum"), F.count(F.lit(1)).alias("n"))


def pca_gram(spark, d):
    held = variants(spark, d)
    coded = ordination.create_012_gt_matrix(held, transform_to_biallelic=True)
    return ordination.gram_matrix(coded, NUM_SAMPLES).withColumn("g", F.round("g", 6))


def pcoa_centered_matrix(spark, d):
    return ordination.centered_matrix(dists.calc_pairwise_kosman_dists(variants(spark, d))).withColumn("f", F.round("f", 6))


def pca_projections(spark, d):
    return ordination.pca_frame(spark, ordination.do_pca_with_vars(variants(spark, d), transform_to_biallelic=True))


def pcoa_projections(spark, d):
    return ordination.pca_frame(spark, ordination.do_pcoa_with_vars(variants(spark, d)))


def _products(spark, found: dict, signs) -> DataFrame:
    """i, j, product over all components, which doesn't depend on the components' own signs."""
    scores = found["projections"].to_numpy()
    square = (scores * signs) @ scores.T
    rows = [(i, j, float(square[i, j])) for i in range(len(square)) for j in range(i, len(square))]
    return spark.createDataFrame(rows, "i int, j int, product double").withColumn("product", F.round("product", 6))


def pca_products(spark, d):
    return _products(spark, ordination.do_pca_with_vars(variants(spark, d), transform_to_biallelic=True), 1.0)


def pcoa_products(spark, d):
    found = ordination.do_pcoa_with_vars(variants(spark, d))
    return _products(spark, found, np.sign(found["explained_variance"].to_numpy()))


def pca_table_products(spark, d):
    """do_pca over a small table: the samples' rates."""
    table = stats.calc_per_sample_stats(variants(spark, d)).orderBy("sample_idx").select("missing_gt_rate", "obs_het_rate").toPandas()
    return _products(spark, ordination.do_pca(table), 1.0)


def pca_princomps(spark, d):
    """Projections times princomps give the standardised genotypes again."""
    found = ordination.do_pca_with_vars(variants(spark, d), transform_to_biallelic=True)
    scores = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in found["projections"].to_numpy()])
    z = F.transform(scores, lambda row: F.aggregate(F.zip_with(row, "loadings", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
    long = found["princomps"].select("var_id", F.posexplode(z).alias("sample_idx", "z"))
    return long.withColumn("z", F.round("z", 6) + F.lit(0.0))


def _vcf_lines(held: VariantFrame) -> DataFrame:
    """Records with two orders of the sample fields, phased and unphased, and haploid calls of the first sample."""
    even = F.col("var_id") % 2 == 0
    called = F.transform("gts", lambda a: F.when(a < 0, ".").otherwise(a.cast("string")))
    pair = lambda k: F.concat(F.get(called, F.lit(2 * k)), F.when(even, "/").otherwise("|"), F.get(called, F.lit(2 * k + 1)))
    calls = [F.when((F.col("var_id") % 4 == 1) & F.lit(k == 0), F.get(called, F.lit(0))).otherwise(pair(k)) for k in range(NUM_SAMPLES)]
    fields = [F.when(even, F.concat(c, F.lit(":7"))).otherwise(F.concat(F.lit("7:"), c)) for c in calls]
    names = [F.concat(F.lit("v"), F.col("var_id")), F.lit("A"), F.lit("C,GT")]
    quality = F.when(F.col("var_id") % 5 == 0, ".").otherwise((F.col("var_id") % 50).cast("string"))
    return held.df.select(F.concat_ws("\t", "chrom", F.col("pos").cast("string"), *names, quality, F.lit("PASS"), F.lit("."), F.when(even, "GT:DP").otherwise("DP:GT"), *fields).alias("value"))


def _vcf_columns(held: VariantFrame) -> DataFrame:
    return held.df.select(
        "var_id", "chrom", "pos", "id", "qual", F.array_join("alleles", ",").alias("alleles"), F.array_join(F.transform("gts", lambda a: a.cast("string")), ",").alias("gts")
    )


def _vcf_header(spark: SparkSession) -> DataFrame:
    header = "##fileformat=VCFv4.5\n" + "\t".join([*vcf.COLUMNS, *SAMPLES])
    return spark.createDataFrame([(header,)], "value string").coalesce(1)


def _vcf_text(spark: SparkSession, d: str) -> DataFrame:
    """Header and records by var_id, as in a sorted VCF: the table's files are read in no order of their own."""
    held = variants(spark, d)
    return _vcf_header(spark).unionAll(_vcf_lines(held.with_df(held.df.orderBy("var_id"))))


def vcf_scan(spark, d):
    """The variants written as VCF parts and read back; var_id is the record's place."""
    path = scratch_path(spark, "variants-vcf")
    _vcf_text(spark, d).write.text(path)
    return _vcf_columns(vcf.vars_from_vcf(spark, path))


def vcf_bgzip_scan(spark, d):
    """The same from files of bgzip blocks, read in small splits by the data source."""
    path = scratch_path(spark, "variants-bgzip")
    vcf_format.write_bgzip(_vcf_text(spark, d), path, block_bytes=4_096)
    return _vcf_columns(vcf.vars_from_vcf(spark, path, split_bytes=8_192))


def _stored_columns(held: VariantFrame) -> DataFrame:
    return held.df.select("var_id", "chrom", "pos", F.array_join(F.transform("gts", lambda a: a.cast("string")), ",").alias("gts"))


def native_round_trip(spark, d):
    path = scratch_path(spark, "variants-native")
    native.write_vars(variants(spark, d), path)
    return _stored_columns(native.load_vars(spark, path))


def native_region(spark, d):
    """A region by the zone map: files that don't reach into it are not opened."""
    path = scratch_path(spark, "variants-native")
    native.write_vars(variants(spark, d), path, num_parts=16)
    return _stored_columns(native.load_vars(spark, path, REGION))


def native_zones(spark, d):
    """What the zone map says: every variant is counted in one file, and files are stretches that don't overlap."""
    path = scratch_path(spark, "variants-native")
    native.write_vars(variants(spark, d), path, num_parts=16)
    zones = native.read_zones(spark, path)
    following = Window.orderBy("start_chrom", "start_pos")  # a row a file
    apart = F.lead(F.struct("start_chrom", "start_pos")).over(following) < F.struct("end_chrom", "end_pos")
    return zones.withColumn("overlap", apart).agg(
        F.sum("n").alias("n"), F.min("start_chrom").alias("first_chrom"), F.max("end_chrom").alias("last_chrom"), F.count_if("overlap").alias("n_overlaps")
    )


def array_folder_round_trip(spark, d):
    """Written as chunks of arrays and read back."""
    path = scratch_path(spark, "variants-arrays")
    array_folder.write_array_folder(variants(spark, d), path, chunk_size=150)
    return _stored_columns(native.load_vars(spark, path))


def kosman_embedding(spark, d):
    return dists.calc_pairwise_kosman_dists(variants(spark, d), use_approx_embedding_algorithm=True).df


def map_reduce_missing(spark, d):
    """A user's own map and reduce: missing alleles by chromosome."""

    def count(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chrom": batch["chrom"], "missing": [int((g == -1).sum()) for g in batch["gts"]]})

    made = Pipeline([count], "chrom string, missing long", lambda df: df.groupBy("chrom").agg(F.sum("missing").alias("missing")))
    return made.map_and_reduce(variants(spark, d))


def fold_missing(spark, d):
    """A user's own fold: a dict of missing and called alleles by chromosome, from batches."""

    def count(batch: pd.DataFrame) -> dict:
        found: dict[str, list[int]] = {}
        for chrom, gts in zip(batch["chrom"], batch["gts"], strict=True):
            held = found.setdefault(chrom, [0, 0])
            held[0], held[1] = held[0] + int((gts == -1).sum()), held[1] + int((gts != -1).sum())
        return found

    def add(one: dict, two: dict) -> dict:
        return {k: [a + b for a, b in zip(one.get(k, (0, 0)), two.get(k, (0, 0)), strict=True)] for k in {**one, **two}}

    made = Pipeline([count], reduce_funct=add, reduce_initializer={}).map_and_reduce(variants(spark, d))
    return spark.createDataFrame([(k, m, c) for k, (m, c) in made.items()], "chrom string, missing long, called long")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        genotype_scan, genotype_long_filter_chrom, gt_missing_het, allele_counts_per_var, allele_freqs_per_pop, obs_het_per_var, obs_het_mean,
        obs_het_hist, major_allele_freq_per_pop, maf_mean, maf_hist, exp_het_per_var, unbiased_exp_het_per_var, exp_het_mean, exp_het_hist,
        poly_ratio_per_pop, per_sample_stats, filter_missing, filter_maf, filter_obs_het, filter_samples, filter_chain, filtering_stats, filtering_stats_of_the_run,
        limit_first_chunks, gt_012, gt_012_pca, ld_pairwise, ld_max_dist, ld_matrix, ld_matrix_rows, ld_per_pop_min_dist, ld_per_pop_sampled, ld_filter,
        kosman_dists, kosman_min_snps, kosman_rect, kosman_tiles, kosman_embedding_of_seeds, jost_dest_per_var, jost_dest, obs_het_log_hist, ld_sample_sizes, euclidean_dists, dist_square_form, dist_triangle, pca_gram,
        pcoa_centered_matrix, pca_projections, pcoa_projections, pca_products, pcoa_products, pca_table_products, pca_princomps, vcf_scan, vcf_bgzip_scan,
        native_round_trip, native_region, native_zones, array_folder_round_trip, kosman_embedding, map_reduce_missing, fold_missing,
    )
}
