"""Population genetics on Spark DataFrames."""

from .config import VAR_TABLE_CHROM_COL, VAR_TABLE_POS_COL
from .frame import VariantFrame
from .operators.dists import calc_jost_dest_pop_dists, calc_pairwise_kosman_dists
from .operators.filters import filter_by_ld_and_maf, filter_by_maf, filter_by_missing_data, gather_filtering_stats
from .operators.ld import get_ld_and_dist_for_pops
from .operators.ordination import do_pca, do_pca_with_vars, do_pcoa
from .operators.stats import (
    calc_exp_het_stats_per_var,
    calc_major_allele_stats_per_var,
    calc_obs_het_stats_per_var,
    calc_per_sample_stats,
    calc_poly_vars_ratio_per_var,
)
from .sources.native import load_vars, write_vars
from .sources.vcf import vars_from_vcf

__all__ = [
    "VAR_TABLE_CHROM_COL", "VAR_TABLE_POS_COL", "VariantFrame", "calc_exp_het_stats_per_var", "calc_jost_dest_pop_dists",
    "calc_major_allele_stats_per_var", "calc_obs_het_stats_per_var", "calc_pairwise_kosman_dists", "calc_per_sample_stats",
    "calc_poly_vars_ratio_per_var", "do_pca", "do_pca_with_vars", "do_pcoa", "filter_by_ld_and_maf", "filter_by_maf",
    "filter_by_missing_data", "gather_filtering_stats", "get_ld_and_dist_for_pops", "load_vars", "vars_from_vcf", "write_vars",
]
