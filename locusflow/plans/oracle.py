"""DuckDB SQL for the queries of this package."""

from __future__ import annotations

from ..operators.stats import histogram_edges

_GT = """gt AS (SELECT vec_id::BIGINT AS var_id, 'chr' || label AS chrom, (vec_id * 100 + 1)::BIGINT AS pos, i::INTEGER AS i,
 (i // 2)::INTEGER AS sample_idx, (i % 2)::INTEGER AS hap,
 (CASE WHEN v < -0.25e0 THEN -1 WHEN v < 0.05e0 THEN 0 WHEN v < 0.2e0 THEN 1 ELSE 2 END)::INTEGER AS allele
 FROM (SELECT vec_id, label, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
_GENO = """geno AS (SELECT var_id, chrom, pos, sample_idx, min(allele) AS lo, max(allele) AS hi, bool_or(allele = -1) AS is_missing,
 (min(allele) <> max(allele) AND NOT bool_or(allele = -1)) AS is_het FROM gt GROUP BY ALL)"""
_TWO = "pops AS (SELECT CASE WHEN s < 16 THEN 'p1' ELSE 'p2' END AS pop, s AS sample_idx FROM range(32) t(s))"
_THREE = "pops AS (SELECT 'q' || (s % 3) AS pop, s AS sample_idx FROM range(32) t(s))"
_OVER = "pops AS (SELECT 'o1' AS pop, s AS sample_idx FROM range(20) t(s) UNION ALL SELECT 'o2', s FROM range(12, 32) t(s))"
_CALLED = "called AS (SELECT var_id, pop, count(*) FILTER (allele >= 0) AS n_alleles, count(*) FILTER (allele < 0) AS missing_alleles FROM gt JOIN pops USING (sample_idx) GROUP BY ALL)"
_COUNTS = "counts AS (SELECT var_id, pop, allele, count(*) AS n FROM gt JOIN pops USING (sample_idx) WHERE allele >= 0 GROUP BY ALL)"
_OBS = """obs AS (SELECT var_id, pop, count(*) FILTER (NOT is_missing) AS n_called, count(*) FILTER (is_het) AS n_het,
 CAST(count(*) FILTER (is_het) AS DOUBLE) / nullif(CAST(count(*) FILTER (NOT is_missing) AS DOUBLE), 0) AS obs_het
 FROM geno JOIN pops USING (sample_idx) GROUP BY ALL)"""
_MAJOR = """major AS (SELECT var_id, pop, CASE WHEN n_alleles / 2e0 >= 5e0 THEN CAST(n AS DOUBLE) / nullif(CAST(n_alleles AS DOUBLE), 0) END AS major_freq
 FROM called LEFT JOIN (SELECT var_id, pop, max(n) AS n FROM counts GROUP BY ALL) m USING (var_id, pop))"""
_HET = """het AS (SELECT var_id, pop, n_alleles, CASE WHEN n_alleles / 2e0 >= 5e0 THEN raw END AS biased,
 CASE WHEN n_alleles / 2e0 >= 5e0 THEN n_alleles / nullif(n_alleles - 1e0, 0) * raw END AS unbiased FROM called LEFT JOIN
 (SELECT var_id, pop, 1e0 - sum(power(CAST(n AS DOUBLE) / n_alleles, 2e0)) AS raw FROM counts JOIN called USING (var_id, pop) GROUP BY ALL) h USING (var_id, pop))"""
_ALL_MAJOR = """allcount AS (SELECT var_id, allele, count(*) AS n FROM gt WHERE allele >= 0 GROUP BY ALL),
 majorallele AS (SELECT var_id, allele AS major, n, sum(n) OVER (PARTITION BY var_id) AS total FROM allcount
 QUALIFY row_number() OVER (PARTITION BY var_id ORDER BY n DESC, allele) = 1)"""
_VARS = "vars AS (SELECT vec_id::BIGINT AS var_id, 'chr' || label AS chrom, (vec_id * 100 + 1)::BIGINT AS pos FROM embeddings)"
_RATES = """rates AS (SELECT var_id, chrom, pos, count(*) FILTER (is_missing) / 32e0 AS miss,
 CAST(count(*) FILTER (is_het) AS DOUBLE) / nullif(count(*) FILTER (NOT is_missing), 0) AS het FROM geno GROUP BY ALL)"""
_CODED = """coded AS (SELECT g.var_id, g.chrom, g.pos, sample_idx, (CASE WHEN bool_or(g.allele = -1) THEN -1 ELSE count(*) FILTER (g.allele <> major) END)::INTEGER AS g012
 FROM gt g JOIN majorallele USING (var_id) GROUP BY ALL)"""
_MOMENTS = "moments AS (SELECT var_id, chrom, pos, list(g012 ORDER BY sample_idx) AS x, sum(g012)::DOUBLE AS s, sum(g012 * g012)::DOUBLE AS ss FROM coded GROUP BY ALL)"
_R = """round((32e0 * list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[]) - a.s * b.s)
 / nullif(sqrt((32e0 * a.ss - a.s * a.s) * (32e0 * b.ss - b.s * b.s)), 0), 6)"""


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def _hist(column: str, source: str, pops: list[str], num_bins: int, **kwargs) -> str:
    edges = histogram_edges(num_bins=num_bins, **kwargs)
    rows = ", ".join(f"({b}, CAST('{edges[b]!r}' AS DOUBLE), CAST('{edges[b + 1]!r}' AS DOUBLE))" for b in range(num_bins))
    names = ", ".join(f"('{p}')" for p in pops)
    return f"""SELECT p.pop, b.bin::INTEGER AS bin, count(s.{column})::BIGINT AS n FROM (VALUES {names}) p(pop) CROSS JOIN (VALUES {rows}) b(bin, lo, hi)
 LEFT JOIN {source} s ON s.pop = p.pop AND s.{column} >= b.lo AND (s.{column} < b.hi OR (b.bin = {num_bins - 1} AND s.{column} = b.hi)) GROUP BY ALL"""


_LD_PREFIX = _with(_GT, _ALL_MAJOR, _CODED, _MOMENTS)
_LD_COLUMNS = f"""a.var_id AS var_id1, a.chrom AS chrom1, a.pos AS pos1, b.var_id AS var_id2, b.chrom AS chrom2, b.pos AS pos2, {_R} AS r2,
 CASE WHEN a.chrom = b.chrom THEN abs(a.pos - b.pos) END AS dist_in_bp"""
_KOSMAN = """sums AS (SELECT a.sample_idx AS i, b.sample_idx AS j, count(*) AS n,
 sum(CASE WHEN a.lo = b.lo AND a.hi = b.hi THEN 0e0 WHEN a.lo IN (b.lo, b.hi) OR a.hi IN (b.lo, b.hi) THEN 0.5e0 ELSE 1e0 END) AS total
 FROM geno a JOIN geno b USING (var_id) WHERE NOT a.is_missing AND NOT b.is_missing AND {pairs} GROUP BY ALL)"""
_TRIANGLE = _KOSMAN.format(pairs="a.sample_idx < b.sample_idx")
_SQUARE = """tri AS (SELECT i, j, total / nullif(n, 0) AS dist FROM sums),
 square AS (SELECT i, j, dist FROM tri UNION ALL SELECT j, i, dist FROM tri UNION ALL SELECT s::INTEGER, s::INTEGER, 0e0 FROM range(32) t(s))"""
_POP_LD = """popmajor AS (SELECT var_id, pop, allele AS major, n, sum(n) OVER (PARTITION BY var_id, pop) AS total FROM counts
 QUALIFY row_number() OVER (PARTITION BY var_id, pop ORDER BY n DESC, allele) = 1),
 coded AS (SELECT g.var_id, g.chrom, g.pos, pop, sample_idx, (CASE WHEN bool_or(g.allele = -1) THEN -1 ELSE count(*) FILTER (g.allele <> major) END)::INTEGER AS g012
 FROM gt g JOIN pops USING (sample_idx) JOIN popmajor USING (var_id, pop) WHERE CAST(n AS DOUBLE) / total <= 0.8e0 GROUP BY ALL),
 moments AS (SELECT var_id, chrom, pos, pop, list(g012 ORDER BY sample_idx) AS x, sum(g012)::DOUBLE AS s, sum(g012 * g012)::DOUBLE AS ss FROM coded GROUP BY ALL)"""
_DEST = """side AS (SELECT o.var_id, o.pop, n_called, obs_het, n_alleles FROM obs o JOIN called USING (var_id, pop)),
 pairs AS (SELECT x.var_id, x.pop AS pop1, y.pop AS pop2, x.n_called AS nx, y.n_called AS ny, x.n_alleles AS ax, y.n_alleles AS ay,
 2e0 / (1e0 / nullif(x.n_called, 0) + 1e0 / nullif(y.n_called, 0)) AS h, coalesce((x.obs_het + y.obs_het) / 2, x.obs_het, y.obs_het) AS ho
 FROM side x JOIN side y ON x.var_id = y.var_id AND x.pop < y.pop),
 freq AS (SELECT p.var_id, p.pop1, p.pop2, a.allele, coalesce(c1.n, 0) / nullif(CAST(p.ax AS DOUBLE), 0) AS f1, coalesce(c2.n, 0) / nullif(CAST(p.ay AS DOUBLE), 0) AS f2
 FROM pairs p JOIN (SELECT DISTINCT var_id, allele FROM counts) a USING (var_id)
 LEFT JOIN counts c1 ON c1.var_id = p.var_id AND c1.pop = p.pop1 AND c1.allele = a.allele LEFT JOIN counts c2 ON c2.var_id = p.var_id AND c2.pop = p.pop2 AND c2.allele = a.allele),
 raw AS (SELECT var_id, pop1, pop2, ((1 - sum(f1 * f1)) + (1 - sum(f2 * f2))) / 2 AS rhs, 1 - sum(((f1 + f2) / 2) ** 2) AS rht FROM freq GROUP BY ALL),
 d1 AS (SELECT p.*, CASE WHEN ax / 2e0 >= 5 AND ay / 2e0 >= 5 AND nx >= 5 AND ny >= 5 THEN h / nullif(h - 1, 0) * (rhs - ho / (2 * h)) END AS hs, rht
 FROM pairs p JOIN raw USING (var_id, pop1, pop2)),
 dest AS (SELECT var_id, pop1, pop2, hs, CASE WHEN ax / 2e0 >= 5 AND ay / 2e0 >= 5 AND nx >= 5 AND ny >= 5 THEN rht + hs / (2 * h) - ho / (4 * h) END AS ht FROM d1)"""

_Z = _with(_GT, _ALL_MAJOR) + """, standing AS (SELECT g.var_id, sample_idx, count(*) FILTER (g.allele <> major) AS g FROM gt g JOIN majorallele USING (var_id) GROUP BY ALL),
 z AS (SELECT var_id, sample_idx, (g - avg(g) OVER w) / stddev_pop(g) OVER w AS z FROM standing WINDOW w AS (PARTITION BY var_id))
 """

_CHAIN = _with(_GT, _GENO, _ALL_MAJOR, _RATES) + """, step1 AS (SELECT * FROM rates WHERE miss <= 0.1e0),
 step2 AS (SELECT step1.* FROM step1 JOIN majorallele USING (var_id) WHERE CAST(n AS DOUBLE) / total <= 0.65e0), step3 AS (SELECT * FROM step2 WHERE het <= 0.5e0) """

ORACLE_SQL: dict[str, str] = {
    "genotype_scan": _with(_GT) + "SELECT var_id, chrom, pos, string_agg(allele::VARCHAR, ',' ORDER BY i) AS gts FROM gt GROUP BY ALL",
    "genotype_long_filter_chrom": _with(_GT) + "SELECT var_id, pos, sample_idx, hap, allele FROM gt WHERE chrom = 'chr3'",
    "gt_missing_het": _with(_GT, _GENO) + "SELECT var_id, sample_idx, is_missing, is_het FROM geno",
    "allele_counts_per_var": _with(_GT, _TWO, _COUNTS) + "SELECT var_id, pop, allele, n FROM counts",
    "allele_freqs_per_pop": _with(_GT, _THREE, _CALLED, _COUNTS) + """SELECT c.var_id, c.pop, a.allele, coalesce(k.n, 0)::BIGINT AS n,
 CASE WHEN n_alleles / 2e0 >= 5e0 THEN CAST(coalesce(k.n, 0) AS DOUBLE) / nullif(CAST(n_alleles AS DOUBLE), 0) END AS freq, missing_alleles
 FROM called c JOIN (SELECT DISTINCT var_id, allele FROM gt WHERE allele >= 0) a USING (var_id) LEFT JOIN counts k ON k.var_id = c.var_id AND k.pop = c.pop AND k.allele = a.allele""",
    "obs_het_per_var": _with(_GT, _GENO, _TWO, _OBS) + "SELECT var_id, pop, n_called, obs_het FROM obs",
    "obs_het_mean": _with(_GT, _GENO, _OVER, _OBS) + "SELECT pop, round(avg(obs_het), 6) AS mean FROM obs GROUP BY pop",
    "obs_het_hist": _with(_GT, _GENO, _OVER, _OBS) + _hist("obs_het", "obs", ["o1", "o2"], 40),
    "major_allele_freq_per_pop": _with(_GT, _THREE, _CALLED, _COUNTS, _MAJOR) + "SELECT var_id, pop, major_freq FROM major",
    "maf_mean": _with(_GT, _TWO, _CALLED, _COUNTS, _MAJOR) + "SELECT pop, round(avg(major_freq), 6) AS mean FROM major GROUP BY pop",
    "maf_hist": _with(_GT, _TWO, _CALLED, _COUNTS, _MAJOR) + _hist("major_freq", "major", ["p1", "p2"], 40),
    "exp_het_per_var": _with(_GT, _TWO, _CALLED, _COUNTS, _HET) + "SELECT var_id, pop, round(biased, 6) AS exp_het FROM het",
    "unbiased_exp_het_per_var": _with(_GT, _TWO, _CALLED, _COUNTS, _HET) + "SELECT var_id, pop, round(unbiased, 6) AS exp_het FROM het",
    "exp_het_mean": _with(_GT, _TWO, _CALLED, _COUNTS, _HET) + "SELECT pop, round(avg(unbiased), 6) AS mean FROM het GROUP BY pop",
    "exp_het_hist": _with(_GT, _TWO, _CALLED, _COUNTS, _HET, "rounded AS (SELECT pop, round(unbiased, 6) AS exp_het FROM het)") + _hist("exp_het", "rounded", ["p1", "p2"], 20),
    "poly_ratio_per_pop": _with(_GT, _THREE, _CALLED, _COUNTS, _MAJOR) + """SELECT pop, count(*) FILTER (major_freq < 0.7e0) AS num_poly, count(*) FILTER (major_freq < 1e0) AS num_variable,
 count(major_freq) AS tot_num_variants_with_data, CAST(count(*) FILTER (major_freq < 0.7e0) AS DOUBLE) / nullif(count(major_freq), 0) AS poly_ratio,
 CAST(count(*) FILTER (major_freq < 0.7e0) AS DOUBLE) / nullif(count(*) FILTER (major_freq < 1e0), 0) AS poly_ratio_over_variables FROM major GROUP BY pop""",
    "per_sample_stats": _with(_GT, _GENO) + """SELECT sample_idx, 's' || sample_idx AS sample, count(*) FILTER (is_missing) / CAST(count(*) AS DOUBLE) AS missing_gt_rate,
 count(*) FILTER (is_het) / CAST(count(*) AS DOUBLE) AS obs_het_rate FROM geno GROUP BY ALL""",
    "filter_missing": _with(_GT, _GENO, _RATES) + "SELECT var_id, chrom, pos FROM rates WHERE miss <= 0.05e0",
    "filter_maf": _with(_GT, _ALL_MAJOR, _VARS) + "SELECT var_id, chrom, pos FROM vars JOIN majorallele USING (var_id) WHERE CAST(n AS DOUBLE) / total <= 0.65e0",
    "filter_obs_het": _with(_GT, _GENO, _RATES) + "SELECT var_id, chrom, pos FROM rates WHERE het <= 0.4e0",
    "filter_samples": _with(_GT) + "SELECT var_id, string_agg(allele::VARCHAR, ',' ORDER BY i) AS gts FROM gt WHERE sample_idx IN (1, 3, 9) GROUP BY ALL",
    "filter_chain": _CHAIN + "SELECT var_id, chrom, pos FROM step3",
    "filtering_stats": _CHAIN + """SELECT 'missing_data' AS kind, (SELECT count(*) FROM rates) AS vars_processed, (SELECT count(*) FROM step1) AS vars_kept
 UNION ALL SELECT 'maf', (SELECT count(*) FROM step1), (SELECT count(*) FROM step2) UNION ALL SELECT 'obs_het', (SELECT count(*) FROM step2), (SELECT count(*) FROM step3)""",
    "filtering_stats_of_the_run": _CHAIN + """SELECT 'missing_data' AS kind, (SELECT count(*) FROM rates) AS vars_processed, (SELECT count(*) FROM step1) AS vars_kept
 UNION ALL SELECT 'maf', (SELECT count(*) FROM step1), (SELECT count(*) FROM step2) UNION ALL SELECT 'obs_het', (SELECT count(*) FROM step2), (SELECT count(*) FROM step3)""",
    "limit_first_chunks": _with(_VARS) + "SELECT var_id, chrom, pos FROM vars ORDER BY var_id LIMIT 200",
    "gt_012": _with(_GT, _ALL_MAJOR, _CODED) + "SELECT var_id, sample_idx, g012 FROM coded",
    "gt_012_pca": _with(_GT, _ALL_MAJOR) + "SELECT g.var_id, sample_idx, (count(*) FILTER (g.allele <> major))::INTEGER AS g012 FROM gt g JOIN majorallele USING (var_id) GROUP BY ALL",
    "ld_pairwise": _LD_PREFIX + f"SELECT {_LD_COLUMNS} FROM moments a JOIN moments b ON a.var_id < b.var_id",
    "ld_max_dist": _LD_PREFIX + f"SELECT {_LD_COLUMNS} FROM moments a JOIN moments b ON a.var_id < b.var_id AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 2000",
    "ld_matrix": _LD_PREFIX + f"""SELECT a.var_id AS var_id1, b.var_id AS var_id2, CASE WHEN a.var_id = b.var_id AND 32e0 * a.ss - a.s * a.s > 0 THEN 1e0 ELSE {_R} END AS r2,
 CASE WHEN a.chrom = b.chrom THEN abs(a.pos - b.pos) END AS dist_in_bp FROM moments a CROSS JOIN moments b""",
    "ld_matrix_rows": _LD_PREFIX + f"""SELECT a.var_id AS var_id1, b.var_id AS var_id2, CASE WHEN a.var_id = b.var_id AND 32e0 * a.ss - a.s * a.s > 0 THEN 1e0 ELSE {_R} END AS r2,
 CASE WHEN a.chrom = b.chrom THEN abs(a.pos - b.pos) END AS dist_in_bp FROM moments a CROSS JOIN moments b WHERE a.var_id IN (3, 30, 300)""",
    "ld_per_pop_min_dist": _with(_GT, _TWO, _COUNTS, _POP_LD) + f"""SELECT a.pop, a.var_id AS var_id1, b.var_id AS var_id2, {_R.replace('32e0', '16e0')} AS r2, abs(a.pos - b.pos) AS dist_in_bp
 FROM moments a JOIN moments b ON a.pop = b.pop AND a.var_id < b.var_id AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 2000 AND abs(a.pos - b.pos) > 500
 WHERE (16e0 * a.ss - a.s * a.s) * (16e0 * b.ss - b.s * b.s) > 0""",
    "ld_per_pop_sampled": _with(_GT, _TWO, _COUNTS, _POP_LD) + f"""SELECT pop, var_id1, var_id2, r2, dist_in_bp FROM (SELECT a.pop, a.var_id AS var_id1, b.var_id AS var_id2, {_R.replace('32e0', '16e0')} AS r2, abs(a.pos - b.pos) AS dist_in_bp
 FROM moments a JOIN moments b ON a.pop = b.pop AND a.var_id <> b.var_id AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 2000 AND abs(a.pos - b.pos) > 1
 WHERE (16e0 * a.ss - a.s * a.s) * (16e0 * b.ss - b.s * b.s) > 0) QUALIFY row_number() OVER (PARTITION BY pop ORDER BY md5(var_id1 || ':' || var_id2 || ':42'), var_id1, var_id2) <= 50""",
    "ld_filter": "WITH RECURSIVE " + ",\n".join([_GT, _ALL_MAJOR, _CODED, _MOMENTS]) + f""",
 kept AS MATERIALIZED (SELECT m.* FROM moments m JOIN majorallele USING (var_id) WHERE CAST(n AS DOUBLE) / total <= 0.95e0),
 nexts AS MATERIALIZED (SELECT a.var_id AS v, min(b.var_id) AS nxt FROM kept a JOIN kept b ON a.var_id < b.var_id WHERE
 abs((32e0 * list_dot_product(a.x::DOUBLE[], b.x::DOUBLE[]) - a.s * b.s) / nullif(sqrt((32e0 * a.ss - a.s * a.s) * (32e0 * b.ss - b.s * b.s)), 0)) < 0.1e0 GROUP BY a.var_id),
 chain AS (SELECT min(var_id) AS v FROM kept UNION ALL SELECT nxt FROM chain JOIN nexts USING (v))
 SELECT var_id, chrom, pos FROM kept WHERE var_id IN (SELECT v FROM chain)""",
    "kosman_dists": _with(_GT, _GENO, _TRIANGLE) + "SELECT i, j, total / nullif(n, 0) AS dist FROM sums",
    "kosman_min_snps": _with(_GT, _GENO, _TRIANGLE) + "SELECT i, j, CASE WHEN n >= 455 THEN total / nullif(n, 0) END AS dist FROM sums",
    "kosman_rect": _with(_GT, _GENO, _KOSMAN.format(pairs="a.sample_idx < 4 AND b.sample_idx >= 16")) + "SELECT i, j, total / nullif(n, 0) AS dist FROM sums",
    "kosman_tiles": _with(_GT, _GENO, _TRIANGLE) + "SELECT i, j, n, total / nullif(n, 0) AS dist FROM sums",
    "kosman_embedding_of_seeds": _with(_GT, _GENO, _TRIANGLE, _SQUARE) + """, known AS (SELECT i, j, coalesce(dist, -1e0) AS d, dist FROM square),
 far AS (SELECT DISTINCT j AS s FROM (SELECT * FROM known WHERE i IN (2, 11, 29) QUALIFY row_number() OVER (PARTITION BY i ORDER BY d DESC, j) = 1)),
 farther AS (SELECT DISTINCT j AS s FROM (SELECT known.* FROM known JOIN far ON i = s QUALIFY row_number() OVER (PARTITION BY i ORDER BY d DESC, j) = 1)),
 seeds AS (SELECT unnest([2, 11, 29]) AS s UNION SELECT s FROM far UNION SELECT s FROM farther),
 sides AS (SELECT j AS id, i AS s, dist FROM known JOIN seeds ON i = s)
 SELECT a.id AS i, b.id AS j, round(sqrt(sum((a.dist - b.dist) ** 2)), 6) AS dist FROM sides a JOIN sides b ON a.s = b.s AND a.id < b.id GROUP BY ALL""",
    "jost_dest_per_var": _with(_GT, _GENO, _THREE, _CALLED, _COUNTS, _OBS, _DEST) + "SELECT var_id, pop1, pop2, round(hs, 6) + 0e0 AS hs, round(ht, 6) + 0e0 AS ht, round(2 * (ht - hs) / nullif(1 - hs, 0), 6) + 0e0 AS dest FROM dest",
    "jost_dest": _with(_GT, _GENO, _THREE, _CALLED, _COUNTS, _OBS, _DEST) + """SELECT pop1, pop2, round(2 * (sum(ht) / count(hs) - sum(hs) / count(hs)) / nullif(1 - sum(hs) / count(hs), 0), 6) AS dest, count(hs) AS n_vars FROM dest GROUP BY ALL""",
    "euclidean_dists": """SELECT a.vec_id AS i, b.vec_id AS j, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dist
 FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id""",
    "dist_square_form": _with(_GT, _GENO, _TRIANGLE, _SQUARE) + "SELECT i, j, dist FROM square",
    "dist_triangle": _with(_GT, _GENO, _TRIANGLE, _SQUARE) + "SELECT i, round(sum(dist), 6) AS row_sum, count(*) AS n FROM square WHERE i >= j GROUP BY i",
    "pca_gram": _Z + "SELECT a.sample_idx AS i, b.sample_idx AS j, round(sum(a.z * b.z), 6) AS g FROM z a JOIN z b USING (var_id) WHERE a.sample_idx <= b.sample_idx GROUP BY ALL",
    "pca_products": _Z + "SELECT a.sample_idx AS i, b.sample_idx AS j, round(sum(a.z * b.z), 6) AS product FROM z a JOIN z b USING (var_id) WHERE a.sample_idx <= b.sample_idx GROUP BY ALL",
    "pca_princomps": _Z + "SELECT var_id, sample_idx, round(z, 6) + 0e0 AS z FROM z",
    "pca_table_products": _with(_GT, _GENO) + """, t AS (SELECT sample_idx, count(*) FILTER (is_missing) / CAST(count(*) AS DOUBLE) AS a, count(*) FILTER (is_het) / CAST(count(*) AS DOUBLE) AS b FROM geno GROUP BY ALL),
 z AS (SELECT sample_idx, (a - avg(a) OVER ()) / stddev_pop(a) OVER () AS a, (b - avg(b) OVER ()) / stddev_pop(b) OVER () AS b FROM t)
 SELECT x.sample_idx AS i, y.sample_idx AS j, round(x.a * y.a + x.b * y.b, 6) AS product FROM z x JOIN z y ON x.sample_idx <= y.sample_idx""",
    "pcoa_products": _with(_GT, _GENO, _TRIANGLE, _SQUARE) + """, e AS (SELECT i, j, -dist * dist / 2 AS e FROM square),
 f AS (SELECT i, j, e - avg(e) OVER (PARTITION BY i) - avg(e) OVER (PARTITION BY j) + avg(e) OVER () AS f FROM e) SELECT i, j, round(f, 6) AS product FROM f WHERE i <= j""",
    "obs_het_log_hist": _with(_GT, _GENO, _OVER, _OBS) + _hist("obs_het", "obs", ["o1", "o2"], 12, range=(-2.0, 0.0), bin_type="logarithmic"),
    "ld_sample_sizes": _with(_GT, _TWO, _COUNTS, _POP_LD.replace("0.8e0", "0.95e0")) + """SELECT a.pop, least(count(*), 20)::BIGINT AS n, 0::BIGINT AS n_far
 FROM moments a JOIN moments b ON a.pop = b.pop AND a.var_id < b.var_id AND a.chrom = b.chrom AND abs(a.pos - b.pos) <= 300
 WHERE (16e0 * a.ss - a.s * a.s) * (16e0 * b.ss - b.s * b.s) > 0 GROUP BY 1""",
    "vcf_scan": _with(_GT) + """SELECT var_id, chrom, pos, 'v' || var_id AS id, CASE WHEN var_id % 5 <> 0 THEN (var_id % 50)::DOUBLE END AS qual, 'A,C,GT' AS alleles,
 string_agg((CASE WHEN var_id % 4 = 1 AND i = 1 THEN -1 ELSE allele END)::VARCHAR, ',' ORDER BY i) AS gts FROM gt GROUP BY ALL""",
    "vcf_bgzip_scan": _with(_GT) + """SELECT var_id, chrom, pos, 'v' || var_id AS id, CASE WHEN var_id % 5 <> 0 THEN (var_id % 50)::DOUBLE END AS qual, 'A,C,GT' AS alleles,
 string_agg((CASE WHEN var_id % 4 = 1 AND i = 1 THEN -1 ELSE allele END)::VARCHAR, ',' ORDER BY i) AS gts FROM gt GROUP BY ALL""",
    "native_round_trip": _with(_GT) + "SELECT var_id, chrom, pos, string_agg(allele::VARCHAR, ',' ORDER BY i) AS gts FROM gt GROUP BY ALL",
    "array_folder_round_trip": _with(_GT) + "SELECT var_id, chrom, pos, string_agg(allele::VARCHAR, ',' ORDER BY i) AS gts FROM gt GROUP BY ALL",
    "native_region": _with(_GT) + "SELECT var_id, chrom, pos, string_agg(allele::VARCHAR, ',' ORDER BY i) AS gts FROM gt WHERE chrom = 'chr3' AND pos BETWEEN 5001 AND 30001 GROUP BY ALL",
    "native_zones": _with(_VARS) + "SELECT count(*) AS n, min(chrom) AS first_chrom, max(chrom) AS last_chrom, 0::BIGINT AS n_overlaps FROM vars",
    "pcoa_centered_matrix": _with(_GT, _GENO, _TRIANGLE, _SQUARE) + """, e AS (SELECT i, j, -dist * dist / 2 AS e FROM square)
 SELECT i, j, round(e - avg(e) OVER (PARTITION BY i) - avg(e) OVER (PARTITION BY j) + avg(e) OVER (), 6) AS f FROM e""",
    "map_reduce_missing": _with(_GT) + "SELECT chrom, count(*) FILTER (allele = -1) AS missing FROM gt GROUP BY chrom",
    "fold_missing": _with(_GT) + "SELECT chrom, count(*) FILTER (allele = -1) AS missing, count(*) FILTER (allele <> -1) AS called FROM gt GROUP BY chrom",
}
