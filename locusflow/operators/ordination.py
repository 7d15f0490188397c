"""Principal components and coordinates. Spark makes the small square matrix; numpy decomposes it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..frame import VariantFrame
from ..functions import genotypes as G
from ..shipping import ship_package
from .dists import Distances, calc_pairwise_kosman_dists


def create_012_gt_matrix(variants: VariantFrame, transform_to_biallelic: bool = False) -> DataFrame:
    """var_id and coded: alleles other than the variant's major one, missing alleles among them."""
    counts = G.allele_counts(F.col("gts"))
    if not variants.df.where(F.size(counts) == 0).isEmpty():
        raise ValueError("there are variants without any called allele")
    alleles = variants.df.select(F.explode(F.transform(counts, lambda c: c["allele"])).alias("allele")).distinct()
    if not transform_to_biallelic and len(alleles.limit(3).collect()) > 2:
        raise ValueError("there are more than two alleles; ask for transform_to_biallelic")
    coded = G.coded_012(F.col("gts"), variants.num_samples, variants.ploidy, G.major_allele(counts), keep_missing=False)
    return variants.df.select("var_id", coded.alias("coded"))


def _names(k: int) -> list[str]:
    width = len(str(max(0, k - 1)))
    return [f"PC{i:0{width}d}" for i in range(k)]


def _signed(vectors: np.ndarray) -> np.ndarray:
    """Columns turned so that the entry of largest size is positive."""
    top = vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])]
    return vectors * np.where(top < 0, -1.0, 1.0)


def _result(values: np.ndarray, projections: np.ndarray, components: np.ndarray | None, rows: Sequence, columns: Sequence | None) -> dict:
    names = _names(len(values))
    out = {
        "projections": pd.DataFrame(projections, index=list(rows), columns=names),
        "explained_variance": pd.Series(values, index=names),
        "explained_variance (%)": pd.Series(100 * values / values.sum(), index=names),
    }
    if components is not None:
        out["princomps"] = pd.DataFrame(components.T, index=names, columns=None if columns is None else list(columns))
    return out


def do_pca(data: pd.DataFrame, center_data: bool = True, standarize_data: bool = True) -> dict:
    """Components of a small table, rows as items, by singular values."""
    values = data.to_numpy(dtype=float)
    if np.isnan(values).any():
        raise ValueError("missing values are not allowed")
    if standarize_data and not center_data:
        raise ValueError("data must be centred to be standardised")
    if center_data:
        values = values - values.mean(axis=0)
    if standarize_data:
        spread = values.std(axis=0)
        if (spread == 0).any():
            raise ValueError("a column has no variance")
        values = values / spread
    _, s, vt = np.linalg.svd(values, full_matrices=False)
    v = _signed(vt.T)
    return _result(s**2 / (len(values) - 1), values @ v, v, data.index, data.columns)


def gram_matrix(coded: DataFrame, num_samples: int) -> DataFrame:
    """i, j (i <= j), g: products of samples over standardised variants; one row a pair and task is sent."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((num_samples, num_samples))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, num_samples).astype(float)
            spread = x.std(axis=1, keepdims=True)
            if (spread == 0).any():
                raise ValueError("there are variants without variance; filter them out first")
            z = (x - x.mean(axis=1, keepdims=True)) / spread
            total += z.T @ z
        i, j = np.triu_indices(num_samples)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "g"])

    ship_package(coded.sparkSession)
    return coded.select("coded").mapInArrow(partial, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def do_pca_with_vars(variants: VariantFrame, transform_to_biallelic: bool = False) -> dict:
    """Components of samples over standardised 012 genotypes; projections only need the Gram matrix.

    princomps, as long as the variants are many, stays a DataFrame: var_id and its loadings.
    """
    n = variants.num_samples
    coded = create_012_gt_matrix(variants, transform_to_biallelic)
    cells = gram_matrix(coded, n).toPandas()  # samples x samples
    gram = np.zeros((n, n))
    gram[cells["i"], cells["j"]] = cells["g"]
    gram = gram + np.triu(gram, 1).T
    values, vectors = np.linalg.eigh(gram)
    k = min(n, max(1, coded.limit(n).count()))
    values, vectors = np.clip(values[::-1][:k], 0, None), _signed(vectors[:, ::-1][:, :k])
    found = _result(values / (n - 1), vectors * np.sqrt(values), None, variants.samples, None)
    return {**found, "princomps": _loadings(coded, found["projections"], n)}


def _loadings(coded: DataFrame, projections: pd.DataFrame, n: int) -> DataFrame:
    scores = projections.to_numpy()
    unit = scores / np.maximum((scores**2).sum(axis=0), 1e-300)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, n).astype(float)
            z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((z @ unit).tolist(), pa.list_(pa.float64()))], ["var_id", "loadings"])

    ship_package(coded.sparkSession)
    return coded.select(F.col("var_id").cast("long").alias("var_id"), "coded").mapInArrow(load, "var_id long, loadings array<double>")


def principal_axes(variants: VariantFrame, projections: pd.DataFrame, transform_to_biallelic: bool = False) -> DataFrame:
    """var_id and loadings on each component, computed where the variants are."""
    return _loadings(create_012_gt_matrix(variants, transform_to_biallelic), projections, variants.num_samples)


def centered_matrix(dists: Distances) -> DataFrame:
    """i, j, f: -d**2/2 less the means of its row and column, plus the mean of all."""
    cells = dists.square_form().withColumn("e", -F.col("dist") * F.col("dist") / 2)
    by_row = cells.groupBy("i").agg(F.avg("e").alias("row_mean"))
    by_column = cells.groupBy("j").agg(F.avg("e").alias("column_mean"))
    whole = F.avg("row_mean").over(Window.partitionBy())
    by_row = by_row.withColumn("mean", whole)  # one row an item
    centred = cells.join(by_row, "i").join(by_column, "j")
    return centred.select("i", "j", (F.col("e") - F.col("row_mean") - F.col("column_mean") + F.col("mean")).alias("f"))


def do_pcoa(dists: Distances) -> dict:
    """Principal coordinates; axes of negative eigenvalues come last and are kept."""
    n = len(dists.names)
    cells = centered_matrix(dists).toPandas()  # items x items
    if cells["f"].isna().any() or len(cells) < n * n:
        raise ValueError("missing distances are not allowed")
    matrix = np.zeros((n, n))
    matrix[cells["i"], cells["j"]] = cells["f"]
    values, vectors = np.linalg.eigh((matrix + matrix.T) / 2)
    values, vectors = values[::-1], _signed(vectors[:, ::-1])
    return _result(values, vectors * np.sqrt(np.abs(values)), None, dists.names, None)


def do_pcoa_with_vars(variants: VariantFrame, min_num_snps: int | None = None, use_approx_embedding_algorithm: bool = False) -> dict:
    return do_pcoa(calc_pairwise_kosman_dists(variants, min_num_snps, use_approx_embedding_algorithm))


def pca_frame(spark: SparkSession, result: dict, label: str = "sample") -> DataFrame:
    """Projections as rows (label, component, value)."""
    long = result["projections"].rename_axis(label).reset_index().melt(id_vars=label, var_name="component", value_name="value")
    long[label] = long[label].astype(str)
    return spark.createDataFrame(long)
