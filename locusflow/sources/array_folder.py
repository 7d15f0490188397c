"""Folders of array chunks: gzipped .npy files of alleles and of a mask, and a Parquet file of info for each chunk.

The layout is that of folders which the single-machine tools of this field leave behind:

    var_dir_metadata.json    version, samples, ploidy, and a list of chunks in order
    chunk_0000/gts.npy.gz        variants x samples x ploidy integers
    chunk_0000/gt_mask.npy.gz    the same shape, true where missing
    chunk_0000/vars_info.parquet a row for each variant (may be absent)

Reading: Spark lists and reads the files (binaryFile, so any store will do), the three of a chunk
meet in one row of compressed bytes, and a task unpacks the rows of its chunks. var_id is the place
in the order of chunks, from the sizes in the arrays' own headers. Writing: a task a chunk.
"""

from __future__ import annotations

import gzip
import io
import json
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import MISSING_ALLELE, VARS_PER_CHUNK
from ..frame import VariantFrame
from ..shipping import ship_package
from .vcf_format import open_store

# Fixed names of the layout.
METADATA, VERSION, GTS, MASK, INFO = "var_dir_metadata.json", "1.0", "gts.npy.gz", "gt_mask.npy.gz", "vars_info.parquet"
#: Variants of an Arrow batch, at most.
BATCH_VALUES = 1_000_000
#: Columns of pandas' own making.
OWN_COLUMNS = "__"


def is_array_folder(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{METADATA}")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _array(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(gzip.decompress(content)), allow_pickle=False)


def _rows_of(content: bytes) -> int:
    """The first dimension in an array's header, from the first bytes alone."""
    head = io.BytesIO(zlib.decompressobj(31).decompress(content, 4_096))
    version = np.lib.format.read_magic(head)
    shape, _, _ = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(head)
    return shape[0]


def _chunk_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """dir, name and content of the files of all chunks."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select(F.element_at(F.split("path", "/"), -2).alias("dir"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _info_schema(spark: SparkSession, path: str) -> T.StructType:
    """Columns of the info files, whole numbers as longs."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/*/{INFO}")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop):
        return T.StructType()
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.DecimalType)
    kept = [f for f in spark.read.parquet(f"{path}/*/{INFO}").schema.fields if not f.name.startswith(OWN_COLUMNS)]
    return T.StructType([T.StructField(f.name, T.LongType() if isinstance(f.dataType, whole) else f.dataType) for f in kept])


def load_array_folder(spark: SparkSession, path: str) -> VariantFrame:
    """Variants of a folder of array chunks; samples without names are numbered."""
    ship_package(spark)
    metadata = json.loads(spark.read.option("wholetext", "true").text(f"{path}/{METADATA}").first().value)
    if metadata["var_dir_format_version"] != VERSION:
        raise ValueError(f"unknown version {metadata['var_dir_format_version']}")
    ploidy = int(metadata["ploidy"])
    samples = metadata.get("samples") or list(range(int(metadata["num_samples"])))
    dirs = [c["dir"] for c in metadata["var_chunks_metadata"]]
    info = _info_schema(spark, path)
    schema = T.StructType([T.StructField("var_id", T.LongType()), *info.fields, T.StructField("gts", T.ArrayType(T.IntegerType()))])
    arrow = to_arrow_schema(schema)
    names, width = info.names, len(samples) * ploidy

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("dir"), pa.array([_rows_of(c) for c in batch.column("content").to_pylist()], pa.int64())], ["dir", "n"])

    sizes = {r.dir: r.n for r in _chunk_files(spark, path, GTS).select("dir", "content").mapInArrow(count, "dir string, n long").collect()}  # a row a chunk, as in the metadata
    absent = [d for d in dirs if d not in sizes]
    if absent:
        raise ValueError(f"chunks without genotypes: {absent[:5]}")
    before = list(accumulate((sizes[d] for d in dirs), initial=0))
    order = spark.createDataFrame([(d, b) for d, b in zip(dirs, before, strict=False)], "dir string, before long")
    held = _chunk_files(spark, path, f"{{{GTS},{MASK},{INFO}}}").join(order, "dir")
    chunks = held.groupBy("dir", "before").agg(F.map_from_entries(F.collect_list(F.struct("name", "content"))).alias("files"))  # three files
    chunks = chunks.select("before", *[F.col("files")[n].alias(c) for n, c in ((GTS, "gts"), (MASK, "mask"), (INFO, "info"))])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                start, gts, mask, table = (batch.column(c)[at].as_py() for c in ("before", "gts", "mask", "info"))
                values = _array(gts)
                if mask is not None:
                    values = np.where(_array(mask), MISSING_ALLELE, values)
                values = np.ascontiguousarray(values.reshape(len(values), -1), np.int32)
                rows = pq.read_table(io.BytesIO(table)) if table is not None else None
                step = max(1, BATCH_VALUES // max(1, width))
                for k in range(0, len(values), step):
                    own = values[k : k + step]
                    columns = [pa.array(np.arange(start + k, start + k + len(own)))]
                    for name in names:
                        known = rows is not None and name in rows.column_names
                        part = rows.column(name).slice(k, len(own)).combine_chunks() if known else pa.nulls(len(own))
                        columns.append(part.cast(arrow.field(name).type))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel())))
                    yield pa.RecordBatch.from_arrays(columns, arrow.names)

    return VariantFrame(chunks.mapInArrow(unpack, schema), samples, ploidy)


def write_array_folder(variants: VariantFrame, path: str, chunk_size: int = VARS_PER_CHUNK, level: int = 4) -> None:
    """Write variants as array chunks in the order of var_id; alleles' names have no place in the layout.

    Each chunk is a group of its own and writes its files with pyarrow.fs; a second attempt writes
    the same bytes again. The metadata, a few values a chunk, is written last. The folder must not exist.
    """
    store, folder = open_store(path)
    if store.get_file_info(folder).type.name != "NotFound":
        raise FileExistsError(path)
    df, place, _ = variants.with_place()
    spark = df.sparkSession
    ship_package(spark)
    info = [c for c in variants.df.columns if c not in ("var_id", "gts", "alleles")]
    shape = (variants.num_samples, variants.ploidy)
    placed = {"chrom", "pos"} <= set(info)
    rows = df.select(place.alias("_place"), F.floor(place / chunk_size).cast("long").alias("_chunk"), "gts", *info)

    def write(group: pa.Table) -> pa.Table:
        group = group.sort_by("_place")
        number = group.column("_chunk")[0].as_py()
        name = f"chunk_{number:04d}"
        out = open_store(path)[0]
        out.create_dir(f"{folder}/{name}")
        values = group.column("gts").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(group.num_rows, *shape).astype(np.int32)
        mask = values == MISSING_ALLELE
        for file, array in ((GTS, values), (MASK, mask)):
            packed = io.BytesIO()
            np.save(packed, array)
            with out.open_output_stream(f"{folder}/{name}/{file}", compression=None) as stream:
                stream.write(gzip.compress(packed.getvalue(), level, mtime=0))
        if info:
            pq.write_table(group.select(info), f"{folder}/{name}/{INFO}", filesystem=out)
        ends = [[group.column(c)[k].as_py() if placed else None for c in ("chrom", "pos")] for k in (0, group.num_rows - 1)]
        return pa.table({"chunk": [number], "dir": [name], "start_chrom": [ends[0][0]], "start_pos": [ends[0][1]], "end_chrom": [ends[1][0]], "end_pos": [ends[1][1]]}, schema=MADE)

    written = rows.groupBy("_chunk").applyInArrow(write, "chunk long, dir string, start_chrom string, start_pos long, end_chrom string, end_pos long").orderBy("chunk").collect()
    chunks = [{"dir": r.dir, **({c: r[c] for c in ("start_chrom", "start_pos", "end_chrom", "end_pos")} if placed else {})} for r in written]
    metadata = {"var_dir_format_version": VERSION, "var_chunks_metadata": chunks, "num_samples": shape[0], "ploidy": shape[1], "samples": list(variants.samples)}
    store.create_dir(folder)
    with store.open_output_stream(f"{folder}/{METADATA}") as stream:
        stream.write(json.dumps(metadata).encode())


MADE = pa.schema([("chunk", pa.int64()), ("dir", pa.string()), ("start_chrom", pa.string()), ("start_pos", pa.int64()), ("end_chrom", pa.string()), ("end_pos", pa.int64())])
