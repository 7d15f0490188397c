"""Operator 10: URL rules in a sorted digest array.

A list of rules or blocked sites becomes an array of sorted 64-bit XXH64 keys and, beside it, the
full strings in the same order. A list of sites is a table: Spark sorts it by digest and stores the
parts, executors fetch them, and tasks map the array into memory instead of loading it. A URL is asked for under each suffix of its host and each
path length that occurs in the list; a vectorised binary search finds equal keys and the stored
string confirms them, so a collision of keys can't change a verdict.

A rule fits its host and all subdomains where the URL's path starts with the rule's path. The
longest rule (host and path together, then the longer host) wins. A URL that no rule fits is
blocked if the list of blocked sites holds its host or a parent of it, else allowed.

Null and malformed URLs (no "://") have empty host and path, fit no rule, and are allowed. Hosts
keep a port and user part, if any. Repeated rows get equal results; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, scratch_path, ship_package

#: Fixed values of the query's contract: (action, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Site names that a crawl of this kind blocks when no rule speaks of them.
BLOCKED_SITES = (
    "ads-track.example.com", "ads-track.example.net", "ads-track.example.org",
    "casino-win.example.com", "casino-win.example.net", "casino-win.example.org",
    "cheap-pills.example.com", "cheap-pills.example.net", "cheap-pills.example.org",
    "free-bets.example.com", "free-bets.example.net", "free-bets.example.org",
    "spam-farm.example.com", "spam-farm.example.net", "spam-farm.example.org",
)
#: Seed of the digest keys, that of Spark's own XXH64.
SEED = 42
#: Entries in a part of a stored array.
PART = 2_000_000


@dataclass(frozen=True)
class DigestFiles:
    """A stored array's name and its parts in the order of their keys, as the executors know them."""

    name: str
    parts: tuple[str, ...]


class DigestArray:
    """Sorted keys with their strings, mapped into memory."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, strings: np.ndarray) -> None:
        self._keys, self._ends, self._strings = keys, ends, strings

    @staticmethod
    def build(strings: Sequence[str]) -> DigestArray:
        rows = sorted((key_of(s.encode()), s.encode()) for s in set(strings))
        ends = np.cumsum([len(s) for _, s in rows], dtype=np.int64) if rows else np.zeros(0, np.int64)
        return DigestArray(np.array([k for k, _ in rows], dtype=np.uint64), ends, np.frombuffer(b"".join(s for _, s in rows), dtype=np.uint8))

    @staticmethod
    def open(files: DigestFiles) -> DigestArray:
        """Map the array into memory; the first task of an executor puts the parts together on its own disk."""
        folder = os.path.join(tempfile.gettempdir(), files.name)
        names = ("keys", "ends", "strings")
        if not os.path.isdir(folder):
            own = tempfile.mkdtemp(prefix=files.name)
            at = 0
            with open(f"{own}/keys", "wb") as keys, open(f"{own}/ends", "wb") as ends, open(f"{own}/strings", "wb") as strings:
                for part in files.parts:
                    for batch in pq.ParquetFile(SparkFiles.get(part)).iter_batches(columns=["key", "entry"]):
                        keys.write(batch.column("key").to_numpy().view(np.uint64).tobytes())
                        held = [e.encode() for e in batch.column("entry").to_pylist()]
                        last = at + np.cumsum([len(e) for e in held], dtype=np.int64)
                        ends.write(last.tobytes())
                        strings.write(b"".join(held))
                        at = int(last[-1]) if held else at
            try:
                os.rename(own, folder)
            except OSError:  # another task was first
                folder = folder if os.path.isdir(folder) else own
        kinds = (np.uint64, np.int64, np.uint8)
        full = [f"{folder}/{n}" for n in names]
        return DigestArray(*(np.memmap(f, k, "r") if os.path.getsize(f) else np.zeros(0, k) for f, k in zip(full, kinds, strict=True)))

    def contains(self, probes: Sequence[bytes]) -> np.ndarray:
        """Which of the probes are in the array, strings compared."""
        found = np.zeros(len(probes), dtype=bool)
        if not len(self._keys) or not len(probes):
            return found
        wanted = np.array([key_of(p) for p in probes], dtype=np.uint64)
        at = np.searchsorted(self._keys, wanted)
        open_ = np.flatnonzero((at < len(self._keys)) & (self._keys[np.minimum(at, len(self._keys) - 1)] == wanted))
        for k in open_:
            i = int(at[k])
            while i < len(self._keys) and self._keys[i] == wanted[k]:  # equal keys stand side by side
                begin = int(self._ends[i - 1]) if i else 0
                if self._strings[begin : int(self._ends[i])].tobytes() == probes[k]:
                    found[k] = True
                    break
                i += 1
        return found


def key_of(value: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(value, SEED)


def ship_array(entries: DataFrame, name: str) -> DigestFiles:
    """Sort a table of strings (its only column) by digest with Spark, store it and hand the parts to every executor.

    Keys are ranged unsigned: the top bit is turned for Spark's signed order. The parts are fetched
    by the executors from the folder for scratch tables; the driver sees their names alone.
    """
    spark = entries.sparkSession
    entry = F.col(entries.columns[0]).cast("string")
    keyed = entries.select(entry.alias("entry")).where("entry is not null").distinct().withColumn("key", F.xxhash64("entry"))
    keyed = keyed.withColumn("place", F.col("key").bitwiseXOR(F.lit(-(2**63))))
    parts = max(1, -(-keyed.count() // PART))
    path = scratch_path(spark, f"digest-{name}")
    keyed.repartitionByRange(parts, "place").sortWithinPartitions("place", "entry").select("key", "entry").write.parquet(path)
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    files = sorted(f.getPath().toString() for f in found if f.getPath().getName().startswith("part-"))
    for file in files:
        spark.sparkContext.addFile(file)
    return DigestFiles(os.path.basename(path), tuple(os.path.basename(f) for f in files))


def host_and_path(url):
    """Columns host and path of a URL column, by the contract above."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def host_suffixes(host: str) -> list[str]:
    """The host and its parents, the longest first."""
    out = [host] if host else []
    at = host.find(".")
    while at >= 0:
        if at + 1 < len(host):
            out.append(host[at + 1 :])
        at = host.find(".", at + 1)
    return out


def filter_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    blocked: DataFrame | Sequence[str] = BLOCKED_SITES,
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict for every row of pages.

    blocked: site names, as a table of one column or, if few, a sequence. rules are few.
    """
    spark = pages.sparkSession
    ship_package(spark)
    actions = {host + path: action for action, host, path in rules}
    sites = blocked if isinstance(blocked, DataFrame) else spark.createDataFrame([(s,) for s in blocked], "site string")
    site_files = ship_array(sites, "sites")
    path_lengths = sorted({len(path) for _, _, path in rules}, reverse=True)
    longest = sites.agg(F.max(F.size(F.split(F.col(sites.columns[0]).cast("string"), r"\."))).alias("n")).first().n or 1
    labels = max([longest, *(host.count(".") + 1 for _, host, _ in rules)])

    host, path = host_and_path(F.col(url_column).cast("string"))
    wanted = pages.select(F.col(id_column).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule_array, site_array = DigestArray.build(list(actions)), DigestArray.open(site_files)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            suffixes = {h: host_suffixes(h)[-labels:] for h in set(hosts)}
            probes: dict[tuple[str, str], bool] = {}
            for h, p in zip(hosts, paths, strict=True):
                for s in suffixes[h]:
                    for n in path_lengths:
                        if n <= len(p):
                            probes[s, p[:n]] = False
            asked = list(probes)
            for key, hit in zip(asked, rule_array.contains([(s + p).encode() for s, p in asked]), strict=True):
                probes[key] = bool(hit)
            names = sorted({s for v in suffixes.values() for s in v})
            bad = dict(zip(names, site_array.contains([s.encode() for s in names]).tolist(), strict=True))
            found, verdicts = [], []
            for h, p in zip(hosts, paths, strict=True):
                fits = [(len(s) + n, len(s), s + p[:n]) for s in suffixes[h] for n in path_lengths if n <= len(p) and probes[s, p[:n]]]
                rule = max(fits)[2] if fits else None
                found.append(rule)
                verdicts.append(actions[rule] if rule else "block" if any(bad[s] for s in suffixes[h]) else "allow")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.string()), pa.array(verdicts, pa.string())], ["page_id", "host", "path", "rule", "verdict"]
            )

    return wanted.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
