"""What several corpus operators share: hashing of words in flat byte buffers,
batching of long texts, and tables written to the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_rng = np.random.default_rng(20240229)
_LUT = _rng.integers(1, 2**63, 256, dtype=np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0, 9, 10, 11, 12, 13, 32]] = True
#: Word bytes: ASCII letters and digits, and every byte of a longer character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_INV = U64(_inverse(int(_BASE)))
_POW = np.ones(1, np.uint64)
_IPOW = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    global _POW, _IPOW
    if len(_POW) < n:
        m = max(n, 1 << 16)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INV, np.uint64)
        up[0] = down[0] = 1
        _POW, _IPOW = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POW[:n], _IPOW[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every bit of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(buf: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of bytes for which inside holds."""
    flag = np.zeros(len(buf) + 2, np.int8)
    flag[1:-1] = inside[buf]
    edge = np.diff(flag)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end]; equal contents have equal hashes wherever they lie."""
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return range_hashes(_LUT[buf], starts, ends)


def chunks(texts: list[str | None], size: int = 1_500_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have together about so many characters; a longer text is alone."""
    at = total = 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if total and total + n > size:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(texts):
        yield at, len(texts)


def flat(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts as one byte string, parted by a zero byte, and where each begins; one more offset at the end."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=at[1:])
    return b"\0".join(parts) + b"\0", at


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its length."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    keep = lengths > 0
    s, n = starts[keep], lengths[keep]
    at = np.cumsum(n)[:-1]
    out[0] = s[0]
    out[at] = s[1:] - (s[:-1] + n[:-1]) + 1
    return np.cumsum(out)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares, as spark.checkpoint.dir names it.

    Where it is unset, a folder of our own if the session runs in one process; on a
    cluster that would be another folder on each machine, so there it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marginalia-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the application ends."""
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if own not in _own_dirs:
        _own_dirs.add(own)
        files, path = _filesystem(spark, own), spark._jvm.org.apache.hadoop.fs.Path(own)
        files.mkdirs(path)
        files.deleteOnExit(path)
    return own


_own_dirs: set[str] = set()


def _filesystem(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, what: str) -> DataFrame:
    """df, written to the shared folder and read again, so that lost executors cost nothing upstream."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._written_to = path
    return again


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() made and nothing reads any more."""
    for df in tables:
        path = df._written_to
        _filesystem(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
