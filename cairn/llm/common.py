"""Shared helpers: the shared folder, tokenisation rules, hashing, Arrow output."""

from __future__ import annotations

import atexit
import gc
import time
import uuid
import weakref

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[object, str]] = []
_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_names: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. A local session that has none gets a temporary one; on a cluster, where
    each executor would write to its own disk, that is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = got.get() if got.isDefined() else None
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        where = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: the lineage is cut, and a lost executor costs
    only the tasks that read it, not what made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cairn/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    _clean_shuffles(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def _clean_shuffles(spark: SparkSession) -> None:
    """Spark then drops shuffle files that nothing needs any more; the first time shows it what."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def bucketed(df: DataFrame, tag: str, column: str, buckets: int) -> DataFrame:
    """As materialise(), in buckets of a column, so that reading by it takes no shuffle. The catalogue holds the table until
    it is released."""
    spark, name = df.sparkSession, f"cairn_{tag}_{uuid.uuid4().hex}"
    path = new_table(spark, tag)
    df.write.option("compression", "zstd").option("path", path).bucketBy(buckets, column).format("parquet").saveAsTable(name)
    _clean_shuffles(spark)
    out = spark.table(name)
    _paths[out], _names[out] = path, name
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that materialise() or bucketed() gave and that nothing still to be run reads. Those
    released before are passed by."""
    for table in tables:
        path, spark = _paths.pop(table, None), table.sparkSession
        if path is not None:
            _delete(spark, path)
            _written.remove((spark, path))
            if table in _names:
                spark.sql(f"DROP TABLE IF EXISTS {_names.pop(table)}")


def new_table(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder, removed with the others when the process ends."""
    path = f"{shared_dir(spark)}/cairn/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_written() -> None:
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            return


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def frugal(df: DataFrame) -> DataFrame:
    """Arrow batches of 2,000 rows where the session has the default of 10,000: documents are large, and both the JVM and
    the Python worker hold a batch at once, more than once."""
    conf = df.sparkSession.conf
    if conf.get(ROWS, "10000") == "10000":
        conf.set(ROWS, "2000")
    return df


def unused(df: DataFrame, name: str) -> str:
    """A column name like name that df has not, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which the cluster sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between the six ASCII white space characters, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unsigned keys in order, and their stable order, by sorting them with their places packed into one number, which is
    much faster than argsort; the same on every machine."""
    n = len(keys)
    keys = keys.astype(np.uint64, copy=False)
    if n < 2:
        return keys, np.arange(n)
    low = np.uint64((n - 1).bit_length())
    exact = int(keys.max()).bit_length() + int(low) <= 64
    packed = keys << low if exact else keys >> low << low
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & ((np.uint64(1) << low) - np.uint64(1))).view(np.int64)
    if exact:
        packed >>= low
        return packed, order
    s = keys[order]
    if (s[1:] < s[:-1]).any():
        order = np.argsort(keys, kind="stable")
        s = keys[order]
    return s, order


def sorting(keys: np.ndarray) -> np.ndarray:
    """The stable order of unsigned keys."""
    return _sorted(keys)[1]


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct unsigned keys in order, the place of each key among them, and where each first stands."""
    s, order = _sorted(keys)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    of = np.empty(len(s), np.int64)
    of[order] = np.cumsum(new) - 1
    return s[new], of, order[new]


class WordHash(dict):
    """word -> 64-bit hash, remembered up to a limit."""

    def __init__(self, limit: int = 120_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def shingles(h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles of a text given by its words' hashes, sorted; of a shorter text the
    whole sequence is the only one; of none, none."""
    if not len(h):
        return h
    if len(h) < n:
        acc = np.uint64(len(h))
        with np.errstate(over="ignore"):
            for x in h:
                acc = mix64(np.array([acc * np.uint64(0x9E3779B97F4A7C15) + x], np.uint64))[0]
        return np.array([acc], np.uint64)
    m = len(h) - n + 1
    acc = np.full(m, n, np.uint64)
    for k in range(n):
        acc = mix64(acc * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m])
    return np.unique(acc)


def batch(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def text_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (long) and the text, so the scan reads no more."""
    return frugal(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
