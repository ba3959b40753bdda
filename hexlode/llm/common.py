"""What the operators of this package share: table access, shared folders, word hashing."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

#: Hashes of words kept by one Python worker at most, before its cache starts anew.
WORD_CACHE = 150_000
#: Odd multiplier of the rolling hash of neighbouring words.
ROLL = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one where it is unset and all run on this machine."""
    sc = spark.sparkContext
    if (configured := spark.conf.get("spark.checkpoint.dir", None)) is None:
        configured = sc._jsc.sc().getCheckpointDir()
        configured = configured.get() if configured.isDefined() else None
    if configured is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="hexlode-checkpoint-")
        sc.setCheckpointDir(configured)
    elif not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(configured)
    return configured


def _on_files(spark: SparkSession, folder: str, what: str, *rest) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    getattr(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), what)(path, *rest)


def remove(spark: SparkSession, folder: str) -> None:
    _on_files(spark, folder, "delete", True)


def fresh_dir(spark: SparkSession, kind: str) -> str:
    """A new folder's name in the shared one; the folder goes when the driver ends, if nothing removes it before."""
    folder = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    _on_files(spark, folder, "deleteOnExit")
    return folder


_local = threading.local()


def _scopes() -> list[list[str]]:
    """Folders of this thread's open scopes, the innermost last."""
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What cut() writes within goes at the end; keep() saves a result from that."""
    _scopes().append([])
    try:
        yield
    finally:
        for folder in _scopes().pop():
            remove(spark, folder)


def _written(df: DataFrame, depth: int) -> DataFrame:
    folder = fresh_dir(df.sparkSession, "cut")
    if len(_scopes()) >= depth:
        _scopes()[-depth].append(folder)
    df.write.parquet(folder)
    out = df.sparkSession.read.schema(df.schema).parquet(folder)
    out.__dict__["_folder"] = folder
    return out


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, lost executors cost nothing afterwards, and it is computed once (checkpoint() computes twice)."""
    return _written(df, 1)


def keep(df: DataFrame) -> DataFrame:
    """cut() for a scope's result, which goes with the scope around it."""
    return _written(df, 2)


def discard(*written: DataFrame) -> None:
    """Removes the files of tables from cut() or keep() that aren't read any more."""
    for df in written:
        remove(df.sparkSession, df.__dict__["_folder"])


class WordHasher:
    """64-bit hashes of words, with a bounded cache."""

    def __init__(self) -> None:
        self.cache: dict[bytes, int] = {}

    def __call__(self, words: Iterable[bytes]) -> np.ndarray:
        cache, out = self.cache, []
        if len(cache) > WORD_CACHE:
            cache.clear()
        get, digest = cache.get, xxhash.xxh3_64_intdigest
        for w in words:
            h = get(w)
            if h is None:
                h = cache[w] = digest(w)
            out.append(h)
        return np.array(out, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a rolling hash depend on all words."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolled(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k neighbouring words; none if there are fewer words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = h[:n].copy()
    for i in range(1, k):
        out = out * ROLL + h[i : i + n]
    return mixed(out)
