"""Tables that cut lineage: Parquet in the folder that spark.checkpoint.dir names.

``Dataset.checkpoint`` computes its input once to count it and once more to write it;
a written table costs one pass, and every executor can read it again after a loss.
"""

from __future__ import annotations

import atexit
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_fallback: str | None = None
_live: dict[str, SparkSession] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set and all tasks run in this process (tests)."""
    global _fallback
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    if _fallback is None:
        _fallback = tempfile.mkdtemp(prefix="quern-")
        atexit.register(shutil.rmtree, _fallback, True)
    return f"file://{_fallback}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that reads it back."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _live[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder, deleted when the application ends."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _live[path] = spark
    return path


def exists(saved: DataFrame) -> bool:
    """Whether the files of a table made by :func:`save` are still there."""
    spark = saved.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(saved._quern_path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def drop(*saved: DataFrame) -> None:
    """Delete tables made by :func:`save` that no later plan reads."""
    for df in saved:
        _delete(df._quern_path)


def _delete(path: str) -> None:
    spark = _live.pop(path, None)
    if spark is None:
        return
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _drop_all() -> None:
    for path in list(_live):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session may be gone at exit
            _live.clear()


#: Bytes of rows that a Python worker is given at once.
BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> None:
    """Bound the batches of Python workers, and let them import this package."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(name, str(batch_bytes))
    _ship(spark)


def _ship(spark: SparkSession) -> None:
    """Send the package along where PYTHONPATH or the working folder does not have it."""
    top = Path(__file__).resolve().parent
    roots = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    if any(r and Path(r).resolve() == top.parent for r in roots) or getattr(spark.sparkContext, "_quern_shipped", False):
        return
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent).as_posix())
    path = Path(tempfile.mkdtemp(prefix="quern-zip-")) / "quern_package.zip"
    path.write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(str(path))
    spark.sparkContext._quern_shipped = True
