"""Session-level helpers: the shared working folder, lineage cuts and partition counts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    Only where the setting is absent (a local session, as in tests) a temporary folder is
    made; on a cluster the setting must be present and is the only place used.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not at:
        if current.isDefined():
            return current.get()
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        at = tempfile.mkdtemp(prefix="quillspan-")
    if not current.isDefined():
        context.setCheckpointDir(at)
    return at


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: its files live in the shared folder, so a lost executor
    loses nothing.  Keeps the number, order and content of partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def work_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder for a table an operator writes."""
    at = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(at)
    return at


def cleanup(spark: SparkSession) -> None:
    """Delete the working tables of this session; frames that read them cannot be run any more."""
    for at in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        _delete(spark, at)


def discard(spark: SparkSession, ending: str) -> None:
    """Delete the working table whose path ends so, ahead of the others."""
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    for at in [w for w in written if w.endswith(ending)]:
        _delete(spark, at)
        written.remove(at)


def _delete(spark: SparkSession, at: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(at)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle width, which the operator of the cluster sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, wherever the driver found it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    at = Path(tempfile.mkdtemp(prefix="quillspan-code-")) / "quillspan.zip"
    with zipfile.ZipFile(at, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(str(at))
    _SHIPPED.add(context.applicationId)
