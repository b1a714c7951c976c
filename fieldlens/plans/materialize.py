"""Lineage cuts: the flagged table is computed once and kept as Parquet.

``run_checks`` is a long chain of projections.  Filters placed on its derived
columns would be pushed back through every projection by substituting the
definitions, which multiplies the expression size.  Writing the flagged table
once (a map-only job) and reading it back gives every monitoring query a plain
columnar scan: column pruning and flag predicates reach the Parquet reader.

The table lives in the shared folder named by ``spark.checkpoint.dir``; a
machine-local folder is made only when the session names none (tests).
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager
from pathlib import Path
from typing import Callable, Mapping

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_PKG_ROOT = Path(__file__).resolve().parents[1]
#: Packages whose sources have no part in a flagged table.
_APART = ("llm",)


def code_version() -> str:
    """Hash of the package sources, so a table built by older rules is never reused."""
    h = hashlib.sha1()
    for path in sorted(_PKG_ROOT.rglob("*.py")):
        name = path.relative_to(_PKG_ROOT)
        if name.parts[0] not in _APART:
            h.update(name.as_posix().encode())
            h.update(path.read_bytes())
    return h.hexdigest()[:12]


def _fs(spark: SparkSession, path: str):
    hpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def input_fingerprint(spark: SparkSession, paths: list[str]) -> str:
    """Path, length and modification time of every input file, listed by the store itself
    (local, HDFS, object store), so a changed input never finds an older table."""
    found = []
    for p in paths:
        fs, hpath = _fs(spark, p)
        files = fs.listFiles(hpath, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("\n".join(sorted(found)).encode()).hexdigest()[:12]


def exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs(spark, path)
    return fs.exists(hpath)


# The rule projections are ~300 expressions wide.  Fused into one whole-stage
# method they exceed the JVM's 64 KB limit and Spark falls back after a failed
# compile; per-operator codegen splits them into methods instead.  Applied only
# while the flagged table is written; narrow monitoring plans keep fusion.
RULE_JOB_CONF = {"spark.sql.codegen.maxFields": "30"}


@contextmanager
def session_conf(spark: SparkSession, conf: Mapping[str, str]):
    """Set session options for the jobs run inside the block, then restore them."""
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def _pointed(spark: SparkSession, path: str) -> str | None:
    """Version that the pointer file of a table names."""
    fs, pointer = _fs(spark, f"{path}/CURRENT")
    if not fs.exists(pointer):
        return None
    stream = fs.open(pointer)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Publish a version: one small file is replaced, no data is moved."""
    fs, pointer = _fs(spark, f"{path}/CURRENT")
    stream = fs.create(pointer, True)
    try:
        stream.write(bytearray(version.encode()))
    finally:
        stream.close()


def drop_versions(spark: SparkSession, name: str, keep_current: bool = True) -> list[str]:
    """Delete the versions of a table that its pointer doesn't name (readers of them must be done)."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens/{name}"
    current = _pointed(spark, path) if keep_current else None
    fs, hpath = _fs(spark, path)
    gone = []
    for f in (fs.listStatus(hpath) if fs.exists(hpath) else []):
        version = f.getPath().getName()
        if version.startswith("v-") and version != current:
            fs.delete(f.getPath(), True)
            gone.append(version)
    return gone


def materialize(spark: SparkSession, build: Callable[[], DataFrame], name: str,
                conf: Mapping[str, str] = RULE_JOB_CONF, rebuild: bool = False) -> DataFrame:
    """Write ``build()`` as Parquet under the checkpoint folder once; return a scan of it.

    ``build`` is only called when the table has no finished version (or ``rebuild``), and the
    write is a job of its own.  A version is written to a folder of its own and then named in
    a small pointer file: readers of the version before keep their files, a write that
    failed is never read, and of two builders the later one is pointed at.  ``drop_versions``
    clears what is left behind.
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens/{name}"
    version = None if rebuild else _pointed(spark, path)
    if version is None or not exists(spark, f"{path}/{version}/_SUCCESS"):
        version = f"v-{uuid.uuid4().hex}"
        with session_conf(spark, conf):
            build().write.parquet(f"{path}/{version}")
        _point(spark, path, version)
    key = (spark.sparkContext.applicationId, f"{path}/{version}")
    if key not in _READ:
        _READ[key] = spark.read.parquet(f"{path}/{version}")  # file listing and footer schema read once per application
        _READ[key]._fieldlens_path = f"{path}/{version}"
    return _READ[key]


_READ: dict[tuple[str, str], DataFrame] = {}


def written(df: DataFrame, label: str, **measures: str) -> DataFrame:
    """``df`` written once into a new folder of the shared checkpoint folder, and read back: a
    step of an operator that later steps must all see alike, whatever executor is lost.

    ``measures`` are aggregates (SQL) taken while it is written; ``seen(step)`` returns them."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/fieldlens-steps/{label}-{uuid.uuid4().hex}"
    watch = Observation() if measures else None
    (df.observe(watch, *[F.expr(m).alias(k) for k, m in measures.items()]) if watch else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._fieldlens_path, out._fieldlens_seen = path, watch.get if watch else {}
    return out


def seen(step: DataFrame) -> dict:
    """What was measured while the step was written."""
    return step._fieldlens_seen


def discard(step: DataFrame) -> None:
    """Delete the folder of a ``written`` step that no plan needs any more."""
    spark = step.sparkSession
    fs, hpath = _fs(spark, step._fieldlens_path)
    fs.delete(hpath, True)
