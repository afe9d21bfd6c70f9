"""Session helpers.

On a cluster the session is built by spark-submit; ``configure`` fills in
settings that the application leaves unset, so the cluster's values (e.g. the
shared ``spark.checkpoint.dir``) hold.  The time zone alone is always UTC: days
and months of the reports are UTC days and months.
"""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job in this library relies on.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    sc = _context(spark)
    given = dict(sc.getConf().getAll()) if sc is not None else {}
    for key, value in REQUIRED_CONF.items():
        if spark.conf.get(key, None) != value and (key not in given or key == "spark.sql.session.timeZone"):
            spark.conf.set(key, value)
    if _is_local(spark):
        ship_package(spark)
    return spark


def _context(spark: SparkSession):
    """The SparkContext, or None on a Spark Connect session (no context there)."""
    try:
        return spark.sparkContext
    except Exception:  # noqa: BLE001 - Connect sessions expose no SparkContext
        return None


def _is_local(spark: SparkSession) -> bool:
    sc = _context(spark)
    return sc is not None and sc.master.startswith("local")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers (the similarity
    UDF and the grouped-map block pass are pickled by module reference).

    Local runs zip the package once per application and add it with
    ``addPyFile``; cluster jobs ship it with ``--py-files`` instead."""
    sc = _context(spark)
    if sc is None or sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="ledgerlake-pkg-")
    archive = os.path.join(folder, "ledgerlake.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "ledgerlake") -> SparkSession:
    """A local session for tests and the bench (UI off, no ports beyond Spark's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.ansi.enabled", "true")
    )
    for key, value in REQUIRED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def python_workers_ready(spark: SparkSession) -> None:
    """Call before planning Python UDF work: ships the package in local mode."""
    if _is_local(spark):
        ship_package(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, creating a scratch one only when unset.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is; a machine-local folder is only chosen for local runs and tests.
    """
    sc = _context(spark)
    current = spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if sc is not None and sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    existing = sc.getCheckpointDir() if sc is not None else None
    if existing:
        return existing
    if not _is_local(spark):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder for cluster runs")
    path = tempfile.mkdtemp(prefix="ledgerlake-ckpt-")
    spark.conf.set("spark.checkpoint.dir", path)
    sc.setCheckpointDir(path)
    return path
