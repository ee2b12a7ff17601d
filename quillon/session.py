"""Session defaults for the engine."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow; ANSI mode stays on, so errors are errors."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # checkpoints go when nothing refers to them any more
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors of a session whose workers cannot import it by themselves; once per application."""
    import os
    import tempfile
    import zipfile
    from pathlib import Path

    here = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    known = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if app in _shipped or str(here.parent) in known:
        return
    path = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
        for f in here.parent.glob("corpus_pipeline.py"):
            z.write(f, f.name)
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)
