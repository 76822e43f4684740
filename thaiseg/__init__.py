"""Dictionary-based Thai word segmentation and text analytics on Spark."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

_shipped: set[str] = set()

#: Texts are large, so Arrow batches of them hold fewer rows than Spark's default.
ROWS_PER_BATCH = 2000


def ship(spark) -> None:
    """Give executors this package, so that they need no installed copy, and bound
    Arrow batches unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    top = pathlib.Path(__file__).resolve().parent
    path = pathlib.Path(tempfile.mkdtemp(prefix="thaiseg-")) / "thaiseg-package.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(application)
