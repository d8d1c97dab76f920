"""Python workers find this package: in local mode at the driver's path, on a cluster in an archive that goes to all executors by way of the shared folder.
And what they get at a time is bounded by bytes, unless the session says otherwise: ten thousand rows, Spark's own bound, are as large as their texts."""

from __future__ import annotations

import io
import os
import uuid
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_shipped: set[str] = set()
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20


def let_workers_import(spark: SparkSession | None = None) -> None:
    """To be called before a function of this package is handed to Spark; does its work once per session."""
    session = spark or SparkSession.getActiveSession()
    if session is None:
        return
    context = session.sparkContext
    if _BATCH not in session.conf.getAll:
        session.conf.set(_BATCH, str(BATCH_BYTES))
    if context.master == "local" or context.master.startswith("local["):
        paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
        if _ROOT not in paths:
            context.environment["PYTHONPATH"] = os.pathsep.join([_ROOT, *filter(None, paths)])
    elif context.applicationId not in _shipped:
        shared = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
        if not shared:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        package = os.path.join(_ROOT, __name__.partition(".")[0])
        room = io.BytesIO()
        with zipfile.ZipFile(room, "w", zipfile.ZIP_DEFLATED) as archive:
            for folder, _, files in os.walk(package):
                for file in sorted(x for x in files if x.endswith(".py")):
                    archive.write(os.path.join(folder, file), os.path.relpath(os.path.join(folder, file), _ROOT))
        path = session._jvm.org.apache.hadoop.fs.Path(f"{shared.rstrip('/')}/package-{uuid.uuid4().hex}.zip")
        files = path.getFileSystem(session._jsc.hadoopConfiguration())
        out = files.create(path)
        out.write(bytearray(room.getvalue()))
        out.close()
        files.deleteOnExit(path)
        context.addPyFile(path.toString())
        _shipped.add(context.applicationId)
