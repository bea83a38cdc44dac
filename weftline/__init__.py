"""Web-page and text-corpus analytics on Spark."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path


#: Large arrays go back to the system when a Python worker frees them, so that idle workers hold little.
WORKER_ENV = {"MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def ship(spark) -> None:
    """Lets Python workers that see this folder import the package; where they don't, install it or pass it with --py-files."""
    env = spark.sparkContext.environment
    here = str(Path(__file__).resolve().parent.parent)
    known = env.get("PYTHONPATH", "")
    if here not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [known, here]))
    for name, value in WORKER_ENV.items():
        env.setdefault(name, value)


def shared_dir(spark) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; one is made and set only where that is unset."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = known.get() if known.isDefined() else None
    if not d:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="weftline-")
        spark.sparkContext.setCheckpointDir(d)
    return d.rstrip("/")


def scratch(spark, name: str) -> str:
    """A new path in the shared folder for an intermediate table; what is there goes when Python ends."""
    path = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM has gone; the cluster's own clean-up of the folder remains
        pass
