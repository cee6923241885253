"""What a session needs: the package on executors that do not have it, and the folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the executors' Python path through Spark, once for an application. Where the workers find
    it anyway (the folder is on PYTHONPATH, or is the working folder), nothing is sent."""
    paths = {str(Path(p).resolve()) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    app = spark.sparkContext.applicationId
    if str(ROOT) in paths or app in _shipped:
        return
    target = Path(tempfile.mkdtemp()) / "pointloom.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "pointloom").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
        if (top := ROOT / "corpus_pipeline.py").exists():
            z.write(top, top.name)
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the cluster's spark.checkpoint.dir and read from there. Where that is unset, a temporary folder
    serves if this is the only machine; else it is an error."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="pointloom-"))
    return df.checkpoint(eager=True)
