"""Tables written to the shared folder, to cut lineage so that a lost executor costs one stage at most.

The folder is the session's ``spark.checkpoint.dir``. Only a local session that has none gets one of its own. What a
run leaves there is deleted when the driver's process ends.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one is made only for a local session without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="netloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Store:
    """Writes intermediate frames as Parquet tables in the shared folder and reads them back."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/netloom-{uuid.uuid4().hex}"
        self.count = 0

    def _end(self) -> None:
        """Delete what is left; a session that has stopped meanwhile cannot."""
        with contextlib.suppress(Exception):
            self.clear()

    def folder(self) -> str:
        """The name of a new folder, deleted with the tables."""
        if not self.count:
            atexit.register(self._end)
        self.count += 1
        return f"{self.root}/{self.count}"

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` once; what is returned scans the written table."""
        path = self.folder()
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.netloom_path = path
        return out

    def free(self, *frames: DataFrame) -> None:
        """Delete tables that :meth:`put` returned and that nothing reads any more."""
        for df in frames:
            self._delete(df.netloom_path)

    def clear(self) -> None:
        """Delete all tables of this store, once nothing reads any of them."""
        self._delete(self.root)
        self.count = 0
        atexit.unregister(self._end)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
