"""Session helpers: the session itself and the shared folder for cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import weakref

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[int, tuple] = {}  # frames of `materialize` and where their tables are


def get_spark(app: str = "penumbra", **conf: str) -> SparkSession:
    """A session with adaptive execution on; `conf` uses double underscores for dots."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir` of the session.

    Only a local session may go without it; it then gets a folder of its own that is removed at exit.
    """
    conf = spark.sparkContext.getConf()
    d = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN[app] = tempfile.mkdtemp(prefix="penumbra-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return f"file://{_OWN[app]}"


def materialize(df: DataFrame, name: str = "t", partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage of `df`: write it as a Parquet table in the shared folder and read it back.

    Unlike an RDD checkpoint the table is columnar and compressed, and later reads prune columns. It survives
    the loss of executors. Loops remove what they no longer need by `forget`; the rest of the folder is cleared by whoever owns the
    cluster's checkpoint folder, or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/penumbra-{name}-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[id(out)] = (weakref.ref(out, lambda _, i=id(out): _WRITTEN.pop(i, None)), path)
    return out


def cached(df: DataFrame, owner: object) -> DataFrame:
    """`df` cached on the executors for as long as its owner lives; what is read from it later is computed anew."""
    df.persist(StorageLevel.MEMORY_AND_DISK)
    weakref.finalize(owner, _release, df).atexit = False
    return df


def _release(df: DataFrame) -> None:
    try:
        df.unpersist()
    except Exception:  # noqa: BLE001  the session may be gone
        pass


def forget(df: DataFrame) -> None:
    """Removes the table behind a frame that `materialize` gave, once nothing reads it any more; other frames are left alone."""
    ref, path = _WRITTEN.pop(id(df), (None, ""))
    if ref is None or ref() is not df:
        return
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
