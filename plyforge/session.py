"""Session construction and the shared folder where lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SHARED: dict[str, str] = {}
_SHIPPED: dict[str, str] = {}
_COMPLETE = b"\n#complete"


def build_session(app: str = "plyforge", cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings this engine expects; on a cluster use the cluster's own session."""
    return ship(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("PLYFORGE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SHARED:
        _LOCAL_SHARED[app] = tempfile.mkdtemp(prefix="plyforge-shared-")
    return _LOCAL_SHARED[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so its lineage ends in files that outlive executors.

    The files of ``replaces``, an earlier cut that nothing reads any more, are removed once the new ones are written.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    if replaces is not None:
        release(replaces)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._plyforge_path = path
    return out


def release(df: DataFrame) -> None:
    """Remove the files of a cut that nothing reads any more."""
    path = getattr(df, "_plyforge_path", None)
    if path is not None:
        remove(df.sparkSession, path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: for costly Python functions on few large files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def remove(spark: SparkSession, path: str) -> None:
    hpath, fs, _ = _hadoop(spark, path)
    fs.delete(hpath, True)


def exists(spark: SparkSession, path: str) -> bool:
    hpath, fs, _ = _hadoop(spark, path)
    return fs.exists(hpath)


def _versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """The versions of a control file, newest first."""
    hpath, fs, _ = _hadoop(spark, path)
    if not fs.exists(hpath.getParent()):
        return []
    start = hpath.getName() + ".v"
    names = [f.getPath().getName() for f in fs.listStatus(hpath.getParent())]
    return sorted(((int(n[len(start) :]), f"{path[: len(path) - len(hpath.getName())]}{n}") for n in names if n.startswith(start) and n[len(start) :].isdigit()), reverse=True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Put a new version of a small control file beside the old ones.

    A version counts once its last line says so, whatever the file system: nothing is renamed or replaced, so after
    a crash at any point the newest complete version is in force. Of the older ones the last is kept.
    """
    old = _versions(spark, path)
    hpath, fs, _ = _hadoop(spark, f"{path}.v{(old[0][0] if old else 0) + 1:08d}")
    out = fs.create(hpath, False)
    out.write(bytearray(text.encode("utf-8") + _COMPLETE))
    out.close()
    for _, name in old[1:]:
        remove(spark, name)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The newest complete version; null where there is none."""
    for _, name in _versions(spark, path):
        hpath, fs, jvm = _hadoop(spark, name)
        stream = fs.open(hpath)
        try:
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()
        if data.endswith(_COMPLETE):
            return data[: -len(_COMPLETE)].decode("utf-8")
    return None


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so Python functions find it wherever they run."""
    import zipfile
    from pathlib import Path

    context = spark.sparkContext
    if _SHIPPED.get("app") != context.applicationId:
        root = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="plyforge-ship-")) / f"plyforge-{context.applicationId}.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, str(Path(root.name) / p.relative_to(root)))
        context.addPyFile(str(target))
        _SHIPPED["app"] = context.applicationId
    return spark
