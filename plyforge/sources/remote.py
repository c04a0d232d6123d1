"""Shards, extracts and control files kept at a second place: any file system Hadoop knows (``s3a``, ``hdfs``, ``file``).

The build writes to paths of any such file system itself; these copies are for a build that works on fast storage and
publishes to another. Copies go to a name beside the target and are renamed, so a reader never sees half a file.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from plyforge import session


class MissingCredentialsError(RuntimeError):
    """A place that needs credentials which the session's Hadoop settings do not have."""


def exists(spark: SparkSession, path: str) -> bool:
    return session.exists(spark, path)


def ensure(spark: SparkSession, folder: str) -> None:
    """Make the folder unless it is there."""
    hpath, fs, _ = session._hadoop(spark, folder)
    fs.mkdirs(hpath)


def copy(spark: SparkSession, source: str, target: str) -> bool:
    """Copy a file or folder over ``target``; False where there is no source."""
    if not exists(spark, source):
        return False
    src, src_fs, jvm = session._hadoop(spark, source)
    part, fs, _ = session._hadoop(spark, f"{target}.part")
    hpath, _, _ = session._hadoop(spark, target)
    fs.delete(part, True)
    jvm.org.apache.hadoop.fs.FileUtil.copy(src_fs, src, fs, part, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hpath.getParent())
    fs.delete(hpath, True)
    if not fs.rename(part, hpath):
        raise OSError(f"cannot rename {target}.part")
    return True


def shard_folders(spark: SparkSession, dataset: str) -> list[str]:
    """The shard folders of a dataset (src_dump=.../shard=...), relative and in order."""
    hpath, fs, jvm = session._hadoop(spark, f"{dataset}/src_dump=*/shard=*")
    found = fs.globStatus(hpath) or []
    return sorted("/".join(str(f.getPath()).split("/")[-2:]) for f in found)


def push_shard(spark: SparkSession, dataset: str, shard: str, place: str) -> None:
    """Publish one shard folder."""
    if not copy(spark, f"{dataset}/{shard}", f"{place}/{shard}"):
        raise FileNotFoundError(f"{dataset}/{shard}")


def sync(spark: SparkSession, dataset: str, place: str) -> list[str]:
    """Fetch the published shards that are missing here; gives their names."""
    missing = sorted(set(shard_folders(spark, place)) - set(shard_folders(spark, dataset)))
    for shard in missing:
        copy(spark, f"{place}/{shard}", f"{dataset}/{shard}")
    return missing


def fetch_text(spark: SparkSession, local: str, place: str) -> str | None:
    """A control file: the version here, else the published one, else none."""
    text = session.read_text(spark, local)
    return text if text is not None else session.read_text(spark, place)


def ensure_extract(spark: SparkSession, local: str, place: str, build) -> str:
    """The extract here; else a copy of the published one; else ``build()`` writes it here and it is published. Says which."""
    if exists(spark, f"{local}/_SUCCESS"):
        return "local"
    if exists(spark, f"{place}/_SUCCESS"):
        copy(spark, place, local)
        return "remote"
    build()
    copy(spark, local, place)
    return "built"
