"""Listing and marker files through the cluster's Hadoop file system.

Paths may be local, HDFS or object-store URIs; the JVM's ``FileSystem`` for
the path is used so the same code works on all of them.  Only directory
metadata goes through here, never rows.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs, p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_path(spark, path)
    return bool(fs.exists(p))


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-directories of ``path`` (empty if it is missing)."""
    fs, p = _fs_path(spark, path)
    if not fs.exists(p):
        return []
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory())


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    if fs.exists(p):
        fs.delete(p, True)


def mkdirs(spark: SparkSession, path: str) -> None:
    fs, p = _fs_path(spark, path)
    fs.mkdirs(p)


def list_files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in ``path`` (empty if it is missing)."""
    fs, p = _fs_path(spark, path)
    return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isFile()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    fs, p = _fs_path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """A rename that fails on an existing target, or replaces it in one step (files only)."""
    sc = spark.sparkContext
    hadoop = sc._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(hadoop.Path(source).toUri(), sc._jsc.hadoopConfiguration())
    how = sc._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE if overwrite else hadoop.Options.Rename.NONE
    context.rename(hadoop.Path(source), hadoop.Path(target), how)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file that appears whole, by a rename that replaces an older one."""
    fs, temporary = _fs_path(spark, f"{path}.new")
    out = fs.create(temporary, True)
    out.write(text.encode("utf-8"))
    out.close()
    rename(spark, f"{path}.new", path, overwrite=True)


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the data files under ``path``, by their directory's name: one listing."""
    fs, p = _fs_path(spark, path)
    out: dict[str, int] = {}
    files = fs.listFiles(p, True) if fs.exists(p) else None
    while files is not None and files.hasNext():
        f = files.next()
        if f.getPath().getName()[0] not in "._":
            name = f.getPath().getParent().getName()
            out[name] = out.get(name, 0) + f.getLen()
    return out


def modified(spark: SparkSession, path: str) -> float:
    """Seconds since the epoch."""
    fs, p = _fs_path(spark, path)
    return fs.getFileStatus(p).getModificationTime() / 1000
