"""Written intermediate tables: lineage is cut in the folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset, one made once per application, on a single machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-signalframe-")
    return _OWN[app]


def written(df: DataFrame, tag: str, compression: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder. A lost executor costs a reread, never a recompute."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def measured(df: DataFrame, tag: str, **sums: Column) -> tuple[DataFrame, dict]:
    """``written``, and aggregates of the rows by name, taken as they were written, without another pass."""
    seen = Observation(f"{tag}-{uuid.uuid4().hex}")
    table = written(df.observe(seen, *[c.alias(k) for k, c in sums.items()]), tag)
    got = seen.get
    return table, {k: got.get(k) or 0 for k in sums}  # nothing is told of a plan found to be empty


def released(table: DataFrame) -> None:
    """Deletes a table of ``written`` that no later step reads, such as that of a past round."""
    files, where = _files(table.sparkSession, table.scratch_path)
    files.delete(where, True)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    where = hadoop.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def claimed(spark: SparkSession, path: str, text: str) -> bool:
    """Creates the small file ``path``, whole or not at all; False if it is there already, so one of many writers wins.

    The text is written aside and then put in its place: by a hard link on a local disk, else by a rename that does not
    replace, both of which the file system does in one step.
    """
    files, where = _files(spark, path)
    aside = files.makeQualified(where.getParent().suffix(f"/.{uuid.uuid4().hex}"))
    files.mkdirs(where.getParent())
    out = files.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    local = files.makeQualified(where).toUri().getScheme() == "file"
    try:
        if local:
            os.link(aside.toUri().getPath(), files.makeQualified(where).toUri().getPath())
            return True
        none = spark._sc._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, files.makeQualified(where), none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in str(e.java_exception):
            raise
        return False
    finally:
        files.delete(aside, False)


def claims(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files that ``claimed`` made in a folder, sorted; none if there is no folder."""
    files, where = _files(spark, folder)
    return sorted(n for n in (x.getPath().getName() for x in files.listStatus(where)) if not n.startswith(".")) if files.exists(where) else []


def claim(spark: SparkSession, path: str) -> str:
    """The text of a claimed file."""
    files, where = _files(spark, path)
    stream = files.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
