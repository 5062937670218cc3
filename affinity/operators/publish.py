"""Saved tables whose readers never meet a half-written one.

Every write goes to a folder of its own, ``v0000000001`` and so on under the table's root.
Only when it is complete does the table's location move there, in one change of the
catalog. A query planned before reads the files of its version to the end, since the newest
versions are kept; a write that fails leaves the table as it was.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_VERSION = re.compile(r"v(\d{10})")


def _folder(spark: SparkSession, path: str):
    """The file system of ``path``, and ``path`` as it knows it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _child(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def versions(spark: SparkSession, root: str) -> dict[int, str]:
    """Number and folder of every version under ``root``, in rising order."""
    files, at = _folder(spark, root)
    if not files.exists(at):
        return {}
    names = sorted(status.getPath().getName() for status in files.listStatus(at))
    matches = [_VERSION.fullmatch(name) for name in names]
    return {int(m.group(1)): f"{root.rstrip('/')}/{m.group(0)}" for m in matches if m}


def _described(spark: SparkSession, name: str) -> dict[str, str]:
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()
    return {row.col_name: row.data_type for row in rows}


def _same_form(spark: SparkSession, name: str, df: DataFrame, fmt: str) -> bool:
    """Whether the table has the columns and the format of ``df`` as written."""
    now = [(field.name, field.dataType.simpleString()) for field in spark.table(name).schema]
    new = [(field.name, field.dataType.simpleString()) for field in df.schema]
    return now == new and _described(spark, name).get("Provider", "").lower() == fmt.lower()


def published_path(spark: SparkSession, name: str) -> str:
    """The folder that a table is read from now."""
    return _described(spark, name)["Location"]


def publish_table(
    df: DataFrame, name: str, root: str, fmt: str = "orc", keep: int = 2
) -> DataFrame:
    """``df`` as the new version of the table ``name``, whose files lie under ``root``.

    The newest ``keep`` complete versions stay on disk, for readers that began before; what
    is older goes, and so does what a broken write left. ``df`` may read the table itself.
    A table of other columns or another format is dropped and made anew, which is not one
    change: readers may miss it for that moment. Two writers must not publish one table at
    a time; the second to begin fails on the folder of the first.
    """
    if keep < 1:
        raise ValueError(f"keep must be at least 1, not {keep}")
    spark = df.sparkSession
    number = max(versions(spark, root), default=0) + 1
    path = f"{root.rstrip('/')}/v{number:010d}"
    files, at = _folder(spark, path)
    if files.exists(at):
        raise FileExistsError(path)
    try:
        df.write.format(fmt).mode("errorifexists").save(path)
    except Exception:
        files.delete(at, True)
        raise
    if spark.catalog.tableExists(name) and _same_form(spark, name, df, fmt):
        location = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{location}'")
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, path=path, source=fmt, schema=df.schema)
    spark.catalog.refreshTable(name)
    prune(spark, root, number, keep)
    return spark.table(name)


def prune(spark: SparkSession, root: str, current: int, keep: int) -> None:
    """Delete versions up to ``current`` but for the newest ``keep`` complete ones."""
    found = {n: path for n, path in versions(spark, root).items() if n <= current}
    files, _ = _folder(spark, root)
    complete = [n for n, path in found.items() if n == current or files.exists(_child(spark, f"{path}/_SUCCESS"))]
    kept = set(complete[-keep:])
    for n, path in found.items():
        if n not in kept:
            files.delete(_child(spark, path), True)
