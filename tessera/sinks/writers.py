"""Writers (SNK1-4): CSV, JSON, and named Parquet snapshots with a history sidecar.

Everything is written by the executors as part files; paths may be any
Hadoop-compatible URI shared by the cluster.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import written


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True,
              mode: str = "overwrite") -> str:
    from tessera.sources.readers import charset
    df.write.mode(mode).options(sep=sep, encoding=charset(encoding), header=str(header).lower()).csv(path)
    return path


def write_json(df: DataFrame, path: str, orient: str = "records", lines: bool = True, mode: str = "overwrite",
               max_document_rows: int = 1_000_000) -> str:
    """JSON lines / records are written as line-delimited part files by every task.

    The orients split and table make one document in part files, one row of
    the frame in a line, in order: the files joined in the order of their
    names are the document.  The orients columns and index are one value, so
    they are assembled for frames up to ``max_document_rows`` rows
    (report-sized outputs) and refused above that.
    """
    if lines or orient == "records":
        df.write.mode(mode).json(path)
        return path
    idx = df.withColumn("__idx", F.monotonically_increasing_id())
    cols = df.columns
    if orient in ("split", "table"):
        if orient == "split":
            def cell(x):  # a value as JSON: the only element of a one-element array
                one = F.to_json(F.array(F.col(f"`{x}`")))
                return F.substr(one, F.lit(2), F.length(one) - 2)
            head = f'{{"columns":{json.dumps(cols, ensure_ascii=False)},"data":['
            row = F.concat(F.lit("["), F.concat_ws(",", *[cell(x) for x in cols]), F.lit("]"))
        else:
            head = '{"data":['
            row = F.to_json(F.struct(F.col("__idx").alias("index"), *[F.col(f"`{x}`") for x in cols]))
        rows = written(idx.select("__idx", row.alias("value")), "json-rows")
        first = rows.agg(F.min("__idx")).first()[0]
        ends = df.sparkSession.createDataFrame([(-1, head), (2 ** 63 - 1, "]}")], "__idx long, value string")
        doc = rows.withColumn("value", F.concat(F.when(F.col("__idx") == F.lit(first), "").otherwise(","), "value"))
        doc.unionByName(ends).orderBy("__idx").select("value").write.mode(mode).text(path)
        return path
    n = df.count()
    if n > max_document_rows:
        raise ValueError(f"orient={orient} makes one JSON document; {n} rows exceed {max_document_rows}")
    if orient in ("columns", "index"):
        if orient == "columns":
            doc = idx.agg(F.to_json(F.struct(*[F.map_from_entries(F.collect_list(F.struct(F.col("__idx").cast("string"), F.col(f"`{x}`"))))
                                               .alias(x) for x in cols])).alias("value"))
        else:
            doc = idx.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("__idx").cast("string"),
                                                                               F.struct(*[F.col(f"`{x}`") for x in cols]))))).alias("value"))
    else:
        raise ValueError(orient)
    doc.write.mode(mode).text(path)
    return path


# ---- snapshots (projects) -----------------------------------------------------------------------
def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def save_snapshot(df: DataFrame, root: str, name: str, history: Sequence[dict] | None = None) -> str:
    """Write ``df`` as Parquet under ``root/name/v=<ms>`` with a JSON history sidecar."""
    spark = df.sparkSession
    version = int(time.time() * 1000)
    base = f"{root.rstrip('/')}/{name}/v={version}"
    df.write.mode("errorifexists").parquet(f"{base}/data")
    meta = {"name": name, "version": version, "created_at": time.strftime("%Y-%m-%dT%H:%M:%S"),
            "columns": df.columns, "history": list(history or [])}
    spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.text(f"{base}/meta")
    return base


def list_snapshots(spark: SparkSession, root: str) -> DataFrame:
    fs, p, _ = _fs(spark, root)
    rows = []
    if fs.exists(p):
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            for v in fs.listStatus(st.getPath()):
                vn = v.getPath().getName()
                if vn.startswith("v="):
                    rows.append((name, int(vn[2:])))
    return spark.createDataFrame(rows, "name string, version long")


def load_snapshot(spark: SparkSession, root: str, name: str, version: int | None = None) -> tuple[DataFrame, dict]:
    if version is None:
        vs = [r["version"] for r in list_snapshots(spark, root).where(F.col("name") == name).collect()]
        if not vs:
            raise FileNotFoundError(name)
        version = max(vs)
    base = f"{root.rstrip('/')}/{name}/v={version}"
    meta = json.loads(spark.read.text(f"{base}/meta").first()[0])
    return spark.read.parquet(f"{base}/data"), meta


def rename_snapshot(spark: SparkSession, root: str, name: str, new: str) -> None:
    fs, p, jvm = _fs(spark, f"{root.rstrip('/')}/{name}")
    fs.rename(p, jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{new}"))


def delete_snapshot(spark: SparkSession, root: str, name: str) -> None:
    fs, p, _ = _fs(spark, f"{root.rstrip('/')}/{name}")
    fs.delete(p, True)


def save_processed(df: DataFrame, path: str) -> str:
    """SNK4: keep the working table as Parquet."""
    df.write.mode("overwrite").parquet(path)
    return path


def load_processed(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """The kept table; with ``rows`` only that many of its rows (a load sample)."""
    df = spark.read.parquet(path)
    return df if rows is None else df.limit(rows)
