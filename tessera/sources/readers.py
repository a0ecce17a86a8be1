"""Readers (SRC1-4, SRC6): CSV / delimited text / JSON orients / Excel workbooks.

All readers return lazy DataFrames split by Spark's file sources.  A JSON
document of orient split or table that has one row in a line, as the writers
make it, is split by lines; other JSON documents in a non-lines orient are one
value per file, so such files are read whole (one task per file).
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import c

# fixed values: candidate delimiters in the order they are tried
DELIMITERS = [",", "\t", ";", "|"]


_ENCODINGS = {"latin1": "ISO-8859-1", "latin-1": "ISO-8859-1", "cp1252": "windows-1252", "utf8": "UTF-8"}


def charset(name: str) -> str:
    """Python-style encoding names mapped to Java charset names."""
    return _ENCODINGS.get(name.lower(), name)


def _numeric_text(col, decimal: str, thousands: str | None):
    s = F.trim(col)
    if thousands:
        s = F.regexp_replace(s, "\\Q" + thousands + "\\E", "")
    if decimal != ".":
        s = F.regexp_replace(s, "\\Q" + decimal + "\\E", ".")
    return s


def read_csv(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", header: bool = True,
             decimal: str = ".", thousands: str | None = None, nrows: int | None = None,
             infer: bool = True) -> DataFrame:
    """CSV with separator, encoding, decimal and thousands marks, optional row limit.

    With a non-default decimal or thousands mark every column is read as text
    and converted where all non-empty values parse as numbers (one aggregate
    pass decides which columns convert).
    """
    custom = decimal != "." or thousands is not None
    rd = spark.read.options(header=str(header).lower(), sep=sep, encoding=charset(encoding),
                            inferSchema=str(infer and not custom).lower(), mode="PERMISSIVE")
    df = rd.csv(path)
    if nrows is not None:
        df = df.limit(nrows)
    if custom:
        conv = {x: _numeric_text(c(x), decimal, thousands).try_cast("double") for x in df.columns}
        ok = df.agg(*[(F.count(c(x)) == F.count(conv[x])).alias(x) for x in df.columns]).first()
        df = df.withColumns({x: conv[x] for x in df.columns if ok[x]})
    return df


def sniff_delimiter(spark: SparkSession, path: str, probe: int = 20, candidates: Sequence[str] = DELIMITERS) -> str:
    """First candidate that appears the same non-zero number of times on every probed line."""
    lines = [r[0] for r in spark.read.text(path).limit(probe).collect()]  # at most ``probe`` lines
    lines = [ln for ln in lines if ln.strip()]
    for d in candidates:
        counts = {ln.count(d) for ln in lines}
        if lines and len(counts) == 1 and counts.pop() > 0:
            return d
    for d in candidates:
        if any(d in ln for ln in lines):
            return d
    return ","


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, header: bool = True, **kw) -> DataFrame:
    """Delimited .txt / .tsv with optional header; the delimiter is sniffed when not given."""
    return read_csv(spark, path, sep=sep or sniff_delimiter(spark, path), header=header, **kw)


def _rows_in_lines(spark: SparkSession, path: str, orient: str) -> DataFrame | None:
    """The rows of a split or table document with one row in a line; None if the document is not laid out so."""
    lines = spark.read.text(path).select(F.trim("value").alias("value"))
    start = F.col("value").startswith('{"columns":[' if orient == "split" else '{"data":[') & F.col("value").endswith('"data":[')
    heads = [r[0] for r in lines.where(start).distinct().limit(2).collect()]
    if len(heads) != 1:
        return None
    try:
        cols = json.loads(heads[0] + "]}").get("columns")
    except ValueError:
        return None
    row = F.regexp_replace("value", "^,|,$", "")
    rows = lines.where(~start & ~F.col("value").isin("", "]}")).select((F.concat(F.lit('{"r":'), row, F.lit("}"))).alias("value"))
    schema = spark.read.option("columnNameOfCorruptRecord", "__broken").json(rows.rdd.map(lambda r: r[0])).schema
    if not schema.fields:  # no rows
        return spark.createDataFrame([], T.StructType([T.StructField(x, T.StringType()) for x in cols or []]))
    if schema.names != ["r"] or not isinstance(schema["r"].dataType, T.ArrayType if orient == "split" else T.StructType):
        return None
    r = rows.select(F.from_json("value", schema)["r"].alias("r"))
    if orient == "table":
        return r.select("r.*").drop("index")
    return r.select(*[F.col("r")[i].alias(name) for i, name in enumerate(cols)])


def read_json(spark: SparkSession, path: str, orient: str = "records", lines: bool = False) -> DataFrame:
    """pandas-style JSON: lines, records, columns, index, split or table orient."""
    if lines:
        return spark.read.json(path)
    if orient == "records":
        return spark.read.option("multiLine", "true").json(path)
    if orient in ("split", "table"):
        by_line = _rows_in_lines(spark, path, orient)
        if by_line is not None:
            return by_line
        doc = spark.read.option("multiLine", "true").json(path)
        if orient == "table":
            return doc.select(F.explode("data").alias("r")).select("r.*").drop("index")
        cols = doc.select("columns").first()[0]  # the column list of the document
        rows = doc.select(F.explode("data").alias("r"))
        return rows.select(*[F.col("r")[i].alias(name) for i, name in enumerate(cols)])
    if orient in ("columns", "index"):
        raw = spark.read.option("wholetext", "true").text(path)
        m = raw.select(F.from_json("value", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))).alias("m"))
        outer = m.select(F.explode("m").alias("k1", "inner")).select("k1", F.explode("inner").alias("k2", "v"))
        if orient == "columns":
            long = outer.select(F.col("k1").alias("column"), F.col("k2").alias("index"), "v")
        else:
            long = outer.select(F.col("k2").alias("column"), F.col("k1").alias("index"), "v")
        names = sorted({r[0] for r in long.select("column").distinct().collect()})  # the columns of the table
        wide = long.groupBy("index").pivot("column", names).agg(F.first("v")).drop("index")
        return auto_numeric(wide)
    raise ValueError(orient)


def auto_numeric(df: DataFrame) -> DataFrame:
    """Convert text columns whose non-null values all parse as numbers (one aggregate decides)."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df
    conv = {x: F.trim(c(x)).try_cast("double") for x in texts}
    ok = df.agg(*[(F.count(c(x)) == F.count(conv[x])).alias(x) for x in texts]).first()
    return df.withColumns({x: conv[x] for x in texts if ok[x]})


def read_workbooks(spark: SparkSession, path_glob: str, sheet: int = 0, header_row: int = 0,
                   nrows: int | None = None) -> DataFrame:
    """Bulk ingest of .xlsx workbooks: one task per file (binaryFile + Arrow), cells as text.

    Parses the Office Open XML parts with the standard library only.
    """
    files = spark.read.format("binaryFile").load(path_glob).select("path", "content")

    def parse(it):
        import io
        import re as _re
        import xml.etree.ElementTree as ET
        import zipfile

        import pandas as pd
        ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
        for pdf in it:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                z = zipfile.ZipFile(io.BytesIO(content))
                shared = []
                if "xl/sharedStrings.xml" in z.namelist():
                    root = ET.fromstring(z.read("xl/sharedStrings.xml"))
                    for si in root.findall("m:si", ns):
                        shared.append("".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")))
                sheets = sorted(n for n in z.namelist() if _re.match(r"xl/worksheets/sheet\d+\.xml", n))
                sheets.sort(key=lambda n: int(_re.findall(r"\d+", n.split("/")[-1])[0]))
                root = ET.fromstring(z.read(sheets[sheet]))
                for row in root.iter(f"{{{ns['m']}}}row"):
                    r = int(row.get("r")) - 1
                    for cell in row.findall("m:c", ns):
                        ref = cell.get("r")
                        letters = _re.match(r"[A-Z]+", ref).group(0)
                        col = 0
                        for ch in letters:
                            col = col * 26 + (ord(ch) - 64)
                        v = cell.find("m:v", ns)
                        if cell.get("t") == "inlineStr":
                            t = cell.find("m:is/m:t", ns)
                            val = t.text if t is not None else None
                        elif v is None:
                            val = None
                        elif cell.get("t") == "s":
                            val = shared[int(v.text)]
                        else:
                            val = v.text
                        out.append((p, r, col - 1, val))
            yield pd.DataFrame(out, columns=["path", "row", "col", "value"])

    cells = files.mapInPandas(parse, "path string, row int, col int, value string")
    heads = cells.where(F.col("row") == header_row).select("path", "col", F.col("value").alias("name"))
    names = sorted({(r["col"], r["name"]) for r in heads.collect()})  # header cells: bounded by the column count
    ncols = {cl: nm for cl, nm in names}
    body = cells.where(F.col("row") > header_row)
    if nrows is not None:
        body = body.where(F.col("row") <= header_row + nrows)
    wide = body.groupBy("path", "row").pivot("col", sorted(ncols)).agg(F.first("value"))
    return auto_numeric(wide.select("path", "row", *[F.col(f"`{cl}`").alias(str(ncols[cl])) for cl in sorted(ncols)]))


def load_metadata(df: DataFrame, name: str | None = None, sample_size: int | None = None) -> DataFrame:
    """One row: file name, bytes read, rows, columns, sample flag (SRC6)."""
    meta = df.select("_metadata.file_size", "_metadata.file_name").distinct()
    size = meta.agg(F.sum("file_size")).scalar()
    fname = meta.agg(F.min("file_name")).scalar()
    rows = df.agg(F.count(F.lit(1))).scalar()
    return df.sparkSession.range(1).select(
        (F.lit(name) if name else fname).alias("filename"), size.alias("size_bytes"), rows.alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"), F.lit(sample_size is not None).alias("is_sample"),
        F.lit(sample_size).cast("long").alias("sample_size"))
