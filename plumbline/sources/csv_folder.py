"""CSV folder scan: many files with differing headers as one table."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: a header that is renamed before anything else.
HEADER_RENAMES = {"tax(£)": "tax"}


@dataclass(frozen=True)
class CsvFolder:
    root: str
    pattern: str = "*.csv"
    recursive: bool = True
    strip_names: bool = True
    lower_names: bool = False
    exclude: tuple[str, ...] = ()
    add_source: bool = True
    source_column: str = "_source_file"
    encoding: str | None = None
    sep: str | None = None
    schema: T.StructType | None = None

    def options(self) -> dict[str, str]:
        out = {"header": "true", "enforceSchema": "false"}
        if self.encoding:
            out["encoding"] = self.encoding
        if self.sep:
            out["sep"] = self.sep
        return out


def normalise_header(names: Sequence[str], strip: bool = True, lower: bool = False) -> list[str]:
    """Strip first, then the fixed rename, then lower case."""
    out = [n.strip() if strip else n for n in names]
    out = [HEADER_RENAMES.get(n.strip(), n) for n in out]
    return [n.lower() if lower else n for n in out]


def normalise_columns(df: DataFrame, strip: bool = True, lower: bool = False) -> DataFrame:
    return df.toDF(*normalise_header(df.columns, strip, lower))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under all column names; a column a frame lacks is null there.

    Where frames disagree on a column's type, the column becomes double if all are numeric and
    text otherwise.
    """
    types: dict[str, list[T.DataType]] = {}
    for f in frames:
        for field in f.schema:
            types.setdefault(field.name, []).append(field.dataType)
    target = {}
    for name, seen in types.items():
        if len(set(seen)) > 1:
            numeric = all(isinstance(t, T.NumericType) for t in seen)
            target[name] = "double" if numeric else "string"
    cast = [f.withColumns({n: F.col(n).cast(t) for n, t in target.items() if n in f.columns}) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def _files(spark: SparkSession, cfg: CsvFolder) -> list[str]:
    """Matching paths, sorted; listing is Spark's own, without reading contents."""
    listing = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", cfg.pattern)
        .option("recursiveFileLookup", str(cfg.recursive).lower())
        .load(cfg.root)
        .select("path")
    )
    name = F.element_at(F.split("path", "/"), -1)
    if cfg.exclude:
        listing = listing.filter(~name.isin(*cfg.exclude))
    return [r[0] for r in listing.orderBy("path").collect()]


def read_csv_folder(spark: SparkSession, cfg: CsvFolder) -> DataFrame:
    """One table from all CSV files of a folder.

    Files are grouped by header, so the plan has one scan per distinct header and not one per
    file. Give a schema to skip type inference, which reads the data once more.
    """
    files = _files(spark, cfg)
    if not files:
        raise FileNotFoundError(f"no files under {cfg.root} match {cfg.pattern!r}")
    headers = _headers(spark, cfg, files)
    frames = []
    for columns, paths in headers.items():
        reader = spark.read.options(**cfg.options())
        names = normalise_header(columns, cfg.strip_names, cfg.lower_names)
        if cfg.schema is not None:
            wanted = {f.name: f.dataType for f in cfg.schema}
            reader = reader.schema(
                T.StructType([T.StructField(c, wanted.get(n, T.StringType())) for c, n in zip(columns, names)])
            )
        else:
            reader = reader.option("inferSchema", "true")
        df = reader.csv(paths)
        source = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
        if cfg.add_source:
            df = df.select(*[F.col(f"`{c}`") for c in df.columns], source.alias(cfg.source_column))
            names = [*names, cfg.source_column]
        frames.append(df.toDF(*names))
    return union_by_name(frames)


def _first_line(spark: SparkSession, path: str, encoding: str) -> str:
    """First line of a file through Hadoop's file system API; the rest is not read."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path.replace(" ", "%20")))
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, encoding))
        return reader.readLine() or ""
    finally:
        stream.close()


def _headers(spark: SparkSession, cfg: CsvFolder, files: list[str]) -> dict[tuple[str, ...], list[str]]:
    """Header row -> files, from the first line of each file."""
    sep = cfg.sep or ","
    with ThreadPoolExecutor(max_workers=32) as pool:
        lines = list(pool.map(lambda f: _first_line(spark, f, cfg.encoding or "UTF-8"), files))
    out: dict[tuple[str, ...], list[str]] = {}
    for path, line in zip(files, lines):
        cells = next(csv.reader([line.lstrip("\ufeff")], delimiter=sep), [])
        out.setdefault(tuple(cells), []).append(path)
    return out
