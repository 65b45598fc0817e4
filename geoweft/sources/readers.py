"""Readers: lake datasets, delimited text, drifting schemas, and where datasets lie."""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Sub-folders of a release that may hold a type, in order, and delimiters of text in order of preference.
DELIMITERS = "\t,;|"
THEME_OF = {"place": "places", "address": "addresses"}


def read_lake(spark: SparkSession, path: str, base_path: str | None = None, fast: bool = False, filename: bool = False) -> DataFrame:
    """Parquet with hive partitions. Files whose schemas differ are merged by name; fast trusts the first footer and is
    followed by a merge if the schema can't be read; files that differ from it then only show when rows are read. Files that disagree on a column's type are read by schema group and
    cast to the least type that holds both. filename adds the file a row is from."""

    def reader(merge: bool):
        r = spark.read.option("mergeSchema", str(merge).lower())
        return r.option("basePath", base_path) if base_path else r

    try:
        df = reader(not fast).parquet(path)
    except Exception as failed:  # noqa: BLE001 Spark raises several kinds for footers that can't be merged
        if fast:
            try:
                df = reader(True).parquet(path)
            except Exception as again:  # noqa: BLE001
                df = _by_schema_group(spark, path, again)
        else:
            df = _by_schema_group(spark, path, failed)
    return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df


def _by_schema_group(spark: SparkSession, path: str, cause: Exception) -> DataFrame:
    if not re.search("MERGE_SCHEMA|CANNOT_MERGE|merge", str(cause), re.I):
        raise cause
    files = [r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path).select("path").collect()]
    groups: dict[str, list[str]] = {}
    for f, schema in sorted(_schemas(spark, files)):
        groups.setdefault(schema, []).append(f)
    return union_by_name([spark.read.schema(T.StructType.fromJson(json.loads(s))).parquet(*fs) for s, fs in groups.items()])


def _schemas(spark: SparkSession, files: list[str]) -> list[tuple[str, str]]:
    """(file, schema as JSON) of Parquet files, whose footers are read by tasks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow.fs import FileSystem
        from pyspark.sql.pandas.types import from_arrow_schema

        for batch in batches:
            rows = []
            for path in batch["path"]:
                uri = path.replace("file:///", "/", 1) if path.startswith("file:///") else path.replace("file:/", "/", 1) if path.startswith("file:/") else path
                system, inner = (None, uri) if uri.startswith("/") else FileSystem.from_uri(uri)
                rows.append((path, from_arrow_schema(pq.read_schema(inner, filesystem=system), True).json()))
            yield pd.DataFrame(rows, columns=["path", "schema"])

    tasks = min(len(files), 4 * spark.sparkContext.defaultParallelism)
    paths = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, tasks))
    return [(r.path, r.schema) for r in paths.mapInPandas(read, "path string, schema string").collect()]


_WHOLE = ("tinyint", "smallint", "int", "bigint")


def promoted(a: T.DataType, b: T.DataType) -> T.DataType:
    """Least upper bound of two types: wider whole numbers, double for whole and decimal numbers, timestamp for dates and times,
    structs and lists part by part; string is the top."""
    x, y = a.simpleString(), b.simpleString()
    if x == y or y == "void":
        return a
    if x == "void":
        return b
    if x in _WHOLE and y in _WHOLE:
        return a if _WHOLE.index(x) > _WHOLE.index(y) else b
    numbers = (*_WHOLE, "float", "double")
    if (x in numbers or x.startswith("decimal")) and (y in numbers or y.startswith("decimal")):
        return T.DoubleType()
    if {x, y} == {"date", "timestamp"}:
        return T.TimestampType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(promoted(a.elementType, b.elementType))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        other = {f.name: f.dataType for f in b.fields}
        fields = [T.StructField(f.name, promoted(f.dataType, other.pop(f.name)) if f.name in other else f.dataType) for f in a.fields]
        return T.StructType([*fields, *[f for f in b.fields if f.name in other]])
    return T.StringType()


def _fits(value: Column, have: T.DataType, want: T.DataType) -> Column:
    """A column of one type in a promoted one."""
    if have.simpleString() == want.simpleString():
        return value
    if isinstance(want, T.StructType) and isinstance(have, T.StructType):
        kinds = {f.name: f.dataType for f in have.fields}
        parts = [(_fits(value[f.name], kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name) for f in want.fields]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
        return F.transform(value, lambda v: _fits(v, have.elementType, want.elementType))
    if isinstance(want, T.StringType) and isinstance(have, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value)
    return value.cast(want)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that is absent is null, one whose types differ has the least type that holds both; only
    types that nothing else holds become strings (nested ones as JSON)."""
    kinds: dict[str, T.DataType] = {}
    for f in frames:
        for field in f.schema.fields:
            kinds[field.name] = promoted(kinds[field.name], field.dataType) if field.name in kinds else field.dataType

    def aligned(f: DataFrame) -> DataFrame:
        return f.select(*[_fits(F.col(f"`{n}`"), f.schema[n].dataType, kinds[n]).alias(n) for n in f.columns])

    out = aligned(frames[0])
    for f in frames[1:]:
        out = out.unionByName(aligned(f), allowMissingColumns=True)
    return out


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = None, header: bool = True, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, damaged): all columns as text. Rows with too few or too many cells are in damaged, not in rows. Quotes are
    doubled within quoted cells; a quoted empty cell is null. multi_line allows line breaks in quoted cells; such a file can't be
    split, so it is read by one task."""
    first = first_line(spark, path)
    sep = delimiter or sniff_delimiter(first)
    names = columns or split_line(first, sep)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_damaged"]])
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, quote='"', escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord="_damaged", enforceSchema=True, multiLine=multi_line)
    # the test refers to every column: a scan of some columns would take rows of another length for whole ones
    whole = F.hash(*[F.col(f"`{n}`") for n in names]) >= F.lit(-(2**31))
    bad = F.col("_damaged").isNotNull()
    return df.where(whole & ~bad).select(*names), df.where(whole & bad).select(F.col("_damaged").alias("line"))


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).limit(1).first()
    return "" if row is None else row[0].lstrip("﻿")


def sniff_delimiter(line: str) -> str:
    """The delimiter that stands most often outside quotes; of equals the first of tab, comma, semicolon, bar."""
    bare = re.sub(r'"(?:[^"]|"")*"', "", line)
    return max(DELIMITERS, key=lambda d: (bare.count(d), -DELIMITERS.index(d)))


def split_line(line: str, delimiter: str) -> list[str]:
    return next(csv.reader(io.StringIO(line), delimiter=delimiter), [])


GEOCODE_ALIASES = {
    "address": "address singleline fulladdress singlelineinput", "street": "street streetname road name saddstr", "number": "number housenumber saddno", "prefix": "prefix predir streetprefix saddpref", "type": "streettype sttype saddsttyp",
    "suffix": "suffix postdir streetsuffix saddstsuf", "unit": "unit apt apartment suite sunit", "city": "city scity locality", "state": "state state2 region province", "postcode": "zip zip5 szip szip5 postcode postalcode",
}
HEADER_WORDS = frozenset("address singleline singlelineinput fulladdress street streetname road name saddstr saddno city scity state state2 zip szip postcode".split())


def read_geocode_file(spark: SparkSession, path: str, max_rows: int | None = 500) -> tuple[DataFrame, bool]:
    """(row_id, address, city, state, postcode), and whether rows beyond max_rows were left out.

    The header is found by its names; a file of one column without header is a list of addresses. A header without an
    address or street column is an error. row_id is the order within the file. max_rows None reads the whole file.
    """
    line = first_line(spark, path)
    sep = sniff_delimiter(line)
    cells = split_line(line, sep)
    keys = [re.sub(r"[\W_]+", "", c.lower()) for c in cells]
    with_header = any(k in HEADER_WORDS for k in keys)
    names = [f"c{i}" for i in range(len(cells))]
    rows, _ = read_delimited(spark, path, names, sep, header=with_header)
    role = {r: names[keys.index(hit)] for r, words in GEOCODE_ALIASES.items() if with_header and (hit := next((k for k in keys if k in words.split()), None))}
    if with_header and "address" not in role and "street" not in role:
        raise ValueError("no address or street column")
    if not with_header:
        role = {"address": names[0]}
    from geoweft.functions.text import blank_to_null, clean

    value = lambda r: clean(F.col(role[r])) if r in role else F.lit("")
    address = F.coalesce(blank_to_null(value("address")), F.concat_ws(" ", *[blank_to_null(value(r)) for r in ("number", "prefix", "street", "type", "suffix", "unit")]))
    numbered = rows.select(F.monotonically_increasing_id().alias("row_id"), address.alias("address"), value("city").alias("city"), value("state").alias("state"), value("postcode").alias("postcode")).where("address != ''")
    if max_rows is None:
        return numbered, False
    more = numbered.limit(max_rows + 1).count() > max_rows
    return numbered.orderBy("row_id").limit(max_rows), more


def newest_release(root: str, has: Callable[[Path], bool] | None = None) -> str | None:
    """The folder changed last below root, of those that ``has`` accepts."""
    folders = [p for p in Path(root).iterdir() if p.is_dir()] if os.path.isdir(root) else []
    folders = [p for p in folders if has is None or has(p)]
    return str(max(folders, key=lambda p: (p.stat().st_mtime, p.name))) if folders else None


def locate_type(release: str, type_: str) -> str | None:
    """Folder of a type's Parquet files in a release: beside the release, in its theme, as hive partitions, else the first
    folder of that name that holds some."""
    root = Path(release)
    if not root.is_dir():
        return None
    theme = THEME_OF.get(type_, type_)
    holds = lambda p: p.is_dir() and any(p.glob("*.parquet"))
    for p in (root / type_, root / theme / type_, root / f"theme={theme}" / f"type={type_}"):
        if holds(p):
            return str(p)
    return next((str(p) for p in sorted(root.rglob("*")) if p.name.lower() == type_.lower() and holds(p)), None)


def lake_path(root: str, release: str, theme: str, type_: str) -> str:
    return f"{root.rstrip('/')}/release/{release}/theme={theme}/type={type_}"


def read_bridge(spark: SparkSession, release: str, root: str) -> DataFrame:
    """Bridge table of a release with its hive partitions theme and type. root: a folder or object store that Spark can list."""
    base = f"{root.strip().rstrip('/').rstrip(chr(92))}/{release.strip()}"
    return spark.read.option("basePath", base).parquet(base)


def release_list(text: str | None, override: str | None = None, cached: str | None = None) -> dict:
    """{latest, releases} of a JSON document; an override wins, a damaged or missing document falls back on the cached one."""
    for source in (text, cached):
        try:
            found = json.loads(source) if source else None
        except ValueError:
            found = None
        if isinstance(found, dict) and found.get("releases"):
            return {"latest": override or found.get("latest") or found["releases"][0], "releases": list(found["releases"])}
    return {"latest": override, "releases": [override] if override else []}


def read_first(spark: SparkSession, path: str, n: int = 1000) -> DataFrame:
    """The first n rows of a dataset, for people to look at; only as many files are opened as hold them."""
    return read_lake(spark, path, fast=True).limit(n)


def rows_as_dicts(spark: SparkSession, sql: str, limit: int = 1000) -> list[dict]:
    """The first rows of an ad-hoc statement, for people to look at."""
    return [r.asDict(recursive=True) for r in spark.sql(sql).limit(limit).collect()]
