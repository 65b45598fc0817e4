"""Writers: GeoParquet per geometry type, CSV, GeoJSON preview."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from geoweft.functions.wkb import CODES, bounds, decode, intersects_extent, to_geojson
from geoweft.operators.extract import GEOMETRY_TYPE, geometry_type_counts
from geoweft.options import Clock, Extent, LayerInfo
from geoweft.session import cut

# Rows of a row group, codecs, file suffixes of geometry types.
ROW_GROUP = 100_000
CODECS = ("zstd", "snappy", "gzip")
SUFFIXES = {"POINT": "points", "LINESTRING": "lines", "POLYGON": "polygons", "MULTIPOINT": "multipoints", "MULTILINESTRING": "multilines", "MULTIPOLYGON": "multipolygons"}
_TITLES = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOINT": "MultiPoint", "MULTILINESTRING": "MultiLineString", "MULTIPOLYGON": "MultiPolygon", "GEOMETRYCOLLECTION": "GeometryCollection"}


def codec(name: str | None) -> str:
    """A known codec in any case; zstd for all else."""
    low = (name or "").lower()
    return low if low in CODECS else CODECS[0]


def geo_metadata(kinds: list[str], box: tuple[float, float, float, float] | None) -> bytes:
    column: dict = {"encoding": "WKB", "geometry_types": [_TITLES[k] for k in kinds]}
    if box:
        column["bbox"] = list(box)
    return json.dumps({"version": "1.1.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()


class _Writer(DataSourceArrowWriter):
    """Each task writes one file under a hidden name; the commit gives the names, an abort removes the files."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path = options["path"].removeprefix("file://")
        self.codec, self.rows, self.overwrite = codec(options.get("compression")), int(options.get("rowgroup", ROW_GROUP)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        os.makedirs(self.path, exist_ok=True)
        name = f".part-{uuid.uuid4().hex}.parquet"
        writer, held, count, kinds, box = None, [], 0, set(), None

        def flush(final: bool) -> None:
            nonlocal held, count
            while count >= self.rows or (final and count):
                table = pa.Table.from_batches(held)
                writer.write_table(table.slice(0, self.rows), row_group_size=self.rows)
                rest = table.slice(self.rows)
                held, count = rest.to_batches(), rest.num_rows

        for batch in iterator:
            if writer is None:
                writer = pq.ParquetWriter(os.path.join(self.path, name), batch.schema, compression=self.codec)
            if "geometry" in batch.schema.names:
                for wkb in batch.column(batch.schema.get_field_index("geometry")):
                    g = decode(wkb.as_py())
                    b = bounds(g)
                    if b:
                        kinds.add(g[0])
                        box = b if box is None else (min(box[0], b[0]), min(box[1], b[1]), max(box[2], b[2]), max(box[3], b[3]))
            held.append(batch)
            count += batch.num_rows
            flush(False)
        if writer is None:
            return _Message("", 0)
        flush(True)
        writer.add_key_value_metadata({"geo": geo_metadata(sorted(kinds, key=lambda k: CODES[k]), box).decode()})
        writer.close()
        return _Message(name, count)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        new = [m.name for m in messages if m and m.name]
        old = [f for f in os.listdir(self.path) if f.endswith(".parquet") and not f.startswith(".")] if self.overwrite and os.path.isdir(self.path) else []
        for i, name in enumerate(new):
            os.replace(os.path.join(self.path, name), os.path.join(self.path, f"part-{i:05d}-{name[6:]}"))
        for f in old:  # only once the new files have their names
            os.remove(os.path.join(self.path, f))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        for m in messages:
            if m and m.name and os.path.exists(os.path.join(self.path, m.name)):
                os.remove(os.path.join(self.path, m.name))


class _Message(WriterCommitMessage):
    def __init__(self, name: str, rows: int) -> None:
        self.name, self.rows = name, rows


class GeoParquetSource(DataSource):
    """df.write.format("geoparquet"): Parquet files with the geo footer, written by the tasks to a shared folder."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> str:
        return "geometry binary"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


def write_geoparquet(df: DataFrame, path: str, compression: str | None = "zstd", mode: str = "overwrite", row_group: int = ROW_GROUP) -> None:
    """mode: overwrite, append, ignore or error (the last two do nothing or raise where Parquet files are)."""
    if mode not in ("overwrite", "append", "ignore", "error", "errorifexists"):
        raise ValueError(f"unknown mode {mode}")
    local = path.removeprefix("file://")
    if "://" in local:
        raise ValueError("the writer needs a folder that all executors see as a path")
    if mode not in ("overwrite", "append") and os.path.isdir(local) and any(f.endswith(".parquet") for f in os.listdir(local)):
        if mode == "ignore":
            return
        raise FileExistsError(path)
    df.sparkSession.dataSource.register(GeoParquetSource)
    df.write.format("geoparquet").option("compression", codec(compression)).option("rowgroup", str(row_group)).mode("overwrite" if mode == "overwrite" else "append").save(path)


def write_by_geometry_type(df: DataFrame, out: str, layer: str, session: str | None = None, compression: str | None = "zstd", mode: str = "overwrite") -> list[LayerInfo]:
    """One dataset per geometry type, polygons first, named by the layer and - if there are several types - the type.

    mode: overwrite, or ignore to keep what is there. A type that can't be written is reported in its entry; the others go on.
    """
    session = session or Clock().session_id()
    counts = [(r[GEOMETRY_TYPE], r["n"]) for r in geometry_type_counts(df).collect() if r[GEOMETRY_TYPE]]  # at most seven types
    layers = []
    for kind, n in counts:
        name = layer if len(counts) == 1 else f"{layer} ({SUFFIXES.get(kind, kind.lower())})"
        path = os.path.join(out, f"{name}_{session}.parquet")
        info = LayerInfo(name, kind, path, n)
        if not (mode == "ignore" and os.path.isdir(path)):
            try:
                write_geoparquet(df.where(F.col(GEOMETRY_TYPE) == kind).drop(GEOMETRY_TYPE), path, compression)
            except Exception as e:  # noqa: BLE001 the contract is to go on with the other types
                info.error = str(e)[:500]
        layers.append(info)
    return layers


def write_csv(df: DataFrame, path: str, single: bool = False, quote_all: bool = False, mode: str = "overwrite") -> None:
    """CSV with header and doubled quotes. single makes one file of a result whose size its caller knows to be small."""
    (df.coalesce(1) if single else df).write.mode(mode).csv(path, header=True, quote='"', escape='"', quoteAll=quote_all, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_geocoded(df: DataFrame, path: str) -> int:
    """query, label, longitude, latitude, source, match, confidence, score; the written rows are counted again."""
    named = df.select("query", F.col("display_label").alias("label"), "longitude", "latitude", F.col("source_type").alias("source"), F.col("match_tier").alias("match"), "confidence", "score")
    named = cut(named)  # counted and written, but geocoded once
    expected = named.count()
    write_csv(named, path, single=True, quote_all=True)
    written = df.sparkSession.read.csv(path, header=True, quote='"', escape='"', multiLine=True).count()
    if written != expected:
        raise OSError(f"{written} of {expected} rows were written")
    return written


def preview_geojson(df: DataFrame, path: str, extent: Extent | None = None, max_features: int = 2000) -> int:
    """A FeatureCollection of ids and geometries for people to look at: a sample of at most max_features rows by id."""
    if extent is not None and "bbox" in df.columns:
        df = df.where((F.col("bbox.xmin") <= extent.xmax) & (F.col("bbox.xmax") >= extent.xmin) & (F.col("bbox.ymin") <= extent.ymax) & (F.col("bbox.ymax") >= extent.ymin))
    elif extent is not None:
        df = df.where(intersects_extent(F.col("geometry"), extent))
    rows = df.where("geometry is not null").select("id", "geometry").orderBy("id").limit(max_features).collect()
    features = [{"type": "Feature", "properties": {"id": r.id}, "geometry": to_geojson(g)} for r in rows if (g := decode(r.geometry))]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"type": "FeatureCollection", "features": features}, f)
    return len(features)
