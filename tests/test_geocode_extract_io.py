import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoweft.functions import wkb
from geoweft.operators import extract, geocode
from geoweft.options import Clock, Extent
from geoweft.plans import catalog
from geoweft.sources import readers, writers


def point(lon, lat):
    return wkb.encode(("POINT", [np.array([[lon, lat]])]))


@pytest.fixture
def addresses(spark):
    rows = [("1939", "E OLIVE AVE", "Fresno", 10.0), ("19", "E OLIVE AVE", "Fresno", 10.1), (None, "OLIVE", None, 10.2), ("5", "OAK ST", "Fresno", 10.3)]
    return geocode.searchable(spark.createDataFrame([(n, s, c, point(x, 50.0)) for n, s, c, x in rows], "number string, street string, city string, geometry binary"))


@pytest.fixture
def places(spark):
    rows = [("Olive Grill", "restaurant", 10.0), (None, None, 10.4), ("Oak", "tree_%", 10.5)]
    return geocode.searchable(spark.createDataFrame([((n,), (c,), point(x, 50.0)) for n, c, x in rows], "names struct<primary:string>, categories struct<primary:string>, geometry binary"))


def test_search_tiers(addresses, places):
    got = [(r.display_label, r.match_tier, r.score, r.confidence) for r in geocode.search(addresses, "1939 E. Olive Ave", "Address").collect()]
    assert got == [("1939 E OLIVE AVE, Fresno", "prefix", 260, "Medium")]
    got = [(r.display_label, r.match_tier, r.score) for r in geocode.search(addresses, "olive", "Address").collect()]
    assert got == [("OLIVE", "exact", 340), ("19 E OLIVE AVE, Fresno", "prefix", 210), ("1939 E OLIVE AVE, Fresno", "prefix", 210)]
    assert [r.match_tier for r in geocode.search(addresses, "fresno oak", "Address").collect()] == ["contains"]  # 160 with the bias
    assert geocode.search(addresses, "%", "Address").count() == 0 and geocode.search(places, "tree", "Place").first().match_tier == "contains"
    both = geocode.search_all(addresses, places, "olive", 2).collect()
    assert len(both) == 2 and both[0].score == 340 and geocode.best(addresses, places, "olive grill").first().source_type == "Place"


def test_geocode_table(spark, addresses, places):
    q = spark.createDataFrame([("1", "1939 E OLIVE AVE", "Nowhere", "CA", None), ("2", "9999 Missing", None, None, None), ("3", None, "x", None, None), ("4", "oak st", "Fresno", None, None)], "row_id string, address string, city string, state string, postcode string")
    got = {r.row_id: r for r in geocode.geocode_table(q, addresses, places).collect()}
    assert got["1"].query == "1939 E OLIVE AVE" and got["1"].display_label.startswith("1939") and got["2"].query is None and got["3"].score is None and got["4"].query == "oak st, Fresno"
    assert geocode.geocode_table(q, addresses, places, max_rows=1).count() == 1
    assert geocode.geocode_table(q.where("false"), addresses, places).count() == 0


def test_geocode_table_takes_every_row(spark, addresses, places):
    """Rows beyond 500, tokens inside words and tokens of one letter, as a comparison of all pairs finds them."""
    texts = ["1939 E OLIVE AVE", "live av", "9 o", "99 OLIVE", "oak s", "rill taur", "k", "OLIVE-AVE 19", "fresno"]
    q = spark.createDataFrame([(f"{i:04d}", texts[i % len(texts)], None, None, None) for i in range(600)], "row_id string, address string, city string, state string, postcode string")
    got = {r.row_id: r for r in geocode.geocode_table(q, addresses, places).collect()}
    assert len(got) == 600
    for i, text in enumerate(texts):
        want = geocode.best(addresses, places, text).first()
        for k in (i, 594 + i if i < 6 else i):
            r = got[f"{k:04d}"]
            assert (r.display_label, r.score, r.source_type) == ((want.display_label, want.score, want.source_type) if want else (None, None, None))


def test_searchable_extents(spark):
    df = spark.createDataFrame([("a", point(1, 1), (1.0, 1.0, 1.0, 1.0)), ("b", point(5, 5), (5.0, 5.0, 5.0, 5.0)), ("c", None, None)], "name string, geometry binary, bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>")
    assert geocode.searchable(df, Extent(0, 0, 2, 2)).count() == 1 and geocode.searchable(df.drop("bbox"), Extent(0, 0, 2, 2)).count() == 1 and geocode.searchable(df).count() == 2
    assert geocode.searchable(df).first().display_label == "a a"


def test_projection_and_derived_columns(spark):
    df = spark.createDataFrame([("1", [("OpenStreetMap", "n1@2", "2024"), ("Meta", None, "x")], [("1 A", "T", "R", "123456", None), (" ", None, None, None, None), ("2 B", "T", "S", "12345", "Q")], point(0, 0)), ("2", None, None, None), ("3", [], [], point(0, 0)), ("4", [(None, "x", " "), ("Esri", "y", "2")], [(None, None, None, None, None)], point(0, 0))], "id string, sources array<struct<dataset:string,record_id:string,update_time:string>>, addresses array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>, geometry binary")
    flat = {r.id: r for r in extract.flatten_addresses(df).collect()}
    assert (flat["1"].address_freeform, flat["1"].address_locality, flat["1"].address_region, flat["1"].address_postcode, flat["1"].address_country) == ("1 A | 2 B", "T", "R | S", "12345", "Q")
    assert all(flat[i].address_freeform is None for i in "234")
    p = {r.id: r for r in extract.add_provenance(df).collect()}
    assert p["1"].source_count == 2 and p["1"].source_datasets == "OpenStreetMap | Meta" and p["1"].source_url == "https://www.openstreetmap.org/edit?node=1" and p["2"].source_count == 0 and p["2"].source_edit_platform == "Unknown source"
    assert p["4"].source_primary_dataset == "Esri" and p["4"].source_primary_record_id == "x" and p["4"].source_primary_update_time == "2"
    assert extract.project_columns(df, "place").columns == ["id", "geometry"] and extract.project_columns(df, None).columns == df.columns and extract.project_columns(df.select("sources"), "land").columns == ["sources"]
    assert "address_freeform" in extract.shape(df, "place").columns and extract.flatten_addresses(df.withColumn("address_freeform", F.lit("x"))).where("address_freeform != 'x'").count() == 0


def areas(spark):
    ring = lambda x, y, n: np.array([(x, y), (x + n, y), (x + n, y + n), (x, y + n), (x, y)], float)
    rows = [("in", wkb.encode(("POLYGON", [[ring(1, 1, 1)]]))), ("cut", wkb.encode(("POLYGON", [[ring(-5, -5, 10)]]))), ("out", wkb.encode(("POLYGON", [[ring(50, 50, 1)]]))), ("line", wkb.encode(("LINESTRING", [np.array([[-1, 5], [20, 5]], float)]))), ("none", None)]
    return extract.with_bounds(spark.createDataFrame(rows, "id string, geometry binary"))


def test_clip_and_geometry_types(spark):
    out = extract.shape(areas(spark), "land", Extent(0, 0, 10, 10))
    rows = {r.id: r for r in out.collect()}
    assert sorted(rows) == ["cut", "in", "line"] and tuple(rows["cut"].bbox) == (0, 5, 0, 5) and tuple(rows["line"].bbox) == (0, 10, 5, 5)
    assert [tuple(r) for r in extract.geometry_type_counts(out).collect()] == [("POLYGON", 2), ("LINESTRING", 1)]
    assert extract.shape(areas(spark).drop("bbox"), "land", Extent(0, 0, 10, 10)).count() == 3


def test_geoparquet_files(spark, tmp_path):
    out = extract.shape(areas(spark), "land", Extent(0, 0, 10, 10))
    layers = writers.write_by_geometry_type(out, str(tmp_path), "Land", "s1", "GZIP")
    assert [(x.name, x.rows, x.error) for x in layers] == [("Land (polygons)", 2, None), ("Land (lines)", 1, None)]
    back = spark.read.parquet(layers[0].path)
    assert back.count() == 2 and extract.GEOMETRY_TYPE not in back.columns
    files = sorted((tmp_path / "Land (polygons)_s1.parquet").glob("*.parquet"))
    boxes = []
    for f in files:
        meta = pq.read_metadata(f)
        geo = json.loads(meta.metadata[b"geo"])
        boxes.append(geo["columns"]["geometry"].get("bbox"))
        assert geo["primary_column"] == "geometry" and meta.row_group(0).column(0).compression == "GZIP"
    assert min(b[0] for b in boxes) == 0 and max(b[2] for b in boxes) == 5
    assert writers.write_by_geometry_type(out.where("id = 'line'"), str(tmp_path), "One", "s1")[0].name == "One"
    writers.write_geoparquet(spark.range(250_000).select("id", F.lit(None).cast("binary").alias("geometry")).coalesce(1), str(tmp_path / "g"))
    meta = pq.read_metadata(next((tmp_path / "g").glob("*.parquet")))
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100_000, 100_000, 50_000]
    assert len(Clock().session_id()) == 17


def test_preview_and_csv(spark, tmp_path):
    n = writers.preview_geojson(areas(spark), str(tmp_path / "p.json"), Extent(0, 0, 10, 10), max_features=2)
    doc = json.loads((tmp_path / "p.json").read_text())
    assert n == 2 and [f["properties"]["id"] for f in doc["features"]] == ["cut", "in"] and doc["features"][0]["geometry"]["type"] == "Polygon"
    df = spark.createDataFrame([('a "q"', "l", 1.0, 2.0, "Place", "exact", "High", 300)], "query string, display_label string, longitude double, latitude double, source_type string, match_tier string, confidence string, score int")
    assert writers.write_geocoded(df, str(tmp_path / "c")) == 1
    assert spark.read.csv(str(tmp_path / "c"), header=True, quote='"', escape='"').first()["query"] == 'a "q"'


def test_delimited_text(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('record_id,name,postcode\n1,"a, ""b""",02139\n2,short\n3,long,1,2\n4,,""\n', encoding="utf-8")
    rows, damaged = readers.read_delimited(spark, str(p))
    assert sorted(map(tuple, rows.collect())) == [("1", 'a, "b"', "02139"), ("4", None, None)] and damaged.count() == 2


def test_geocode_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("Number;SADDSTR;Zip\n12;Main;02139\n;;\n13;Oak;1\n", encoding="utf-8")
    df, more = readers.read_geocode_file(spark, str(tmp_path / "a.txt"), max_rows=1)
    assert more and [tuple(r)[1:] for r in df.collect()] == [("12 Main", "", "", "02139")]
    (tmp_path / "b.txt").write_text("1 Main St\n2 Oak\n", encoding="utf-8")
    assert [r.address for r in readers.read_geocode_file(spark, str(tmp_path / "b.txt"))[0].collect()] == ["1 Main St", "2 Oak"]
    (tmp_path / "c.txt").write_text("city,zip\nx,1\n", encoding="utf-8")
    with pytest.raises(ValueError):
        readers.read_geocode_file(spark, str(tmp_path / "c.txt"))


def test_lake(spark, tmp_path):
    root = tmp_path / "release" / "r1"
    for theme, t in (("places", "place"), ("base", "land")):
        spark.createDataFrame([("1", t)], "id string, kind string").write.parquet(str(root / f"theme={theme}" / f"type={t}"))
    assert readers.locate_type(str(root), "place").endswith("theme=places/type=place") and readers.locate_type(str(root), "segment") is None and readers.locate_type(str(tmp_path / "no"), "place") is None
    assert readers.lake_path(str(tmp_path), "r1", "places", "place") == f"{tmp_path}/release/r1/theme=places/type=place"
    df = readers.read_lake(spark, str(root), filename=True)
    assert df.where("theme = 'base' and type = 'land'").first().filename.startswith("file:") and {"theme", "type"} <= set(df.columns)
    assert readers.newest_release(str(tmp_path / "release")) == str(root) and readers.newest_release(str(tmp_path / "none")) is None
    assert readers.read_bridge(spark, "r1", str(tmp_path / "release")).count() == 2
    spark.createDataFrame([("1", 5)], "id string, v int").write.parquet(str(tmp_path / "d" / "x=1"))
    spark.createDataFrame([("2", "b", 1.0)], "id string, v string, w double").write.parquet(str(tmp_path / "d" / "x=2"))
    assert sorted((r.id, r.v, r.w) for r in readers.read_lake(spark, str(tmp_path / "d")).collect()) == [("1", "5", None), ("2", "b", 1.0)]
    assert readers.rows_as_dicts(spark, "SELECT 1 AS a") == [{"a": 1}]
    assert extract.load(spark, str(root / "theme=base" / "type=land"), "land").count() == 1


def test_catalog(spark, tmp_path):
    ring = np.array([(0, 0), (1, 0), (1, 1), (0, 0)], float)
    df = spark.createDataFrame([("1", ("x",), wkb.encode(("POLYGON", [[ring]])), True, 1, None)], "id string, names struct<primary:string>, geometry binary, is_land boolean, zeta int, sources array<string>")
    df.write.parquet(str(tmp_path / "division_area"))
    df.select("zeta", "id", "geometry").write.parquet(str(tmp_path / "other"))
    spark.createDataFrame([("1",)], "id string").write.parquet(str(tmp_path / "plain"))
    doc = catalog.build(spark, str(tmp_path))
    by = {d["name"]: d for d in doc["datasets"]}
    assert [f["name"] for f in by["division_area"]["fields"]] == ["id", "bbox_xmin", "bbox_xmax", "bbox_ymin", "bbox_ymax", "names_primary", "is_land", "geometry", "zeta"]
    assert {"name": "is_land", "type": "String", "sourceType": "Boolean"} in by["division_area"]["fields"] and by["division_area"]["geometry"]["geometryType"] == "esriGeometryPolygon"
    assert [f["name"] for f in by["other"]["fields"]][-2:] == ["zeta", "geometry"] and "geometry" not in by["plain"]
    catalog.write(doc, str(tmp_path / "out" / "c.json"))
    assert json.loads((tmp_path / "out" / "c.json").read_text())["datasets"]
    names = [f["name"] for f in catalog.fields_of(spark.createDataFrame([], "id string, perspectives string").schema, "division")]
    assert "perspectives_mode" in names and "brand_wikidata" in [f["name"] for f in catalog.fields_of(spark.createDataFrame([], "id string, brand string").schema, "place")]
