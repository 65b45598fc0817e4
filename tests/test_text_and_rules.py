import pytest
from pyspark.sql import functions as F

from geoweft.functions import text
from geoweft.functions.wkb import needs_projection
from geoweft.operators import geocode, mapping, rules
from geoweft.options import BridgeOptions, Extent, LinkOptions, LinkSummary, TraceOptions
from geoweft.sources import readers, writers


@pytest.mark.parametrize(("raw", "want"), [("1939 E. Olive Ave", "1939 e olive ave"), ("  A,,B  ", "a b"), ("", ""), (None, ""), ("Café-Bar №5", "café bar 5"), ("---", "")])
def test_search_form(raw, want):
    assert text.search_form(raw) == want


def test_normalize_keeps_edge_spaces(spark):
    df = spark.createDataFrame([("(Foo)  Bar-1!",), (None,), ("!!!",)], "v string")
    assert [r[0] for r in df.select(text.normalize_text(F.col("v"))).collect()] == [" foo bar 1 ", "", " "]


def test_column_and_driver_forms_agree(spark):
    rows = ["1939 E. Olive Ave", "  A,,B  ", "", None, "Ünïcode-Bar №5"]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    assert [r[0] for r in df.select(text.normalize_for_search(F.col("v"))).collect()] == [text.search_form(r) for r in rows]


def test_number_postcode_and_joins(spark):
    df = spark.createDataFrame([(" 12B Main", "QA 93710-5109", " "), (None, None, None), ("Main 5", "x", "a")], "a string, p string, b string")
    got = df.select(text.house_number(F.col("a")), text.postcode_digits(F.col("p")), text.join_non_blank(" ", F.col("b"), F.col("p"))).collect()
    assert [tuple(r) for r in got] == [("12b", "93710", "QA 93710-5109"), ("", "", None), ("", "", "a x")]


@pytest.mark.parametrize(("raw", "want"), [("Linked_geo.CY_TOWN.ADDRESS_VW", "Linked_geo_CY_TOWN_ADDRESS_VW"), ("123 bad/name", "fc_123_bad_name"), ("a" * 60, "a" * 50), ("...", "Fallback"), (None, "Fallback")])
def test_sanitize_name(raw, want):
    assert text.sanitize_name(raw, "Fallback") == want


def test_query_variants(spark):
    assert geocode.query_variants("1939 E OLIVE AVE", "FRESNO", "CA", "93701") == ["1939 E OLIVE AVE, FRESNO, CA 93701", "1939 E OLIVE AVE, 93701", "1939 E OLIVE AVE, FRESNO", "1939 E OLIVE AVE, FRESNO, CA", "1939 E OLIVE AVE"]
    assert geocode.query_variants("1 Main", "", None, "93701") == ["1 Main, 93701", "1 Main"]
    assert geocode.query_variants("  ", "a", "b", "c") == []
    cases = [("1939 E OLIVE AVE", "FRESNO", "CA", "93701"), ("1 Main", "", None, "93701"), ("", "a", "b", "c"), (None, None, None, None), ('"1  Main"', "x", "", "")]
    df = spark.createDataFrame(cases, "a string, c string, s string, z string")
    assert [r[0] for r in df.select(geocode.variants(*[F.col(c) for c in "acsz"])).collect()] == [geocode.query_variants(*c) for c in cases]


@pytest.mark.parametrize(("tier", "source", "want"), [("exact", "Address", "Exact address match"), ("prefix", "Place", "Strong place match"), ("contains", "Address", "Partial address match"), ("token", "Place", "Approximate text match"), ("?", None, "Matched result")])
def test_labels(tier, source, want):
    assert geocode.match_label(tier, source) == want


def test_confidence_labels():
    assert [geocode.confidence_label(c) for c in ("High", "medium", "LOW", None)] == ["High confidence", "Good candidate", "Needs review", "Candidate"]


@pytest.mark.parametrize(("fields", "want"), [(["OBJECTID", "GlobalID", "NAME"], "GlobalID"), (["Shape", "SITE_ID", "OBJECTID"], "SITE_ID"), (["OBJECTID", "Shape"], None), ([], None), (["zone_guid_2", "thingid"], "thingid")])
def test_preferred_id_field(fields, want):
    assert mapping.preferred_id_field(fields) == want


def test_field_mapping_and_roles():
    found = mapping.map_fields(["Business Name", "SADDNO", "saddstr", "ZIP", "City"])
    assert (found["name"], found["number"], found["street"], found["postcode"], found["city"], found["unit"]) == ("Business Name", "SADDNO", "saddstr", "ZIP", "City", None)
    assert mapping.relate_key("OBJECTID", False) == "source_record_key" and mapping.relate_key("site_id", False) == "record_id"
    assert mapping.locator_roles(["number", "road", "country"]) == {"HouseNumber": "number", "StreetName": "road", "CountryCode": "country"}


def test_assembled_values_and_ids(spark):
    df = spark.createDataFrame([(" ", "12", "N", "Main", "x", "02139", "k1"), ("5 Oak", None, None, None, "9", None, None)], "addr string, number string, prefix string, street string, zip string, postcode string, OBJECTID string")
    fields = {"address": "addr", "number": "number", "prefix": "prefix", "street": "street"}
    got = df.select(mapping.assemble_address(df, fields).alias("a"), mapping.assemble_postcode(df, "zip").alias("p")).collect()
    assert [tuple(r) for r in got] == [("12 N Main", "02139"), ("5 Oak", "9")]
    ids = [r.record_id for r in mapping.with_record_ids(df, "OBJECTID").collect()]
    again = [r.record_id for r in mapping.with_record_ids(df.repartition(3), "OBJECTID").collect()]
    assert sorted(ids) == sorted(again) and len(set(ids)) == 2 and len(ids[0]) == 36
    preview = mapping.mapping_preview(df, fields | {"postcode": "zip", "unit": None}, "OBJECTID")
    assert preview["addresses"] == ["12 N Main", "5 Oak"] and any("row pointer" in w for w in preview["warnings"])


@pytest.mark.parametrize(("args", "want"), [((True, True, True, True), "map"), ((True, False, True, True), "custom"), ((False, True, True, True), "custom"), ((False, True, True, False), "none"), ((False, False, False, False), "none")])
def test_extent_source(args, want):
    assert rules.extent_source(*args) == want


def test_projection_countries_scales():
    assert [needs_projection(w) for w in (4326, 3857, None)] == [False, True, True]
    assert rules.country_of(Extent(-120, 36, -119, 37)) == "US" and rules.country_of(Extent(0, 0, 1, 1)) is None and rules.country_of(None) is None
    assert rules.point_min_scale("Address") == 6000 and rules.point_min_scale(None) == 25000 and rules.layer_label("base", "land_use") == "Base - Land Use"


def test_land_use_and_road_labels(spark):
    df = spark.createDataFrame([("garden", "primary", "A"), ("retail", "service", "B"), (None, "trunk", None)], "subtype string, class string, names_primary string")
    assert [r[0] for r in df.select(rules.land_use_class(F.col("subtype"))).collect()] == ["park", "commercial", None]
    assert rules.road_labels(df).count() == 1 and rules.road_labels(df, local=True).count() == 1


def test_family_counts(spark):
    df = spark.createDataFrame([("MULTIPOINT",), ("POINT",), ("LINESTRING",), ("MULTIPOLYGON",), (None,)], "geometry_type string")
    assert [tuple(r) for r in rules.family_counts(df).collect()] == [("line", 1), ("point", 2), ("polygon", 2)]


def test_options():
    with pytest.raises(ValueError):
        LinkOptions(max_distance_m=0)
    assert LinkOptions().nearby_only_m == 15 and LinkOptions(max_distance_m=10).nearby_only_m == 5 and LinkOptions(review_candidates=99).k == 25
    assert TraceOptions(max_rows=0).limit == 1 and BridgeOptions().theme == "places"
    assert LinkSummary(4, 1, 3, 1).percent == 25.0 and LinkSummary(0, 0, 0, 0).percent == 0.0


@pytest.mark.parametrize(("name", "want"), [("SNAPPY", "snappy"), ("Gzip", "gzip"), ("zstd", "zstd"), ("LZ4", "zstd"), ("", "zstd"), (None, "zstd")])
def test_codec(name, want):
    assert writers.codec(name) == want


def test_delimiters():
    assert [readers.sniff_delimiter(s) for s in ("a;b;c", "a,b\tc", '"a;b;c",d', "x|y", "one")] == [";", "\t", ",", "|", "\t"]


def test_release_list():
    assert readers.release_list('{"latest": "b", "releases": ["b", "a"]}') == {"latest": "b", "releases": ["b", "a"]}
    assert readers.release_list("broken", cached='{"releases": ["a"]}')["latest"] == "a"
    assert readers.release_list(None, override="x") == {"latest": "x", "releases": ["x"]}


def test_sql_functions(spark):
    from geoweft.functions import sql

    sql.register(spark)
    r = spark.sql("SELECT normalize_text('(Foo)  Bar') AS n, build_osm_url('OpenStreetMap', 'w1@2') AS u, build_osm_url('Esri', 'w1') AS e, jaro_winkler_similarity('martha', 'marhta') AS j, distance_m(0, 0, 0, 1) AS d").first()
    assert (r.n, r.u, r.e, round(r.j, 6), round(r.d)) == (" foo bar", "https://www.openstreetmap.org/way/1", None, 0.961111, 110540)


def test_layer_points(spark):
    import numpy as np

    from geoweft.functions import wkb

    area = wkb.encode(("POLYGON", [[np.array([(0, 0), (4, 0), (4, 2), (0, 0)], float)]]))
    df = spark.createDataFrame([("a", area), ("b", wkb.encode(("POINT", [np.array([[1.0, 2.0]])]))), ("c", None), ("d", b"\x01")], "id string, geometry binary")
    assert sorted((r.id, r.longitude, r.latitude) for r in mapping.layer_points(df).collect()) == [("a", 2.0, 1.0), ("b", 1.0, 2.0)]
    with pytest.raises(ValueError):
        mapping.layer_points(df, None)
