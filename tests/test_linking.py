import numpy as np
import pytest
from pyspark.sql import functions as F

from geoweft.functions import wkb
from geoweft.operators import linking, trace
from geoweft.options import BridgeOptions, Extent, LinkOptions, TraceOptions
from geoweft.streaming.link_stream import link_stream

STEP = 10 / 110540.0
USER = "record_id string, source_record_key string, name string, address string, city string, state string, postcode string, longitude double, latitude double"


def users(spark, *rows):
    return spark.createDataFrame([(r[0], f"k{r[0]}", r[1], r[2], "Town", "QA", r[3], r[4], r[5]) for r in rows], USER)


def point(lon, lat):
    return wkb.encode(("POINT", [np.array([[lon, lat]])]))


PLACE = "id string, names struct<primary:string>, addresses array<struct<freeform:string,locality:string,region:string,postcode:string,country:string>>, geometry binary, bbox struct<xmin:float,xmax:float,ymin:float,ymax:float>"


def place(i, name, street, lon, lat):
    return (i, (name,), [(street, "Town", "QA", "00942-1", "QX"), (None, "Town", " ", None, None)] if street else [], point(lon, lat), (lon, lon, lat, lat))


def test_places_end_to_end(spark):
    u = users(spark, ("1", "Olive Grill", "12 Main St", "00942", 10.0, 50.0), ("2", None, "5 Oak Ave", None, 10.1, 50.0), ("3", "!!!", None, None, 10.2, 50.0), ("4", "Far Away", "9 Elm", None, 10.3, 50.0), ("1", "Olive Grill", "12 Main St", "00942", 10.0, 50.0))
    t = spark.createDataFrame([place("a", "Olive Grill", "12 Main St", 10.0, 50.0 + STEP), place("b", "Olive Gril", "14 Main St", 10.0, 50.0 + 2 * STEP), place("c", "Bakery", None, 10.1, 50.0 + STEP), place("d", "Bank", "1 Hill", 10.2, 50.0), place("z", None, None, 10.2, 50.0)], PLACE)
    # the extent of the records isn't widened by the radius unless asked for
    assert linking.link(u, t, LinkOptions()).candidates.where("record_id = '1'").count() == 0
    r = linking.link(u, t, LinkOptions(buffer_extent=True), BridgeOptions(update_time="t"))
    # a record that is delivered twice has each candidate twice in its one pool and one winner
    assert r.candidates.where("record_id = '1'").count() == 4 and r.accepted.where("record_id = '1'").count() == 1
    c = {(x.record_id, x.overture_id): x for x in sorted(r.candidates.collect(), key=lambda x: -x.candidate_rank)}
    assert c["1", "a"].candidate_rank == 1 and c["1", "a"].accepted and c["1", "a"].match_strategy == "name_address" and not c["1", "b"].accepted
    assert c["2", "c"].match_strategy == "nearby_only" and c["2", "c"].accepted and abs(c["2", "c"].gers_match_score - 100 * (1 - 10 / 75)) < 1e-6
    assert c["3", "d"].name_similarity == 0 or not c["3", "d"].accepted  # punctuation alone normalises to a space, which isn't empty
    out = {x.record_id: x for x in r.output.collect()}
    assert r.output.count() == 5 and out["1"].gers_id == "a" and out["4"].gers_link_review == "unmatched" and {x.gers_link_review for x in out.values()} <= {"linked", "weak", "unmatched"}
    assert all((x.gers_link_review == "unmatched") == (x.gers_id is None) for x in out.values())
    assert r.summary.input_count == 5 and r.summary.linked == r.summary.input_count - r.summary.unmatched
    bridge = r.bridge.collect()
    assert [b.record_id for b in bridge] == sorted(b.record_id for b in bridge) and len(bridge[0]) == 14 and bridge[0].source_layer == "Local layer" and bridge[0].overture_release == "unknown"
    assert linking.strategy_counts(r.candidates).count() == 2
    assert linking.signal_coverage(linking.user_records(u), r.candidates).first().with_name == 4
    assert not linking.place_candidates(linking.user_records(u), linking.place_targets(t), LinkOptions(allow_nearby_only=False)).where("record_id = '2' and accepted").count()


def test_ranks_are_contiguous_and_limited(spark):
    u = users(spark, *[(str(i), "Grill", "1 A", None, 10.0, 50.0) for i in range(3)])
    t = spark.createDataFrame([place(f"p{j}", "Grill", "1 A", 10.0, 50.0) for j in range(9)], PLACE)
    a = linking.place_candidates(linking.user_records(u), linking.place_targets(t), LinkOptions(review_candidates=4))
    rows = sorted((r.record_id, r.candidate_rank, r.overture_id) for r in a.collect())
    assert rows == [(str(i), k + 1, f"p{k}") for i in range(3) for k in range(4)]
    again = linking.place_candidates(linking.user_records(u.repartition(5)), linking.place_targets(t.repartition(7)), LinkOptions(review_candidates=4))
    assert sorted((r.record_id, r.candidate_rank, r.overture_id) for r in again.collect()) == rows


def test_addresses(spark):
    u = users(spark, ("1", "", "1939 E OLIVE AVE", "93710-5109", 10.0, 50.0), ("2", "", "5071 E BELMONT AVE A", "93710", 10.1, 50.0), ("3", "", "7 Elm", "93710", 10.2, 50.0))
    rows = [("a", "1939", "E OLIVE AVE", None, "93710", 10.0, 50.0), ("b", "5071", "E BELMONT AVE", None, "93710", 10.1, 50.0), ("c", None, "7 Elm", None, None, 10.2, 50.0)]
    t = spark.createDataFrame([(i, n, s, x, p, point(lon, lat)) for i, n, s, x, p, lon, lat in rows], "id string, house_number string, road string, unit string, postcode string, geometry binary")
    got = {r.record_id: r for r in linking.address_candidates(linking.user_records(u), linking.address_targets(t)).collect()}
    assert got["1"].match_strategy == "exact_address" and got["1"].accepted and got["2"].match_strategy == "address" and got["2"].accepted
    assert got["3"].house_number_match is None and got["3"].accepted is None
    assert linking.linked_output(linking.user_records(u), linking.address_candidates(linking.user_records(u), linking.address_targets(t))).where("gers_id is null").count() == 1
    for bad in (["id", "number", "geometry"], ["id", "street", "geometry"]):
        with pytest.raises(ValueError):
            linking.address_targets(spark.createDataFrame([], ", ".join(f"{c} {'binary' if c == 'geometry' else 'string'}" for c in bad)))
    with pytest.raises(ValueError):
        linking.place_targets(spark.createDataFrame([], "id string, geometry binary"))


@pytest.mark.parametrize("columns", ["id string, name string, address_freeform string, longitude double, latitude double", "id string, name_primary string, street string, city string, zip string, longitude double, latitude double"])
def test_flat_targets(spark, columns):
    row = ("a", "Grill", "1 A", *(["Town", "12345-1"] if "zip" in columns else []), 10.0, 50.0)
    r = linking.place_targets(spark.createDataFrame([row], columns)).first()
    assert (r.t_name, r.t_street) == ("grill", "1 a") and ("12345" in r.t_full) == ("zip" in columns) and "12345 1" not in r.t_full


def test_user_records_are_defensive(spark):
    raw = spark.createDataFrame([("1", "x", "10", "50"), ("2", "x", "abc", "50"), (None, "x", "1", "1"), ("3", "x", None, "1")], "RECORD_ID string, Name string, longitude string, latitude string")
    rows = linking.user_records(raw).collect()
    assert len(rows) == 1 and rows[0].address is None and rows[0].longitude == 10.0
    with pytest.raises(ValueError):
        linking.link(raw.where("false"), raw)


def test_bbox_filter_reaches_scan(spark, tmp_path):
    spark.createDataFrame([place("a", "x", "1", 10.0, 50.0), place("b", "x", "1", 20.0, 50.0)], PLACE).write.parquet(str(tmp_path / "p"))
    t = linking.place_targets(spark.read.parquet(str(tmp_path / "p")), Extent(9, 49, 11, 51))
    assert t.count() == 1
    plan = t._jdf.queryExecution().executedPlan().toString()
    assert "bbox.xmin" in plan and "PushedFilters" in plan


def test_review_and_relate(spark):
    out = spark.createDataFrame([("1", "g", 75.0), ("2", None, None), ("3", " ", 90.0), ("4", "h", 80.0), ("5", "i", 72.0)], "record_id string, gers_id string, gers_match_score double")
    assert sorted(r.record_id for r in linking.review_unmatched(out).collect()) == ["2", "3"]
    assert sorted(r.record_id for r in linking.review_weak(out).collect()) == ["1", "5"]
    source = spark.createDataFrame([("1", "a"), ("1", "b"), ("9", "c"), ("'", "d")], "key string, v string")
    keys = spark.createDataFrame([("1",), ("'",), (" ",), (None,)], "key string")
    assert sorted(r.v for r in linking.review_source_keys(source, "key", keys).collect()) == ["a", "b", "d"]
    assert linking.review_source_keys(source, "key", keys.where("false")).count() == 0
    twice = out.withColumn("gers_link_review", F.lit("x")).unionByName(out.limit(1).withColumn("gers_match_score", F.lit(99.0)).withColumn("gers_link_review", F.lit("x")))
    assert linking.relate(source, "key", twice).count() == 4


def test_trace(spark):
    ids = trace.trace_ids(spark.createDataFrame([("abc-1",), ("ABC-1",), ("abc-2",), (" ",), (None,)], "id string"))
    assert sorted(r.gers_id for r in ids.collect()) == ["ABC-1", "abc-2"]
    bridge = spark.createDataFrame([("abc-2", "w1182486582@1", "2024", "OpenStreetMap", "places", "place"), ("abc-2", "N42x", "2024", "openstreetmap", "places", "place"), ("abc-2", "1", "2024", "Esri", "places", "place"), ("abc-2", "1", "2024", None, "places", "place"), ("abc-2", "1", "2024", "Microsoft", "base", "land"), ("q", "1", "2024", "Esri", "places", "place")], "id string, record_id string, update_time string, dataset string, theme string, type string")
    got = trace.trace_sources(ids, bridge)
    rows = trace.enrich_trace(got).collect()
    assert [r.dataset for r in rows] == ["Esri", "OpenStreetMap", "openstreetmap", None]
    assert rows[1].source_url == "https://www.openstreetmap.org/way/1182486582" and rows[1].edit_url == "https://www.openstreetmap.org/edit?way=1182486582"
    assert rows[2].source_url == rows[2].edit_url == "https://www.openstreetmap.org/edit?node=42" and rows[0].edit_url is None and rows[3].edit_platform == "Unknown source"
    assert trace.enrich_trace(trace.enrich_trace(got)).columns == trace.enrich_trace(got).columns
    assert [tuple(r) for r in trace.dataset_counts(got).collect()] == [("OpenStreetMap", 2), ("Esri", 1)] and trace.dataset_summary(got).startswith("OpenStreetMap: 2")
    assert trace.trace_sources(ids, bridge, TraceOptions(max_rows=1)).count() == 1 and trace.trace_sources(ids.where("false"), bridge).count() == 0


def test_stream(spark, tmp_path):
    u = users(spark, ("1", "Grill", "1 A", None, 10.0, 50.0), ("2", "Else", "1 B", None, 11.0, 50.0))
    u.write.parquet(str(tmp_path / "in"))
    t = linking.place_targets(spark.createDataFrame([place("a", "Grill", "1 A", 10.0, 50.0)], PLACE))
    q = link_stream(spark.readStream.schema(u.schema).parquet(str(tmp_path / "in")), t, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted((r.record_id, r.gers_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("1", "a"), ("2", None)]
