import json

from geoweft.operators.schema_drift import consistent_table, join_kinds, schema_changes, union_columns

SCHEMA = "dataset string, file_seq int, record_no int, id string, payload string, address_freeform string"


def records(spark, rows):
    return spark.createDataFrame([(d, s, n, i, p if p is None or isinstance(p, str) else json.dumps(p), "x") for d, s, n, i, p in rows], SCHEMA)


def changes(df):
    return sorted((r.dataset, r.file_seq, r.field, r.change_kind) for r in schema_changes(df).collect())


def file(seq, make, n=6, dataset="d"):
    return [(dataset, seq, k, f"i{k}", make(k)) for k in range(n)]


def test_each_kind_of_change(spark):
    rows = file(1, lambda k: {"id": f"i{k}", "a": k, "b": f"v{k}", "old": "s", "addresses": [{"post": f"{k}", "x": 1}]})
    rows += file(2, lambda k: {"id": f"i{k}", "a": f"{k}", "B": f"v{k}", "new": True, "addresses": [{"zip": f"{k}", "x": "1"}]})
    rows += file(3, lambda k: {"id": f"i{k}", "a": None, "B": f"v{k}", "new": None, "addresses": "[]"})
    rows += file(4, lambda k: {"id": f"i{k}", "a": 1.5 if k else 2, "B": f"v{k}", "new": 1 if k < 3 else None, "lists": [{"q": 1}]})
    assert changes(records(spark, rows)) == [
        ("d", 2, "B", "renamed"), ("d", 2, "a", "retyped"), ("d", 2, "addresses.x", "retyped"), ("d", 2, "addresses.zip", "renamed"), ("d", 2, "new", "added"), ("d", 2, "old", "removed"),
        ("d", 3, "addresses", "retyped"), ("d", 4, "addresses", "removed"), ("d", 4, "lists", "added"),
    ]


def test_renamed_list_hides_its_keys_and_minority_is_no_retype(spark):
    rows = file(1, lambda k: {"addr": [{"a": f"{k}"}], "n": k}) + file(2, lambda k: {"places": [{"a": f"{k}"}], "n": "x" if k < 3 else k})
    assert changes(records(spark, rows)) == [("d", 2, "places", "renamed")]


def test_values_elsewhere_are_no_renaming(spark):
    rows = file(1, lambda k: {"a": f"{k}"}) + file(2, lambda k: {"b": f"{k + 1}"}) + file(3, lambda k: {"c": {"b": f"{k + 1}"}})
    assert changes(records(spark, rows)) == [("d", 2, "a", "removed"), ("d", 2, "b", "added"), ("d", 3, "b", "removed"), ("d", 3, "c", "added")]


def test_edge_cases(spark):
    rows = [("d", 1, 0, "i", None), ("d", 1, 1, "i", ""), ("d", 1, 2, "i", "{broken"), ("d", 1, 3, "i", "[1]"), ("d", 1, 4, None, {"a": 1}), ("d", 2, 0, "i", {}), ("d", 2, 1, "i", {"a": 1}), (None, 1, 0, "i", {"z": 1}), ("d", None, 0, "i", {"z": 1}), ("e", 5, 0, "i", {"q": 1}), ("e", 7, 0, "i", {"r": 1})]
    df = records(spark, rows)
    assert changes(df) == []
    assert schema_changes(df.where("false")).count() == 0
    table = consistent_table(df)
    assert table.count() == len(rows)
    assert consistent_table(df.where("false")).count() == 0


def test_consistent_table_keeps_all_values(spark):
    rows = file(1, lambda k: {"name": f"n{k}", "size": k, "Dataset": "in"}) + file(2, lambda k: {"title": f"n{k}", "size": k + 0.5, "NAME": "both"}) + file(1, lambda k: {"name": "x", "size": "big"}, dataset="e")
    df = records(spark, rows)
    columns = {c: (n, k) for c, n, k in union_columns(df)}
    assert columns["name"] == ({None: ["name"], "d": ["name", "title"]}, "text") and columns["size"][1] == "text" and "NAME_2" in columns
    got = consistent_table(df).orderBy("dataset", "file_seq", "record_no").collect()
    assert [r.field_name for r in got] == [f"n{k}" for k in range(6)] * 2 + ["x"] * 6 and got[0].field_Dataset == "in" and got[6].field_size == "0.5"


def test_lattice():
    assert [join_kinds(*p) for p in ((None, "whole"), ("whole", "decimal"), ("text", "whole"), ("list", "object"), ("boolean", "boolean"))] == ["whole", "decimal", "text", "text", "boolean"]


def test_lists_of_objects_have_one_schema(spark):
    rows = file(1, lambda k: {"addresses": [{"post": f"{k}", "x": 1}], "tags": ["a"]}) + file(2, lambda k: {"addresses": [{"zip": f"{k}", "x": 2.5}, None], "tags": ["a"]})
    rows += file(3, lambda k: {"addresses": json.dumps([{"zip": k, "town": "T"}])}) + file(1, lambda k: {"addresses": None, "mixed": [1, {"q": 1}]}, dataset="e")
    got = consistent_table(records(spark, rows)).orderBy("dataset", "file_seq", "record_no").collect()
    assert [[e and e.asDict() for e in r.field_addresses] for r in (got[1], got[7], got[13])] == [
        [{"zip": "1", "x": 1.0, "town": None}], [{"zip": "1", "x": 2.5, "town": None}, None], [{"zip": "1", "x": None, "town": "T"}],
    ]
    assert got[18].field_addresses is None and got[18].field_mixed == '[1,{"q":1}]' and got[0].field_tags == '["a"]'


def test_strays_and_renames_of_one_dataset(spark):
    rows = file(1, lambda k: {"capacity": "many" if k == 0 else k, "conf": 1, "phones": ["1"], "flag": True}, 12)
    rows += file(2, lambda k: {"capacity": k, "confidence": 1, "phones": "none" if k == 0 else ["1"], "flag": True}, 12)
    rows += file(1, lambda k: {"capacity": 2.5 if k == 3 else k, "conf": k, "confidence": 2 * k}, 12, dataset="e")
    df = records(spark, rows)
    got = consistent_table(df)
    kinds = dict(got.dtypes)
    assert kinds["field_capacity"] == "double" and kinds["field_confidence"] == "bigint" and kinds["field_flag"] == "boolean" and kinds["strays"] == "map<string,string>"
    by = {(r.dataset, r.file_seq, r.record_no): r for r in got.collect()}
    assert by["d", 1, 0].strays == {"capacity": "many"} and by["d", 2, 0].strays == {"phones": "none"} and by["d", 1, 1].strays is None
    # conf was renamed in d alone; e has both
    one = by["e", 1, 3]
    assert (one.field_conf, one.field_confidence, one.field_capacity) == (3, 6, 2.5)
    assert {by["d", f, 4].field_confidence if by["d", f, 4].field_confidence is not None else by["d", f, 4].field_conf for f in (1, 2)} == {1}
    whole = consistent_table(records(spark, file(1, lambda k: {"n": 2.5 if k == 0 else "7" if k == 1 else k}, 5) + file(2, lambda k: {"n": k})))
    assert dict(whole.dtypes)["field_n"] == "double" and sorted(r.field_n for r in whole.collect()) == [0, 1, 2, 2, 2.5, 3, 3, 4, 4, 5, 7]
