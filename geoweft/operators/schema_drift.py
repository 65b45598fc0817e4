"""Schemas that drift between the files of a dataset: per-file schemas, ordered differences, one table of all records.

Input: one row per record with ``dataset``, ``file_seq``, ``record_no``, ``id`` and ``payload`` (the JSON object as the file
holds it). Rows with a null dataset or file_seq belong to no file; a null, damaged or non-object payload has no keys; an
empty table gives empty results; repeated records count as often as they occur for types and once for values.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweft.session import cut

# JSON type names, in lattice order. Whole numbers promote to decimal numbers; any other mix to text.
KINDS = ("text", "whole", "decimal", "boolean", "list", "object")

#: Share of a column's values up to which those that are no lists of objects don't keep it from being a column of such lists.
STRAY_SHARE = 0.05
#: Distinct field names of datasets that may come to the driver for the union schema; more raise an error.
MAX_FIELD_NAMES = 20_000


def json_kind(value: Column) -> Column:
    """Kind of a variant value, null for JSON null."""
    kind = F.schema_of_variant(value)
    return (
        F.when(kind.startswith("STRING"), "text").when(kind.startswith("BIGINT"), "whole").when(kind.startswith("DECIMAL") | kind.startswith("DOUBLE") | kind.startswith("FLOAT"), "decimal")
        .when(kind.startswith("BOOLEAN"), "boolean").when(kind.startswith("ARRAY"), "list").when(kind.startswith("OBJECT"), "object")
    )


def _exploded(df: DataFrame, value: str, key: str, out: str) -> DataFrame:
    """One row per member of the variant column: objects give their keys, lists null keys."""
    spark = df.sparkSession
    members = spark.tvf.variant_explode(F.col(value).outer()).select(F.col("key").alias(key), F.col("value").alias(out))
    return df.lateralJoin(members)


def field_values(records: DataFrame) -> DataFrame:
    """dataset, file_seq, record_no, id, list_key, key, kind, value_hash: one row per key of each record; list_key is null for the
    record's own keys and the key of the list for keys inside the objects of a list (one row per key and record, elements in order)."""
    base = records.where(F.col("dataset").isNotNull() & F.col("file_seq").isNotNull()).select("dataset", F.col("file_seq").cast("long").alias("file_seq"), "record_no", "id", F.try_parse_json(F.col("payload")).alias("_v"))
    base = base.where(F.schema_of_variant(F.col("_v")).startswith("OBJECT"))
    own = _exploded(base, "_v", "key", "_value").drop("_v").withColumn("kind", json_kind(F.col("_value")))
    own = own.withColumn("_json", F.when(F.col("kind").isNotNull(), F.to_json(F.col("_value"))))
    top = own.select("dataset", "file_seq", "record_no", "id", F.lit(None).cast("string").alias("list_key"), "key", "kind", F.xxhash64("_json").alias("value_hash"))
    lists = own.where((F.col("kind") == "list") & F.col("_json").contains("{")).withColumnRenamed("key", "list_key").select("dataset", "file_seq", "record_no", "id", "list_key", "_value")
    elements = lists.lateralJoin(lists.sparkSession.tvf.variant_explode(F.col("_value").outer()).select(F.col("pos").alias("_pos"), F.col("value").alias("_element"))).drop("_value")
    elements = elements.where(F.schema_of_variant(F.col("_element")).startswith("OBJECT"))
    inner = _exploded(elements, "_element", "key", "_value").drop("_element").withColumn("kind", json_kind(F.col("_value")))
    inner = inner.withColumn("_json", F.when(F.col("kind").isNotNull(), F.to_json(F.col("_value"))))
    inner = inner.select("dataset", "file_seq", "record_no", "id", "list_key", "key", "kind", F.xxhash64("_pos", "_json").alias("value_hash"))
    return top.unionByName(inner)


def file_schemas(values: DataFrame) -> DataFrame:
    """One row per file and field: n_<kind> counts, n_values (non-null) and the prevailing kind (null if all are null)."""
    counts = values.groupBy("dataset", "file_seq", "list_key", "key").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS])
    total = sum((F.col(f"n_{k}") for k in KINDS), F.lit(0))
    most = F.greatest(*[F.col(f"n_{k}") for k in KINDS])
    prevailing = F.coalesce(*[F.when((F.col(f"n_{k}") == most) & (most > 0), k) for k in KINDS])
    return counts.withColumn("n_values", total).withColumn("prevailing", prevailing)


def _label(list_key: Column, key: Column) -> Column:
    return F.concat_ws(".", list_key, key)


def schema_changes(records: DataFrame) -> DataFrame:
    """(dataset, file_seq, field, change_kind, old_field, old_kind, new_kind), one row per change of a file against the file
    before it (file_seq - 1); a file without that file before it has no changes.

    added, removed: the key is in one file only. retyped: more than half of the non-null values are of another kind than the
    prevailing one before; a file of nulls alone tells none. renamed: of the ids with a value under both, more than half have
    the same value under a key that is gone and a key that is new on the same level; each key takes part in one renaming, the
    one with the most equal ids (ties by name). Keys inside a list's objects count if the list is a list under the same key
    in both files.
    """
    values = cut(field_values(records))
    fields = cut(file_schemas(values))
    files = fields.select("dataset", "file_seq").distinct()
    pairs = files.join(files.select("dataset", (F.col("file_seq") + 1).alias("file_seq")), ["dataset", "file_seq"])
    lists = fields.where(F.col("list_key").isNull() & (F.col("prevailing") == "list"))
    lists = lists.select("dataset", "file_seq", F.col("key").alias("list_key"))
    kept_lists = lists.join(lists.select("dataset", (F.col("file_seq") + 1).alias("file_seq"), "list_key"), ["dataset", "file_seq", "list_key"])

    now = fields.select("dataset", "file_seq", F.coalesce("list_key", F.lit("")).alias("_l"), F.col("list_key").isNull().alias("_own"), "key", F.lit(True).alias("_now"), F.col("prevailing").alias("new_kind"), F.col("n_values").alias("_n"), *[F.col(f"n_{k}").alias(f"_n_{k}") for k in KINDS])
    was = fields.select("dataset", (F.col("file_seq") + 1).alias("file_seq"), F.coalesce("list_key", F.lit("")).alias("_l"), F.col("list_key").isNull().alias("_own"), "key", F.lit(True).alias("_was"), F.col("prevailing").alias("old_kind"))
    on = ["dataset", "file_seq", "_own", "_l", "key"]
    both = now.join(was, on, "full").join(pairs, ["dataset", "file_seq"], "left_semi")
    kept_lists = kept_lists.select("dataset", "file_seq", F.col("list_key").alias("_l"), F.lit(True).alias("_kept"))
    # the table of differences is small beside the records; written once, it keeps the plans below short
    comparable = cut(both.join(kept_lists, ["dataset", "file_seq", "_l"], "left").where(F.col("_own") | F.col("_kept")).drop("_kept"))
    of_old = F.coalesce(*[F.when(F.col("old_kind") == k, F.col(f"_n_{k}")) for k in KINDS])
    retyped = comparable.where(F.col("_now") & F.col("_was") & F.col("old_kind").isNotNull() & (2 * (F.col("_n") - of_old) > F.col("_n")))
    gone = comparable.where(F.col("_now").isNull()).select(*on[:4], F.col("key").alias("old_key"), F.col("old_kind"))
    new = comparable.where(F.col("_was").isNull()).select(*on[:4], F.col("key").alias("new_key"), F.col("new_kind"))
    renamed = cut(_renamings(values, gone, new))

    def shaped(df: DataFrame, key: str, kind: str, old: Column | None = None) -> DataFrame:
        label = F.when(F.col("_own"), F.col(key)).otherwise(_label(F.col("_l"), F.col(key)))
        have = df.columns
        return df.select("dataset", "file_seq", label.alias("field"), F.lit(kind).alias("change_kind"), (old if old is not None else F.lit(None).cast("string")).alias("old_field"),
                         (F.col("old_kind") if "old_kind" in have else F.lit(None).cast("string")).alias("old_kind"), (F.col("new_kind") if "new_kind" in have else F.lit(None).cast("string")).alias("new_kind"))

    old_label = F.when(F.col("_own"), F.col("old_key")).otherwise(_label(F.col("_l"), F.col("old_key")))
    added = new.join(renamed.select(*on[:4], "new_key"), [*on[:4], "new_key"], "left_anti")
    removed = gone.join(renamed.select(*on[:4], "old_key"), [*on[:4], "old_key"], "left_anti")
    return (
        shaped(added, "new_key", "added").unionByName(shaped(removed, "old_key", "removed"))
        .unionByName(shaped(renamed, "new_key", "renamed", old_label)).unionByName(shaped(retyped, "key", "retyped"))
    )


def _renamings(values: DataFrame, gone: DataFrame, new: DataFrame) -> DataFrame:
    level = ["dataset", "file_seq", "_own", "_l"]
    # only levels with both a gone and a new key can hold a renaming: the values of the others aren't read
    gone = gone.join(new.select(*level).distinct(), level, "left_semi")
    new = new.join(gone.select(*level).distinct(), level, "left_semi")
    known = values.where(F.col("kind").isNotNull() & F.col("id").isNotNull())
    # one value for a record that is repeated in a file: list elements fold into one hash in order
    per_id = known.groupBy("dataset", "file_seq", F.coalesce("list_key", F.lit("")).alias("_l"), F.col("list_key").isNull().alias("_own"), "key", "id", "record_no").agg(F.sum(F.col("value_hash").cast("decimal(20,0)")).alias("_h"))
    old_values = per_id.withColumn("file_seq", F.col("file_seq") + 1).withColumnRenamed("key", "old_key").join(gone.drop("old_kind"), [*level, "old_key"], "left_semi")
    new_values = per_id.withColumnRenamed("key", "new_key").join(new.drop("new_kind"), [*level, "new_key"], "left_semi")
    old_values = old_values.groupBy(*level, "old_key", "id").agg(F.min_by("_h", "record_no").alias("_a"))
    new_values = new_values.groupBy(*level, "new_key", "id").agg(F.min_by("_h", "record_no").alias("_b"))
    score = old_values.join(new_values, [*level, "id"]).groupBy(*level, "old_key", "new_key").agg(F.count("*").alias("_both"), F.count_if(F.col("_a") == F.col("_b")).alias("_equal"))
    score = score.where(2 * F.col("_equal") > F.col("_both"))
    best_new = Window.partitionBy(*level, "old_key").orderBy(F.desc("_equal"), "new_key")
    best_old = Window.partitionBy(*level, "new_key").orderBy(F.desc("_equal"), "old_key")
    score = score.withColumn("_i", F.row_number().over(best_new)).withColumn("_j", F.row_number().over(best_old)).where("_i = 1 and _j = 1")
    return score.select(*level, "old_key", "new_key").join(gone, [*level, "old_key"]).join(new, [*level, "new_key"])


def join_kinds(a: str | None, b: str | None) -> str | None:
    """Least upper bound in the lattice: null below all, whole below decimal, text above all."""
    if a is None or b is None or a == b:
        return a or b
    return "decimal" if {a, b} == {"whole", "decimal"} else "text"


Names = dict[str | None, list[str]]


def _renames(records: DataFrame) -> set[tuple[str, str, str]]:
    """(dataset, old field, new field) of all renamings."""
    return {(r.dataset, r.old_field, r.field) for r in schema_changes(records).where("change_kind = 'renamed'").select("dataset", "old_field", "field").distinct().collect()}


def file_kind(fields: DataFrame) -> DataFrame:
    """fields with ``file_kind``: the prevailing kind of a file's field; decimal if whole and decimal numbers are both there, as
    a decimal number is none of the strays that a file may hold."""
    both = F.col("prevailing").isin("whole", "decimal") & (F.col("n_whole") > 0) & (F.col("n_decimal") > 0)
    return fields.withColumn("file_kind", F.when(both, "decimal").otherwise(F.col("prevailing")))


def _folded(fields: DataFrame, renames: set[tuple[str, str, str]]) -> list[tuple[str, Names, str]]:
    """(column, names by dataset, kind) of the union of all files' fields of one level. Under None are the names of the datasets
    that aren't listed.

    The kinds that the files' schemas give a field are counted per dataset and key in tasks, so that the fold through the
    lattice sees each distinct kind of a key once.
    """
    seen = file_kind(fields).groupBy("dataset", "key").agg(F.count("*").alias("files"), F.collect_set("file_kind").alias("kinds")).limit(MAX_FIELD_NAMES + 1).collect()
    if len(seen) > MAX_FIELD_NAMES:
        raise ValueError(f"more than {MAX_FIELD_NAMES} field names")
    touched = sorted({n for _, a, b in renames for n in (a, b)})
    together = set()
    if touched:
        small = fields.where(F.col("key").isin(touched)).select("dataset", "file_seq", "key")
        pairs = small.join(small.withColumnRenamed("key", "other"), ["dataset", "file_seq"]).where("key < other")
        together = {(r.dataset, r.key, r.other) for r in pairs.select("dataset", "key", "other").distinct().collect()}
    files: dict[str, int] = {}
    group: dict[tuple[str, str], list[str]] = {}
    for r in seen:
        files[r.key] = files.get(r.key, 0) + r.files
        group[r.dataset, r.key] = [r.key]
    for d, a, b in sorted(renames):
        left, right = group.get((d, a)), group.get((d, b))
        if left and right and left is not right and not any((d, min(x, y), max(x, y)) in together for x in left for y in right):
            merged = sorted(left + right)
            for n in merged:
                group[d, n] = merged
    best = lambda names: min(names, key=lambda n: (-files[n], n))
    of: dict[str, Names] = {}
    kinds: dict[str, str | None] = {}
    for r in sorted(seen, key=lambda r: (r.dataset, r.key)):
        names = group[r.dataset, r.key]
        column = best(names)
        if names != [column]:
            of.setdefault(column, {})[r.dataset] = names
            if r.key != column:  # here the name is a writing of another column
                of.setdefault(r.key, {})[r.dataset] = []
        else:
            of.setdefault(column, {})
        for k in r.kinds:
            kinds[column] = join_kinds(kinds.get(column), k)
        kinds.setdefault(column, None)
    out, taken = [], set()
    for base in sorted((c for c in of if c in kinds), key=lambda c: (-files[c], c)):
        column, i = base, 2
        while column.lower() in taken:
            column, i = f"{base}_{i}", i + 1
        taken.add(column.lower())
        out.append((column, {None: [base], **of[base]}, kinds[base] or "text"))
    return out


def union_columns(records: DataFrame, renames: set[tuple[str, str, str]] | None = None) -> list[tuple[str, Names, str]]:
    """(column, names by dataset, kind) of the union schema over all datasets and files.

    Names that were renamed into each other in a dataset are one column there, unless some file of it has both; the column has
    the one of them that most files of all datasets use. Each file says one kind of a field, the prevailing one; the kind of
    the column is the least upper bound of the files' kinds. Only the distinct names with their kinds, and the pairs seen
    in one file, come to the driver, at most MAX_FIELD_NAMES names of datasets.
    """
    fields = cut(file_schemas(field_values(records)).where("list_key is null"))
    return _folded(fields, _renames(records) if renames is None else renames)


def _member(value: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(value, "$[\"" + name.replace("\\", "\\\\").replace('"', '\\"') + "\"]", kind)


def _value(names: Names, read: Callable[[str], Column]) -> Column:
    """The value of a column in a row: under the names of the row's dataset the first that has one."""
    def first(keys: list[str]) -> Column:
        return F.coalesce(*[read(n) for n in keys]) if keys else F.lit(None)

    out = first(names[None])
    for dataset, keys in sorted((d, k) for d, k in names.items() if d is not None):
        out = F.when(F.col("dataset") == dataset, first(keys)).otherwise(out)
    return out


def _text_of(names: Names) -> Column:
    return _value(names, lambda n: _member(F.col("_v"), n, "string")).cast("string")


def _elements(names: Names) -> Column:
    """The list of a column, as array<variant>; a text that holds a list in JSON is that list."""
    return F.try_variant_get(F.try_parse_json(_text_of(names)), "$", "array<variant>")


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _are_objects(names: Names) -> Column:
    """True for a list of objects and nulls."""
    return F.coalesce(F.forall(_elements(names), lambda e: F.coalesce(_is_object(e), F.lit(True)) | F.is_variant_null(e)), F.lit(False))


def inner_columns(records: DataFrame, columns: list[tuple[str, Names, str]], renames: set[tuple[str, str, str]]) -> dict[str, list[tuple[str, Names, str]]]:
    """For each column of lists of objects, as lists or as texts of JSON, the union schema of the objects: the inner keys with their
    renames and kinds folded as union_columns() does it. At most STRAY_SHARE of its values may be something else."""
    maybe = [(i, c, names) for i, (c, names, kind) in enumerate(columns) if kind in ("list", "text")]
    parsed = cut(records.where("dataset is not null and file_seq is not null").select("dataset", F.col("file_seq").cast("long").alias("file_seq"), F.try_parse_json("payload").alias("_v")))
    tests = []
    for i, _, names in maybe:
        has = _text_of(names).isNotNull()
        tests += [F.count_if(has).alias(f"all_{i}"), F.count_if(has & ~_are_objects(names)).alias(f"other_{i}"), F.count_if(has & F.exists(_elements(names), _is_object)).alias(f"objects_{i}")]
    said = parsed.agg(*tests).first() if tests else None
    out = {}
    for i, column, names in maybe:
        if said[f"other_{i}"] > STRAY_SHARE * said[f"all_{i}"] or not said[f"objects_{i}"]:
            continue
        elements = parsed.select("dataset", "file_seq", F.explode(_elements(names)).alias("_e")).where(_is_object(F.col("_e")))
        inner = _exploded(elements, "_e", "key", "_value").withColumn("kind", json_kind(F.col("_value"))).where("key is not null").select("dataset", "file_seq", F.lit(column).alias("list_key"), "key", "kind")
        heads = sorted({n + "." for keys in names.values() for n in keys})
        own = {(d, a[len(h) :], b[len(g) :]) for d, a, b in renames for h in heads for g in heads if a.startswith(h) and b.startswith(g)}
        out[column] = _folded(cut(file_schemas(inner)), own)
    return {c: fields for c, fields in out.items() if fields}


def _shaper(fields: list[tuple[str, Names, str]]) -> Callable[[Column], Column]:
    def shaped(element: Column) -> Column:
        values = [_value(names, lambda n, kind=kind: _member(element, n, _SQL.get(kind, "string"))).cast(_SQL.get(kind, "string")).alias(name) for name, names, kind in fields]
        return F.when(_is_object(element), F.struct(*values))

    return shaped


_SQL = {"whole": "bigint", "decimal": "double", "boolean": "boolean"}


def consistent_table(records: DataFrame) -> DataFrame:
    """All records in one schema: dataset, file_seq, record_no, id, a column field_<name> per column of union_columns, and strays.

    Whole numbers are bigint, decimal numbers double, booleans boolean. Lists of objects are array<struct> of the schema of
    inner_columns, also where some files hold them as texts of JSON. Text, other lists and objects are strings (the latter two
    JSON). strays (map of strings, null for none) holds the values of a record that its columns' types can't, as the file has
    them, so no value is lost; numbers and booleans that a file holds as their texts are cast. No record is dropped: a
    damaged payload leaves its fields null.
    """
    renames = _renames(records)
    columns = union_columns(records, renames)
    nested = inner_columns(records, columns, renames)

    out, strays = [], []
    for name, names, kind in columns:
        text = _text_of(names)
        if name in nested:
            fits = _are_objects(names)
            value = F.when(fits, F.transform(_elements(names), _shaper(nested[name])))
        else:
            value = _value(names, lambda n, kind=kind: _member(F.col("_v"), n, _SQL.get(kind, "string"))).cast(_SQL.get(kind, "string"))
            fits = value.isNotNull()
            if kind == "list":
                fits = F.try_variant_get(F.try_parse_json(text), "$", "array<variant>").isNotNull()
            elif kind == "object":
                fits = F.coalesce(_is_object(F.try_parse_json(text)), F.lit(False))
            elif kind == "whole":  # 2.5 is no whole number
                fits = fits & (text.try_cast("double") == value)
            if kind in ("list", "object", "whole"):
                value = F.when(fits, value)
        out.append(value.alias(f"field_{name}"))
        if kind != "text" or name in nested:
            strays.append(F.when(text.isNotNull() & ~F.coalesce(fits, F.lit(False)), F.struct(F.lit(name).alias("key"), text.alias("value"))))
    found = F.array_compact(F.array(*strays)) if strays else F.array().cast("array<struct<key:string,value:string>>")
    out.append(F.when(F.size(found) > 0, F.map_from_entries(found)).alias("strays"))
    parsed = records.withColumn("_v", F.try_parse_json(F.col("payload")))
    return parsed.select("dataset", F.col("file_seq").cast("long").alias("file_seq"), F.col("record_no").cast("long").alias("record_no"), "id", *out)
