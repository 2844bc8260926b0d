"""Problem 2: columns, types and versions that change from file to file.

Each file's schema is inferred as a tagged union: per dotted path the set of JSON types of its non-null values
(number, string, boolean, array). Parallel schemas are fused over the quantity that a name stands for (the aliases of
the whole table), keeping every alternative name and type; a quantity with conflicting types is split into typed
branches beside a canonical conversion, and each alternative that appears is reported as a change.

Defined results: a line that is no JSON object adds no columns and no row; repeated lines change nothing; null or unreadable
aliases tie nothing; a name tied to several quantities belongs to the first in order; a file without lines has no
columns; the first file of a dataset has no changes; a missing version is that of the file before; an all-null column
has no type and so is never retyped; repeated file rows count once; empty tables give no rows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "array"}


def flatten(o: dict, prefix: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths of a JSON object's leaves; an empty object is a null leaf."""
    for k, v in o.items():
        if isinstance(v, dict) and v:
            yield from flatten(v, f"{prefix}{k}.")
        else:
            yield prefix + k, None if isinstance(v, dict) else v


def _object(line: str | None) -> dict | None:
    try:
        o = json.loads(line) if line else None
    except ValueError:
        return None
    return o if isinstance(o, dict) else None


def _schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen: dict[tuple[int, str, str | None], int] = {}
        for file_id, payload in zip(b["file_id"], b["payload"]):
            for path, v in flatten(_object(payload) or {}):
                key = (file_id, path, TYPES.get(type(v)))
                seen[key] = seen.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in seen.items()], columns=["file_id", "name", "json_type", "n"])


def file_schemas(rows: DataFrame) -> DataFrame:
    """(file_id, name, types, n): the tagged union of each file, combined per batch before the shuffle."""
    part = rows.where("file_id is not null").select("file_id", "payload").mapInPandas(_schemas, "file_id long, name string, json_type string, n long")
    return part.groupBy("file_id", "name").agg(F.sort_array(F.collect_set("json_type")).alias("types"), F.sum("n").alias("n_values"))


def alias_pairs(files: DataFrame) -> DataFrame:
    """(name, quantity) that at least one file's aliases tie."""
    m = F.from_json("column_aliases", "map<string,string>")
    e = files.where("column_aliases is not null").select(F.explode(m).alias("quantity", "v"))
    names = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>")).otherwise(F.array("v"))
    return e.select("quantity", F.explode(names).alias("name")).where("name is not null").groupBy("name").agg(F.min("quantity").alias("quantity"))


def plain_version(v: Column) -> Column:
    """One writing per version: no blanks, no leading v, no trailing zero parts after the second."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(v)), r"^(?:version|v)\.?\s*", ""), r"\.")
    ints = F.transform(parts, lambda x: F.coalesce(x.try_cast("int").cast("string"), x))
    return F.when(F.trim(v) == "", F.lit(None)).otherwise(F.regexp_replace(F.array_join(ints, "."), r"^([^.]+(?:\.[^.]+)*?)(?:\.0)+$", "$1"))


#: Numbers of files that one block of a dataset's order spans.
FILES = 4096


def _ordered(files: DataFrame) -> DataFrame:
    """Each file with the one before and after it and the version before it.

    A dataset's files are ordered in blocks of file numbers; only the blocks' ends meet per dataset.
    """
    one = files.select("dataset_id", "file_no", "file_id", "version").where("file_id is not null").distinct()
    one = one.withColumn("own", plain_version(F.col("version"))).withColumn("b", F.coalesce(F.floor(F.col("file_no") / FILES), F.lit(-1 << 40).cast("long")))
    w, at = Window.partitionBy("dataset_id", "b").orderBy("file_no", "file_id"), F.struct("file_no", "file_id")
    told = F.when(F.col("own").isNotNull(), at)
    ends = one.groupBy("dataset_id", "b").agg(F.min_by("file_id", at).alias("first_id"), F.max_by("file_id", at).alias("last_id"), F.max_by("own", told).alias("last_v"))
    d = Window.partitionBy("dataset_id").orderBy("b")
    ends = ends.select(
        F.col("dataset_id").alias("_d"), F.col("b").alias("_b"), F.lag("last_id").over(d).alias("id_before"), F.lead("first_id").over(d).alias("id_after"),
        F.last("last_v", ignorenulls=True).over(d.rowsBetween(Window.unboundedPreceding, -1)).alias("v_before"),
    )
    x = one.withColumns({"in_block": F.last("own", ignorenulls=True).over(w), "lag_id": F.lag("file_id").over(w), "lead_id": F.lead("file_id").over(w)})
    x = x.withColumn("lag_v", F.last("own", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.join(ends, F.col("dataset_id").eqNullSafe(F.col("_d")) & (F.col("b") == F.col("_b")), "left")
    return x.select(
        "dataset_id", "file_id", "file_no", F.coalesce("in_block", "v_before").alias("v"), F.coalesce("lag_id", "id_before").alias("prev_id"), F.coalesce("lead_id", "id_after").alias("next_id"),
        F.coalesce("lag_v", "v_before").alias("prev_v"),
    )


def schema_changes(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(file_id, column_name, change_kind, detail): each file against the file before it in its dataset."""
    order = _ordered(files)
    cols = file_schemas(rows).join(alias_pairs(files), "name", "left").withColumn("quantity", F.coalesce("quantity", "name"))
    cols = cols.join(order.select("file_id", "prev_id", "next_id"), "file_id")
    # Each column serves its own file and, as the older side, the next one.
    side = F.explode(F.array(F.struct(F.col("file_id").alias("f"), F.lit(True).alias("now"), F.col("prev_id").isNotNull().alias("ok")), F.struct(F.col("next_id").alias("f"), F.lit(False).alias("now"), F.col("next_id").isNotNull().alias("ok"))))
    both = cols.select("name", "quantity", "types", side.alias("s")).where("s.ok").select("name", "quantity", "types", F.col("s.f").alias("file_id"), F.col("s.now").alias("now"))
    per = both.groupBy("file_id", "quantity").agg(
        F.sort_array(F.collect_list(F.when(F.col("now"), F.struct("name", "types")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("now"), F.struct("name", "types")))).alias("b")
    )
    per = per.withColumn("fresh", F.filter("a", lambda x: ~F.exists("b", lambda y: y["name"] == x["name"]))).withColumn("gone", F.filter("b", lambda y: ~F.exists("a", lambda x: x["name"] == y["name"])))
    n = F.least(F.size("fresh"), F.size("gone"))
    change = lambda name, kind, detail: F.struct(name.alias("column_name"), F.lit(kind).alias("change_kind"), detail.alias("detail"))
    told = lambda t: F.array_join(t, "|")
    pairs = F.concat(
        F.transform(F.filter("a", lambda x: F.exists("b", lambda y: y["name"] == x["name"])), lambda x: F.struct(x["name"].alias("name"), x["types"].alias("now"), F.element_at(F.filter("b", lambda y: y["name"] == x["name"]), 1)["types"].alias("was"))),
        F.transform(F.slice("fresh", 1, n), lambda x, i: F.struct(x["name"].alias("name"), x["types"].alias("now"), F.col("gone")[i]["types"].alias("was"))),
    )
    out = F.concat(
        F.transform(F.slice("fresh", n + 1, F.size("fresh")), lambda x: change(x["name"], "added", told(x["types"]))),
        F.transform(F.slice("gone", n + 1, F.size("gone")), lambda x: change(x["name"], "removed", told(x["types"]))),
        F.transform(F.slice("fresh", 1, n), lambda x, i: change(x["name"], "renamed", F.col("gone")[i]["name"])),
        F.transform(F.filter(pairs, lambda p: (F.size(p["now"]) > 0) & (F.size(p["was"]) > 0) & (p["now"] != p["was"])), lambda p: change(p["name"], "retyped", F.concat(told(p["was"]), F.lit(" -> "), told(p["now"])))),
    )
    drift = per.select("file_id", F.explode(out).alias("c")).select("file_id", "c.*")
    version = order.where("prev_id is not null and v is not null and prev_v is not null and v <> prev_v").select(
        "file_id", F.lit("version").alias("column_name"), F.lit("version").alias("change_kind"), F.concat("prev_v", F.lit(" -> "), "v").alias("detail")
    )
    return drift.unionByName(version)


def fused_schema(files: DataFrame, rows: DataFrame) -> DataFrame:
    """(quantity, names, types, n_files): the tagged union of all files' schemas, alternative names and types kept."""
    c = file_schemas(rows).join(alias_pairs(files), "name", "left").withColumn("quantity", F.coalesce("quantity", "name"))
    types = F.array_sort(F.array_distinct(F.flatten(F.collect_set("types"))))
    return c.groupBy("quantity").agg(F.array_sort(F.collect_set("name")).alias("names"), types.alias("types"), F.countDistinct("file_id").alias("n_files"))


def _wide(quantity_of: dict[str, str], columns: list[tuple[str, str, str]]):
    """Lines as tuples of the wide table; ``columns`` are (quantity, branch, column)."""
    places = {(q, kind): i + 2 for i, (q, kind, _) in enumerate(columns)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for file_id, line_no, payload in zip(b["file_id"], b["line_no"], b["payload"]):
                o = _object(payload)
                if o is None:
                    continue
                row: list = [file_id, line_no, *[None] * len(columns)]
                for path, v in flatten(o):
                    kind = TYPES.get(type(v))
                    i = places.get((quantity_of.get(path, path), kind))
                    if i is not None and row[i] is None:  # of two names of one quantity in a line the first counts
                        row[i] = float(v) if kind == "number" else json.dumps(v) if kind == "array" else v
                out.append(tuple(row))
            yield pd.DataFrame(out, columns=["file_id", "line_no", *[c for _, _, c in columns]]).astype({"file_id": "Int64", "line_no": "Int32"})

    return run


def consistent_table(files: DataFrame, rows: DataFrame, most: int = 10_000) -> DataFrame:
    """One wide typed table: a row per line of a file, a column per quantity.

    A quantity of one type is one column of that type. One with conflicting types has a typed branch for each
    (``<quantity>__number`` and so on) beside its canonical conversion under its own name: the instant of a quantity named
    timestamp, else the number (text read as a number, true as 1), or the text where no branch holds numbers or booleans.

    Action: the fused schema is read to the driver, as it is the table's schema (``most`` quantities at most). Payloads
    are never shuffled: repeated lines are found by (file_id, line_no) and the row's values.
    """
    fused = sorted(((r["quantity"], r["names"], r["types"]) for r in fused_schema(files, rows).limit(most + 1).collect()), key=lambda x: x[0])
    if len(fused) > most:
        raise ValueError(f"more than {most} quantities")
    quantity_of = {n: q for q, names, _ in fused for n in names}
    columns = [(q, t, f"{q}__{t}") for q, _, types in fused for t in types]
    ddl = {"number": "double", "string": "string", "boolean": "boolean", "array": "string"}
    schema = "file_id long, line_no int" + "".join(f", `{c}` {ddl[t]}" for _, t, c in columns)
    x = rows.where("file_id is not null").select("file_id", "line_no", "payload").mapInPandas(_wide(quantity_of, columns), schema).distinct()
    out = []
    for q, _, types in fused:
        branch = {t: F.col(f"`{q}__{t}`") for t in types}
        if q == "timestamp":
            instants = [F.try_to_timestamp(branch["string"])] if "string" in branch else []
            instants += [F.timestamp_millis(branch["number"].cast("long"))] if "number" in branch else []
            out.append((F.coalesce(*instants) if instants else F.lit(None).cast("timestamp")).alias(q))
        elif len(types) == 1:
            out.append(branch[types[0]].alias(q))
        elif types:
            values = [branch["number"]] if "number" in branch else []
            values += [F.trim(branch["string"]).try_cast("double")] if "string" in branch and set(types) & {"number", "boolean"} else []
            values += [branch["boolean"].cast("double")] if "boolean" in branch else []
            out.append((F.coalesce(*values) if values else F.coalesce(*branch.values())).alias(q))
        else:
            out.append(F.lit(None).cast("string").alias(q))
        if len(types) > 1 or q == "timestamp":
            out += [branch[t].alias(f"{q}__{t}") for t in types]
    return x.select("file_id", "line_no", *out)
