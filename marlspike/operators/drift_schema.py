"""Records whose fields change from file to file: one table, and a list of changes.

Every record is parsed once into the variant type, and its top-level fields
become rows (path, kind, value). A file's schema is a tagged union: for each
path the set of kinds seen. Unions are fused by set union, which is associative,
so files and partitions are inferred in parallel and merged in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("string", "number", "boolean", "object", "array")


def field_rows(records: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """(``keep``..., path, kind, value): one row per top-level field of each complete JSON object.

    Lines that aren't one complete JSON object, and null lines, give no row. A
    JSON null has kind null. ``value`` is the field as JSON text with object
    keys in order, so equal values have equal text; it is null for JSON null.
    """
    parsed = records.select(*keep, F.try_parse_json(payload).alias("__v"))
    parsed = parsed.filter(F.col("__v").isNotNull() & F.schema_of_variant("__v").startswith("OBJECT"))
    exploded = parsed.lateralJoin(parsed.sparkSession.tvf.variant_explode(F.col("__v").outer())).select(
        *keep, F.col("key").alias("path"), F.schema_of_variant("value").alias("__type"), F.col("value").alias("__value")
    )
    kind = (
        F.when(F.col("__type") == "VOID", None)
        .when(F.col("__type") == "STRING", "string")
        .when(F.col("__type") == "BOOLEAN", "boolean")
        .when(F.col("__type").startswith("OBJECT"), "object")
        .when(F.col("__type").startswith("ARRAY"), "array")
        .otherwise("number")
    )
    return exploded.select(*keep, "path", kind.alias("kind"), F.when(F.col("__type") != "VOID", F.to_json("__value")).alias("value"))


def tagged_union(fields: DataFrame, by: list[str]) -> DataFrame:
    """Schema per group ``by``: (by..., path, kinds, present, filled), kinds in order.

    With ``by=[]`` all schemas are fused into one. ``present`` counts records
    that carry the key, ``filled`` those with a value. Kinds are at most five,
    so a state is small whatever the rows.
    """
    return fields.groupBy(*by, "path").agg(
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count(F.lit(1)).alias("present"),
        F.count("kind").alias("filled"),
    )


def appearing_kinds(fields: DataFrame, feed: str, seq: str) -> DataFrame:
    """(feed, path, kind, first_seq, records): when each alternative of a path first appears in a feed."""
    return (
        fields.filter(F.col("kind").isNotNull())
        .groupBy(feed, "path", "kind")
        .agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("records"))
    )


def _one_per_record(fields: DataFrame, keys: list[str], record: str) -> DataFrame:
    """A record that stands twice in its file counts once; the least value of a field stands for it."""
    return fields.groupBy(*keys, record, "path").agg(F.min("value").alias("value"))


def schema_changes(fields: DataFrame, feed: str, seq: str, record: str) -> DataFrame:
    """(feed, seq, change_kind, field_name, new_name): each file against its feed's previous one.

    ``fields`` are ``field_rows`` with the columns feed, seq and record id. The
    previous file is the one with the next lower seq; a feed's first file has no
    changes. A field only the earlier file has is 'renamed' if a field only the
    later one has carries an equal value on every record both files hold (null
    and absent alike, not null on all of them), else 'removed'. If several pairs
    fit, names pair up in order, one new name for one old. What is new and no
    new name is 'added'. A field of both with other kinds (unless all its values
    are null in one of them) is 'retyped'. Rows without feed, seq or record id
    take no part.

    ``fields`` are read in several branches; give them written (``durable``), so
    that records are parsed once. Only states move: one row per file and path, and for renames the values of
    changed fields of records both files hold. Files of a feed are ordered by a
    window over its file list, never over its records.
    """
    known = fields.filter(F.col(feed).isNotNull() & F.col(seq).isNotNull())
    schemas = tagged_union(known, [feed, seq]).select(
        F.col(feed).alias("f"), F.col(seq).alias("s"), "path", "kinds"
    )
    files = schemas.groupBy("f", "s").agg(F.map_from_entries(F.collect_list(F.struct("path", "kinds"))).alias("now"))
    order = Window.partitionBy("f").orderBy("s")
    steps = files.select(
        "f", "s", "now", F.lag("s").over(order).alias("before_s"), F.lag("now").over(order).alias("before")
    ).filter(F.col("before_s").isNotNull())
    names_now, names_before = F.map_keys("now"), F.map_keys("before")
    steps = steps.select(
        "f", "s", "before_s",
        F.array_sort(F.array_except(names_before, names_now)).alias("gone"),
        F.array_sort(F.array_except(names_now, names_before)).alias("fresh"),
        F.array_sort(
            F.filter(
                F.array_intersect(names_before, names_now),
                lambda p: (F.size(F.element_at("before", p)) > 0)
                & (F.size(F.element_at("now", p)) > 0)
                & (F.element_at("before", p) != F.element_at("now", p)),
            )
        ).alias("retyped"),
    )
    moved = steps.filter((F.size("gone") > 0) & (F.size("fresh") > 0))
    lost = moved.select("f", F.col("s").alias("step"), F.col("before_s").alias("s"), F.explode("gone").alias("path"))
    new = moved.select("f", F.col("s").alias("step"), "s", F.explode("fresh").alias("path"))
    named = known.filter(F.col(record).isNotNull()).select(
        F.col(feed).alias("f"), F.col(seq).alias("s"), F.col(record).alias("r"), "path", "value"
    )
    held = named.select("f", "s", "r").distinct()
    shared = (
        moved.select("f", F.col("s").alias("step"), F.col("before_s").alias("earlier"))
        .join(held.withColumnRenamed("s", "step"), ["f", "step"])
        .join(held.withColumnRenamed("s", "earlier"), ["f", "earlier", "r"], "left_semi")
        .select("f", "step", "r")
    )

    def values(side: DataFrame, out: str) -> DataFrame:
        cells = _one_per_record(named.filter(F.col("value").isNotNull()).join(side, ["f", "s", "path"]), ["f", "step"], "r")
        return cells.join(shared, ["f", "step", "r"], "left_semi").withColumnsRenamed({"path": out, "value": f"{out}_value"})

    old_values, new_values = values(lost, "old"), values(new, "fresh")
    filled_old = old_values.groupBy("f", "step", "old").agg(F.count(F.lit(1)).alias("n_old"))
    filled_new = new_values.groupBy("f", "step", "fresh").agg(F.count(F.lit(1)).alias("n_new"))
    fits = (
        old_values.join(new_values, ["f", "step", "r"])
        .filter(F.col("old_value") == F.col("fresh_value"))
        .groupBy("f", "step", "old", "fresh")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(filled_old, ["f", "step", "old"])
        .join(filled_new, ["f", "step", "fresh"])
        .filter((F.col("n") == F.col("n_old")) & (F.col("n") == F.col("n_new")))
        .groupBy("f", F.col("step").alias("s"))
        .agg(F.array_sort(F.collect_list(F.struct("old", "fresh"))).alias("fits"))
    )
    # pairs in order of names, skipping a name that is taken already
    chosen = F.aggregate(
        F.coalesce(F.col("fits"), F.array().cast("array<struct<old:string,fresh:string>>")),
        F.array().cast("array<struct<old:string,fresh:string>>"),
        lambda acc, p: F.when(
            F.exists(acc, lambda q: (q["old"] == p["old"]) | (q["fresh"] == p["fresh"])), acc
        ).otherwise(F.concat(acc, F.array(p))),
    )
    settled = steps.join(fits, ["f", "s"], "left").withColumn("renames", chosen)
    none = F.lit("")

    def change(kind: str, old: Column, fresh: Column) -> Column:
        return F.struct(F.lit(kind).alias("change_kind"), old.alias("field_name"), fresh.alias("new_name"))

    all_changes = F.concat(
        F.transform("renames", lambda p: change("renamed", p["old"], p["fresh"])),
        F.transform(F.array_except("gone", F.col("renames.old")), lambda p: change("removed", p, none)),
        F.transform(F.array_except("fresh", F.col("renames.fresh")), lambda p: change("added", p, none)),
        F.transform("retyped", lambda p: change("retyped", p, none)),
    )
    return settled.select(F.col("f").alias(feed), F.col("s").alias(seq), F.explode(all_changes).alias("c")).select(
        feed, seq, "c.*"
    )


def field_names(fields: DataFrame, changes: DataFrame, files: list[str]) -> dict[str, str]:
    """Canonical name of every path: the most frequent name among those that renames connect, over all feeds.

    Two names are only taken for one field if no file has both. What comes to the
    driver is the schema: one entry per path, and one per different rename.
    """
    links = changes.filter("change_kind = 'renamed'").select("field_name", "new_name").distinct()
    per_file = fields.select(*files, "path").distinct()
    pair = per_file.groupBy(*files).agg(F.collect_set("path").alias("paths"))
    both = F.array_contains("paths", F.col("field_name")) & F.array_contains("paths", F.col("new_name"))
    # a file's paths against the different renames, both as short as a schema
    clash = {(r[0], r[1]) for r in pair.join(F.broadcast(links), both).select("field_name", "new_name").distinct().collect()}
    count = {r["path"]: r["n"] for r in fields.groupBy("path").agg(F.count(F.lit(1)).alias("n")).collect()}
    home = {p: p for p in count}

    def find(x: str) -> str:
        while home[x] != x:
            x = home[x]
        return x

    for old, new in sorted((r[0], r[1]) for r in links.collect()):
        if (old, new) not in clash and old in home and new in home:
            a, b = sorted((find(old), find(new)), key=lambda p: (-count[p], p))
            home[b] = a
    return {p: find(p) for p in count}


def unified_records(fields: DataFrame, names: dict[str, str], keys: list[str]) -> DataFrame:
    """One consistent row per record with the columns that the tagged union of all its names has.

    For each canonical name ``p`` (``field_names``) come ``p`` (canonical text:
    strings without quotes, everything else as JSON), ``p__kind`` (which branch
    holds the value) and one typed branch for every kind that the fused union
    knows: ``p__string``, ``p__number`` (double), ``p__boolean``, ``p__object``
    and ``p__array`` (JSON text); branches that don't apply are null. The number
    branch also takes text that is a number, so a field retyped between files
    stays comparable. A record whose fields are all null still has its row. Of
    two fields of a record with one canonical name the least value stands.
    """
    canonical = F.create_map(*[F.lit(x) for pair in sorted(names.items()) for x in pair]) if names else None
    text = F.when(F.col("kind") == "string", F.from_json(F.concat(F.lit('{"s":'), F.col("value"), F.lit("}")), "s string")["s"]).otherwise(F.col("value"))
    cells = fields.select(*keys, (F.element_at(canonical, F.col("path")) if names else F.col("path")).alias("path"), "kind", text.alias("text"))
    union = tagged_union(cells.filter("kind IS NOT NULL"), [])
    # the fused schema: one row per canonical name
    schema = {r["path"]: list(r["kinds"]) for r in union.collect()}
    for p in names.values():
        schema.setdefault(p, [])
    rows = cells.groupBy(*keys).agg(
        *[F.min(F.when((F.col("path") == p) & F.col("kind").isNotNull(), F.struct("kind", "text"))).alias(p) for p in sorted(schema)], F.count(F.lit(1)).alias("__n")
    )
    out: list[Column] = [F.col(k) for k in keys]
    for p, kinds in sorted(schema.items()):
        kind, value = F.col(f"`{p}`")["kind"], F.col(f"`{p}`")["text"]
        out += [value.alias(p), kind.alias(f"{p}__kind")]
        for k in kinds:
            branch = value.try_cast("double") if k == "number" else F.when(kind == k, value == "true" if k == "boolean" else value)
            out.append(branch.alias(f"{p}__{k}"))
    return rows.select(*out)
