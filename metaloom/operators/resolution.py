"""Operators over the relations of XML exports: census, healing and its cascade, references, variables, home files, checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.exports import _plain


def healed_uuid(catalog: str, file: str | Column, uuid: str | Column, discriminator: str | Column) -> Column:
    """The identity that a twin gets in place of its own; nulls count as empty."""
    text = lambda c: F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit(""))
    return F.md5(F.concat_ws("::", F.lit("DupHeal"), F.lit(catalog), text(file), text(uuid), text(discriminator)))


def heal(df: DataFrame, catalog: str, key: str = "id") -> DataFrame:
    """Rows of one file that share a uuid: the smallest key keeps it, others get a new one; original_uuid tells the old.

    Rows that agree in the key too are one record twice and keep one identity between them; rows without key or uuid are never healed.
    """
    least = F.min(key).over(Window.partitionBy("file_name", "uuid"))
    twin = F.col("uuid").isNotNull() & F.col(key).isNotNull() & (F.col(key) != F.col("_least"))
    new = F.when(twin, healed_uuid(catalog, "file_name", "uuid", key)).otherwise(F.col("uuid"))
    return df.withColumn("_least", least).withColumn("original_uuid", F.when(twin, F.col("uuid"))).withColumn("uuid", new).drop("_least")


def census(df: DataFrame, catalog: str, key: str = "id") -> DataFrame:
    """Identities that occur more than once in a file: occurrences, and different records among them."""
    per = df.where("uuid is not null").groupBy("file_name", "uuid").agg(F.count("*").alias("n"), F.count_distinct(key).alias("n_records")).where("n > 1")
    return per.select(F.lit(catalog).alias("catalog"), "*")


def cascade(df: DataFrame, healed: DataFrame, uuid: str, key: str, healed_key: str = "id") -> DataFrame:
    """Foreign identities of df that point to a healed twin, told by (file, old uuid, key), become the twin's new one."""
    renamed = healed.where("original_uuid is not null").select(F.col("file_name").alias("_f"), F.col("original_uuid").alias("_old"), F.col(healed_key).alias("_key"), F.col("uuid").alias("_new")).distinct()
    joined = df.join(renamed, (df["file_name"] == F.col("_f")) & (df[uuid] == F.col("_old")) & (df[key] == F.col("_key")), "left")
    return joined.withColumn(uuid, F.coalesce("_new", uuid)).drop("_f", "_old", "_key", "_new")


def references(df: DataFrame, body: str) -> DataFrame:
    """References within a column of XML, one row each in order: all columns of df but the body, ref_index, ref_type, ref_id, ref_name, ref_uuid."""
    found = df.select("*", F.posexplode(F.expr(rf"regexp_extract_all(`{body}`, '<\\w+Reference\\s[^>]*>', 0)")).alias("_at", "_tag")).drop(body)
    value = lambda name: F.nullif(F.regexp_extract("_tag", rf'\s{name}="([^"]*)"', 1), F.lit(""))
    return found.select("*", (F.col("_at") + 1).cast("long").alias("ref_index"), F.regexp_extract("_tag", r"<(\w+)Reference", 1).alias("ref_type"), value("id").try_cast("long").alias("ref_id"), _plain(value("name")).alias("ref_name"), value("UUID").alias("ref_uuid")).drop("_at", "_tag")


def representatives(chunks: DataFrame) -> DataFrame:
    """Tokens of one calculation for each hash of a file, the smallest; those without hash stand for themselves."""
    first = chunks.where("calc_hash is not null").groupBy("file_name", "calc_hash").agg(F.min("calc_uuid").alias("_first"))
    joined = chunks.join(first, ["file_name", "calc_hash"], "left").where("_first is null or _first = calc_uuid")
    return joined.select(*chunks.columns)


def calc_references(owners: DataFrame, chunks: DataFrame) -> DataFrame:
    """References of calculations by owner: owners (file_name, owner_uuid, owner_role, calc_hash) meet one calculation for each hash."""
    refs = references(representatives(chunks).where("calc_hash is not null and chunk_content like '<%'"), "chunk_content")
    return owners.join(refs, ["file_name", "calc_hash"]).select("file_name", "owner_uuid", "owner_role", "chunk_index", "chunk_type", "ref_type", "ref_id", "ref_name", "ref_uuid")


def scope(name: Column) -> Column:
    """Scope of a variable by the longest prefix."""
    return F.when(name.startswith("$$$"), "superglobal").when(name.startswith("$$"), "global").when(name.startswith("$"), "local").otherwise("let_local")


def variable_usages(uses: DataFrame) -> DataFrame:
    """uses (file_name, name, usage: set or read, script_uuid, context_uuid) with scope and the anchor that tells equal names apart."""
    file = F.concat(F.lit("__file::"), "file_name")
    kind = scope(F.col("name"))
    anchor = F.when(kind == "superglobal", "__global").when(kind == "global", F.col("file_name")).when(kind == "local", F.coalesce("script_uuid", file)).otherwise(F.coalesce("context_uuid", file))
    return uses.select("*", kind.alias("scope"), anchor.alias("anchor"))


def variables(uses: DataFrame) -> DataFrame:
    """One row for each variable: set and read counts, number of files, the file with most uses (ties by name)."""
    per = variable_usages(uses).groupBy("name", "scope", "anchor", "file_name").agg(F.count("*").alias("n"), F.count_if(F.col("usage") == "set").alias("sets"), F.count_if(F.col("usage") == "read").alias("reads"))
    return per.groupBy("name", "scope", "anchor").agg(F.sum("sets").alias("set_count"), F.sum("reads").alias("read_count"), F.count("file_name").alias("n_files"), F.min_by("file_name", F.struct(-F.col("n"), "file_name")).alias("main_file")).withColumn("normalized_name", F.regexp_replace("name", r"^\$+", ""))


def home_files(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """refs (ref_uuid, ref_name, declared_file) with target_file and how it was found.

    An identity known in one file is at home there; else the one file that knows it by this name; else the declared file, if it knows the
    identity. What remains is ambiguous, or not imported where no file knows it. Candidates are summed up per identity before the join.
    """
    known = objects.where("object_uuid is not null").groupBy("object_uuid").agg(F.collect_set("file_name").alias("_files"), F.collect_set(F.struct("object_name", "file_name")).alias("_named"))
    named = F.array_distinct(F.transform(F.filter("_named", lambda x: x["object_name"] == F.col("ref_name")), lambda x: x["file_name"]))
    joined = refs.join(known, F.col("ref_uuid") == F.col("object_uuid"), "left").withColumn("_by_name", named)
    declared = F.coalesce(F.array_contains("_files", F.col("declared_file")), F.lit(False))
    out = joined.withColumn("resolution", F.when(F.coalesce(F.size("_files"), F.lit(-1)) < 1, "not_imported").when(F.size("_files") == 1, "unique").when(F.size("_by_name") == 1, "by_name").when(declared, "declared").otherwise("ambiguous"))
    target = F.when(F.col("resolution") == "unique", F.col("_files")[0]).when(F.col("resolution") == "by_name", F.col("_by_name")[0]).when(F.col("resolution") == "declared", F.col("declared_file"))
    return out.withColumn("target_file", target).select(*refs.columns, "target_file", "resolution")


def _bad(name: str, df: DataFrame, rule: str) -> DataFrame:
    return df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n_rows"), F.count_if(F.coalesce(F.expr(rule), F.lit(False))).alias("n_bad"))


def export_checks(tables: dict[str, DataFrame], known_steps: DataFrame | None = None) -> DataFrame:
    """check_name, n_rows, n_bad over the relations that are there: chunks, relationships, fields, layout_objects, occurrences, steps, variables."""
    out = []
    if (chunks := tables.get("chunks")) is not None:
        out += [
            _bad("chunk_type_null", chunks, "chunk_type is null"), _bad("chunk_refs", chunks.where("chunk_type like '%Ref' and chunk_type <> 'NoRef'"), "chunk_content = ''"), _bad("calc_hash", chunks, "calc_hash is null"),
            _bad("calc_uuid", chunks, "calc_uuid is null or calc_uuid = ''"), _bad("function_missing", chunks, "chunk_content like '%<Function Missing>%'"),
        ]
    if (relations := tables.get("relationships")) is not None:
        per = relations.groupBy("file_name", "uuid").agg(F.count_distinct("id").alias("n"))
        out.append(_bad("relationship_uuid", per, "uuid is null or n > 1"))
        if (fields := tables.get("fields")) is not None:
            known = fields.select(F.col("uuid").alias("_known")).where("_known is not null").distinct()
            sides = relations.select("file_name", F.explode(F.array("left_field_uuid", "right_field_uuid")).alias("field_uuid"))
            out.append(_bad("relationship_field_resolution", sides.join(known, F.col("field_uuid") == F.col("_known"), "left"), "_known is null"))
    if (boxes := tables.get("layout_objects")) is not None:
        out += [_bad("layoutobjects_without_part", boxes, "part is null"), _bad("layout_bounds", boxes, "right < left or bottom < top"), _bad("layout_parents", boxes, "nesting > 0 and parent_id is null")]
    if (tos := tables.get("occurrences")) is not None:
        out.append(_bad("occurrences_without_table", tos, "base_table is null"))
    if (steps := tables.get("steps")) is not None and known_steps is not None:
        kinds = steps.groupBy("step_id").agg(F.count("*").alias("n")).join(known_steps.select("step_id", F.lit(True).alias("_known")).distinct(), "step_id", "left")
        out.append(kinds.agg(F.lit("step_roles").alias("check_name"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_bad")))
    if (names := tables.get("variables")) is not None:
        out.append(_bad("variable_identity", names, "scope = 'local' and n_files > 1"))
    if not out:
        raise ValueError("no relation to check")
    return reduce(DataFrame.unionByName, out)
