"""Record files whose fields change names, presence and types from export to export.

Every file's schema is a fingerprint over its (field, types) pairs. Files that keep the fingerprint of
the one before need no step. What fields come, go or change type is worked out once for each pair of
fingerprints that follow each other anywhere; which of them are the same field under a new name is read
from the records of the two files. Records are routed through the chain of their workspace's renames to
canonical fields, then through cast and default rules, into one table; every rule is a row of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..session import materialize

# fixed values: the registry's fields in their order
REGISTRY_FIELDS = (
    "Term_ID", "English_Term", "Preferred_Chinese", "Alternative_Chinese", "Abbreviation", "Domain", "Subdomain", "Definition",
    "Context", "Operational_Use", "Source_Type", "Source_Citation", "Confidence", "Evidence_ID", "Evidence_IDs", "Evidence_Level",
    "Paper_ID", "First_Seen", "First_Verified", "Last_Used", "Last_Verified", "Usage_Count", "Status", "Notes",
)
# fixed values: names of the same fields in the former registry layout
FORMER_NAMES = {"Discipline": "Domain", "Subfield": "Subdomain"}
# cast and default rules of the canonical table; all other fields are text
CASTS = {"Usage_Count": "bigint"}
DEFAULTS = {"Usage_Count": "0"}

STRING, NUMBER, BOOLEAN, ARRAY, OBJECT = 1, 2, 4, 8, 16
_FILE = ["workspace_id", "file_id"]
_FIELDS = "array<struct<field:string,kinds:int>>"


def _kind(s: Column) -> Column:
    """The bit of a JSON type, by the schema of a variant; 0 for null."""
    return (
        F.when(s.isNull() | (s == "VOID"), 0).when(s == "STRING", STRING).when(s == "BOOLEAN", BOOLEAN)
        .when(s.startswith("ARRAY"), ARRAY).when(s.startswith("OBJECT"), OBJECT).otherwise(NUMBER)
    )


def file_schemas(files: DataFrame) -> DataFrame:
    """One row per file: (workspace_id, file_id, exported_at, fields, fingerprint). ``fields`` are (field, kinds) by name, kinds the bits of all types seen.

    Records that are no JSON object have no fields; a file without any readable record has none, too.
    Each record is parsed once and goes to the shuffle as what its split of the file adds.
    """
    known = files.where("file_id IS NOT NULL AND workspace_id IS NOT NULL")
    entries = F.transform(F.map_entries(F.from_json("record", "map<string,variant>")), lambda e: F.struct(e["key"].alias("field"), _kind(F.schema_of_variant(e["value"])).alias("kind")))
    e = known.select(*_FILE, "exported_at", F.explode_outer(entries).alias("e")).select(*_FILE, "exported_at", "e.*")
    per_field = e.groupBy(*_FILE, "field").agg(F.bit_or("kind").alias("kinds"), F.min("exported_at").alias("exported_at"))
    listed = F.sort_array(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "kinds")))).cast(_FIELDS)
    per_file = per_field.groupBy(*_FILE).agg(listed.alias("fields"), F.min("exported_at").alias("exported_at"))
    return per_file.withColumn("fingerprint", F.sha2(F.to_json("fields"), 256))


def fingerprints(schemas: DataFrame) -> DataFrame:
    """Versioned schema fingerprints: (workspace_id, version, fingerprint, file_id, n_fields) of each file that begins one. Files without fields are passed over."""
    w = Window.partitionBy("workspace_id").orderBy("exported_at", "file_id")
    held = schemas.where("size(fields) > 0").withColumn("new", F.coalesce(F.lag("fingerprint").over(w) != F.col("fingerprint"), F.lit(True))).where("new")
    return held.select("workspace_id", F.row_number().over(w).cast("bigint").alias("version"), "fingerprint", "file_id", F.size("fields").cast("bigint").alias("n_fields"))


def versioned(schemas: DataFrame) -> DataFrame:
    """``schemas`` with each file's place (seq) among its workspace's exports (arrival means nothing, ties by file_id), its schema version, and the schema and file before it."""
    w = Window.partitionBy("workspace_id").orderBy("exported_at", "file_id")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = schemas.withColumn("seq", F.row_number().over(w)).withColumn("before", F.lag(F.struct("fingerprint", "fields", "file_id")).over(w))
    d = d.withColumn("new", F.coalesce(F.col("before.fingerprint") != F.col("fingerprint"), F.lit(True)))
    return d.withColumn("version", F.sum(F.col("new").cast("int")).over(upto).cast("bigint"))


def _named(fields: Column, name: Column) -> Column:
    return F.get(F.filter(fields, lambda f: f["field"] == name), F.lit(0))["kinds"]


def _other_kinds(a: Column, b: Column) -> Column:
    """Both have a type and the types differ: a field that is null throughout has none."""
    return (a != b) & (a > 0) & (b > 0)


def version_steps(changes: DataFrame) -> DataFrame:
    """(old, new, came, went, retyped) for each pair of fingerprints that follow each other somewhere: worked out once, whatever the number of files."""
    pairs = changes.groupBy(F.col("before.fingerprint").alias("old"), F.col("fingerprint").alias("new")).agg(F.any_value("before.fields").alias("was"), F.any_value("fields").alias("now"))
    names = lambda c: F.transform(c, lambda f: f["field"])
    only = lambda a, b: F.filter(a, lambda f: ~F.array_contains(names(F.col(b)), f["field"]))
    retyped = F.filter("now", lambda f: F.coalesce(_other_kinds(f["kinds"], _named(F.col("was"), f["field"])), F.lit(False)))
    return pairs.select("old", "new", only("now", "was").alias("came"), only("was", "now").alias("went"), names(retyped).alias("retyped"))


def renames(files: DataFrame, changes: DataFrame, term_field: str) -> DataFrame:
    """(workspace_id, seq, moves): pairs (old_field, new_field) whose values agree for more than half of the shared terms.

    Only records of files next to a change are opened, and only the fields that came or went. Where
    one file states a term several times, its last line counts.
    """
    sided = changes.where("size(came) > 0 AND size(went) > 0")
    side = lambda s, file, fields: F.struct(F.lit(s).alias("side"), file.alias("file_id"), F.transform(fields, lambda f: f["field"]).alias("fields"))
    wanted = sided.select("workspace_id", "seq", F.explode(F.array(side("new", F.col("file_id"), F.col("came")), side("old", F.col("before_file"), F.col("went")))).alias("w"))
    wanted = wanted.select("workspace_id", "w.file_id", F.struct("seq", "w.side", "w.fields").alias("w")).groupBy(*_FILE).agg(F.collect_list("w").alias("wanted"))
    records = files.where("file_id IS NOT NULL").select(*_FILE, "line_no", "record").join(wanted, _FILE)
    records = records.withColumn("m", F.map_entries(F.from_json("record", "map<string,string>"))).where("m IS NOT NULL")
    records = records.withColumn("term", strip(F.get(F.filter("m", lambda e: e["key"] == F.lit(term_field)), F.lit(0))["value"])).where("term <> ''")
    v = records.select("workspace_id", "line_no", "term", "m", F.explode("wanted").alias("w")).select(
        "workspace_id", F.col("w.seq").alias("seq"), F.col("w.side").alias("side"), "term", "line_no",
        F.explode(F.filter("m", lambda e: e["value"].isNotNull() & F.array_contains(F.col("w.fields"), e["key"]))).alias("e"),
    )
    v = v.groupBy("workspace_id", "seq", "term", "side", F.col("e.key").alias("field")).agg(F.max_by("e.value", "line_no").alias("text"))
    value = lambda s: F.collect_list(F.when(F.col("side") == s, F.struct("field", "text")))
    # a term's fields of both files in one row: as many pairs as fields came times fields went
    met = v.groupBy("workspace_id", "seq", "term").agg(value("old").alias("old"), value("new").alias("new")).where("size(old) > 0 AND size(new) > 0")
    met = met.withColumn("o", F.explode("old")).withColumn("n", F.explode("new"))
    agreed = met.groupBy("workspace_id", "seq", F.col("o.field").alias("old_field"), F.col("n.field").alias("new_field")).agg(
        F.count("*").alias("n"), F.sum((F.col("o.text") == F.col("n.text")).cast("int")).alias("same")
    )
    return agreed.where("same * 2 > n").groupBy("workspace_id", "seq").agg(F.sort_array(F.collect_list(F.struct("old_field", "new_field"))).alias("moves"))


@dataclass(frozen=True)
class Drift:
    """What is known of a set of files: ``versions`` (one row per file), ``renamed`` (workspace_id, seq, moves) and ``steps``, all small tables."""

    versions: DataFrame
    renamed: DataFrame
    steps: DataFrame


def drift(files: DataFrame, *, term_field: str = "Term_ID") -> Drift:
    """Schema versions of all files and every change from one file of a workspace to the next.

    ``steps``: (workspace_id, seq, file_id, change, old_field, new_field). A file has a field if one of
    its records has the key. RENAMED: gone field and new field whose values agree in more than half of
    the terms of both files that have both. REMOVED and ADDED: gone or new and not renamed. RETYPED:
    kept or renamed, and the sets of JSON types of the non-null values differ (fields null throughout
    have no type). Workspaces with one file, empty tables and unreadable records give no rows.
    """
    versions = versioned(materialize(file_schemas(files), "file-schemas"))
    changed = versions.where("seq > 1 AND new")
    found = changed.select("workspace_id", "seq", "file_id", F.col("before.file_id").alias("before_file"), F.col("before.fingerprint").alias("old"), F.col("fingerprint").alias("new"))
    changes = materialize(found.join(version_steps(changed), ["old", "new"]).drop("old", "new"), "schema-steps")
    renamed = materialize(renames(files, changes, term_field), "renames")

    d = changes.join(renamed, ["workspace_id", "seq"], "left").withColumn("moves", F.coalesce("moves", F.array().cast("array<struct<old_field:string,new_field:string>>")))
    step = lambda change, old, new: F.struct(F.lit(change).alias("change"), old.alias("old_field"), new.alias("new_field"))
    stays = lambda fields, side: F.filter(fields, lambda f: ~F.exists("moves", lambda m: m[side] == f["field"]))
    none = F.lit("")
    moved = F.filter("moves", lambda m: _other_kinds(_named(F.col("went"), m["old_field"]), _named(F.col("came"), m["new_field"])))
    steps = F.concat(
        F.transform("moves", lambda m: step("RENAMED", m["old_field"], m["new_field"])), F.transform(stays("came", "new_field"), lambda f: step("ADDED", none, f["field"])),
        F.transform(stays("went", "old_field"), lambda f: step("REMOVED", f["field"], none)), F.transform("retyped", lambda f: step("RETYPED", f, f)),
        F.transform(moved, lambda m: step("RETYPED", m["old_field"], m["new_field"])),
    )
    return Drift(versions, renamed, d.select("workspace_id", "seq", "file_id", F.explode(steps).alias("s")).select("workspace_id", "seq", "file_id", "s.*"))


def migration_steps(files: DataFrame, *, term_field: str = "Term_ID") -> DataFrame:
    return drift(files, term_field=term_field).steps


def _squeezed(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def declared_names() -> dict[str, str]:
    """Canonical fields by the letters and digits of the names they go by."""
    return {_squeezed(n): n for n in REGISTRY_FIELDS} | {_squeezed(a): b for a, b in FORMER_NAMES.items()}


def lineages(d: Drift) -> DataFrame:
    """(workspace_id, version, field, canonical): where each schema version's fields end up.

    A chain of renames is one lineage. It takes the declared field that one of its names stands for
    (the earliest such name), or keeps its first name. Versions, not files, are folded in order, with
    only the current one's fields in memory.
    """
    begun = d.versions.where("new").select("workspace_id", "version", "seq", F.transform("fields", lambda f: f["field"]).alias("fields"))
    per_version = begun.join(d.renamed, ["workspace_id", "seq"], "left").repartition("workspace_id").sortWithinPartitions("workspace_id", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, known = None, {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.workspace_id != here:
                    here, known = r.workspace_id, {}
                came_from = {}
                for m in r.moves if r.moves is not None else ():
                    came_from.setdefault(m["new_field"], m["old_field"])
                line = {}
                for f in r.fields:
                    source = f if f in known else came_from.get(f)
                    line[f] = known[source] if source in known else f"{r.seq} {f}"
                known = line
                out += [(here, r.version, f, int(r.seq), name) for f, name in line.items()]
            yield pd.DataFrame(out, columns=["workspace_id", "version", "field", "seq", "lineage"])

    ids = per_version.mapInPandas(fold, "workspace_id string, version bigint, field string, seq int, lineage string")
    names = F.create_map(*[F.lit(x) for kv in declared_names().items() for x in kv])
    ids = ids.withColumn("declared", F.element_at(names, F.regexp_replace(F.lower("field"), "[^a-z0-9]", "")))
    first = ids.groupBy("workspace_id", "lineage").agg(F.min_by("declared", F.when(F.col("declared").isNotNull(), F.struct("seq", "field"))).alias("name"), F.min_by("field", F.struct("seq", "field")).alias("own"))
    return ids.join(first, ["workspace_id", "lineage"]).select("workspace_id", "version", "field", F.coalesce("name", "own").alias("canonical"))


def migration_rules(d: Drift, routes: DataFrame) -> DataFrame:
    """The rules each schema version goes through: (workspace_id, version, rule, field, canonical).

    RENAME: the field takes another name. CAST: it has values of another type than the canonical
    field's. DEFAULT: no field of the version ends in a canonical field that has a default (field '').
    """
    begun = d.versions.where("new").select("workspace_id", "version", F.explode_outer("fields").alias("f")).select("workspace_id", "version", F.col("f.field").alias("field"), F.col("f.kinds").alias("kinds"))
    r = begun.join(routes, ["workspace_id", "version", "field"], "left")
    own = F.when(F.col("canonical").isin(*[c for c, t in CASTS.items() if t != "string"]), NUMBER).otherwise(STRING)
    cast = F.col("canonical").isin(*REGISTRY_FIELDS) & (F.col("kinds").bitwiseAND(F.bitwise_not(own)) != 0)
    per_field = r.select("workspace_id", "version", "field", "canonical", F.explode(F.array_compact(F.array(F.when(F.col("field") != F.col("canonical"), "RENAME"), F.when(cast, "CAST")))).alias("rule"))
    missing = F.array_except(F.array(*[F.lit(c) for c in DEFAULTS]), F.array_agg("canonical"))
    absent = r.groupBy("workspace_id", "version").agg(missing.alias("c")).select("workspace_id", "version", F.lit("").alias("field"), F.explode("c").alias("canonical"), F.lit("DEFAULT").alias("rule"))
    return per_field.unionByName(absent).select("workspace_id", "version", "rule", "field", "canonical")


def unified_records(files: DataFrame, d: Drift) -> DataFrame:
    """Every record once, in the canonical fields: (row_id, workspace_id, file_id, line_no, <fields>, extra, changes).

    Values keep their text; Usage_Count is cast to BIGINT after its default. Fields outside the
    registry stay in ``extra`` (JSON, '' if none). Unreadable records have null fields. Nothing is
    lost: ``changes`` (JSON list, '' if none) holds what the columns could not take, as (rule, field,
    value). CONFLICT: two fields of one record end in the same canonical field; the first non-null one
    by field name stays, the other is listed. CAST: a value that the cast cannot read, null in its
    column. DEFAULT: the value was absent or null.
    """
    by_version = lineages(d).groupBy("workspace_id", "version").agg(F.map_from_entries(F.collect_set(F.struct("field", "canonical"))).alias("routes"))
    routes = d.versions.select(*_FILE, "version").join(by_version, ["workspace_id", "version"]).select(*_FILE, "routes")
    r = files.select("row_id", *_FILE, "line_no", F.map_entries(F.from_json("record", "map<string,string>")).alias("e")).join(routes, _FILE, "left")
    given = F.filter(F.array_sort(F.coalesce("e", F.array().cast("array<struct<key:string,value:string>>"))), lambda x: x["value"].isNotNull())
    r = r.withColumn("c", F.transform(given, lambda x: F.struct(F.coalesce(F.element_at("routes", x["key"]), x["key"]).alias("key"), x["value"].alias("value"), x["key"].alias("field"))))
    # of several fields with one canonical name the first one counts, the rest is kept aside
    first = lambda x, i: F.array_position(F.transform("c", lambda y: y["key"]), x["key"]) == i + 1
    r = r.withColumn("used", F.filter("c", first)).withColumn("rest", F.filter("c", lambda x, i: ~first(x, i)))
    pick = lambda name: F.get(F.filter("used", lambda x: x["key"] == F.lit(name)), F.lit(0))["value"]
    note = lambda rule, field, value: F.struct(F.lit(rule).alias("rule"), field.alias("field"), value.alias("value"))
    columns, notes = [], []
    for name in REGISTRY_FIELDS:
        c = pick(name)
        if name in CASTS:
            notes.append(F.when(c.isNotNull() & c.try_cast(CASTS[name]).isNull(), note("CAST", F.lit(name), c)))
        if name in DEFAULTS:
            notes.append(F.when(c.isNull() & F.col("e").isNotNull(), note("DEFAULT", F.lit(name), F.lit(DEFAULTS[name]))))
            c = F.coalesce(c, F.when(F.col("e").isNotNull(), F.lit(DEFAULTS[name])))
        columns.append((c.try_cast(CASTS[name]) if name in CASTS else c).alias(name.lower()))
    others = F.filter("used", lambda x: ~x["key"].isin(*REGISTRY_FIELDS))
    extra = F.when(F.size(others) > 0, F.to_json(F.map_from_entries(F.transform(others, lambda x: F.struct(x["key"], x["value"]))))).otherwise(F.lit(""))
    changes = F.concat(F.transform("rest", lambda x: note("CONFLICT", x["field"], x["value"])), F.array_compact(F.array(*notes)))
    return r.select("row_id", *_FILE, "line_no", *columns, extra.alias("extra"), F.when(F.size(changes) > 0, F.to_json(changes)).otherwise(F.lit("")).alias("changes"))
