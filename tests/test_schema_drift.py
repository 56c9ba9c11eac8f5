import json
from datetime import datetime

from lathework.operators import schema_drift

SCHEMA = "row_id long, file_id string, workspace_id string, exported_at timestamp_ntz, received_at timestamp_ntz, line_no int, record string, field string"


def files(spark, content):
    """content: [(workspace, file, day, [records])] -> registry_files rows with a clashing extra column."""
    out = []
    for ws, f, day, records in content:
        for i, r in enumerate(records):
            out.append((len(out), f, ws, datetime(2024, 1, day), datetime(2024, 2, day), i, r if isinstance(r, str) or r is None else json.dumps(r), "x"))
    return spark.createDataFrame(out, SCHEMA)


def steps(spark, rows, content):
    return rows(schema_drift.migration_steps(files(spark, content)), "file_id", "change", "old_field", "new_field")


def term(i, **k):
    return {"Term_ID": f"T{i}", **k}


def test_rename_add_remove_retype(spark, rows):
    a = [term(i, Discipline=f"d{i}", Usage_Count=str(i), Gone="x") for i in range(3)]
    b = [term(i, Domain=f"d{i}", Usage_Count=i, New=None) for i in range(3)]
    assert steps(spark, rows, [("w", "f2", 2, b), ("w", "f1", 1, a)]) == [
        ("f2", "ADDED", "", "New"), ("f2", "REMOVED", "Gone", ""), ("f2", "RENAMED", "Discipline", "Domain"), ("f2", "RETYPED", "Usage_Count", "Usage_Count")
    ]


def test_renamed_and_retyped_by_text(spark, rows):
    a = [term(i, n=str(i), o=f'["{i}"]') for i in range(3)]
    b = [term(i, m=i, p=[str(i)]) for i in range(3)]
    assert steps(spark, rows, [("w", "f1", 1, a), ("w", "f2", 2, b)]) == [("f2", "RENAMED", "n", "m"), ("f2", "RENAMED", "o", "p"), ("f2", "RETYPED", "n", "m"), ("f2", "RETYPED", "o", "p")]


def test_half_is_not_enough_and_nulls_do_not_count(spark, rows):
    a = [term(0, x="a"), term(1, x="b"), term(2, x=None)]
    b = [term(0, y="a"), term(1, y="c"), term(2, y="z")]
    assert steps(spark, rows, [("w", "f1", 1, a), ("w", "f2", 2, b)]) == [("f2", "ADDED", "", "y"), ("f2", "REMOVED", "x", "")]
    b[1]["y"] = None
    assert steps(spark, rows, [("w", "f1", 1, a), ("w", "f2", 2, b)]) == [("f2", "RENAMED", "x", "y")]


def test_workspaces_apart_repeats_broken_and_empty(spark, rows):
    a, b = [term(0, x="a"), term(0, x="a"), "{broken", None, "", "[1]"], [term(0, y="b")]
    assert steps(spark, rows, [("w", "f1", 1, a), ("v", "g1", 2, b)]) == []
    assert steps(spark, rows, []) == []


def test_export_order_rules_not_arrival_or_name(spark, rows):
    assert steps(spark, rows, [("w", "a", 3, [term(0, x="1", y="2")]), ("w", "b", 1, [term(0, x="1")])]) == [("a", "ADDED", "", "y")]


def test_unified_records_follow_chains(spark, rows):
    content = [
        ("w", "f1", 1, [term(0, Discipline="d", Usage_Count="3", Odd="o")]), ("w", "f2", 2, [term(0, Field_Of_Study="d", Usage_Count=4)]), ("w", "f3", 3, [term(0, Area="d"), "{broken"]),
    ]
    df = files(spark, content)
    out = schema_drift.unified_records(df, schema_drift.drift(df))
    assert rows(out, "file_id", "line_no", "term_id", "domain", "usage_count", "extra") == [("f1", 0, "T0", "d", 3, '{"Odd":"o"}'), ("f2", 0, "T0", "d", 4, ""), ("f3", 0, "T0", "d", 0, ""), ("f3", 1, None, None, None, "")]


def test_no_value_is_lost_and_every_rule_is_recorded(spark, rows):
    df = files(spark, [("w", "f1", 1, [{"Domain": "a", "Discipline": "b", "Usage_Count": "many"}, term(1, Domain=5, Notes=None)])])
    d = schema_drift.drift(df)
    assert rows(schema_drift.unified_records(df, d), "line_no", "domain", "usage_count", "changes") == [
        (0, "b", None, '[{"rule":"CONFLICT","field":"Domain","value":"a"},{"rule":"CAST","field":"Usage_Count","value":"many"}]'), (1, "5", 0, '[{"rule":"DEFAULT","field":"Usage_Count","value":"0"}]')
    ]
    assert rows(schema_drift.migration_rules(d, schema_drift.lineages(d)), "version", "rule", "field", "canonical") == [(1, "CAST", "Domain", "Domain"), (1, "CAST", "Usage_Count", "Usage_Count"), (1, "RENAME", "Discipline", "Domain")]
    none = files(spark, [("w", "f1", 1, ["{broken"])])
    d = schema_drift.drift(none)
    assert rows(schema_drift.migration_rules(d, schema_drift.lineages(d))) == [("w", 1, "DEFAULT", "", "Usage_Count")]


def test_fingerprints_begin_versions(spark, rows):
    content = [("w", "f1", 1, [term(0, x="a")]), ("w", "f2", 2, [term(1, x="b")]), ("w", "f3", 3, [term(1, x=1)])]
    assert rows(schema_drift.fingerprints(schema_drift.file_schemas(files(spark, content))), "version", "file_id") == [(1, "f1"), (2, "f3")]


def test_steps_come_from_pairs_of_fingerprints(spark, rows, monkeypatch):
    """Two workspaces with the same change share one step of versions; without the fingerprints there is no step at all."""
    a, b = [term(0, x="a")], [term(0, x="a", y="b")]
    df = files(spark, [("w", "f1", 1, a), ("w", "f2", 2, b), ("w", "f3", 3, b), ("v", "g1", 1, a), ("v", "g2", 2, b)])
    changed = schema_drift.versioned(schema_drift.file_schemas(df)).where("seq > 1 AND new")
    assert changed.count() == 2 and schema_drift.version_steps(changed).count() == 1
    assert rows(schema_drift.migration_steps(df), "file_id", "change", "new_field") == [("f2", "ADDED", "y"), ("g2", "ADDED", "y")]
    whole = schema_drift.file_schemas
    monkeypatch.setattr(schema_drift, "file_schemas", lambda f: whole(f).drop("fingerprint").selectExpr("*", "'' AS fingerprint"))
    assert rows(schema_drift.migration_steps(df)) == []
