"""SQL for the pN_ queries of the general problems, in the dialect of the comparing engine."""

from ..operators.schema_drift import REGISTRY_FIELDS, declared_names

P1_FOUND = r"""
WITH files AS (
  SELECT workspace_id, file_id, row_number() OVER (PARTITION BY workspace_id ORDER BY min(exported_at), file_id) AS seq
  FROM registry_files WHERE file_id IS NOT NULL AND workspace_id IS NOT NULL GROUP BY workspace_id, file_id),
entries AS (
  SELECT f.workspace_id, f.file_id, f.seq, r.line_no, json_extract_string(r.record, '$."Term_ID"') AS term, k.field,
         json_extract_string(r.record, '$."' || k.field || '"') AS text, json_type(r.record, '$."' || k.field || '"') AS kind
  FROM registry_files r JOIN files f USING (workspace_id, file_id), unnest(json_keys(r.record)) AS k(field)
  WHERE json_valid(r.record)),
schemas AS (
  SELECT workspace_id, seq, field,
         list_sort(list(DISTINCT CASE WHEN kind IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT') THEN 'NUMBER' ELSE kind END) FILTER (WHERE kind <> 'NULL')) AS kinds
  FROM entries GROUP BY ALL),
steps AS (SELECT workspace_id, seq FROM files WHERE seq > 1),
came AS (
  SELECT s.workspace_id, s.seq, s.field, s.kinds FROM schemas s JOIN steps USING (workspace_id, seq)
  WHERE NOT EXISTS (SELECT 1 FROM schemas p WHERE p.workspace_id = s.workspace_id AND p.seq = s.seq - 1 AND p.field = s.field)),
went AS (
  SELECT s.workspace_id, s.seq + 1 AS seq, s.field, s.kinds FROM schemas s JOIN steps t ON t.workspace_id = s.workspace_id AND t.seq = s.seq + 1
  WHERE NOT EXISTS (SELECT 1 FROM schemas p WHERE p.workspace_id = s.workspace_id AND p.seq = s.seq + 1 AND p.field = s.field)),
vals AS (
  SELECT workspace_id, seq, trim(term) AS term, field, arg_max(text, line_no) AS text
  FROM entries WHERE kind <> 'NULL' AND trim(term) <> '' GROUP BY ALL),
renamed AS (
  SELECT o.workspace_id, w.seq, o.field AS old_field, n.field AS new_field
  FROM vals o JOIN went w ON w.workspace_id = o.workspace_id AND w.seq = o.seq + 1 AND w.field = o.field
  JOIN vals n ON n.workspace_id = o.workspace_id AND n.seq = w.seq AND n.term = o.term
  JOIN came c ON c.workspace_id = n.workspace_id AND c.seq = n.seq AND c.field = n.field
  GROUP BY ALL HAVING 2 * count(*) FILTER (WHERE o.text = n.text) > count(*)),
changes AS (
  SELECT workspace_id, seq, 'RENAMED' AS change, old_field, new_field FROM renamed
  UNION ALL SELECT workspace_id, seq, 'ADDED', '', field FROM came c
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.workspace_id = c.workspace_id AND r.seq = c.seq AND r.new_field = c.field)
  UNION ALL SELECT workspace_id, seq, 'REMOVED', field, '' FROM went w
    WHERE NOT EXISTS (SELECT 1 FROM renamed r WHERE r.workspace_id = w.workspace_id AND r.seq = w.seq AND r.old_field = w.field)
  UNION ALL SELECT s.workspace_id, s.seq, 'RETYPED', s.field, s.field FROM schemas s
    JOIN schemas p ON p.workspace_id = s.workspace_id AND p.seq = s.seq - 1 AND p.field = s.field
    WHERE s.kinds <> p.kinds AND len(s.kinds) > 0 AND len(p.kinds) > 0
  UNION ALL SELECT r.workspace_id, r.seq, 'RETYPED', r.old_field, r.new_field FROM renamed r
    JOIN went w ON w.workspace_id = r.workspace_id AND w.seq = r.seq AND w.field = r.old_field
    JOIN came c ON c.workspace_id = r.workspace_id AND c.seq = r.seq AND c.field = r.new_field
    WHERE w.kinds <> c.kinds AND len(w.kinds) > 0 AND len(c.kinds) > 0)
SELECT DISTINCT file_id, change, old_field, new_field FROM changes JOIN files USING (workspace_id, seq)
"""

P1_VERSIONS = P1_FOUND[: P1_FOUND.index("schemas AS (")] + r"""
fields AS (SELECT workspace_id, file_id, seq, field, bit_or(CASE kind WHEN 'NULL' THEN 0 WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 WHEN 'OBJECT' THEN 16 ELSE 2 END) AS kinds FROM entries GROUP BY ALL),
prints AS (SELECT workspace_id, file_id, seq, count(*) AS n_fields, sha256('[' || string_agg('{"field":' || to_json(field) || ',"kinds":' || kinds || '}', ',' ORDER BY field) || ']') AS fingerprint FROM fields GROUP BY ALL),
marked AS (SELECT *, lag(fingerprint) OVER (PARTITION BY workspace_id ORDER BY seq) AS p FROM prints)
SELECT workspace_id, row_number() OVER (PARTITION BY workspace_id ORDER BY seq) AS version, fingerprint, file_id, n_fields FROM marked WHERE p IS NULL OR p <> fingerprint"""

_P1_NAMED = P1_FOUND[: P1_FOUND.index("changes AS (")].replace("WITH files", "WITH RECURSIVE files") + r"""
moves AS (SELECT workspace_id, seq, new_field, min(old_field) AS old_field FROM renamed GROUP BY ALL),
lines AS (
  SELECT workspace_id, seq, field, seq || ' ' || field AS line FROM schemas s
  WHERE NOT EXISTS (SELECT 1 FROM schemas p WHERE p.workspace_id = s.workspace_id AND p.seq = s.seq - 1 AND p.field = s.field)
    AND NOT EXISTS (SELECT 1 FROM moves m WHERE m.workspace_id = s.workspace_id AND m.seq = s.seq AND m.new_field = s.field)
  UNION ALL
  SELECT s.workspace_id, s.seq, s.field, l.line FROM lines l JOIN schemas s ON s.workspace_id = l.workspace_id AND s.seq = l.seq + 1
    LEFT JOIN moves m ON m.workspace_id = s.workspace_id AND m.seq = s.seq AND m.new_field = s.field
  WHERE s.field = l.field OR m.old_field = l.field),
declared(squeezed, name) AS (VALUES """ + ", ".join(f"('{a}', '{b}')" for a, b in declared_names().items()) + r"""),
named AS (SELECT l.*, d.name FROM lines l LEFT JOIN declared d ON d.squeezed = regexp_replace(lower(l.field), '[^a-z0-9]', '', 'g')),
first AS (SELECT workspace_id, line, arg_min(name, (seq, field)) FILTER (WHERE name IS NOT NULL) AS name, arg_min(field, (seq, field)) AS own FROM named GROUP BY ALL),
routes AS (SELECT n.workspace_id, n.seq, n.field, coalesce(f.name, f.own) AS canonical FROM named n JOIN first f USING (workspace_id, line)),
"""
P1_RECORDS = _P1_NAMED + r"""
given AS (
  SELECT r.row_id, o.canonical, k.field, json_extract_string(r.record, '$."' || k.field || '"') AS text
  FROM registry_files r JOIN files f USING (workspace_id, file_id), unnest(json_keys(r.record)) AS k(field) JOIN routes o ON o.workspace_id = f.workspace_id AND o.seq = f.seq AND o.field = k.field
  WHERE json_valid(r.record) AND json_type(r.record, '$."' || k.field || '"') <> 'NULL'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row_id, canonical ORDER BY field) AS n FROM given),
wide AS (SELECT row_id, """ + ", ".join(f"max(text) FILTER (WHERE n = 1 AND canonical = '{c}') AS {c.lower()}" for c in REGISTRY_FIELDS) + r""",
  '{' || string_agg(to_json(canonical) || ':' || to_json(text), ',' ORDER BY field) FILTER (WHERE n = 1 AND canonical NOT IN (""" + ", ".join(f"'{c}'" for c in REGISTRY_FIELDS) + r""")) || '}' AS extra,
  string_agg('{"rule":"CONFLICT","field":' || to_json(field) || ',"value":' || to_json(text) || '}', ',' ORDER BY field) FILTER (WHERE n > 1) AS conflicts FROM ranked GROUP BY row_id),
noted AS (SELECT r.row_id, workspace_id, file_id, line_no, w.* EXCLUDE (row_id, usage_count), json_valid(r.record) AS ok, w.usage_count AS raw, try_cast(w.usage_count AS BIGINT) AS parsed FROM registry_files r LEFT JOIN wide w USING (row_id))
SELECT row_id, workspace_id, file_id, line_no, """ + ", ".join(c.lower() for c in REGISTRY_FIELDS if c != "Usage_Count") + r""", CASE WHEN raw IS NULL AND ok THEN 0 ELSE parsed END AS usage_count, coalesce(extra, '') AS extra,
  CASE WHEN conflicts IS NULL AND (parsed IS NOT NULL OR NOT coalesce(ok, false)) THEN '' ELSE '[' || concat_ws(',', conflicts, CASE WHEN raw IS NOT NULL AND parsed IS NULL THEN '{"rule":"CAST","field":"Usage_Count","value":' || to_json(raw) || '}' END,
    CASE WHEN raw IS NULL AND ok THEN '{"rule":"DEFAULT","field":"Usage_Count","value":"0"}' END) || ']' END AS changes FROM noted"""
P1_RULES = _P1_NAMED + r"""
kinds AS (SELECT workspace_id, seq, field, bit_or(CASE kind WHEN 'NULL' THEN 0 WHEN 'VARCHAR' THEN 1 WHEN 'BOOLEAN' THEN 4 WHEN 'ARRAY' THEN 8 WHEN 'OBJECT' THEN 16 ELSE 2 END) AS kinds FROM entries GROUP BY ALL),
prints AS (SELECT f.workspace_id, f.seq, coalesce(list(field || ' ' || kinds ORDER BY field) FILTER (WHERE field IS NOT NULL), []) AS print FROM files f LEFT JOIN kinds k USING (workspace_id, seq) GROUP BY ALL),
begun AS (SELECT workspace_id, seq, row_number() OVER (PARTITION BY workspace_id ORDER BY seq) AS version FROM (SELECT *, lag(print) OVER (PARTITION BY workspace_id ORDER BY seq) AS p FROM prints) WHERE p IS DISTINCT FROM print),
held AS (SELECT b.workspace_id, b.version, k.field, k.kinds, r.canonical FROM begun b JOIN kinds k USING (workspace_id, seq) JOIN routes r USING (workspace_id, seq, field))
SELECT workspace_id, version, 'RENAME' AS rule, field, canonical FROM held WHERE field <> canonical
UNION ALL SELECT workspace_id, version, 'CAST', field, canonical FROM held WHERE canonical IN (""" + ", ".join(f"'{c}'" for c in REGISTRY_FIELDS) + r""") AND kinds & (CASE WHEN canonical = 'Usage_Count' THEN 29 ELSE 30 END) <> 0
UNION ALL SELECT workspace_id, version, 'DEFAULT', '', 'Usage_Count' FROM begun b WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.workspace_id = b.workspace_id AND h.version = b.version AND h.canonical = 'Usage_Count')"""

_TRIM = r"regexp_replace(coalesce({0}, ''), '^\s+|\s+$', '', 'g')"

_P4_RUNS = f"""
WITH days AS (
  SELECT workspace_id, snapshot_date, row_number() OVER w AS seq, lead(snapshot_date) OVER w AS next_date
  FROM (SELECT DISTINCT workspace_id, snapshot_date FROM registry_snapshots) WINDOW w AS (PARTITION BY workspace_id ORDER BY snapshot_date)),
latest AS (
  SELECT *, row_number() OVER (PARTITION BY workspace_id, snapshot_date, {_TRIM.format('term_id')} ORDER BY loaded_at DESC, row_id DESC) AS rn
  FROM registry_snapshots WHERE {_TRIM.format('term_id')} <> ''),
present AS (
  SELECT workspace_id, {_TRIM.format('term_id')} AS term_id, snapshot_date, seq, next_date, {', '.join(_TRIM.format(a) + ' AS ' + a for a in ('status', 'first_verified', 'last_verified', 'preferred_chinese'))}
  FROM latest JOIN days USING (workspace_id, snapshot_date) WHERE rn = 1),
marked AS (
  SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag(status) OVER w = status AND lag(first_verified) OVER w = first_verified
                  AND lag(last_verified) OVER w = last_verified AND lag(preferred_chinese) OVER w = preferred_chinese THEN 0 ELSE 1 END AS opens
  FROM present WINDOW w AS (PARTITION BY workspace_id, term_id ORDER BY seq)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY workspace_id, term_id ORDER BY seq) AS run FROM marked),
versions AS (
  SELECT workspace_id, term_id, status, first_verified, last_verified, preferred_chinese,
         strftime(min(snapshot_date), '%Y-%m-%d') AS valid_from, coalesce(strftime(arg_max(next_date, seq), '%Y-%m-%d'), '') AS valid_to
  FROM runs GROUP BY workspace_id, term_id, run, status, first_verified, last_verified, preferred_chinese)
"""
# the run's own next date is null at the workspace's last snapshot, which arg_max would skip over
_P4_RUNS = _P4_RUNS.replace("coalesce(strftime(arg_max(next_date, seq), '%Y-%m-%d'), '')", "CASE WHEN count(*) > count(next_date) THEN '' ELSE strftime(max(next_date), '%Y-%m-%d') END")
P4_FOUND = _P4_RUNS + "SELECT DISTINCT term_id, valid_from, valid_to FROM versions"
P4_VERSIONS = _P4_RUNS + "SELECT * FROM versions"

_P5 = r"""
WITH refs AS (
  SELECT 'terminology_registry' AS ref_table, 'evidence_id' AS ref_field, row_id, upper(trim(evidence_id)) AS k, loaded_at AS t FROM terminology_registry
  UNION ALL SELECT 'paper_terminology', 'term_id', row_id, upper(trim(term_id)), used_at FROM paper_terminology
  UNION ALL SELECT 'paper_terminology', 'frame_id', row_id, upper(trim(frame_id)), used_at FROM paper_terminology),
events AS (
  SELECT upper(trim(CASE WHEN coalesce(event_type, 'ADD') = 'ADD' THEN evidence_id ELSE coalesce(target_evidence_id, evidence_id) END)) AS k,
         coalesce(event_type, 'ADD') AS e, recorded_at AS t, seq FROM terminology_evidence WHERE coalesce(event_type, 'ADD') IN ('ADD', 'DEPRECATE')),
spans AS (
  SELECT 'evidence_id' AS ref_field, k, t AS a, CASE WHEN e = 'ADD' THEN lead(t) OVER (PARTITION BY k ORDER BY t, seq) ELSE t END AS z, e FROM events
  UNION ALL SELECT 'term_id', upper(trim(term_id)), loaded_at, removed_at, 'ADD' FROM terminology_registry
  UNION ALL SELECT 'frame_id', upper(trim(frame_id)), loaded_at, removed_at, 'ADD' FROM text_frame_inventory),
firsts AS (SELECT ref_field, k, min(a) AS first_at FROM spans WHERE e = 'ADD' AND k <> '' GROUP BY ALL),
judged AS (
  SELECT r.*, CASE WHEN f.first_at IS NULL THEN 'MISSING' WHEN f.first_at > r.t THEN 'LATE'
    WHEN NOT EXISTS (SELECT 1 FROM spans s WHERE s.ref_field = r.ref_field AND s.k = r.k AND s.e = 'ADD' AND s.a <= r.t AND (s.z IS NULL OR s.z > r.t)) THEN 'DELETED' END AS reason
  FROM refs r LEFT JOIN firsts f USING (ref_field, k) WHERE r.k <> ''),
found AS (SELECT ref_table, ref_field, row_id, reason, strftime(t, '%Y-%m') AS ref_month FROM judged WHERE reason IS NOT NULL)
"""
P5_FOUND = _P5 + "SELECT * FROM found"
P5_REPORT = _P5 + "SELECT ref_table, ref_field, ref_month, reason, count(*) AS n_orphans FROM found GROUP BY ALL"

_SEPARATORS = ";；,，、､|｜/／\\n\\r"


def _packed(field: str, blanks: str) -> str:
    # a value is a run of quoted parts, bracketed parts and characters that neither separate nor open; brackets hold no brackets here
    item = rf'(?:"(?:[^"]|"")*"|“[^”]*”|\([^()（）]*\)|（[^()（）]*）|[^{_SEPARATORS}{blanks}"“(（])+'
    return f"""
  SELECT row_id, '{field}' AS field_name, starts_with(trim({field}), '[') AND json_valid({field}) AS listed, CASE WHEN starts_with(trim({field}), '[') AND json_valid({field}) THEN list_transform(json_extract_string({field}, '$[*]'), lambda x: trim(x))
    ELSE list_transform(regexp_extract_all({field}, '{item}'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) END AS items FROM terminology_registry WHERE regexp_matches({field}, '[^ ]')"""


_P2_RAW = "WITH raw AS (" + _packed("evidence_ids", " \\t") + " UNION ALL " + _packed("alternative_chinese", "") + "), "
P2_FOUND = (
    _P2_RAW + r"""
plain AS (SELECT row_id, field_name, list_filter(list_transform(items, lambda x: CASE WHEN length(x) > 1 AND x[1] = '"' AND x[-1] = '"' THEN trim(replace(x[2:-2], '""', '"'))
  WHEN length(x) > 1 AND x[1] = '“' AND x[-1] = '”' THEN trim(x[2:-2]) ELSE x END), lambda x: x <> '') AS items FROM raw)
SELECT row_id, field_name, CAST(pos AS BIGINT) AS pos_no, items[pos] AS item_text FROM (SELECT *, unnest(range(1, len(items) + 1)) AS pos FROM plain)"""
)
# values that hold a separator: those the dictionary knows
_P2_HELD = f"list_filter(items, lambda x: regexp_matches(x, '[{_SEPARATORS}' || CASE field_name WHEN 'evidence_ids' THEN ' \\t' ELSE '' END || ']'))"
P2_DICTIONARY = _P2_RAW + f"held AS (SELECT CASE field_name WHEN 'evidence_ids' THEN 'ids' ELSE 'text' END AS kind, unnest({_P2_HELD}) AS value FROM raw WHERE NOT listed) SELECT kind, value, count(*) AS n FROM held GROUP BY ALL"
P2_DECIDED = _P2_RAW + f"held AS (SELECT field_name, NOT listed AND len({_P2_HELD}) > 0 AS decided FROM raw) SELECT field_name, count(*) AS n_cells, count(*) FILTER (WHERE decided) AS n_decided FROM held GROUP BY field_name"


def _elements(j: str) -> str:
    return f"CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN [] WHEN json_type({j}) = 'ARRAY' THEN json_extract({j}, '$[*]') ELSE [{j}] END"


def _text(j: str) -> str:
    return f"CASE WHEN {j} IS NULL OR json_type({j}) = 'NULL' THEN '' ELSE {j} ->> '$' END"


P3_FOUND = f"""
WITH b AS (SELECT DISTINCT map_id, CAST(body AS JSON) AS body FROM c_source_map WHERE json_valid(body)),
places AS (
  SELECT map_id, 0 AS part, (body -> 'paragraphs') AS p FROM b UNION ALL SELECT map_id, 1, ((body -> 'review') -> 'paragraphs') FROM b
  UNION ALL SELECT map_id, 1 + i, (sections[i] -> 'paragraphs') FROM (SELECT map_id, sections, unnest(range(1, len(sections) + 1)) AS i FROM (SELECT map_id, {_elements("(body -> 'sections')")} AS sections FROM b))),
decoded AS (SELECT map_id, part, CASE WHEN json_type(p) = 'VARCHAR' AND json_valid((p ->> '$')) THEN CAST((p ->> '$') AS JSON) ELSE p END AS p FROM places WHERE p IS NOT NULL),
lists AS (SELECT map_id, part, {_elements('p')} AS ps FROM decoded),
paragraphs AS (SELECT map_id, ps[i] AS p, row_number() OVER (PARTITION BY map_id ORDER BY part, i) AS pn FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM lists)),
claim_lists AS (SELECT map_id, pn, {_text("(p -> 'paragraph_index')")} AS paragraph_index, {_elements("(p -> 'claims')")} AS cs FROM paragraphs),
claims AS (SELECT map_id, pn, paragraph_index, cn, {_text("(c -> 'source_class')")} AS source_class, {_elements("(c -> 'source_anchor')")} AS ans
  FROM (SELECT *, cs[cn] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS cn FROM claim_lists))),
anchors AS (SELECT map_id, pn, paragraph_index, cn, source_class, n, ans[n] AS a FROM (SELECT *, unnest(range(1, len(ans) + 1)) AS n FROM claims)),
found AS (
  SELECT map_id, pn AS paragraph_no, paragraph_index, cn AS claim_no, source_class, n AS anchor_no, CASE WHEN json_type(a) = 'VARCHAR' THEN a ->> '$' ELSE {_text("(a -> 'section')")} END AS anchor FROM anchors
  UNION ALL SELECT map_id, pn, paragraph_index, cn, source_class, 0, '' FROM claims WHERE len(ans) = 0
  UNION ALL SELECT map_id, pn, paragraph_index, 0, '', 0, '' FROM claim_lists WHERE len(cs) = 0)
SELECT map_id, CAST(paragraph_no AS BIGINT) AS paragraph_no, paragraph_index, CAST(claim_no AS BIGINT) AS claim_no, source_class, CAST(anchor_no AS BIGINT) AS anchor_no, anchor FROM found"""

_P3 = P3_FOUND[: P3_FOUND.index(",\nfound AS (")]
# scalar fields of an object in the order of their names, and the text of what is no object
_P3_AT = """json_extract({0}, '$."' || k || '"')"""
_P3_FIELDS = (
    "CASE WHEN json_type({0}) = 'OBJECT' THEN '{{' || array_to_string(list_transform(list_sort(list_filter(json_keys({0}), lambda k: json_type(" + _P3_AT + ") NOT IN ('OBJECT', 'ARRAY'))), "
    "lambda k: to_json(k) || ':' || to_json(CASE WHEN json_type(" + _P3_AT + ") = 'NULL' THEN '' ELSE " + _P3_AT + " ->> '$' END)), ',') || '}}' ELSE '{{}}' END AS fields, CASE WHEN json_type({0}) <> 'OBJECT' THEN {0} ->> '$' END AS value"
)
P3_PARAGRAPHS = _P3 + " SELECT DISTINCT map_id, CAST(pn AS BIGINT) AS no, " + _P3_FIELDS.format("p") + " FROM paragraphs WHERE json_type(p) <> 'NULL'"
P3_CLAIMS = _P3 + " SELECT DISTINCT map_id, CAST(pn AS BIGINT) AS paragraph_no, true AS in_paragraph, CAST(cn AS BIGINT) AS no, " + _P3_FIELDS.format("c") + " FROM (SELECT *, cs[cn] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS cn FROM claim_lists)) WHERE json_type(c) <> 'NULL'"
P3_ANCHORS = _P3 + " SELECT DISTINCT map_id, CAST(pn AS BIGINT) AS paragraph_no, CAST(cn AS BIGINT) AS claim_no, true AS in_paragraph, true AS in_claim, CAST(n AS BIGINT) AS no, " + _P3_FIELDS.format("a") + " FROM anchors WHERE json_type(a) <> 'NULL'"

_P4_ATTRIBUTE = """
  SELECT workspace_id, term_id, '{0}' AS attribute, any_value({0}) AS value, min(snapshot_date) AS a, max(snapshot_date) AS z, count(*) > count(next_date) AS o, max(next_date) AS n
  FROM (SELECT *, sum(opens) OVER (PARTITION BY workspace_id, term_id ORDER BY seq) AS r FROM (
    SELECT *, CASE WHEN lag(seq) OVER w = seq - 1 AND lag({0}) OVER w = {0} THEN 0 ELSE 1 END AS opens FROM present WINDOW w AS (PARTITION BY workspace_id, term_id ORDER BY seq)))
  GROUP BY workspace_id, term_id, r"""
P4_ATTRIBUTE_LOG = (
    _P4_RUNS[: _P4_RUNS.index("marked AS (")] + "logs AS (" + " UNION ALL ".join(_P4_ATTRIBUTE.format(a) for a in ("status", "first_verified", "last_verified", "preferred_chinese")) + ")"
    + " SELECT workspace_id, term_id, attribute, value, strftime(a, '%Y-%m-%d') AS valid_from, CASE WHEN o THEN '' ELSE strftime(n, '%Y-%m-%d') END AS valid_to FROM logs"
)

SQL = {"p1_found": P1_FOUND, "p1_versions": P1_VERSIONS, "p1_records": P1_RECORDS, "p1_rules": P1_RULES, "p2_found": P2_FOUND, "p2_dictionary": P2_DICTIONARY, "p2_decided": P2_DECIDED, "p3_found": P3_FOUND, "p3_paragraphs": P3_PARAGRAPHS, "p3_claims": P3_CLAIMS, "p3_anchors": P3_ANCHORS, "p4_found": P4_FOUND, "p4_attribute_log": P4_ATTRIBUTE_LOG, "p4_versions": P4_VERSIONS, "p5_found": P5_FOUND, "p5_report": P5_REPORT}
