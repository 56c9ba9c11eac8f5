"""SQL for the queries of reference_queries, in the dialect of the comparing engine."""

SQL: dict[str, str] = {}

_OBSERVED = """
obs AS (SELECT user_id, event_type, event_id,
  CASE WHEN event_id % 5 = 0 THEN 'UNKNOWN' WHEN floor(coalesce(value, 0) / 10) = 0 THEN 'MISSING' WHEN floor(value / 10) = 1 THEN 'PRESENT_UNVERIFIED'
       WHEN floor(value / 10) = 9 THEN 'CONFLICT' ELSE 'VERIFIED' END AS status FROM events),
known AS (SELECT *, last_value(CASE WHEN status <> 'UNKNOWN' THEN status END IGNORE NULLS) OVER w AS last_known,
                 row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn
          FROM obs WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
latest AS (SELECT user_id, event_type, CASE WHEN status = 'UNKNOWN' THEN coalesce(last_known, 'UNKNOWN') ELSE status END AS shown FROM known WHERE rn = 1)"""
_PLACES = ("click", "error", "purchase", "signup", "view")
_WIDE = "wide AS (SELECT user_id, " + ", ".join(f"coalesce(max(CASE WHEN event_type = '{p}' THEN shown END), 'UNKNOWN') AS {p}" for p in _PLACES) + " FROM latest GROUP BY user_id)"
_DONE = "('VERIFIED', 'NOT_APPLICABLE')"
SQL["status_overview"] = f"""WITH {_OBSERVED}, {_WIDE},
overall AS (SELECT user_id, CASE WHEN bool_or(shown = 'CONFLICT') THEN 'CONFLICT' WHEN bool_or(shown = 'MISSING') THEN 'MISSING' WHEN bool_or(shown = 'PRESENT_UNVERIFIED') THEN 'PRESENT_UNVERIFIED'
  WHEN bool_and(shown = 'VERIFIED') THEN 'VERIFIED' ELSE 'UNKNOWN' END AS overall FROM latest GROUP BY user_id)
SELECT wide.*, CAST({' + '.join(f"(CASE WHEN {p} IN {_DONE} THEN 0 ELSE 1 END)" for p in _PLACES)} AS BIGINT) AS pending, overall FROM wide JOIN overall USING (user_id)"""
SQL["pending_unpivot"] = f"WITH {_OBSERVED}, {_WIDE} " + " UNION ALL ".join(f"SELECT user_id, '{p}' AS place, {p} AS status FROM wide WHERE {p} NOT IN {_DONE}" for p in _PLACES)
SQL["carry_forward"] = f"WITH {_OBSERVED} SELECT event_id, status, coalesce(last_known, '') AS last_known FROM known"
SQL["overview_lines"] = f"WITH {_OBSERVED}, {_WIDE} SELECT '| ' || user_id || ' | ' || " + " || ' | ' || ".join(_PLACES) + " || ' |' AS line FROM wide"
SQL["presence_status"] = """
WITH u AS (SELECT * FROM orders),
p AS (SELECT c_custkey AS key, count(o_orderkey) AS n, bool_and(o_orderstatus <> 'P') AS place, bool_and(o_totalprice > 100000) AS whole FROM customer LEFT JOIN u ON o_custkey = c_custkey GROUP BY c_custkey)
SELECT key, n, CASE WHEN n = 0 THEN 'MISSING' WHEN n > 1 THEN 'CONFLICT' WHEN NOT place THEN 'CONFLICT' WHEN NOT whole THEN 'MISSING' ELSE 'PRESENT_UNVERIFIED' END AS status FROM p"""

SQL["doi_normalize"] = """SELECT lower(trim(p)) AS doi, count(*) AS n FROM (SELECT paper_id AS p FROM paper_terminology UNION ALL SELECT paper_id FROM terminology_evidence) WHERE trim(p) <> '' GROUP BY 1"""
SQL["week_label"] = "SELECT strftime(o_orderdate, '%G-W%V') AS week, count(*) AS n FROM orders GROUP BY 1"
SQL["canonical_dates"] = r"SELECT coalesce(regexp_matches(regexp_replace(first_verified, '^\s+|\s+$', '', 'g'), '^\d{4}-\d{2}-\d{2}$') AND try_cast(regexp_replace(first_verified, '^\s+|\s+$', '', 'g') AS DATE) IS NOT NULL, false) AS canonical, count(*) AS n FROM registry_snapshots GROUP BY 1"
SQL["id_patterns"] = r"SELECT count(*) FILTER (WHERE regexp_matches(trim(term_id), '^TERM-\d{4,}$')) AS term_id_ok, count(*) FILTER (WHERE regexp_matches(trim(evidence_id), '^TERMEV-\d{4,}$')) AS evidence_id_ok, count(*) FILTER (WHERE regexp_matches(trim(evidence_level), '^TE[1-7]$')) AS evidence_level_ok, count(*) AS n FROM terminology_registry"
SQL["dedupe_week"] = "SELECT week, o_custkey, min(o_orderkey) AS o_orderkey FROM (SELECT strftime(o_orderdate, '%G-W%V') AS week, * FROM orders) GROUP BY week, o_custkey"
SQL["dedupe_global"] = "SELECT paper, row_id, week FROM (SELECT lower(trim(paper_id)) AS paper, row_id, week, row_number() OVER (PARTITION BY lower(trim(paper_id)) ORDER BY used_at, row_id) AS rn FROM paper_terminology WHERE trim(paper_id) <> '') WHERE rn = 1"
SQL["or_identity_semi"] = """
WITH s AS (SELECT lower(trim(json_extract_string(record, '$.English_Term'))) AS e, trim(json_extract_string(record, '$.Preferred_Chinese')) AS c FROM term_submissions)
SELECT row_id, term_id FROM terminology_registry r WHERE EXISTS (SELECT 1 FROM s WHERE s.e = lower(trim(r.english_term))) OR EXISTS (SELECT 1 FROM s WHERE s.c = trim(r.preferred_chinese))"""
SQL["same_papers"] = """
WITH l AS (SELECT row_id, nullif(lower(trim(paper_id)), '') AS p, nullif(lower(trim(term_id)), '') AS t FROM terminology_registry), r AS (SELECT row_id AS id, nullif(lower(trim(paper_id)), '') AS p, nullif(lower(trim(term_id)), '') AS t FROM paper_terminology),
m AS (SELECT row_id, id FROM l JOIN r USING (p) UNION SELECT row_id, id FROM l JOIN r USING (t))
SELECT row_id, count(*) AS links, min(id) AS representative FROM m GROUP BY row_id"""
SQL["leading_issues"] = """
WITH d AS (SELECT source_id || '/' || source_page AS page, bbox_pt[4] AS top, source_font_size_pt AS s FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL), e AS (SELECT page, max(s) * 4 AS w FROM d GROUP BY page),
p AS (SELECT DISTINCT page, round_even(top * 2, 0) / 2 AS y FROM d WHERE top IS NOT NULL), g AS (SELECT page, y - lag(y) OVER (PARTITION BY page ORDER BY y) AS gap FROM p), h AS (SELECT page, gap, w FROM g JOIN e USING (page) WHERE gap > 1),
o AS (SELECT page, any_value(w) AS w, list_sort(list(gap) FILTER (WHERE gap BETWEEN w * 0.75 AND w * 1.6)) AS k FROM h GROUP BY page), m AS (SELECT page, w, k[CAST(floor(len(k) / 2) AS BIGINT) + 1] AS observed FROM o)
SELECT page, observed FROM m WHERE coalesce(abs(observed - w) > 0.75, true)"""
SQL["group_identity"] = """
WITH d AS (SELECT row_id, lower(trim(english_term)) AS a, upper(trim(term_id)) AS k FROM terminology_registry),
m AS (SELECT a, arg_max(k, row_id) AS mk FROM d WHERE a <> '' AND k IS NOT NULL GROUP BY a)
SELECT coalesce(mk, k, 'row-' || row_id) AS identity, count(*) AS n, min(row_id) AS first_row FROM d LEFT JOIN m USING (a) GROUP BY 1"""
_C = "lower(coalesce(trim({0}), ''))"
SQL["duplicate_terms"] = f"SELECT {_C.format('english_term')} AS english, {_C.format('domain')} AS domain, {_C.format('subdomain')} AS subdomain, {_C.format('context')} AS context, count(*) AS n FROM terminology_registry GROUP BY ALL HAVING count(*) > 1"
SQL["current_submission"] = """
WITH d AS (SELECT contributor, submission_id, submission_id % 211 = 0 AS f, submission_id % 7 = 0 AS p, sum(CAST(submission_id % 211 = 0 AS INT)) OVER w AS fs, sum(CAST(submission_id % 7 = 0 AS INT)) OVER w AS ps
           FROM term_submissions WINDOW w AS (PARTITION BY contributor)),
r AS (SELECT *, row_number() OVER (PARTITION BY contributor ORDER BY CASE WHEN fs = 1 AND f THEN 0 WHEN p THEN 1 ELSE 2 END, submission_id DESC) AS rn FROM d)
SELECT contributor, submission_id, fs <> 1 AND ps > 1 AS ambiguous FROM r WHERE rn = 1"""

SQL["lookup_any"] = "SELECT row_id, english_term FROM terminology_registry WHERE " + " OR ".join(f"coalesce(contains(lower({c}), 'load'), false)" for c in ("term_id", "english_term", "abbreviation", "preferred_chinese", "alternative_chinese"))
SQL["ambiguous_terms"] = """SELECT status, confidence, count(*) AS n FROM terminology_registry WHERE confidence IN ('LOW', 'MEDIUM') OR status = 'CONTEXTUAL' OR trim(alternative_chinese, chr(10) || ' ') <> ''
  OR NOT (trim(coalesce(evidence_id, '')) <> '' OR trim(coalesce(evidence_ids, '')) <> '') GROUP BY ALL"""
_IDS = r"list_filter(list_transform(string_split_regex(coalesce(evidence_id, '') || ';' || coalesce(evidence_ids, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '')"
SQL["resolve_context"] = f"""
WITH q AS (SELECT submission_id AS query_id, {_C.format("json_extract_string(record, '$.English_Term')")} AS t, json_extract_string(record, '$.Domain') AS d FROM term_submissions WHERE json_extract_string(record, '$.English_Term') IS NOT NULL),
r AS (SELECT term_id, {_C.format('english_term')} AS t, {_C.format('domain')} AS d, confidence = 'HIGH' AND status IN ('ACTIVE', 'CONTEXTUAL') AND len({_IDS}) > 0 AS good FROM terminology_registry WHERE removed_at IS NULL AND trim(english_term) <> ''),
p AS (SELECT query_id, count(r.term_id) AS n_candidates, count(*) FILTER (WHERE r.good) AS g, min(r.term_id) FILTER (WHERE r.good) AS f FROM q LEFT JOIN r ON q.t = r.t AND (q.d IS NULL OR {_C.format('q.d')} = r.d) GROUP BY query_id)
SELECT query_id, n_candidates, CASE WHEN g = 1 THEN 'REUSE' ELSE 'VERIFY' END AS decision, CASE WHEN g = 1 THEN f ELSE '' END AS term_id FROM p"""
# the log replayed by hand: the last addition, then every later event on it
_LATER = "(SELECT arg_max(u.{0}, u.seq) FROM ev u WHERE u.id = a.id AND u.seq > a.at AND u.k = 'UPDATE_SUPPORTS' AND u.new_supports IS NOT NULL AND u.{0} IS NOT NULL)"
_FOLD = f"""
ev AS (SELECT seq, CASE WHEN event_type IN ('DEPRECATE', 'UNLINK', 'UPDATE_SUPPORTS') THEN event_type ELSE 'ADD' END AS k, upper(trim(CASE WHEN event_type IN ('DEPRECATE', 'UNLINK', 'UPDATE_SUPPORTS') THEN target_evidence_id ELSE evidence_id END)) AS id, * EXCLUDE (seq) FROM terminology_evidence),
adds AS (SELECT id, max(seq) AS at FROM ev WHERE k = 'ADD' AND id <> '' GROUP BY id),
state AS (SELECT a.id, e.evidence_type, e.supports AS s0, e.reported_terms AS r0, e.roles AS o0, e.status,
   {_LATER.format('new_supports')} AS s1, {_LATER.format('reported_terms')} AS r1, {_LATER.format('roles')} AS o1,
   EXISTS (SELECT 1 FROM ev g WHERE g.id = a.id AND g.seq > a.at AND g.k = 'DEPRECATE') AS gone
   FROM adds a JOIN ev e ON e.seq = a.at),
folded AS (SELECT id, evidence_type, coalesce(s1, s0) AS supports, coalesce(r1, r0) AS reported_terms, coalesce(o1, o0) AS roles, CASE WHEN gone THEN 'DEPRECATED' ELSE coalesce(status, 'ACTIVE') END AS state FROM state)"""
SQL["evidence_fold"] = f"WITH {_FOLD} SELECT id AS evidence_id, state, coalesce(evidence_type, '') AS evidence_type, coalesce(array_to_string(supports, '|'), '') AS supports, coalesce(array_to_string(reported_terms, '|'), '') AS reported_terms, coalesce(array_to_string(roles, '|'), '') AS roles FROM folded"
SQL["evidence_links"] = f"""WITH {_FOLD},
links AS (SELECT DISTINCT term_id, {_C.format('english_term')} AS t, unnest(list_transform({_IDS}, lambda x: upper(x))) AS id FROM terminology_registry),
issues AS (SELECT DISTINCT term_id, l.id, CASE WHEN f.id IS NULL THEN 'UNKNOWN' WHEN f.state = 'DEPRECATED' THEN 'DEPRECATED' WHEN NOT coalesce(list_contains(list_transform(f.supports, lambda x: lower(trim(x))), l.t), false) THEN 'UNSUPPORTED' END AS issue FROM links l LEFT JOIN folded f ON f.id = l.id)
SELECT issue, count(*) AS n, count(DISTINCT term_id) AS n_terms FROM issues WHERE issue IS NOT NULL GROUP BY issue"""
SQL["overclaimed_evidence"] = f"WITH {_FOLD} SELECT id FROM folded WHERE evidence_type = 'TE7' AND len(list_filter(coalesce(supports, []), lambda x: NOT list_contains(coalesce(reported_terms, []), x))) > 0"
SQL["usage_count"] = "SELECT upper(trim(term_id)) AS term, count(DISTINCT lower(trim(paper_id))) AS n_papers, strftime(min(used_at), '%Y-%m-%d') AS first_used, strftime(max(used_at), '%Y-%m-%d') AS last_used FROM paper_terminology WHERE trim(term_id) <> '' AND trim(paper_id) <> '' GROUP BY 1"
SQL["usage_merge"] = """
WITH r AS (SELECT upper(trim(term_id)) AS term_id, max(try_cast(usage_count AS BIGINT)) AS c, max(last_used) AS l FROM terminology_registry GROUP BY 1),
u AS (SELECT upper(trim(term_id)) AS term_id, count(DISTINCT lower(trim(paper_id))) AS p, strftime(max(used_at), '%Y-%m-%d') AS d FROM paper_terminology WHERE trim(term_id) <> '' AND trim(paper_id) <> '' GROUP BY 1)
SELECT term_id, coalesce(c, 0) + coalesce(p, 0) AS usage_count, greatest(l, d) AS last_used, coalesce(p, 0) AS n_papers FROM r LEFT JOIN u USING (term_id)"""
_PARTS = "list_filter(list_transform(string_split(coalesce({0}, ''), ';'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
SQL["merge_alternatives"] = f"""WITH v AS (SELECT row_id, list_concat({_PARTS.format('alternative_chinese')}, {_PARTS.format('preferred_chinese')}) AS a FROM terminology_registry)
SELECT row_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '; ') AS merged FROM v"""
SQL["term_choices"] = r"""
WITH r AS (SELECT upper(trim(term_id)) AS id, list(DISTINCT trim(preferred_chinese)) AS ok FROM terminology_registry GROUP BY 1),
i AS (SELECT DISTINCT paper_id, upper(trim(p.term_id)) AS id, CASE WHEN r.ok IS NULL THEN 'UNKNOWN' WHEN NOT list_contains(r.ok, coalesce(trim(p.preferred_chinese), '')) THEN 'PREFERRED' END AS issue
      FROM paper_terminology p LEFT JOIN r ON r.id = upper(trim(p.term_id)) WHERE p.paper_id IS NOT NULL AND trim(p.term_id) <> '')
SELECT issue, count(*) AS n FROM i WHERE issue IS NOT NULL GROUP BY issue"""
SQL["wording_conflicts"] = f"SELECT {_C.format('english_term')} AS english, count(DISTINCT trim(preferred_chinese)) AS n_wordings FROM paper_terminology GROUP BY 1 HAVING count(DISTINCT trim(preferred_chinese)) > 1 AND english <> ''"
SQL["term_in_documents"] = "SELECT term, count(*) AS n_docs FROM (SELECT DISTINCT trim(abbreviation) AS term FROM terminology_registry WHERE trim(abbreviation) <> '') JOIN documents ON contains(text, term) GROUP BY term"
SQL["reconcile_rows"] = "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 AND c_custkey % 2 = 0 THEN 'REVIEW' ELSE c_mktsegment END AS c_mktsegment FROM customer"
SQL["reconcile_audit"] = "SELECT c_custkey, 'c_mktsegment' AS field, c_mktsegment AS old_value, 'REVIEW' AS new_value, 'negative balance' AS reason FROM customer WHERE c_acctbal < 0 AND c_custkey % 2 = 0"
SQL["append_new_terms"] = """
SELECT DISTINCT lower(trim(json_extract_string(record, '$.English_Term'))) AS english, trim(json_extract_string(record, '$.Domain')) AS domain FROM term_submissions s
WHERE english IS NOT NULL AND domain IS NOT NULL AND NOT EXISTS (SELECT 1 FROM terminology_registry r WHERE lower(trim(r.english_term)) = lower(trim(json_extract_string(s.record, '$.English_Term'))) AND trim(r.domain) = trim(json_extract_string(s.record, '$.Domain')))"""
SQL["preferred_changes"] = """
WITH one AS (SELECT term_id, arg_min(preferred_chinese, row_id) AS p FROM terminology_registry GROUP BY term_id),
c AS (SELECT term_id, 'alt ' || term_id AS n, max(reason) AS reason FROM terminology_evidence WHERE event_type = 'UNLINK' AND term_id IS NOT NULL AND trim(reason) <> '' GROUP BY term_id)
SELECT term_id, p AS old_preferred_chinese, n AS new_preferred_chinese, reason FROM one JOIN c USING (term_id) WHERE p IS DISTINCT FROM n"""
SQL["unlinked_evidence"] = r"""
WITH one AS (SELECT term_id, arg_min(coalesce(evidence_ids, ''), row_id) AS ids FROM terminology_registry GROUP BY term_id),
l AS (SELECT DISTINCT term_id, unnest(list_filter(list_transform(string_split_regex(ids, '[;,]'), lambda x: trim(x)), lambda x: x <> '')) AS e FROM one)
SELECT term_id, e AS target_evidence_id, 'UNLINK' AS event_type FROM l WHERE e IN (SELECT target_evidence_id FROM terminology_evidence WHERE event_type = 'DEPRECATE')"""

SQL["coverage_diff"] = "WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag <> 'R') SELECT coalesce(o_orderkey, k) AS k, CASE WHEN k IS NULL THEN 'MISSING' ELSE 'EXTRA' END AS issue FROM orders FULL JOIN f ON o_orderkey = k WHERE k IS NULL OR o_orderkey IS NULL"
SQL["frame_coverage"] = """
WITH e AS (SELECT DISTINCT upper(trim(frame_id)) AS k FROM text_frame_inventory WHERE translatable AND trim(frame_id) <> ''), f AS (SELECT DISTINCT upper(trim(frame_id)) AS k FROM paper_terminology WHERE trim(frame_id) <> '')
SELECT CASE WHEN f.k IS NULL THEN 'MISSING' ELSE 'EXTRA' END AS issue, count(*) AS n FROM e FULL JOIN f ON e.k = f.k WHERE e.k IS NULL OR f.k IS NULL GROUP BY 1"""
SQL["value_coverage"] = """
WITH e AS (SELECT upper(trim(term_id)) AS k, max(trim(english_term)) AS v FROM terminology_registry GROUP BY 1), f AS (SELECT upper(trim(term_id)) AS k, max(trim(english_term)) AS v FROM paper_terminology WHERE trim(term_id) <> '' GROUP BY 1)
SELECT coalesce(e.k, f.k) AS k, CASE WHEN f.k IS NULL THEN 'MISSING' WHEN e.k IS NULL THEN 'EXTRA' ELSE 'MISMATCH' END AS issue, CASE WHEN e.k IS NOT NULL AND f.k IS NOT NULL THEN 'english' ELSE '' END AS differing
FROM e FULL JOIN f ON e.k = f.k WHERE e.k IS NULL OR f.k IS NULL OR e.v IS DISTINCT FROM f.v"""
SQL["link_both_ways"] = """
SELECT 'no_parent' AS side, o_custkey AS key FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT c_custkey FROM customer) GROUP BY o_custkey
UNION ALL SELECT 'no_child', c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey = c_custkey)"""
SQL["expected_sequence"] = """
WITH l AS (SELECT * FROM lineitem WHERE l_returnflag <> 'N')
SELECT l_orderkey, CAST(n AS BIGINT) AS l_linenumber FROM (SELECT l_orderkey, unnest(range(1, max(l_linenumber) + 1)) AS n FROM l GROUP BY l_orderkey) m WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = m.l_orderkey AND l.l_linenumber = m.n)"""
SQL["page_sequence"] = "SELECT source_id, count(DISTINCT source_page) AS n, min(source_page) = 1 AND max(source_page) = count(DISTINCT source_page) AS passed FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL GROUP BY source_id"
_BAG = "SELECT {0}, CAST(greatest(d, 0) AS BIGINT) AS missing, CAST(greatest(-d, 0) AS BIGINT) AS added FROM (SELECT {1}, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END) AS d FROM lineitem GROUP BY ALL) WHERE d <> 0"
SQL["multiset_diff"] = _BAG.format("l_orderkey, token", "l_orderkey, l_linestatus AS token")
SQL["page_cancel"] = f"""
WITH diff AS ({_BAG.format("page, l_orderkey, token", "l_suppkey % 50 AS page, l_orderkey, l_linenumber AS token")}),
u AS (SELECT page, token, l_orderkey, 'm' AS side, unnest(range(missing)) AS i FROM diff UNION ALL SELECT page, token, l_orderkey, 'a', unnest(range(added)) FROM diff),
r AS (SELECT *, row_number() OVER (PARTITION BY page, token, side ORDER BY l_orderkey, i) AS rn FROM u),
n AS (SELECT page, token, count(*) FILTER (WHERE side = 'm') AS ms, count(*) FILTER (WHERE side = 'a') AS ads FROM u GROUP BY ALL)
SELECT page, token, count(*) FILTER (WHERE side = 'm') AS missing, count(*) FILTER (WHERE side = 'a') AS added, min(l_orderkey) AS first_unit FROM r JOIN n USING (page, token) WHERE rn > least(ms, ads) GROUP BY page, token"""
SQL["bag_minus"] = """
WITH a AS (SELECT frame_kind, weight, count(*) AS n FROM text_frame_inventory WHERE rotation = 0 AND source_page > 1 GROUP BY ALL), b AS (SELECT frame_kind, weight, count(*) AS m FROM text_frame_inventory WHERE source_page = 1 GROUP BY ALL)
SELECT frame_kind, weight, n - coalesce(m, 0) AS n FROM a LEFT JOIN b USING (frame_kind, weight) WHERE n > coalesce(m, 0)"""
SQL["unique_ids"] = " UNION ALL ".join(
    f"SELECT '{c}' AS id_column, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (WHERE b), 0) AS BIGINT) AS n_blank, count(*) FILTER (WHERE NOT b) AS n_distinct, count(*) FILTER (WHERE NOT b AND n > 1) AS n_duplicated "
    f"FROM (SELECT {c} AS k, count(*) AS n, {c} IS NULL OR trim(CAST({c} AS VARCHAR)) = '' AS b FROM {t} GROUP BY {c})"
    for t, c in (("terminology_registry", "term_id"), ("text_frame_inventory", "frame_id"), ("documents", "doc_id")))
SQL["landed_compare"] = """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS k, CASE WHEN n IS NULL THEN 'absent' ELSE concat_ws(',', CASE WHEN NOT n <= 5 THEN 'lines' END, CASE WHEN NOT q > 20 THEN 'quantity' END) END AS failed FROM orders LEFT JOIN l ON k = o_orderkey)
SELECT * FROM c WHERE failed <> ''"""

SQL["lifecycle_chain"] = """
WITH d AS (SELECT event_id, event_type AS new, CASE WHEN event_id % 3 = 0 THEN 'view' ELSE 'click' END AS old, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS l FROM events)
SELECT event_id, coalesce(l, '') AS last_state, old, new FROM d WHERE (l IS NOT NULL AND l <> old) OR old = new"""
_RANGES = "r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) AS last_no, CAST(sum(CAST(l_quantity AS BIGINT)) OVER w AS BIGINT) - CAST(l_quantity AS BIGINT) + 1 AS first_no FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"
SQL["running_ranges"] = f"WITH {_RANGES} SELECT l_orderkey, l_linenumber, first_no, last_no FROM r"
SQL["ranges_contiguous"] = f"WITH {_RANGES}, k AS (SELECT *, first_no = coalesce(lag(last_no) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) + 1, 1) AS ok FROM r WHERE l_returnflag <> 'A') SELECT l_orderkey, max(last_no) AS total, bool_and(ok) AS passed FROM k GROUP BY l_orderkey"
SQL["stable_numbering"] = """
WITH t AS (SELECT p_type, max(p_partkey + 1) AS top FROM part WHERE p_size <= 25 GROUP BY 1)
SELECT p_type AS kind, p_partkey AS item, CASE WHEN p_size <= 25 THEN p_partkey + 1 ELSE coalesce(top, 0) + row_number() OVER (PARTITION BY p_type, p_size <= 25 ORDER BY p_partkey) END AS no FROM part LEFT JOIN t USING (p_type)"""
SQL["renumber"] = "SELECT row_id, row_number() OVER (PARTITION BY source_id, source_page ORDER BY reading_order NULLS FIRST, row_id) AS new_order FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL"
SQL["consecutive_runs"] = """
WITH d AS (SELECT l_orderkey, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - l_linenumber AS s FROM lineitem)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE s BETWEEN 1 AND 3) AS steps, count(*) >= 3 AND count(*) FILTER (WHERE s BETWEEN 1 AND 3) >= greatest(2, floor(count(*) / 2)) AS numbered FROM d GROUP BY l_orderkey"""
SQL["gap_median"] = """
WITH d AS (SELECT DISTINCT user_id, epoch_us(ts) AS t FROM events), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM d)
SELECT user_id, count(*) AS n, list_sort(list(gap))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM g WHERE gap > 1 GROUP BY user_id"""
SQL["upper_median_mode"] = """
WITH m AS (SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median FROM lineitem GROUP BY 1),
f AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, l_quantity) AS rn FROM lineitem GROUP BY l_suppkey, l_quantity)
SELECT l_suppkey, n, upper_median, l_quantity AS mode FROM m JOIN f USING (l_suppkey) WHERE rn = 1"""
SQL["sessions"] = """
WITH d AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 86400000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, CAST(sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM d)
SELECT user_id, session, count(*) AS n, min(event_id) AS first_event FROM s GROUP BY user_id, session"""
SQL["ordered_containment"] = r"SELECT regexp_matches(coalesce(text, ''), '(?s)return.*def .*return') AS in_order, count(*) AS n FROM documents GROUP BY 1"
SQL["section_carry"] = """SELECT row_id, coalesce(last_value(CASE WHEN frame_kind = 'heading' THEN source_text END IGNORE NULLS) OVER (PARTITION BY source_id ORDER BY source_page NULLS FIRST, reading_order NULLS FIRST, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS section FROM text_frame_inventory WHERE source_id IS NOT NULL"""

_HELD = """
live AS (SELECT source_id, source_page, row_id, bbox_pt[1] AS x0, bbox_pt[2] AS y0, bbox_pt[3] AS x1, bbox_pt[4] AS y1 FROM text_frame_inventory
  WHERE len(bbox_pt) = 4 AND bbox_pt[3] > bbox_pt[1] AND bbox_pt[4] > bbox_pt[2] AND removed_at IS NULL AND source_id IS NOT NULL AND source_page IS NOT NULL),
held AS (SELECT p.source_id, p.source_page, p.row_id AS point, b.row_id AS box, b.x0, b.y0, b.x1, b.y1, (b.x1 - b.x0) * (b.y1 - b.y0) AS area FROM live p JOIN live b USING (source_id, source_page)
  WHERE (p.x0 + p.x1) / 2 BETWEEN b.x0 - 0.25 AND b.x1 + 0.25 AND (p.y0 + p.y1) / 2 BETWEEN b.y0 - 0.25 AND b.y1 + 0.25)"""
SQL["smallest_owner"] = f"WITH {_HELD}, m AS (SELECT *, min(area) OVER (PARTITION BY point) AS a FROM held), t AS (SELECT *, count(*) FILTER (WHERE area <= a + 0.01) OVER (PARTITION BY point) AS n FROM m) SELECT source_id, source_page, point, box FROM t WHERE area = a AND n = 1"
SQL["innermost_owner"] = f"WITH {_HELD}, i AS (SELECT h.point, h.box FROM held h WHERE NOT EXISTS (SELECT 1 FROM held o WHERE o.point = h.point AND (o.x0 > h.x0 OR o.y0 > h.y0 OR o.x1 < h.x1 OR o.y1 < h.y1))) SELECT point, any_value(box) AS box FROM i GROUP BY point HAVING count(*) = 1"
SQL["owner_counts"] = f"WITH {_HELD}, c AS (SELECT live.row_id, count(held.box) AS owners FROM live LEFT JOIN held ON held.point = live.row_id GROUP BY live.row_id) SELECT owners, count(*) AS n FROM c GROUP BY owners"
SQL["style_envelopes"] = "SELECT frame_role, count(*) AS n, list_sort(list(source_font_size_pt))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS upper_median, min(source_font_size_pt) AS least, max(source_font_size_pt) AS most FROM text_frame_inventory WHERE source_font_size_pt IS NOT NULL AND frame_role IS NOT NULL GROUP BY frame_role"
SQL["range_owner"] = """
WITH b AS (SELECT p_size AS box, min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part GROUP BY 1), p AS (SELECT row_number() OVER () AS point, l_extendedprice / l_quantity AS x FROM lineitem),
h AS (SELECT point, box, hi - lo AS area, min(hi - lo) OVER (PARTITION BY point) AS a FROM p JOIN b ON x BETWEEN lo AND hi), t AS (SELECT *, count(*) FILTER (WHERE area <= a + 0.01) OVER (PARTITION BY point) AS n FROM h)
SELECT box, count(*) AS n FROM t WHERE area = a AND n = 1 GROUP BY box"""
SQL["vector_tolerance"] = """
WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, round(avg(CAST(x AS DOUBLE)), 6) AS m FROM x GROUP BY ALL)
SELECT vec_id, bool_and(abs(CAST(x AS DOUBLE) - m) <= 0.25) AS near FROM x JOIN m USING (label, i) GROUP BY vec_id"""

SQL["router"] = """
WITH r(ordinal, value, outcome) AS (VALUES (1, 'purchase', 'BUYER'), (2, 'click', 'BROWSER'), (2, 'view', 'BROWSER'), (3, 'error', 'SUPPORT'), (4, 'signup', 'MEMBER'), (4, 'purchase', 'MEMBER'), (5, 'error', 'BROWSER')),
p AS (SELECT DISTINCT user_id, event_type FROM events WHERE value > 40), h AS (SELECT user_id, outcome, min(ordinal) AS o FROM p JOIN r ON r.value = p.event_type GROUP BY ALL)
SELECT user_id, coalesce(string_agg(outcome, ',' ORDER BY o, outcome), '') AS outcomes FROM (SELECT DISTINCT user_id FROM p) LEFT JOIN h USING (user_id) GROUP BY user_id"""
SQL["set_relations"] = """
WITH d AS (SELECT user_id, coalesce(list(DISTINCT event_type) FILTER (WHERE value > 50), []) AS a, coalesce(list(DISTINCT event_type) FILTER (WHERE value <= 20), []) AS b FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_sort(list_filter(a, lambda x: list_contains(b, x))), ',') AS "both", array_to_string(list_sort(list_filter(a, lambda x: NOT list_contains(b, x))), ',') AS only_a,
  array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS "any", len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 AS b_in_a FROM d"""
SQL["weighted_rank"] = """
WITH p AS (SELECT l_suppkey, avg(l_quantity) / 10 AS q, avg(l_discount) * 50 AS d FROM lineitem GROUP BY 1),
s AS (SELECT s_nationkey, s_suppkey, CASE WHEN s_acctbal < 0 THEN 'RED' WHEN s_acctbal < 3000 THEN 'AMBER' ELSE 'GREEN' END AS gate, round((q * 60 + d * 40) / 500 * 100, 4) AS score FROM supplier JOIN p ON l_suppkey = s_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE gate WHEN 'GREEN' THEN 0 ELSE 1 END, score DESC, s_suppkey) AS rank FROM s WHERE gate <> 'RED')
SELECT * FROM r WHERE rank <= 3"""
SQL["preferred_versions"] = """
SELECT paper, kind, version FROM (SELECT trim(paper_id) AS paper, artifact AS kind, row_id AS version, row_number() OVER (PARTITION BY trim(paper_id) ORDER BY CASE artifact WHEN 'C' THEN 1 WHEN 'B' THEN 2 WHEN 'A' THEN 3 ELSE 4 END, row_id DESC) AS rn FROM paper_terminology WHERE paper_id IS NOT NULL) WHERE rn = 1"""
_CHECKS = """
bad AS (SELECT row_id, NOT coalesce(trim(frame_id) <> '', false) AS c1, NOT coalesce(len(bbox_pt) = 4 AND bbox_pt[3] > bbox_pt[1] AND bbox_pt[4] > bbox_pt[2], false) AS c2, NOT coalesce(source_page > 0, false) AS c3,
  NOT coalesce(trim(source_font) <> '', false) AS c4, NOT coalesce(CASE WHEN translatable THEN translation_action = 'TRANSLATE' ELSE translation_action = 'RETAIN_SOURCE' END, false) AS c5 FROM text_frame_inventory),
rows AS (""" + " UNION ALL ".join(
    f"SELECT '{code}' AS code, count(*) FILTER (WHERE c{i}) = 0 AS passed, count(*) FILTER (WHERE c{i}) AS n_failed, " + (f"coalesce(min(CASE WHEN c{i} THEN CAST(row_id AS VARCHAR) END), '')" if i < 5 else "''") + " AS detail FROM bad"
    for i, code in enumerate(("FRAME_ID", "BOX", "PAGE", "FONT", "ACTION"), 1)) + ")"
SQL["frame_checks"] = f"WITH {_CHECKS} SELECT * FROM rows"
SQL["checks_report"] = f"WITH {_CHECKS} SELECT 'frames' AS validator, bool_and(passed) AS passed, count(*) AS n_checks, count(*) FILTER (WHERE NOT passed) AS n_failed, coalesce(min(CASE WHEN NOT passed THEN code END), '') AS first_failure FROM rows"
SQL["suite_summary"] = """
WITH d AS (SELECT o_orderpriority AS suite, CASE WHEN o_orderstatus = 'F' THEN 'ok' WHEN o_orderstatus = 'P' THEN 'skip' WHEN o_totalprice > 400000 THEN 'failure' ELSE 'ok' END AS o FROM orders)
SELECT suite, count(*) AS run, count(*) FILTER (WHERE o = 'ok') AS passed, count(*) FILTER (WHERE o = 'failure') AS failures, count(*) FILTER (WHERE o = 'error') AS errors, count(*) FILTER (WHERE o = 'skip') AS skipped,
  count(*) FILTER (WHERE o IN ('failure', 'error', 'skip')) = 0 AS ok FROM d GROUP BY suite"""

SQL["canon_tokens"] = r"""
WITH t AS (SELECT unnest(regexp_extract_all(text, '[0-9]+[.,]?[0-9]* ?(?:ms|s|seconds|min|minutes|h|hours|days)?')) AS t FROM documents),
c AS (SELECT replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(t), '\s+', '', 'g'), '(seconds?|secs?)$', 's'), 'minutes?$|mins$', 'min'), 'hours?$|hrs$', 'h'), 'days$', 'day'), ',', '') AS token FROM t)
SELECT token, count(*) AS n FROM c GROUP BY token"""
SQL["cjk_latin_counts"] = "SELECT coalesce(lang, '') AS lang, CAST(sum(length(regexp_replace(text, '[^㐀-䶿一-鿿]', '', 'g'))) AS BIGINT) AS cjk, CAST(sum(length(regexp_replace(text, '[^A-Za-z]', '', 'g'))) AS BIGINT) AS latin, count(*) FILTER (WHERE regexp_matches(text, '[㐀-䶿一-鿿]')) AS with_cjk FROM documents GROUP BY 1"
SQL["visible_length"] = r"SELECT doc_id, CAST(length(regexp_replace(coalesce(text, ''), '[\p{Z}\p{C}\s]', '', 'g')) AS BIGINT) AS visible FROM documents"
SQL["frame_styles"] = r"""
SELECT coalesce(source_font, '') AS font_family, lower(coalesce(nullif(weight, ''), 'regular')) AS weight, regexp_matches(lower(coalesce(source_font, '')), 'bold|semibold|demi|\.b($|\+)') AS bold,
  regexp_matches(lower(coalesce(source_font, '')), 'italic|oblique|\.i($|\+)') AS italic, count(*) AS n, max(round(coalesce(source_font_size_pt, 0), 3)) AS largest FROM text_frame_inventory GROUP BY ALL"""
SQL["frame_roles"] = r"""
WITH b AS (SELECT source_id, list_sort(list(source_font_size_pt))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS body FROM text_frame_inventory WHERE frame_kind = 'paragraph' AND source_font_size_pt IS NOT NULL GROUP BY 1),
d AS (SELECT frame_kind, source_font_size_pt AS s, coalesce(body, 10.0) AS b, lower(coalesce(trim(source_text), '')) AS t FROM text_frame_inventory LEFT JOIN b USING (source_id))
SELECT frame_kind, CASE WHEN frame_kind = 'heading' AND s >= b * 1.55 THEN 'H1' WHEN frame_kind = 'heading' AND s >= b * 1.3 THEN 'H2' WHEN frame_kind = 'heading' THEN 'H3' WHEN frame_kind = 'table_cell' THEN 'TABLE_TEXT' WHEN starts_with(t, 'abstract') THEN 'ABSTRACT'
  WHEN regexp_matches(t, '^(fig(ure)?\.?|table|supplementary\s+(fig|table))\s*\d') THEN 'CAPTION' WHEN regexp_matches(t, '^(https?://\S+|(doi\s*:?\s*)?10\.\d{4,9}/\S+)$') THEN 'DOI_URL' ELSE 'BODY' END AS role, count(*) AS n FROM d GROUP BY ALL"""
SQL["page_keys"] = "SELECT CASE WHEN trim(source_id) <> '' AND source_page > 0 THEN trim(source_id) ELSE '' END AS source_id, CASE WHEN trim(source_id) <> '' AND source_page > 0 THEN source_page ELSE 0 END AS page, count(*) AS n FROM text_frame_inventory GROUP BY 1, 2"
SQL["funnel_breaks"] = """
WITH d AS (SELECT user_id, list_position(['view', 'click', 'signup', 'purchase'], event_type) AS stage, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL), l AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY stage) AS before FROM d)
SELECT user_id, CAST(stage AS BIGINT) AS stage, n, before FROM l WHERE n > before"""
SQL["md_sections"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS p FROM documents WHERE coalesce(lang = 'markdown', path LIKE '%.md')),
h AS (SELECT *, nullif(regexp_extract(line, '^##\s+(.+?)\s*$', 1), '') AS h FROM l), s AS (SELECT *, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM h)
SELECT doc_id, section, CAST(length(trim(string_agg(line, chr(10) ORDER BY p), ' ')) AS BIGINT) AS n_chars FROM s WHERE section IS NOT NULL AND h IS NULL GROUP BY doc_id, section"""
SQL["html_links"] = """WITH l AS (SELECT paper_id, seq, url FROM terminology_evidence WHERE url IS NOT NULL AND source IS NOT NULL AND paper_id IS NOT NULL AND length(source) % 3 < 2)
SELECT paper_id AS page_id, row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS seq, url AS href FROM l"""
SQL["exact_copies"] = "SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1"
SQL["json_props"] = "SELECT event_type, count(json_extract_string(props, '$.k')) AS n, CAST(sum(try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(DISTINCT json_extract_string(props, '$.k')) AS n_distinct FROM events GROUP BY event_type"
SQL["first_cjk_run"] = "WITH r AS (SELECT row_id, regexp_extract_all(coalesce(preferred_chinese, ''), '[㐀-鿿]+') AS runs FROM terminology_registry) SELECT row_id, left(coalesce(list_filter(runs, lambda x: length(x) >= 2)[1], runs[1], ''), 4) AS keyword FROM r"
SQL["alias_columns"] = r"""
WITH d AS (SELECT coalesce(nullif(trim(english_term), ''), '') AS e, coalesce(nullif(trim(preferred_chinese), ''), nullif(regexp_replace(alternative_chinese, '^\s+|\s+$', '', 'g'), ''), '') AS c, coalesce(nullif(trim(evidence_ids), ''), nullif(trim(evidence_id), ''), '') AS v FROM terminology_registry)
SELECT concat_ws(',', CASE WHEN e = '' THEN 'english' END, CASE WHEN c = '' THEN 'chinese' END, CASE WHEN v = '' THEN 'evidence' END) AS problem, count(*) AS n FROM d GROUP BY 1"""
SQL["ledger_text"] = r"""
WITH d AS (SELECT source_id, row_id, nullif(regexp_replace(source_text, '^\s+|\s+$', '', 'g'), '') AS t FROM text_frame_inventory WHERE source_id IS NOT NULL)
SELECT source_id, sha256(string_agg(t, chr(10) ORDER BY row_id)) AS digest FROM d WHERE t IS NOT NULL GROUP BY source_id"""
_FOLLOWED = "d AS (SELECT * FROM (SELECT row_id, frame_role, source_text AS s, lead(source_text) OVER (PARTITION BY source_id, source_page ORDER BY row_id) AS o FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL) WHERE o IS NOT NULL)"
SQL["residual_runs"] = rf"""
WITH {_FOLLOWED}, w AS (SELECT row_id, regexp_extract_all(lower(s), '[A-Za-z][A-Za-z''’-]*') AS s, regexp_extract_all(lower(o), '[A-Za-z][A-Za-z''’-]*') AS o FROM d),
r AS (SELECT row_id, n, i, o[i : i + n - 1] AS run, s FROM (SELECT *, unnest(range(1, len(o) - n + 2)) AS i FROM (SELECT *, unnest(range(1, least(12, len(o)) + 1)) AS n FROM w)))
SELECT row_id, arg_max(n, (n, -i)) AS n_words, arg_max(array_to_string(run, ' '), (n, -i)) AS run FROM r WHERE len(list_filter(range(1, len(s) - n + 2), lambda j: s[j : j + n - 1] = run)) > 0 GROUP BY row_id"""
SQL["residual_words"] = rf"""
WITH {_FOLLOWED}, w AS (SELECT row_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(s), '[a-z]+'), lambda x: list_contains(regexp_extract_all(lower(o), '[a-z]+'), x) AND NOT list_contains(regexp_extract_all(lower(coalesce(frame_role, '')), '[a-z]+'), x) AND x <> 'n'))) AS w FROM d)
SELECT row_id, array_to_string(w, ' ') AS words FROM w WHERE len(w) > 0"""
SQL["anchor_locate"] = """
WITH b AS (SELECT source_id, source_page, reading_order, arg_max(source_text, row_id) AS text FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_text IS NOT NULL GROUP BY ALL)
SELECT coalesce(trim(split_part(source_text, ',', 1)) <> '' AND contains(replace(text, ' ', ''), replace(split_part(source_text, ',', 1), ' ', '')), false) AS located, count(*) AS n
FROM text_frame_inventory LEFT JOIN b USING (source_id, source_page, reading_order) WHERE source_id IS NOT NULL GROUP BY 1"""

SQL["html_plain"] = r"SELECT row_id, regexp_replace(regexp_replace(concat_ws(' ', definition, context, source_citation), '\s+', ' ', 'g'), '^ | $', '', 'g') AS text FROM terminology_registry"
SQL["pipe_rows"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS seq FROM documents WHERE coalesce(lang = 'markdown', path LIKE '%.md')),
c AS (SELECT doc_id, seq, list_transform(string_split(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '|'), lambda x: trim(x, ' ')) AS cells FROM l WHERE starts_with(trim(line, ' '), '|'))
SELECT doc_id, CAST(seq AS BIGINT) AS seq, array_to_string(cells, '¦') AS cells FROM c WHERE len(cells) = 3 AND len(list_filter(cells, lambda x: NOT regexp_matches(x, '^:?-+:?$'))) > 0"""
SQL["supplement_citations"] = r"""
WITH t AS (SELECT CASE frame_kind WHEN 'table_cell' THEN 'see supplementary Tables S' || source_page || ', S' || reading_order || ' and Supplementary   Methods.' WHEN 'caption' THEN 'Supplementary Fig. ' || reading_order || '–' || rotation || ' shows'
  WHEN 'heading' THEN 'Supplementary ' || source_text ELSE source_text END AS t FROM text_frame_inventory),
f AS (SELECT unnest(list_distinct(list_transform(regexp_extract_all(t, '(?i)\bSupplementary\s+(?:Table|Figure|Fig\.?)(?:s)?\s*(?:S?\d+(?:\s*[–,\-]\s*S?\d+)*)|\bSupplementary\s+(?:Methods|Results|Materials?)\b'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))))) AS citation FROM t)
SELECT citation, count(*) AS n FROM f GROUP BY citation"""
# a group stands after a letter or closing bracket; a lone t, f or v before it makes it a statistic
SQL["citation_groups"] = r"""
WITH m AS (SELECT doc_id, unnest(regexp_extract_all(replace(regexp_replace(regexp_replace(text, '(^|[^A-Za-z])[TtFfVv]\d', '\1#', 'g'), '(^|[^A-Za-z])[TtFfVv]\d', '\1#', 'g'), ')', '))'), '(?:[A-Za-z)])\d{1,3}(?:\s*[,;]\s*\d{1,3}|\s*[–—-]\s*\d{1,3})*(?:[.,;:)\s]|$)')) AS g FROM documents),
c AS (SELECT DISTINCT doc_id, translate(regexp_replace(regexp_extract(g, '^[A-Za-z)](\d.*?)[.,;:)\s]?$', 1), '\s+', '', 'g'), '；;，、—-', ',,,,––') AS citation FROM m)
SELECT citation, count(*) AS n_docs FROM c WHERE citation <> '' GROUP BY citation"""
SQL["numeric_residuals"] = r"""
WITH u AS (SELECT row_id, source_id, source_page, regexp_extract_all(source_text, '[0-9]+') AS s, coalesce(lead(regexp_extract_all(source_text, '[0-9]+')) OVER (PARTITION BY source_id, source_page ORDER BY row_id), []) AS t FROM text_frame_inventory WHERE source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL),
b AS (SELECT source_id, source_page, unnest(s) AS token, 1 AS d FROM u UNION ALL SELECT source_id, source_page, unnest(t), -1 FROM u), n AS (SELECT source_id, source_page, token, sum(d) AS d FROM b GROUP BY ALL)
SELECT source_id, CAST(sum(greatest(d, 0)) AS BIGINT) AS missing, CAST(sum(greatest(-d, 0)) AS BIGINT) AS added FROM n WHERE d <> 0 GROUP BY source_id"""
SQL["markdown_visible"] = r"""
WITH d AS (SELECT doc_id, text FROM documents WHERE coalesce(lang = 'markdown', path LIKE '%.md')),
v AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '!\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '\[([^\]]+)\]\([^)]*\)', '\1', 'g'), '(?m)^\s*(?:#{1,6}\s+|>\s*|[-*+]\s+|\d+\.\s+)', '', 'g') AS t FROM d),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[*_~`]+|[^*_~`]+') AS p FROM v),
k AS (SELECT doc_id, array_to_string(list_filter(p, lambda x, i: NOT regexp_matches(x, '^[*_~`]+$') OR (i > 1 AND i < len(p) AND regexp_matches(p[i - 1], '[\p{L}\p{N}]$') AND regexp_matches(p[i + 1], '^[\p{L}\p{N}]'))), '') AS t FROM w)
SELECT doc_id, CAST(length(regexp_replace(t, '[\p{Z}\p{C}\s]', '', 'g')) AS BIGINT) AS visible FROM k"""

SQL["recency_roles"] = "WITH d AS (SELECT year(crawled_at) - year(committed_at) AS a FROM documents) SELECT CASE WHEN a <= 2 THEN 'CURRENT' WHEN a <= 5 THEN 'RECENT_SUPPORT' WHEN a IS NOT NULL THEN 'FOUNDATIONAL' END AS role, count(*) AS n FROM d GROUP BY 1"
SQL["hypothesis_closure"] = """
WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'N') AS y, count(*) FILTER (WHERE l_returnflag = 'R') AS x, bool_or(o_orderpriority <> '5-LOW') AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)
SELECT l_orderkey, n, CASE WHEN NOT p THEN 'Unplanned Finding' WHEN x + y = 0 THEN 'Cannot Determine' WHEN y = n THEN 'Fully Supported' WHEN y = 0 THEN 'Not Supported' ELSE 'Partially Supported' END AS closure FROM d"""
SQL["update_propagation"] = """
WITH RECURSIVE e(a, b) AS (VALUES ('signup', 'view'), ('view', 'click'), ('click', 'purchase'), ('purchase', 'error')),
r AS (SELECT DISTINCT user_id, event_type, 0 AS steps FROM events WHERE value > 60 UNION SELECT user_id, b, steps + 1 FROM r JOIN e ON a = event_type WHERE steps < 2)
SELECT user_id, event_type, min(steps) AS steps FROM r GROUP BY ALL"""
SQL["resume_routing"] = f"WITH {_OBSERVED} SELECT user_id, coalesce(arg_min(event_type, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type)) FILTER (WHERE shown <> 'VERIFIED'), '') AS stage FROM latest GROUP BY user_id"
SQL["item_records"] = r"""
WITH c AS (SELECT row_id, trim(english_term) AS title, trim(coalesce(domain, '')) AS publication_title, trim(coalesce(first_seen, '')) AS date, trim(coalesce(source_citation, '')) AS pages, trim(coalesce(notes, '')) AS url, trim(coalesce(definition, '')) AS abstract_note, lower(trim(coalesce(paper_id, ''))) AS doi FROM terminology_registry WHERE trim(english_term) <> '')
SELECT row_id, 'journalArticle' AS item_type, title, publication_title, date, '' AS volume, '' AS issue, pages, url, abstract_note, '' AS language, doi, CASE WHEN url <> '' THEN url WHEN doi <> '' THEN 'https://doi.org/' || doi ELSE '' END AS source_uri FROM c"""
SQL["frame_defaults"] = """
SELECT CASE frame_kind WHEN 'paragraph' THEN 'BODY' WHEN 'heading' THEN 'H2' WHEN 'caption' THEN 'CAPTION' WHEN 'table_cell' THEN 'TABLE_TEXT' WHEN 'reference' THEN 'REFERENCE' ELSE 'OTHER' END AS by_kind,
  CASE WHEN translation_action = 'RETAIN_SOURCE' THEN CASE frame_kind WHEN 'reference' THEN 'REFERENCE' WHEN 'statistic' THEN 'STATISTIC' ELSE 'OTHER' END WHEN frame_kind = 'paragraph' AND starts_with(lower(trim(source_text)), 'abstract') THEN 'ABSTRACT'
       ELSE CASE frame_kind WHEN 'paragraph' THEN 'BODY' WHEN 'heading' THEN 'H2' WHEN 'caption' THEN 'CAPTION' WHEN 'table_cell' THEN 'TABLE_TEXT' WHEN 'reference' THEN 'REFERENCE' ELSE 'OTHER' END END AS inferred, count(*) AS n FROM text_frame_inventory GROUP BY ALL"""
SQL["added_evidence"] = r"""
WITH known AS (SELECT DISTINCT evidence_id AS k FROM terminology_evidence WHERE recorded_at < TIMESTAMP '2024-01-01' AND coalesce(event_type, 'ADD') NOT IN ('DEPRECATE', 'UNLINK', 'UPDATE_SUPPORTS') AND evidence_id IS NOT NULL),
j AS (SELECT evidence_id, CASE WHEN NOT coalesce(regexp_matches(evidence_id, '^TERMEV-\d{4,}$'), false) THEN 'ID' WHEN evidence_id IN (SELECT k FROM known) THEN 'KNOWN' WHEN NOT coalesce(regexp_matches(verified_date, '^\d{4}-\d{2}-\d{2}$') AND try_cast(verified_date AS DATE) IS NOT NULL, false) THEN 'DATE'
  WHEN len(list_filter(coalesce(supports, []), lambda x: trim(x) <> '')) = 0 THEN 'SUPPORTS' WHEN len(list_filter(coalesce(roles, []), lambda x: trim(x) <> '')) = 0 THEN 'ROLES' END AS problem FROM terminology_evidence WHERE coalesce(event_type, 'ADD') = 'ADD' AND recorded_at >= TIMESTAMP '2024-01-01')
SELECT problem, count(*) AS n FROM j WHERE problem IS NOT NULL GROUP BY problem UNION ALL SELECT '', count(DISTINCT evidence_id) FROM j WHERE problem IS NULL"""

_OTHERS = r"list_distinct(list_filter(list_transform(string_split_regex(coalesce(alternative_chinese, ''), '[;；]'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''))"
SQL["wording_in_documents"] = f"""
WITH c AS (SELECT DISTINCT trim(english_term) AS e, trim(preferred_chinese) AS p, list_sort({_OTHERS}) AS o, trim(coalesce(notes, '')) <> '' AS noted FROM terminology_registry WHERE trim(english_term) <> '' AND trim(preferred_chinese) <> ''),
m AS (SELECT c.*, doc_id, contains(text, p) AS has, list_filter(o, lambda x: contains(text, x)) AS seen FROM c JOIN documents ON text IS NOT NULL AND (contains(lower(text), lower(e)) OR contains(text, p) OR len(list_filter(o, lambda x: contains(text, x))) > 0)),
i AS (SELECT DISTINCT doc_id, e, p, 'PREFERRED_ABSENT' AS issue, CAST(NULL AS VARCHAR) AS wording FROM m WHERE NOT has
  UNION SELECT DISTINCT doc_id, e, p, 'ALTERNATIVE_WITHOUT_NOTE', w FROM (SELECT *, unnest(seen) AS w FROM m WHERE NOT noted) WHERE w <> p)
SELECT e AS english_term, p AS preferred_chinese, issue, wording, count(*) AS n_docs FROM i GROUP BY ALL"""
_LOW = "lower(coalesce(trim({0}), ''))"
SQL["term_contexts"] = f"""
WITH r AS (SELECT * FROM terminology_registry WHERE removed_at IS NULL), u AS (SELECT * FROM terminology_registry WHERE paper_id IS NOT NULL),
w AS (SELECT upper(trim(term_id)) AS id, list(DISTINCT trim(preferred_chinese)) AS ok FROM r GROUP BY 1),
a AS (SELECT DISTINCT paper_id, upper(trim(term_id)) AS id, coalesce(trim(preferred_chinese), '') AS p FROM u WHERE trim(term_id) <> ''),
i1 AS (SELECT DISTINCT paper_id, a.id, CASE WHEN w.ok IS NULL THEN 'UNKNOWN' WHEN NOT list_contains(w.ok, p) THEN 'PREFERRED' END AS issue FROM a LEFT JOIN w ON w.id = a.id),
k AS (SELECT upper(trim(term_id)) AS id, {', '.join(f"list(DISTINCT {_LOW.format(c)}) AS {c}" for c in ('domain', 'subdomain', 'context'))} FROM r GROUP BY 1),
s AS (SELECT {_LOW.format('english_term')} AS e FROM r WHERE status IS NULL OR status <> 'DEPRECATED' GROUP BY 1 HAVING count(DISTINCT upper(trim(term_id))) > 1),
g AS (SELECT DISTINCT paper_id, upper(trim(term_id)) AS id, {_LOW.format('english_term')} AS e, {', '.join(f"{_LOW.format(c)} AS {c}" for c in ('domain', 'subdomain', 'context'))} FROM u WHERE trim(term_id) <> ''),
i2 AS (SELECT paper_id, g.id, 'AMBIGUOUS' AS issue FROM g JOIN k USING (id) JOIN s USING (e) WHERE g.domain = '' OR g.context = ''
  {' '.join(f"UNION SELECT paper_id, g.id, '{c.upper()}' FROM g JOIN k USING (id) WHERE g.{c} <> '' AND NOT list_contains(k.{c}, g.{c})" for c in ('domain', 'subdomain', 'context'))})
SELECT issue, count(*) AS n FROM (SELECT * FROM i1 WHERE issue IS NOT NULL UNION ALL SELECT DISTINCT * FROM i2) GROUP BY issue"""
