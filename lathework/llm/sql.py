"""SQL for the queries on text that SQL can express, in the dialect of the comparing engine."""

import unicodedata

from . import lookalike

_P7 = r"""
WITH pairs AS (
  SELECT DISTINCT submission_id AS id, lower(regexp_replace(k.name, '[^\p{L}\p{N}]', '', 'g')) AS name,
         lower(regexp_replace(json_extract_string(record, '$."' || k.name || '"'), '[^\p{L}\p{N}]', '', 'g')) AS value
  FROM term_submissions, unnest(json_keys(record)) AS k(name)),
forms AS (SELECT id, list_sort(list(name || chr(30) || value)) AS form FROM pairs WHERE value <> '' GROUP BY id),
kept AS (SELECT id, min(id) OVER (PARTITION BY form) AS keep_id, count(*) OVER (PARTITION BY form) AS n FROM forms)
"""
P7_FOUND = _P7 + "SELECT keep_id, id AS copy_id FROM kept WHERE id <> keep_id"
P7_KEPT = _P7 + "SELECT keep_id, record, n AS n_copies FROM kept JOIN term_submissions ON submission_id = id WHERE id = keep_id"

_P8 = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\p{L}\p{N}]+') AS w FROM eval_items),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
ig AS (SELECT DISTINCT item_id, list_slice(w, i + 1, i + 13) AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS i FROM iw WHERE len(w) >= 13)),
dg AS (SELECT DISTINCT doc_id, list_slice(w, i + 1, i + 13) AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 12)) AS i FROM dw WHERE len(w) >= 13)),
found AS (SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g))
"""
P8_FOUND = _P8 + "SELECT * FROM found"

# words of an item under shared runs; tiles cover the same words wherever an item does not repeat itself
_P8_COVERED = _P8.replace("found AS (", """ip AS (SELECT item_id, i, list_slice(w, i + 1, i + 13) AS g FROM (SELECT item_id, w, unnest(range(0, len(w) - 12)) AS i FROM iw WHERE len(w) >= 13)),
places AS (SELECT DISTINCT doc_id, item_id, i FROM dg JOIN ip USING (g)),
covers AS (SELECT doc_id, item_id, count(DISTINCT p) AS covered FROM (SELECT doc_id, item_id, unnest(range(i, i + 13)) AS p FROM places) GROUP BY ALL),
sized AS (SELECT doc_id, item_id, covered, CAST(len(w) AS BIGINT) AS item_words FROM covers JOIN iw USING (item_id)),
found AS (""")
P8_COVERAGE = _P8_COVERED + "SELECT * FROM sized WHERE 2 * covered >= item_words"
P8_ITEMS = _P8_COVERED + "SELECT item_id, count(DISTINCT doc_id) AS n_docs, max(covered) AS most_covered, max(item_words) AS item_words FROM sized GROUP BY item_id"

_P10 = r"""
WITH w AS (
  SELECT doc_id, s, md5(substr(text, s + 1, 400)) AS h
  FROM (SELECT doc_id, text, unnest(range(0, length(text) - 399)) AS s FROM documents WHERE length(text) >= 400)),
shared AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1),
starts AS (SELECT DISTINCT doc_id, s FROM w JOIN shared USING (h)),
marked AS (SELECT doc_id, s, CASE WHEN lag(s) OVER o >= s - 400 THEN 0 ELSE 1 END AS opens FROM starts WINDOW o AS (PARTITION BY doc_id ORDER BY s)),
runs AS (SELECT doc_id, s, sum(opens) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM marked),
found AS (SELECT doc_id, CAST(min(s) AS BIGINT) AS span_start, CAST(max(s) + 400 AS BIGINT) AS span_end FROM runs GROUP BY doc_id, run)
"""
P10_FOUND = _P10 + "SELECT * FROM found"
P10_SHARE = _P10 + """
SELECT d.doc_id, CAST(length(d.text) AS BIGINT) AS n_chars, CAST(coalesce(sum(span_end - span_start), 0) AS BIGINT) AS shared_chars,
       round(CASE WHEN length(d.text) = 0 THEN 0.0 ELSE coalesce(sum(span_end - span_start), 0) / length(d.text) END, 6) AS shared_share
FROM documents d LEFT JOIN found f USING (doc_id) WHERE d.text IS NOT NULL GROUP BY d.doc_id, d.text"""

P6_PLANTED = "SELECT row_id, 'disguised' AS field_name, english_term AS plain_text FROM terminology_registry WHERE regexp_matches(english_term, '^[A-Za-z0-9-]+( [A-Za-z0-9-]+)*$')"

# what any right selection shows, whatever the tokenizer: listed sources with text are selected, shares and repeats hold
P9_BOUNDS = r"""
WITH have AS (SELECT replace(lower(trim(source, chr(9) || ' ')), '-', '_') AS s, count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1)
SELECT replace(lower(trim(source)), '-', '_') AS source, coalesce(n, 0) > 0 AND target_share > 0 AND max_repeats > 0 AS selected, true AS share_kept, true AS records_kept FROM source_targets LEFT JOIN have ON s = replace(lower(trim(source)), '-', '_')"""



def _p6() -> str:
    """Plain substitution: compatibility forms character by character, then every look-alike letter Latin, but for lone Greek letters and words with a letter of another script that looks like no Latin one."""
    single, several = {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0xFFFF), *range(0x1D400, 0x1D800)]):
        form, tag = unicodedata.normalize("NFKC", c), unicodedata.decomposition(c)
        if form != c and tag.startswith("<") and not tag.startswith(lookalike.DIFFERENT) and (c.isalnum() or unicodedata.name(c, "").startswith("KANGXI")):
            (single if len(form) == 1 else several)[c] = form
    single |= {c: "-" for c in lookalike.HYPHENS} | lookalike.RADICALS
    text = "regexp_replace(regexp_replace(nfc_normalize(cell), '[\\p{Cf}\\x{FE00}-\\x{FE0F}\\x{034F}\\x{3164}\\x{FFA0}\\x{E0100}-\\x{E01EF}]|[\\x00-\\x08\\x0E-\\x1B\\x7F-\\x84\\x86-\\x9F]', '', 'g'), '\\p{Zs}', ' ', 'g')"
    text = f"translate({text}, '{''.join(single)}', '{''.join(single.values())}')"
    for c, form in several.items():
        if c in "ﬀﬁﬂﬃﬄﬅﬆⅡⅢⅣⅥⅦⅧⅨⅪⅫ":
            text = f"replace({text}, '{c}', '{form}')"
    like = lookalike.LOOK_ALIKES
    other = "".join(chr(i) for i in range(0x370, 0x530) if chr(i).isalpha() and chr(i) not in like)
    return f"""
WITH c AS (SELECT row_id, 'english_term' AS field_name, english_term AS cell FROM terminology_registry UNION ALL SELECT row_id, 'preferred_chinese', preferred_chinese FROM terminology_registry),
n AS (SELECT row_id, field_name, cell, nfc_normalize({text}) AS t FROM c WHERE cell IS NOT NULL),
w AS (SELECT row_id, field_name, cell, regexp_extract_all(t, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+') AS w FROM n),
p AS (SELECT row_id, field_name, cell, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '^[α-ωΑ-Ω]$') OR regexp_matches(x, '[{other}]') THEN x ELSE translate(x, '{''.join(like)}', '{''.join(like.values())}') END), '') AS plain_text FROM w)
SELECT row_id, field_name, plain_text FROM p WHERE plain_text <> cell"""


P6_FOUND = _p6()

SQL = {"p6_found": P6_FOUND, "p9_bounds": P9_BOUNDS, "p6_planted": P6_PLANTED, "p7_found": P7_FOUND, "p7_kept": P7_KEPT, "p8_found": P8_FOUND, "p8_coverage": P8_COVERAGE, "p8_items": P8_ITEMS, "p10_found": P10_FOUND, "p10_share": P10_SHARE}
