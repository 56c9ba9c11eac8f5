"""Small packages against the validator suites: what a right one looks like, and which check each fault breaks."""

import hashlib

from lathework.operators import suites as S


def failed(checks):
    rows = checks.collect()
    assert len({r.code for r in rows}) == len(rows) and all((r.n_failed == 0) == r.passed for r in rows)
    return {r.code: r.n_failed for r in rows if not r.passed}


BOX = [0.0, 0.0, 10.0, 10.0]
SOURCES = "source_id string, role string, page_count int, pdf_path string, language_authority string, geometry_authority string"
PAGES = "source_id string, source_page int, output_page int, boxes array<array<double>>, rotation int, frame_ids array<string>, object_ids array<string>"
OBJECTS = "object_id string, kind string, source_id string, source_page int, bbox_pt array<double>, label_frame_ids array<string>, rows int, columns int"
CELLS = "object_id string, row int, column int, bbox_pt array<double>, frame_id string"


def inventory(spark, sources=None, pages=None, objects=None, cells=None):
    make = spark.createDataFrame
    return failed(S.inventory_suite(
        make(sources or [("M", "MAIN", 2, "m.pdf", "OCR", "VERSION_OF_RECORD_PDF")], SOURCES),
        make(pages or [("M", 1, 1, [BOX] * 5, 0, ["F1"], ["T1"]), ("M", 2, 2, [BOX] * 5, 90, ["F2"], [])], PAGES),
        make(objects or [("T1", "table", "M", 1, BOX, ["F1"], 1, 1)], OBJECTS), make(cells or [("T1", 1, 1, BOX, "F1")], CELLS),
    ))


def test_inventory(spark):
    assert inventory(spark) == {}
    assert inventory(spark, sources=[("M", "MAIN", 3, " ", None, "PUBLISHER_SUPPLEMENT_PDF"), ("M", "SI", 0, "s", "OCR", "PUBLISHER_SUPPLEMENT_PDF")]) == {
        "PDF_PATH": 1, "LANGUAGE_AUTHORITY": 1, "GEOMETRY_AUTHORITY": 1, "SOURCE_REPEATED": 1, "PAGE_COUNT": 1, "PAGE_COVERAGE": 1}
    assert inventory(spark, pages=[("M", 1, 1, [BOX] * 5, 0, ["F1"], ["T1", "T2"]), ("M", 2, 3, [BOX] * 4, 45, ["F2", " "], []), ("X", 1, 3, [BOX] * 5, 0, [], [])]) == {
        "PAGE_COVERAGE": 1, "PAGE_BOXES": 1, "PAGE_ROTATION": 1, "PAGE_LISTS": 1, "OUTPUT_REPEATED": 1, "OUTPUT_SEQUENCE": 1, "OBJECT_COVERAGE": 1}
    assert inventory(spark, objects=[("T1", "table", "M", 9, BOX, ["F9"], 0, 1), ("T3", "map", None, None, None, None, None, None)], cells=[("T1", 0, 1, [1.0], "F9")]) == {
        "OBJECT_PAGE": 2, "OBJECT_LABELS": 1, "TABLE_STRUCTURE": 1, "OBJECT_KIND": 1, "OBJECT_BOX": 1, "OBJECT_COVERAGE": 1, "CELL_PLACE": 1, "CELL_BOX": 1, "CELL_FRAME": 1}


FRAMES = "frame_id string, source_id string, source_page int, unit_id string, frame_kind string, frame_role string, bbox_pt array<double>, rotation int, reading_order int, source_font string, source_font_size_pt double, weight string, translation_action string, translatable boolean"


def frame(i, **k):
    d = dict(zip([c.split()[0] for c in FRAMES.split(", ")], [i, "M", 1, f"U{i}", "body", "BODY", BOX, 0, 1, "Serif", 10.0, "regular", "TRANSLATE", True])) | k
    return tuple(d.values())


def frames(spark, *rows):
    return spark.createDataFrame(list(rows), FRAMES)


def test_frames_and_ledger(spark):
    pages, listed = spark.createDataFrame([("M", 1)], "source_id string, source_page int"), spark.createDataFrame([("F1",), ("F2",)], "frame_id string")
    good = frames(spark, frame("F1"), frame("F2", frame_role="REFERENCE", frame_kind="reference", translatable=False, translation_action="RETAIN_SOURCE"))
    assert failed(S.frame_suite(good, pages, listed)) == {}
    bad = frames(spark, frame("F1", source_page=2), frame("F1", frame_role="REFERENCE"), frame("F3", source_font_size_pt=0.0, rotation=5, reading_order=None, translation_action="DROP", unit_id=None))
    assert failed(S.frame_suite(bad, pages, listed)) == {
        "FRAME_REPEATED": 1, "FRAME_PAGE": 1, "ROLE_FLAG": 1, "FRAME_SIZE": 1, "FRAME_ROTATION": 1, "READING_ORDER": 1, "FRAME_ACTION": 1, "FRAME_UNIT": 1, "FRAME_COVERAGE": 2, "ACTION_FLAG": 1}
    ledger = "unit_id string, frame_id string, source_id string, source_page int, source_text string, translated_text string, font_scale double, fit_status string, issue_ids array<string>"
    issues = spark.createDataFrame([("I1",)], "issue_id string")
    one = ("U1", "F1", "M", 1, "a", "甲", 1.1, "FIT", ["I1"])
    assert failed(S.ledger_suite(spark.createDataFrame([one], ledger), good, issues)) == {}
    rows = [one, ("U1", "F2", "M", 1, "a", "甲", 1.0, "FIT", None), ("U3", "F1", "S", 1, "a", " ", 1.2, "?", ["I9"]), ("U4", "F9", "M", 1, "a", "b", 1.0, "FIT", [])]
    assert failed(S.ledger_suite(spark.createDataFrame(rows, ledger), good, issues)) == {"UNIT_REPEATED": 1, "UNIT_FRAME": 2, "FRAME_IN_TWO_UNITS": 1, "UNIT_PLACE": 1, "UNIT_TEXTS": 1, "UNIT_SCALE": 1, "UNIT_FIT": 1, "UNIT_ISSUE": 1}
    assert failed(S.ledger_suite(spark.createDataFrame([], ledger), good, issues)) == {"UNIT_COVERAGE": 1}


def test_links_and_plan(spark):
    units = spark.createDataFrame([("a", "M", 1), ("b", "M", 2), ("c", "M", 2)], "unit_id string, source_id string, source_page int")
    pages = spark.createDataFrame([("M", 1, ["a", "b"]), ("M", 2, ["b", "z"])], "source_id string, source_page int, unit_ids array<string>")
    assert failed(S.link_suite(units, pages, unit="unit_id", listed="unit_ids")) == {"LISTED_ELSEWHERE": 1, "NOT_LISTED": 1, "LISTED_UNKNOWN": 1, "LISTED_TWICE": 1}
    plan_schema, region_schema = "output_page int, source_id string, source_page int, strategy string, extension_page boolean, rotation int, render_checked boolean", "output_page int, frame_id string, bbox_pt array<double>"
    at = spark.createDataFrame([("M", 1)], "source_id string, source_page int")
    ok, region = (1, "M", 1, "exact-text-frame", False, 0, True), (1, "F1", [0.2, 0.0, 10.0, 9.8])
    plan = lambda p, r: failed(S.plan_suite(spark.createDataFrame(p, plan_schema), spark.createDataFrame(r, region_schema), frames(spark, frame("F1")), at))
    assert plan([ok], [region]) == {}
    assert plan([ok, (1, "M", 1, "flow", True, 1, None), (4, "S", 1, *ok[3:])], [(7, "F1", [0.5, 0.0, 10.0, 10.0]), (1, "F2", [0.0])]) == {
        "PLAN_REPEATED": 1, "PLAN_ONE_TO_ONE": 1, "PLAN_STRATEGY": 1, "PLAN_EXTENSION": 1, "PLAN_ROTATION": 1, "PLAN_CHECKED": 1, "PLAN_SEQUENCE": 1, "PLAN_COVERAGE": 1, "REGION_PAGE": 1, "REGION_BOX": 1, "REGION_MATCH": 2}
    settings = spark.createDataFrame([("font", "A"), ("fallback", "true"), ("path", " "), ("font2", "x"), ("font2", "x")], "name string, value string")
    assert failed(S.settings_suite(settings, {"font": "A", "fallback": "false", "mode": "m", "font2": "x"}, ["path"])) == {"fallback": 1, "mode": 1, "path": 1, "font2": 1}


def test_numbers_with_whitelist_and_pages(spark):
    ledger = "unit_id string, source_id string, source_page int, source_text string, translated_text string"
    allow = "unit_id string, kind string, source_token string, translated_token string, reason string, reviewer string, reviewed_date string"
    split = [("1", "M", 1, "n = 28", "共"), ("2", "M", 1, "x", "共 28"), ("3", "M", 2, "β = −0.42", "β = 0.42")]
    run = lambda rows, w: failed(S.numeric_suite(spark.createDataFrame(rows, ledger), spark.createDataFrame(w, allow)))
    assert run(split[:2], []) == {} and run(split, []) == {"NUMBER_MISSING": 1, "NUMBER_ADDED": 1}
    pair = ("3 ", None, "β = −0.42", "β = 0.42", "sign", "r", "2024-02-29")
    assert run(split, [pair]) == {}
    assert run(split, [(*pair[:6], "2023-02-29")]) == {"NUMBER_MISSING": 1, "NUMBER_ADDED": 1, "WHITELIST": 1}
    assert run(split, [("3", "ADDED", None, "β=.42", "r", "r", "2024-01-01"), ("3", "missing", "β = −0.42", None, "r", "r", "2024-01-01")]) == {"NUMBER_ADDED": 1}
    # a pair clears one added token for each missing one, and may be used again
    twice = [("4", "M", 3, "5 ms and 5 ms", "6 ms and 6 ms and 6 ms")]
    assert run(twice, [("4", "PAIR", "5 ms", "6 ms", "r", "r", "2024-01-01")]) == {"NUMBER_ADDED": 1}


def test_figures_conflicts_and_issues(spark):
    labels = "frame_id string, figure_id string, bbox_pt array<double>, translated_text string, reviewed boolean, rendered boolean, validated boolean"
    objects = spark.createDataFrame([("FIG1", "figure", "M", 1, BOX, ["F1", "F2"], 0, 0)], OBJECTS)
    f = frames(spark, frame("F1", frame_kind="figure_label"), frame("F2", frame_kind="figure_label"), frame("F3"))
    ledger = spark.createDataFrame([("UF1", "甲"), ("UF2", "乙"), ("UF3", "丙")], "unit_id string, translated_text string")
    run = lambda rows: failed(S.figure_text_suite(spark.createDataFrame(rows, labels), objects, f, ledger))
    assert run([("F1", "FIG1", BOX, "甲", True, True, True), ("F2", "FIG1", BOX, "乙", True, True, True)]) == {}
    assert run([("F1", "FIG2", [1.0] * 4, "x", True, None, True), ("F3", "FIG1", BOX, "丙", True, True, True)]) == {"LABEL_FIGURE": 2, "LABEL_BOX": 1, "LABEL_TEXT": 1, "LABEL_REVIEW": 1, "LABEL_FRAME": 1, "LABEL_COVERAGE": 2}
    conflicts = spark.createDataFrame([("CONFLICT-001", ["1", "2"], ["UF1", "UF2"], True), ("C2", ["1,000", "1000"], ["UF1", "U9"], None)], "conflict_id string, source_values array<string>, unit_ids array<string>, preserved_separately boolean")
    assert failed(S.conflict_suite(conflicts, ledger)) == {"CONFLICT_ID": 1, "CONFLICT_VALUES": 1, "CONFLICT_KEPT": 1, "CONFLICT_UNKNOWN": 1, "CONFLICT_SAID": 1}
    issues = spark.createDataFrame([("I1", "RESOLVED", "BLOCKED"), ("I2", "OPEN", "BLOCKED"), ("I2", "OPEN", "NONE"), (None, "?", None)], "issue_id string, status string, completion_impact string")
    assert failed(S.issue_suite(issues)) == {"ISSUE_OPEN": 1, "ISSUE_REPEATED": 1, "ISSUE_ID": 1, "ISSUE_STATUS": 1, "ISSUE_IMPACT": 1}


def test_styles(spark):
    records = "frame_id string, role string, language string, font_size_pt double, style_name string, alignment string, first_line_indent_pt double, exact_mirror boolean, overflow boolean, clipping boolean, has_exception boolean"
    styles = spark.createDataFrame([("BODY", "zh", "BODY_ZH", "justify", 2.0), ("BODY", "en", "BODY_EN", "left", 0.0), ("H1", "zh", "H1", "left", 0.0)], "role string, language string, style_name string, alignment string, indent_em double")
    rows = [("1", "body", "zh-CN", 10.0, "BODY_ZH", "justify", 20.2, True, False, None, None), ("2", "H1", None, 12.0, "H1", "center", 9.0, True, None, None, None), ("3", "BODY", "en", 10.0, "x", "right", 5.0, None, None, None, True), ("4", "BODY", "zh", 10.0, "BODY_ZH", "left", 0.0, True, True, None, None), ("5", "NONE", "zh", 0.0, "x", "left", 0.0, True, None, None, None)]
    assert failed(S.style_records_suite(spark.createDataFrame(rows, records), styles)) == {"STYLE_NAME": 1, "STYLE_ALIGNMENT": 1, "STYLE_INDENT": 1, "STYLE_FIT": 1}
    style_map = spark.createDataFrame([("BODY", 12.0, 0.95, 1.1, 1.15, 1.45), ("H1", 11.0, 0.9, 1.1, 1.4, 1.3)], "role string, median_size double, size_low double, size_high double, leading_low double, leading_high double")
    f = frames(spark, frame("F1"), frame("F2", frame_role="H1"), frame("F3", frame_role="NEW"), frame("F4"))
    assert failed(S.style_map_suite(style_map, f)) == {"ROLE_UNMAPPED": 1, "SIZE_RANGE": 1, "LEADING_RANGE": 1, "HEADING_SIZE": 1}
    rendered = spark.createDataFrame([("F1", 11.005, 14.0, "regular"), ("F2", 9.0, 20.0, "bold"), ("F4", 12.0, 14.4, "regular")], "frame_id string, font_size_pt double, leading_pt double, weight string")
    assert failed(S.rendered_style_suite(f, rendered, style_map)) == {"STYLE_RENDERED": 1, "STYLE_SIZE": 1, "STYLE_LEADING": 1, "STYLE_KEPT": 1}


def test_evidence(spark):
    prose = "It says so here."
    sections = spark.createDataFrame([(n, prose, ["p1"]) for n in S.SECTIONS[2:]] + [("METHODS", "no end", [])], "name string, prose string, source_anchors array<string>")
    claims = spark.createDataFrame([("CLM-1", "clm", prose, "p"), ("AN-1", "AN", prose, " "), ("AUD-1", "AUD", prose, "p")], "claim_id string, claim_class string, prose string, source_anchor string")
    required = spark.createDataFrame([("CLM-1",), ("CLM-9",), (" ",)], "claim_id string")
    assert failed(S.narrative_suite(sections, claims, required)) == {"SECTION_MISSING": 1, "SECTION_PROSE": 1, "SECTION_ANCHOR": 1, "CLAIM_CLASS": 1, "CLAIM_CLOSED": 1, "CLAIM_REQUIRED": 1}
    figures = "figure_id string, category string, source_anchor string, embedded boolean, image_path string, translated_caption string, interpretation string"
    rows = [("f1", "DESIGN", "p", True, "x.png", "图", prose), ("f2", "METHOD", None, None, "", None, "short"), ("f3", "SUPPORTING", "p", None, None, None, None), ("f4", "OTHER", "p", None, None, None, None)]
    assert failed(S.figure_suite(spark.createDataFrame(rows, figures), spark.createDataFrame([("f1",), ("f9",)], "figure_id string"))) == {
        "FIGURE_CATEGORY": 1, "FIGURE_ANCHOR": 1, "FIGURE_EMBEDDED": 1, "FIGURE_IMAGE": 1, "FIGURE_CAPTION": 1, "FIGURE_READ": 1, "FIGURE_OMITTED": 1}
    mapping = spark.createDataFrame([("SRC-1", "p. 3", "n", "CLM-1", "full"), ("X", "somewhere", " ", "CLM-2", "full")], "source_id string, source_locator string, notebook_section string, claim_id string, coverage_type string")
    assert failed(S.mapping_suite(mapping, required.where("trim(claim_id) <> ''"))) == {"MAPPING_FILLED": 1, "MAPPING_LOCATOR": 1, "MAPPING_COVERAGE": 1}


def test_review(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    comments = spark.createDataFrame([("r", "one fact\n\ntwo facts\n \nthree"), ("s", "AUD-7 only")], "review_id string, text string")
    claims = spark.createDataFrame([("r", 1, "c1", "one", "MAIN"), ("r", 2, "c2", "absent", "MAIN"), ("r", 3, "c3", "three", "SI"), ("s", 1, "c4", "only", "MAIN")], "review_id string, paragraph_index int, claim_id string, text string, source_class string")
    judged = spark.createDataFrame([("c1", "PASS", "ok", sha("one")), ("c2", "PASS", "ok", sha("other")), ("c3", "PASS", " ", sha("three")), ("c9", "PASS", "ok", sha(""))], "claim_id string, status string, reason string, text_sha256 string")
    gates = spark.createDataFrame([("g1", "PASS", "seen", ["c1"]), ("g2", "FAIL", "seen", ["c1", "c8"]), ("g3", "PASS", "seen", [])], "gate string, status string, evidence string, claim_ids array<string>")
    got = failed(S.review_suite(comments, claims, judged, gates, shortest=9, longest=100, marks=r"AUD-\d+"))
    assert got == {"REVIEW_PARAGRAPHS": 1, "REVIEW_MARKS": 1, "CLAIM_TEXT": 1, "CLAIM_SOURCE": 1, "CLAIM_JUDGED": 4, "GATE_PASSED": 2, "GATE_CLAIMS": 1}
    w = spark.createDataFrame([(1, "a b\n c"), (2, "x"), (3, "y")], "id int, text string")
    assert failed(S.same_text_suite(w, spark.createDataFrame([(1, "ab c "), (2, "z")], "id int, text string"), key="id", text="text", code="ABSTRACT")) == {"ABSTRACT": 2}


def test_files(spark):
    records = spark.createDataFrame([("a", "MAIN", "AVAILABLE", "/a", "h", 1), ("b", "SI", "AVAILABLE", "/b", "h", 2), ("c", "SI", "AVAILABLE", "/c", None, 2), ("d", "MAIN", "MISSING", "/d", "h", 1), ("e", "MAIN", "AVAILABLE", "/e", "h", 1)], "source_id string, source_type string, availability string, path string, sha256 string, size long")
    there = spark.createDataFrame([("/a", "h", 1), ("/b", "h", 3), ("/c", None, 2)], "path string, sha256 string, size long")
    identities = spark.createDataFrame([("paper_id", "p", "p"), ("workflow_id", None, None), ("contract_version", "1", "2")], "name string, actual string, expected string")
    assert failed(S.binding_suite(records, there, identities)) == {"FILE_PRESENT": 1, "FILE_SAME": 2, "ONE_MAIN": 1, "IDENTITY": 2}
    members = spark.createDataFrame([("p", "a.xml"), ("p", "b.xml"), ("p", "b.xml")], "package string, name string")
    relations = spark.createDataFrame([("p", "a.xml", None), ("p", "c.xml", False), ("q", "a.xml", False), ("p", "http://x", True)], "package string, target string, external boolean")
    assert failed(S.relationship_suite(members, relations)) == {"RELATION_TARGET": 2, "MEMBER_REPEATED": 1}
    pages = spark.createDataFrame([("d", 1, True, False), ("d", 2, None, None), ("d", 4, True, True)], "document string, page int, reviewed boolean, blank boolean")
    images = spark.createDataFrame([("d", f"p{i}.png") for i in range(3)], "document string, name string")
    assert failed(S.visual_suite(pages, images, ["blank"])) == {"PAGE_REVIEWED": 1, "PAGE_FLAGS": 2, "PAGE_IMAGES": 2}
    parts = spark.createDataFrame([("d", "docProps/core.xml", "made by tool"), ("d", "word/comments.xml", ""), ("e", "word/document.xml", "tool")], "document string, name string, text string")
    props = spark.createDataFrame([("d", "creator", "someone"), ("e", "keywords", " "), ("d", "subject", "s")], "document string, name string, value string")
    assert failed(S.metadata_suite(parts, props, forbidden="tool")) == {"CORE_MISSING": 1, "COMMENTS": 1, "FORBIDDEN": 1, "AUTHOR": 1, "PROPERTIES": 1}
