"""Queries of the registry, coverage, order, status and text operators on the test tables.

Each runs over its whole tables. Where the operator needs a shape that no table has (an OCR pair, a glyph page), it is derived
from the tables at hand by a projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import records, statistics, udfs
from ..functions.text import strip
from ..operators import checks, coverage, identity, ordered, registry, rules, spatial, status, token_compare
from ..session import spread, table
from ..sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Registers ``f``, whose parameters after the session are the names of the tables it reads."""
    names = f.__code__.co_varnames[1 : f.__code__.co_argcount]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        return f(spark, *[table(spark, sf, n) for n in names])

    QUERIES[f.__name__] = run
    return f


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


# -- status of many places --------------------------------------------------------------------------------------------

# the kinds of event as places and their values as observations
PLACES = ("click", "error", "purchase", "signup", "view")


def _observations(events: DataFrame) -> DataFrame:
    level = F.floor(F.coalesce("value", F.lit(0.0)) / 10)
    s = F.when(F.pmod("event_id", F.lit(5)) == 0, "UNKNOWN").when(level == 0, "MISSING").when(level == 1, "PRESENT_UNVERIFIED").when(level == 9, "CONFLICT").otherwise("VERIFIED")
    return events.select("user_id", "event_type", "event_id", s.alias("status"))


def _latest(events: DataFrame) -> DataFrame:
    d = status.latest_known(_observations(events), key=["user_id", "event_type"], order="event_id", status="status")
    return d.withColumn("shown", F.when(F.col("status") == "UNKNOWN", F.coalesce("last_known", F.lit("UNKNOWN"))).otherwise(F.col("status")))


@query
def status_overview(spark, events):
    wide = status.overview(_latest(events), row="user_id", column="event_type", value="shown", columns=PLACES)
    overall = status.reduced(_latest(events).select("user_id", F.col("shown").alias("s")), ["user_id"], "s").withColumnRenamed("status", "overall")
    return wide.join(overall, "user_id")


@query
def pending_unpivot(spark, events):
    return status.pending_list(status.overview(_latest(events), row="user_id", column="event_type", value="shown", columns=PLACES), row="user_id", columns=PLACES)


@query
def carry_forward(spark, events):
    d = ordered.carry_forward(_observations(events), key=["user_id", "event_type"], order="event_id", value="status", known=F.col("status") != "UNKNOWN")
    return d.select("event_id", "status", F.coalesce("last_known", F.lit("")).alias("last_known"))


@query
def presence_status(spark, customer, orders):
    c = customer.select(F.col("c_custkey").alias("key")).join(orders.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("candidate"), "o_orderstatus", "o_totalprice"), "key", "left")
    return status.classify_presence(c, key="key", right_place=F.col("o_orderstatus") != "P", complete=F.col("o_totalprice") > 100000)


@query
def overview_lines(spark, events):
    wide = status.overview(_latest(events), row="user_id", column="event_type", value="shown", columns=PLACES)
    return status.markdown_table(wide, ["user_id", *PLACES])


# -- identity ---------------------------------------------------------------------------------------------------------


@query
def doi_normalize(spark, paper_terminology, terminology_evidence):
    """Papers by the DOI they are cited with: uses spell it bare, evidence as an address with its own case and blanks."""
    cited = terminology_evidence.select(F.concat(F.when(F.length("source") % 2 == 0, "HTTPS://doi.org/").otherwise("doi: "), "paper_id", F.lit(" ")).alias("raw"))
    return paper_terminology.select(F.col("paper_id").alias("raw")).unionByName(cited).groupBy(N.normalize_doi(F.col("raw")).alias("doi")).agg(F.count("*").alias("n")).where("doi IS NOT NULL")


@query
def week_label(spark, orders):
    return orders.groupBy(N.iso_week(F.col("o_orderdate")).alias("week")).agg(F.count("*").alias("n")).where(N.is_iso_week(F.col("week")))


@query
def canonical_dates(spark, registry_snapshots):
    ok = N.is_iso_date(strip(F.col("first_verified")))
    return registry_snapshots.groupBy(ok.alias("canonical")).agg(F.count("*").alias("n"))


@query
def id_patterns(spark, terminology_registry):
    c = lambda col, kind: F.count_if(N.is_id(strip(F.col(col)), kind)).alias(f"{col}_ok")
    return terminology_registry.agg(c("term_id", "term"), c("evidence_id", "evidence"), c("evidence_level", "level"), F.count("*").alias("n"))


@query
def dedupe_week(spark, orders):
    d = orders.withColumn("week", N.iso_week(F.col("o_orderdate")))
    return identity.first_per_key(d, ["week", "o_custkey"], ["o_orderkey"]).select("week", "o_custkey", "o_orderkey")


@query
def dedupe_global(spark, paper_terminology):
    d = paper_terminology.where("trim(coalesce(paper_id, '')) <> ''").withColumn("p", F.lower(F.trim("paper_id")))
    return identity.first_per_key(d, ["p"], ["used_at", "row_id"]).select(F.col("p").alias("paper"), "row_id", "week")


@query
def or_identity_semi(spark, terminology_registry, term_submissions):
    sub = term_submissions.select(F.lower(F.trim(F.get_json_object("record", "$.English_Term"))).alias("e"), F.trim(F.get_json_object("record", "$.Preferred_Chinese")).alias("c"))
    reg = terminology_registry.withColumn("_row", F.col("row_id")).withColumn("e", F.lower(F.trim("english_term"))).withColumn("c", F.trim("preferred_chinese"))
    return identity.matching_rows(reg, sub, [(["e"], ["e"]), (["c"], ["c"])]).select("row_id", "term_id")


@query
def same_papers(spark, terminology_registry, paper_terminology):
    """How many uses of terms are of the same paper or the same term as a registry row, and the first of them."""
    form = lambda c: F.nullif(N.component(F.col(c)), F.lit(""))
    keyed = lambda d: d.select("row_id", form("paper_id").alias("p"), form("term_id").alias("t"))
    d = identity.identity_links(keyed(terminology_registry), keyed(paper_terminology), [("p", "p"), ("t", "t")], left_id="row_id", right_id="row_id")
    return d.select(F.col("left_id").alias("row_id"), "links", "representative")


@query
def leading_issues(spark, text_frame_inventory):
    """Pages as frames, the tops of their boxes as lines, against a leading from the largest font."""
    d = text_frame_inventory.where("source_id IS NOT NULL AND source_page IS NOT NULL").withColumn("page", F.concat_ws("/", "source_id", "source_page")).withColumn("top", F.get("bbox_pt", F.lit(3)))
    expected = d.groupBy("page").agg((F.max("source_font_size_pt") * 4).alias("leading"))
    return ordered.leading_issues(d, expected, frame="page", at="top", leading="leading")


@query
def group_identity(spark, terminology_registry):
    d = terminology_registry.select("row_id", F.lower(F.trim("english_term")).alias("alias"), F.upper(F.trim("term_id")).alias("key"), F.concat(F.lit("row-"), F.col("row_id").cast("string")).alias("fallback"))
    return identity.canonical_groups(d, alias="alias", key="key", fallback="fallback", order="row_id").groupBy("identity").agg(F.count("*").alias("n"), F.min("row_id").alias("first_row"))


@query
def duplicate_terms(spark, terminology_registry):
    return identity.duplicate_identities(terminology_registry, ["english_term", "domain", "subdomain", "context"]).select(F.col("k0").alias("english"), F.col("k1").alias("domain"), F.col("k2").alias("subdomain"), F.col("k3").alias("context"), "n")


@query
def current_submission(spark, term_submissions):
    d = term_submissions.withColumn("flag", F.pmod("submission_id", F.lit(211)) == 0).withColumn("preferred", F.pmod("submission_id", F.lit(7)) == 0)
    return identity.current_rows(d, key="contributor", flag="flag", preferred="preferred", order="submission_id").select("contributor", "submission_id", "ambiguous")


# -- registry ---------------------------------------------------------------------------------------------------------


@query
def lookup_any(spark, terminology_registry):
    return registry.lookup(terminology_registry, ["term_id", "english_term", "abbreviation", "preferred_chinese", "alternative_chinese"], "Load").select("row_id", "english_term")


@query
def ambiguous_terms(spark, terminology_registry):
    return registry.ambiguous_terms(terminology_registry).groupBy("status", "confidence").agg(F.count("*").alias("n"))


@query
def resolve_context(spark, terminology_registry, term_submissions):
    q = term_submissions.select(F.col("submission_id").alias("query_id"), F.get_json_object("record", "$.English_Term").alias("english_term"), F.get_json_object("record", "$.Domain").alias("domain"), F.lit(None).cast("string").alias("subdomain"), F.lit(None).cast("string").alias("context"))
    r = registry.resolve(q.where("english_term IS NOT NULL"), terminology_registry.where("removed_at IS NULL"))
    return r.select("query_id", "n_candidates", "decision", "term_id")


def _evidence(log: DataFrame) -> DataFrame:
    return registry.evidence_state(log, key=F.upper(F.trim("evidence_id")), target=F.upper(F.trim("target_evidence_id")), kind="event_type", order="seq", payload=["evidence_type"], updates={"supports": "new_supports", "reported_terms": "reported_terms", "roles": "roles"}, guard="new_supports")


@query
def evidence_fold(spark, terminology_evidence):
    return _evidence(terminology_evidence).select(F.col("id").alias("evidence_id"), "state", F.coalesce("evidence_type", F.lit("")).alias("evidence_type"), *[F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("supports", "reported_terms", "roles")])


@query
def evidence_links(spark, terminology_registry, terminology_evidence):
    ids = F.transform(N.ordered_union(F.col("evidence_id"), F.col("evidence_ids")), lambda x: F.upper(x))
    found = registry.evidence_links(terminology_registry, _evidence(terminology_evidence), term_id="term_id", english="english_term", ids=ids)
    return found.groupBy("issue").agg(F.count("*").alias("n"), F.countDistinct("term_id").alias("n_terms"))


@query
def overclaimed_evidence(spark, terminology_evidence):
    return registry.overclaimed_evidence(_evidence(terminology_evidence))


@query
def usage_count(spark, paper_terminology):
    u = paper_terminology.select(F.nullif(F.upper(F.trim("term_id")), F.lit("")).alias("t"), F.nullif(F.lower(F.trim("paper_id")), F.lit("")).alias("p"), F.col("used_at").cast("date").cast("string").alias("d"))
    return registry.usage_counts(u, term="t", paper="p", at="d")


@query
def usage_merge(spark, terminology_registry, paper_terminology):
    r = terminology_registry.groupBy(F.upper(F.trim("term_id")).alias("term_id")).agg(F.max(F.col("usage_count").try_cast("bigint")).alias("usage_count"), F.max("last_used").alias("last_used")).withColumn("used_by", F.array().cast("array<string>"))
    u = paper_terminology.where("trim(coalesce(term_id, '')) <> '' AND trim(coalesce(paper_id, '')) <> ''").select(F.upper(F.trim("term_id")).alias("term_id"), F.lower(F.trim("paper_id")).alias("paper_id"), F.col("used_at").cast("date").cast("string").alias("used_on"))
    return registry.record_usage(r, u).select("term_id", big("usage_count").alias("usage_count"), "last_used", big(F.size("used_by")).alias("n_papers"))


@query
def merge_alternatives(spark, terminology_registry):
    a = N.merge_values(F.col("alternative_chinese"), F.col("preferred_chinese"))
    return terminology_registry.select("row_id", a.alias("merged"))


@query
def term_choices(spark, paper_terminology, terminology_registry):
    return registry.term_choices(paper_terminology.where("paper_id IS NOT NULL"), terminology_registry).groupBy("issue").agg(F.count("*").alias("n"))


@query
def term_contexts(spark, terminology_registry):
    """The papers that registered a term, against the rows that hold now."""
    return registry.term_choices(terminology_registry.where("paper_id IS NOT NULL"), terminology_registry.where("removed_at IS NULL")).groupBy("issue").agg(F.count("*").alias("n"))


@query
def wording_conflicts(spark, paper_terminology):
    return registry.wording_conflicts(paper_terminology, english="english_term", chinese="preferred_chinese")


@query
def term_in_documents(spark, terminology_registry, documents):
    abbreviations = terminology_registry.select(F.nullif(F.trim("abbreviation"), F.lit("")).alias("term"))
    found = token_compare.terms_in_texts(abbreviations, documents, term="term", text_id="doc_id", text="text")
    return found.groupBy("term").agg(F.count("*").alias("n_docs"))


@query
def wording_in_documents(spark, terminology_registry, documents):
    found = registry.wording_in_texts(terminology_registry.withColumnRenamed("notes", "context_note"), documents, text_id="doc_id", text="text")
    return found.groupBy("english_term", "preferred_chinese", "issue", "wording").agg(F.count("*").alias("n_docs"))


def _price_updates(customer: DataFrame) -> DataFrame:
    return customer.where("c_acctbal < 0").select("c_custkey", F.lit(0.0).alias("c_acctbal"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "REVIEW").alias("c_mktsegment"))


@query
def reconcile_rows(spark, customer):
    rows, _ = registry.reconcile(customer, _price_updates(customer), key="c_custkey", fields=["c_acctbal", "c_mktsegment"], reason="negative balance")
    return rows.select("c_custkey", "c_acctbal", "c_mktsegment")


@query
def reconcile_audit(spark, customer):
    _, audit = registry.reconcile(customer, _price_updates(customer), key="c_custkey", fields=["c_mktsegment"], reason="negative balance")
    return audit


@query
def append_new_terms(spark, terminology_registry, term_submissions):
    new = term_submissions.select(F.lower(F.trim(F.get_json_object("record", "$.English_Term"))).alias("english"), F.trim(F.get_json_object("record", "$.Domain")).alias("domain")).where("english IS NOT NULL AND domain IS NOT NULL")
    have = terminology_registry.select(F.lower(F.trim("english_term")).alias("english"), F.trim("domain").alias("domain"))
    return registry.append_new(have, new, [["english", "domain"]])


@query
def preferred_changes(spark, terminology_registry, terminology_evidence):
    one = identity.first_per_key(terminology_registry, ["term_id"], ["row_id"])
    changes = terminology_evidence.where("event_type = 'UNLINK' AND term_id IS NOT NULL").select("term_id", F.concat(F.lit("alt "), "term_id").alias("preferred_chinese"), F.col("reason").alias("note"))
    return registry.change_preferred(one, changes)[1]


@query
def unlinked_evidence(spark, terminology_registry, terminology_evidence):
    one = identity.first_per_key(terminology_registry, ["term_id"], ["row_id"])
    links = terminology_evidence.where("event_type = 'DEPRECATE'").select(F.col("target_evidence_id").alias("evidence_id"))
    pairs = one.select("term_id", F.explode(N.ordered_union(F.col("evidence_ids"))).alias("evidence_id")).join(links.distinct(), "evidence_id")
    return registry.unlink(one, pairs.select("term_id", "evidence_id"))[1]


# -- coverage ---------------------------------------------------------------------------------------------------------


@query
def coverage_diff(spark, orders, lineitem):
    found = lineitem.where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("k"))
    return coverage.coverage(orders.select(F.col("o_orderkey").alias("k")), found, ["k"]).select("k", "issue")


@query
def frame_coverage(spark, text_frame_inventory, paper_terminology):
    key = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    e = text_frame_inventory.where("translatable").select(key("frame_id").alias("k"))
    f = paper_terminology.select(key("frame_id").alias("k"))
    return coverage.coverage(e.where("k IS NOT NULL"), f.where("k IS NOT NULL"), ["k"]).groupBy("issue").agg(F.count("*").alias("n"))


@query
def value_coverage(spark, terminology_registry, paper_terminology):
    e = terminology_registry.groupBy(F.upper(F.trim("term_id")).alias("k")).agg(F.max(F.trim("english_term")).alias("english"))
    f = paper_terminology.where("trim(coalesce(term_id, '')) <> ''").groupBy(F.upper(F.trim("term_id")).alias("k")).agg(F.max(F.trim("english_term")).alias("english"))
    return coverage.coverage(e, f, ["k"], ["english"])


@query
def link_both_ways(spark, customer, orders):
    return coverage.broken_links(orders.where("o_orderstatus = 'F'"), customer, child="o_custkey", parent="c_custkey")


@query
def expected_sequence(spark, lineitem):
    return coverage.missing_numbers(lineitem.where("l_returnflag <> 'N'"), ["l_orderkey"], "l_linenumber").select("l_orderkey", big("l_linenumber").alias("l_linenumber"))


@query
def page_sequence(spark, text_frame_inventory):
    pages = text_frame_inventory.where("source_id IS NOT NULL AND source_page IS NOT NULL").select("source_id", "source_page").distinct()
    return coverage.is_sequence(pages, ["source_id"], "source_page")


@query
def multiset_diff(spark, lineitem):
    d = lineitem.select("l_orderkey", F.col("l_linestatus").alias("token"), (F.col("l_returnflag") == "R").alias("side"))
    return coverage.bag_difference(d, ["l_orderkey"], "token", "side")


@query
def page_cancel(spark, lineitem):
    d = lineitem.select(F.pmod("l_suppkey", F.lit(50)).alias("page"), "l_orderkey", F.col("l_linenumber").alias("token"), (F.col("l_returnflag") == "R").alias("side"))
    diff = coverage.bag_difference(d, ["page", "l_orderkey"], "token", "side")
    left = coverage.cancel_within(diff, page=["page"], unit="l_orderkey", token="token")
    return left.groupBy("page", "token").agg(F.sum("missing").alias("missing"), F.sum("added").alias("added"), F.min("l_orderkey").alias("first_unit"))


@query
def bag_minus(spark, text_frame_inventory):
    keys = ["frame_kind", "weight"]
    left = text_frame_inventory.where("rotation = 0 AND source_page > 1")
    out = coverage.unmatched_copies(left, text_frame_inventory.where("source_page = 1"), keys, ["row_id"])
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


@query
def unique_ids(spark, terminology_registry, text_frame_inventory, documents):
    parts = [coverage.id_report(d, c).select(F.lit(c).alias("id_column"), "*") for d, c in ((terminology_registry, "term_id"), (text_frame_inventory, "frame_id"), (documents, "doc_id"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def landed_compare(spark, orders, lineitem):
    landed = lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    r = coverage.compare_landed(orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus"), landed, "k", {"lines": F.col("r_n") <= 5, "quantity": F.col("r_q") > 20})
    return r.select("k", F.array_join("failed", ",").alias("failed")).where("failed <> ''")


# -- order ------------------------------------------------------------------------------------------------------------


@query
def lifecycle_chain(spark, events):
    d = events.select("user_id", "event_id", F.col("event_type").alias("new"), F.when(F.pmod("event_id", F.lit(3)) == 0, "view").otherwise("click").alias("old"))
    return ordered.chain_breaks(d, key="user_id", order="event_id", old="old", new="new").select("event_id", F.coalesce("last_state", F.lit("")).alias("last_state"), "old", "new")


# line numbers repeat within an order
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query
def running_ranges(spark, lineitem):
    d = ordered.running_ranges(lineitem.withColumn("q", big("l_quantity")), group=["l_orderkey"], order=LINE_ORDER, length="q")
    return d.select("l_orderkey", "l_linenumber", "first_no", "last_no")


@query
def ranges_contiguous(spark, lineitem):
    d = ordered.running_ranges(lineitem.withColumn("q", big("l_quantity")), group=["l_orderkey"], order=LINE_ORDER, length="q")
    return ordered.ranges_contiguous(d.where("l_returnflag <> 'A'"), group=["l_orderkey"], order=LINE_ORDER, first="first_no", last="last_no")


@query
def stable_numbering(spark, part):
    items = part.select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("item"))
    previous = part.where("p_size <= 25").select(F.col("p_type").alias("kind"), F.col("p_partkey").alias("item"), (F.col("p_partkey") + 1).alias("no"))
    return ordered.stable_numbers(items, previous, kind="kind", item="item", number="no", order=["item"]).select("kind", "item", "no")


@query
def renumber(spark, text_frame_inventory):
    d = text_frame_inventory.where("source_id IS NOT NULL AND source_page IS NOT NULL")
    return ordered.renumbered(d, group=["source_id", "source_page"], order=["reading_order", "row_id"], name="new_order").select("row_id", "new_order")


@query
def consecutive_runs(spark, lineitem):
    return ordered.increasing_share(lineitem, group=["l_orderkey"], order=["l_linenumber"], value="l_linenumber").select("l_orderkey", "n", "steps", "numbered")


@query
def gap_median(spark, events):
    d = events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return ordered.gap_medians(d, group=["user_id"], value="t", least=1)


@query
def upper_median_mode(spark, lineitem):
    m = ordered.upper_median_per_group(lineitem, ["l_suppkey"], "l_extendedprice")
    return m.join(ordered.mode_per_group(lineitem, ["l_suppkey"], "l_quantity"), "l_suppkey")


@query
def sessions(spark, events):
    d = ordered.sessions(events, group=["user_id"], at="ts", gap_seconds=86400)
    return d.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query
def ordered_containment(spark, documents):
    parts = F.array(F.lit("return"), F.lit("def "), F.lit("return"))
    return documents.groupBy(ordered.holds_in_order(parts, F.coalesce("text", F.lit(""))).alias("in_order")).agg(F.count("*").alias("n"))


@query
def section_carry(spark, text_frame_inventory):
    d = text_frame_inventory.where("source_id IS NOT NULL").withColumn("h", F.when(F.col("frame_kind") == "heading", F.col("source_text")))
    return ordered.carry_section(d, group=["source_id"], order=["source_page", "reading_order", "row_id"], heading="h").select("row_id", "section")


# -- places -----------------------------------------------------------------------------------------------------------


def _frames_and_points(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    live = frames.where(N.is_box(F.col("bbox_pt"))).where("removed_at IS NULL AND source_id IS NOT NULL AND source_page IS NOT NULL")
    boxes = live.select("source_id", "source_page", F.col("row_id").alias("box_id"), "bbox_pt")
    middle = lambda i, j: (F.get("bbox_pt", F.lit(i)) + F.get("bbox_pt", F.lit(j))) / 2
    return boxes, live.select("source_id", "source_page", F.col("row_id").alias("point_id"), middle(0, 2).alias("x"), middle(1, 3).alias("y"))


def _held(frames: DataFrame) -> DataFrame:
    boxes, points = _frames_and_points(frames)
    return spatial.containing(points, boxes, page=["source_id", "source_page"], point="point_id", x="x", y="y", box="box_id", bounds="bbox_pt", tolerance=0.25)


@query
def smallest_owner(spark, text_frame_inventory):
    return spatial.smallest_owner(_held(text_frame_inventory), page=["source_id", "source_page"])


@query
def innermost_owner(spark, text_frame_inventory):
    return spatial.innermost_owner(_held(text_frame_inventory), page=["source_id", "source_page"]).select("point", "box")


@query
def owner_counts(spark, text_frame_inventory):
    _, points = _frames_and_points(text_frame_inventory)
    d = spatial.owner_counts(_held(text_frame_inventory), points, page=["source_id", "source_page"], point="point_id")
    return d.groupBy("owners").agg(F.count("*").alias("n"))


@query
def range_owner(spark, part, lineitem):
    bands = part.groupBy("p_size").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).select(F.lit(0).alias("page"), F.col("p_size").alias("band"), F.array("lo", F.lit(0.0), "hi", F.lit(1.0)).alias("b"))
    points = lineitem.select(F.lit(0).alias("page"), F.monotonically_increasing_id().alias("point"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("x"), F.lit(0.5).alias("y"))
    held = spatial.containing(points, bands, page=["page"], point="point", x="x", y="y", box="band", bounds="b")
    return spatial.smallest_owner(held, page=["page"]).groupBy("box").agg(F.count("*").alias("n"))


@query
def page_lines(spark, text_frame_inventory):
    g = text_frame_inventory.where(N.is_box(F.col("bbox_pt"))).where("source_id IS NOT NULL AND source_page IS NOT NULL")
    side = lambda i: F.get("bbox_pt", F.lit(i))
    glyphs = g.select("source_id", "source_page", F.coalesce("source_text", F.lit("")).alias("text"), side(0).alias("x0"), side(2).alias("x1"), side(1).alias("top"), side(3).alias("bottom"), F.col("source_font_size_pt").alias("size"), F.col("source_font").alias("font"))
    lines = spatial.glyph_lines(glyphs, page=["source_id", "source_page"])
    return spatial.line_blocks(lines, page=["source_id", "source_page"])


@query
def style_envelopes(spark, text_frame_inventory):
    d = text_frame_inventory.where("source_font_size_pt IS NOT NULL AND frame_role IS NOT NULL")
    m = ordered.upper_median_per_group(d, ["frame_role"], "source_font_size_pt")
    return m.join(d.groupBy("frame_role").agg(F.min("source_font_size_pt").alias("least"), F.max("source_font_size_pt").alias("most")), "frame_role")


@query
def vector_tolerance(spark, embeddings):
    """Each vector against the middle of its label: within the tolerance in every dimension?"""
    dims = embeddings.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg("x"), 6).alias("m"))
    middle = dims.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("middle"))
    return embeddings.join(middle, "label").select("vec_id", N.boxes_match(F.col("embedding").cast("array<double>"), F.col("middle"), 0.25).alias("near"))


@query
def frame_styles(spark, text_frame_inventory):
    d = text_frame_inventory.withColumn("s", N.style_fingerprint(F.col("source_font"), F.col("source_font_size_pt"), F.col("weight"))).withColumn("e", N.font_emphasis(F.col("source_font")))
    return d.groupBy("s.font_family", "s.weight", "e.bold", "e.italic").agg(F.count("*").alias("n"), F.max("s.font_size_pt").alias("largest"))


@query
def frame_roles(spark, text_frame_inventory):
    body = ordered.upper_median_per_group(text_frame_inventory.where("frame_kind = 'paragraph' AND source_font_size_pt IS NOT NULL"), ["source_id"], "source_font_size_pt").select("source_id", F.col("upper_median").alias("body"))
    d = text_frame_inventory.join(body, "source_id", "left")
    role = N.text_role(F.col("frame_kind"), F.col("source_font_size_pt"), F.coalesce("body", F.lit(10.0)), F.col("source_text"))
    return d.groupBy("frame_kind", role.alias("role")).agg(F.count("*").alias("n"))


@query
def page_keys(spark, text_frame_inventory):
    k = N.source_key(F.col("source_id"), F.col("source_page"))
    return text_frame_inventory.groupBy(F.coalesce(k["source_id"], F.lit("")).alias("source_id"), F.coalesce(k["page"], F.lit(0)).alias("page")).agg(F.count("*").alias("n"))


# -- rules and checks -------------------------------------------------------------------------------------------------


@query
def router(spark, events):
    profiles = events.where("value > 40").groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    table_ = spark.createDataFrame([(1, ["purchase"], "BUYER"), (2, ["click", "view"], "BROWSER"), (3, ["error"], "SUPPORT"), (4, ["signup", "purchase"], "MEMBER"), (5, ["error"], "BROWSER")], "ordinal int, any_of array<string>, outcome string")
    return rules.route(profiles, table_, key="user_id", values="kinds").select("user_id", F.array_join("outcomes", ",").alias("outcomes"))


@query
def set_relations(spark, events):
    kinds = lambda w: F.collect_set(F.when(w, F.col("event_type")))
    d = events.groupBy("user_id").agg(kinds(F.col("value") > 50).alias("a"), kinds(F.col("value") <= 20).alias("b"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    return d.select("user_id", join(F.array_intersect("a", "b")).alias("both"), join(F.array_except("a", "b")).alias("only_a"), join(F.array_union("a", "b")).alias("any"), (F.size(F.array_except("b", "a")) == 0).alias("b_in_a"))


@query
def weighted_rank(spark, supplier, lineitem):
    per = lineitem.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    s = supplier.join(per, F.col("s_suppkey") == F.col("l_suppkey")).withColumn("gate", F.when(F.col("s_acctbal") < 0, "RED").when(F.col("s_acctbal") < 3000, "AMBER").otherwise("GREEN"))
    s = s.withColumn("quantity", F.col("q") / 10).withColumn("discount", F.col("d") * 50).withColumn("score", rules.weighted_score({"quantity": 60.0, "discount": 40.0}, 5.0))
    return rules.ranked(s, group=["s_nationkey"], gate={"GREEN": 0, "AMBER": 1}, gate_column="gate", barred=["RED"], score="score", tie="s_suppkey", keep=3).select("s_nationkey", "s_suppkey", "gate", "score", "rank")


@query
def p_values(spark, lineitem):
    per = lineitem.groupBy("l_suppkey").agg(F.avg("l_discount").alias("m"), F.stddev_samp("l_discount").alias("s"), F.count("*").alias("n"))
    t = per.where("n > 1 AND s > 0").withColumn("t", (F.col("m") - 0.05) / (F.col("s") / F.sqrt("n")))
    return t.select("l_suppkey", F.round(statistics.p_value(F.lit("t"), F.col("t"), (F.col("n") - 1).cast("double"), F.lit(None).cast("double")), 6).alias("p"))


@query
def funnel_breaks(spark, events):
    stage = F.array_position(F.array(*[F.lit(x) for x in ("view", "click", "signup", "purchase")]), F.col("event_type"))
    d = events.withColumn("stage", stage).where("stage > 0").groupBy("user_id", "stage").agg(F.count("*").alias("n"))
    return ordered.funnel_breaks(d, group=["user_id"], order="stage", n="n").select("user_id", "stage", "n", "before")


@query
def preferred_versions(spark, paper_terminology):
    d = paper_terminology.where("paper_id IS NOT NULL").select(F.trim("paper_id").alias("paper"), F.col("artifact").alias("kind"), F.col("row_id").alias("version"))
    return rules.preferred_version(d, key="paper", kind="kind", order=["C", "B", "A"])


def _checks(frames: DataFrame) -> DataFrame:
    return checks.run_checks(frames, [
        checks.Check("FRAME_ID", F.coalesce(F.trim("frame_id"), F.lit("")) != "", F.col("row_id")),
        checks.Check("BOX", N.is_box(F.col("bbox_pt")), F.col("row_id")),
        checks.Check("PAGE", F.col("source_page") > 0, F.col("row_id")),
        checks.Check("FONT", F.coalesce(F.trim("source_font"), F.lit("")) != "", F.col("row_id")),
        checks.Check("ACTION", F.when(F.col("translatable"), F.col("translation_action") == "TRANSLATE").otherwise(F.col("translation_action") == "RETAIN_SOURCE")),
    ])


@query
def frame_checks(spark, text_frame_inventory):
    return _checks(text_frame_inventory)


@query
def checks_report(spark, text_frame_inventory):
    return checks.report(_checks(text_frame_inventory), validator="frames").select("validator", "passed", "n_checks", "n_failed", "first_failure")


@query
def suite_summary(spark, orders):
    d = orders.select(F.col("o_orderpriority").alias("suite"), F.when(F.col("o_orderstatus") == "F", "ok").when(F.col("o_orderstatus") == "P", "skip").otherwise(F.when(F.col("o_totalprice") > 400000, "failure").otherwise("ok")).alias("outcome"))
    return checks.suite_summary(d, suite="suite", outcome="outcome")


# -- text -------------------------------------------------------------------------------------------------------------


@query
def numeric_tokens(spark, documents):
    return spread(documents.select("doc_id", "text")).select("doc_id", big(F.size(udfs.numeric_tokens("text"))).alias("n_tokens"))


@query
def numeric_residuals(spark, text_frame_inventory):
    """Numbers of each frame against those of the frame after it on the page."""
    d = text_frame_inventory.where("source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL")
    d = d.withColumn("target", F.lead("source_text").over(Window.partitionBy("source_id", "source_page").orderBy("row_id")))
    left = token_compare.numeric_residuals(d, page=["source_id", "source_page"], unit="row_id", source="source_text", target="target")
    return left.groupBy("source_id").agg(F.sum("missing").alias("missing"), F.sum("added").alias("added"))


@query
def canon_tokens(spark, documents):
    found = F.regexp_extract_all("text", F.lit("[0-9]+[.,]?[0-9]* ?(?:ms|s|seconds|min|minutes|h|hours|days)?"), F.lit(0))
    t = documents.select(F.explode(F.transform(found, N.canon_number)).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query
def semantic_token_kinds(spark, documents):
    return token_compare.semantic_kinds(spread(documents.select("text")), text="text")


@query
def chinese_typography(spark, documents):
    d = spread(documents.select("doc_id", "text")).select("doc_id", udfs.chinese_typography("text").alias("n"))
    return d.select("doc_id", F.sha2("n", 256).alias("digest"), udfs.typography_is_stable(F.col("n"), udfs.chinese_typography("n")).alias("stable"))


@query
def citation_groups(spark, documents):
    return documents.select("doc_id", F.explode(N.citation_groups(F.coalesce("text", F.lit("")))).alias("citation")).groupBy("citation").agg(F.count("*").alias("n_docs"))


@query
def cjk_latin_counts(spark, documents):
    d = documents.select(F.coalesce("lang", F.lit("")).alias("lang"), N.cjk_length(F.col("text")).alias("cjk"), F.regexp_count("text", F.lit("[A-Za-z]")).alias("latin"), N.has_cjk(F.col("text")).alias("has"))
    return d.groupBy("lang").agg(F.sum(big("cjk")).alias("cjk"), F.sum(big("latin")).alias("latin"), F.count_if("has").alias("with_cjk"))


@query
def visible_length(spark, documents):
    return documents.select("doc_id", big(N.visible_length(F.coalesce("text", F.lit("")))).alias("visible"))


def _markdown(documents: DataFrame) -> DataFrame:
    """Markdown by language, where that is not known by the file's name."""
    return documents.where(F.coalesce(F.col("lang") == "markdown", F.col("path").endswith(".md")))


@query
def markdown_visible(spark, documents):
    return _markdown(documents).select("doc_id", big(N.visible_length(N.visible_text(F.col("text")))).alias("visible"))


@query
def md_sections(spark, documents):
    s = readers.markdown_sections(_markdown(documents), key="doc_id", value="text")
    return s.select("doc_id", "section", big(F.length("body")).alias("n_chars"))


@query
def pipe_rows(spark, documents):
    return readers.pipe_tables(_markdown(documents), cells=3, key="doc_id", value="text").select("doc_id", "seq", F.array_join("cells", "¦").alias("cells"))


@query
def html_links(spark, terminology_evidence):
    """One page per paper, with a link for each of its evidence: quoted in turn by the length of the source, some tags in capitals."""
    style = F.pmod(F.length("source"), F.lit(3))
    link = F.when(style == 0, F.concat(F.lit('<a class="x" href="'), "url", F.lit('">'), "source", F.lit("</a>"))).when(style == 1, F.concat(F.lit("<A HREF='"), "url", F.lit("'>"), "source", F.lit("</A>"))).otherwise(F.concat(F.lit("<a name='n'>"), "source", F.lit("</a>")))
    page = terminology_evidence.where("url IS NOT NULL AND source IS NOT NULL AND paper_id IS NOT NULL").select("paper_id", F.struct("seq", link.alias("link")).alias("l"))
    html = page.groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda l: l["link"]), "<br>").alias("html"))
    return readers.html_links(html.withColumnRenamed("paper_id", "page_id"), key="page_id", value="html").select("page_id", "seq", "href")


@query
def html_plain(spark, terminology_registry):
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<table><tr><td>"), cell("definition"), F.lit("</td><TD>"), cell("context"), F.lit("</td></tr></table><p title='a>b'>"), cell("source_citation"), F.lit("<br/></p>"))
    return terminology_registry.select("row_id", udfs.html_plain(html).alias("text"))


@query
def exact_copies(spark, documents):
    return documents.groupBy(F.sha2(F.col("text"), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1 AND digest IS NOT NULL")


def _followed(frames: DataFrame) -> DataFrame:
    """Each text with the one that follows on its page as its output."""
    d = frames.where("source_id IS NOT NULL AND source_page IS NOT NULL AND source_text IS NOT NULL")
    return d.withColumn("output", F.lead("source_text").over(Window.partitionBy("source_id", "source_page").orderBy("row_id"))).where("output IS NOT NULL")


@query
def residual_runs(spark, text_frame_inventory):
    return token_compare.longest_shared_run(_followed(text_frame_inventory), key="row_id", output="output", source="source_text", least=1)


@query
def residual_words(spark, text_frame_inventory):
    """Words of a text that the next one shows although the frame's font and role do not allow them."""
    w = token_compare.residual_words(F.col("source_text"), F.col("frame_role"), F.col("output"), F.array(F.lit("n")))
    return _followed(text_frame_inventory).select("row_id", F.array_join(w, " ").alias("words")).where("words <> ''")


@query
def anchor_locate(spark, text_frame_inventory, documents):
    blocks = text_frame_inventory.where("source_id IS NOT NULL AND source_text IS NOT NULL").groupBy("source_id", "source_page", "reading_order").agg(F.max_by("source_text", "row_id").alias("text")).withColumn("section", F.lit(""))
    anchors = text_frame_inventory.where("source_id IS NOT NULL").select("row_id", "source_id", "source_page", "reading_order", F.substring_index("source_text", ",", 1).alias("quote"), F.lit("").alias("section"))
    return token_compare.locate_quotes(anchors, blocks, keys=["source_id", "source_page", "reading_order"]).groupBy("located").agg(F.count("*").alias("n"))


@query
def json_props(spark, events):
    k = F.get_json_object("props", "$.k")
    return events.groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k.try_cast("bigint")).alias("total"), F.countDistinct(k).alias("n_distinct"))


@query
def first_cjk_run(spark, terminology_registry):
    return terminology_registry.select("row_id", N.first_cjk_run(F.coalesce("preferred_chinese", F.lit(""))).alias("keyword"))


@query
def supplement_citations(spark, text_frame_inventory):
    """Sentences on supplements as the frames' kinds and places make them."""
    no = lambda c: F.col(c).cast("string")
    text = (
        F.when(F.col("frame_kind") == "table_cell", F.concat(F.lit("see supplementary Tables S"), no("source_page"), F.lit(", S"), no("reading_order"), F.lit(" and Supplementary   Methods.")))
        .when(F.col("frame_kind") == "caption", F.concat(F.lit("Supplementary Fig. "), no("reading_order"), F.lit("–"), no("rotation"), F.lit(" shows"))).when(F.col("frame_kind") == "heading", F.concat(F.lit("Supplementary "), F.col("source_text"))).otherwise(F.col("source_text"))
    )
    return text_frame_inventory.select(F.explode(N.supplement_references(text)).alias("citation")).groupBy("citation").agg(F.count("*").alias("n"))


@query
def recency_roles(spark, documents):
    year = lambda c: F.year(F.col(c))
    return documents.groupBy(rules.recency(year("committed_at"), year("crawled_at")).alias("role")).agg(F.count("*").alias("n"))


@query
def hypothesis_closure(spark, orders, lineitem):
    said = F.when(F.col("l_returnflag") == "N", "SUPPORTED").when(F.col("l_returnflag") == "R", "NOT_SUPPORTED").otherwise("OPEN")
    d = lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderpriority") != "5-LOW").alias("planned")), "l_orderkey").withColumn("said", said)
    return rules.closure(d, key="l_orderkey", outcome="said", planned="planned")


STAGE_EDGES = (("signup", "view"), ("view", "click"), ("click", "purchase"), ("purchase", "error"))


@query
def update_propagation(spark, events):
    edges = spark.createDataFrame(STAGE_EDGES, "from_stage string, to_stage string")
    return rules.propagated(events.where("value > 60"), edges, key="user_id", stage="event_type", depth=2)


@query
def resume_routing(spark, events):
    """The first place of each user, in the order of places, whose latest known status is not verified."""
    d = _latest(events).withColumn("place", F.array_position(F.array(*[F.lit(p) for p in PLACES]), F.col("event_type")))
    return rules.first_open(d, key="user_id", stage="event_type", ordinal="place", done=F.col("shown") == "VERIFIED").select("user_id", F.coalesce("event_type", F.lit("")).alias("stage"))


@query
def item_records(spark, terminology_registry):
    """Registry rows as loose metadata of items."""
    meta = F.map_from_arrays(F.array(*[F.lit(k) for k in ("title", "journal", "year", "pages", "abstract", "DOI", "url")]), F.array("english_term", "domain", "first_seen", "source_citation", "definition", "paper_id", "notes"))
    return terminology_registry.select("row_id", records.item_record(meta).alias("i")).where("i IS NOT NULL").select("row_id", "i.*")


@query
def frame_defaults(spark, text_frame_inventory):
    """Roles of frames by kind alone, and as a migration infers them."""
    kind = F.when(F.col("frame_kind") == "paragraph", "body").otherwise(F.col("frame_kind"))
    reason = F.when(F.col("frame_kind") == "reference", "REFERENCE_ENTRY").otherwise(F.upper("frame_kind"))
    d = text_frame_inventory.select(records.frame_role(F.lit(None).cast("string"), kind).alias("by_kind"), records.inferred_role(kind, F.col("translation_action"), reason, F.col("source_text")).alias("inferred"))
    return d.groupBy("by_kind", "inferred").agg(F.count("*").alias("n"))


@query
def added_evidence(spark, terminology_evidence):
    """The log's own additions, offered to the part of it that came before 2024: what is refused, and why."""
    new = terminology_evidence.where("coalesce(event_type, 'ADD') = 'ADD' AND recorded_at >= TIMESTAMP_NTZ '2024-01-01'")
    accepted, refused = registry.add_evidence(terminology_evidence.where("recorded_at < TIMESTAMP_NTZ '2024-01-01'"), new)
    return refused.groupBy("problem").agg(F.count("*").alias("n")).unionByName(accepted.agg(F.lit("").alias("problem"), F.count("*").alias("n")))


@query
def alias_columns(spark, terminology_registry):
    d = readers.aliased(terminology_registry, {"english": ["term_en", "english_term"], "chinese": ["preferred_chinese", "alternative_chinese"], "evidence": ["evidence_ids", "evidence_id"]}, required=["english", "chinese", "evidence"])
    return d.groupBy("problem").agg(F.count("*").alias("n"))


@query
def ledger_text(spark, text_frame_inventory):
    d = text_frame_inventory.where("source_id IS NOT NULL").select("source_id", "row_id", F.when(F.col("translation_action") == "RETAIN_SOURCE", F.col("source_text")).alias("retained"), "source_text")
    t = readers.ledger_text(d, group="source_id", order="row_id", columns=["retained", "source_text"])
    return t.select("source_id", F.sha2("text", 256).alias("digest"))
