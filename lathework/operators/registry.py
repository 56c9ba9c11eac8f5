"""A registry of terms with evidence: lookup, resolution, event folds, usage, consistency with texts, and audited changes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.normalize import component, is_id, is_iso_date, ordered_union
from ..functions.records import inferred_role
from ..functions.text import strip, text_or_blank
from ..session import materialize
from .token_compare import terms_in_texts


def lookup(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows that hold ``text`` in one of the columns, case ignored."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lower(F.lit(text))), F.lit(False))
    return df.where(hit)


def ambiguous_terms(df: DataFrame) -> DataFrame:
    """Terms that can't be used without a look: low or medium confidence, contextual, with alternatives, or without evidence."""
    filled = lambda c: F.coalesce(strip(F.col(c)), F.lit("")) != ""
    return df.where(F.col("confidence").isin("LOW", "MEDIUM") | (F.col("status") == "CONTEXTUAL") | filled("alternative_chinese") | ~(filled("evidence_id") | filled("evidence_ids")))


def resolve(queries: DataFrame, registry: DataFrame, *, parts: Sequence[str] = ("domain", "subdomain", "context")) -> DataFrame:
    """Each query (query_id, english_term, parts; null part: any) with its candidates and decision.

    REUSE if exactly one of the candidates that fit is of high confidence, active or contextual and has evidence, whatever
    others fit; else VERIFY. Candidates meet by term first (equi-join), the other parts filter.
    """
    q = queries.select("query_id", component(F.col("english_term")).alias("_t"), *[F.when(F.col(p).isNotNull(), component(F.col(p))).alias(f"_q_{p}") for p in parts])
    r = registry.select(
        "term_id", component(F.col("english_term")).alias("_t"), *[component(F.col(p)).alias(f"_r_{p}") for p in parts],
        ((F.col("confidence") == "HIGH") & F.col("status").isin("ACTIVE", "CONTEXTUAL") & (F.size(ordered_union(F.col("evidence_id"), F.col("evidence_ids"))) > 0)).alias("_good"),
    ).where("_t <> ''")
    j = q.join(r, "_t", "left")
    fits = F.col("term_id").isNotNull()
    for p in parts:
        fits = fits & (F.col(f"_q_{p}").isNull() | (F.col(f"_q_{p}") == F.col(f"_r_{p}")))
    per = j.groupBy("query_id").agg(F.count_if(fits).alias("n_candidates"), F.count_if(fits & F.col("_good")).alias("n_good"), F.min(F.when(fits & F.col("_good"), F.col("term_id"))).alias("_first"))
    reuse = F.col("n_good") == 1
    return per.select("query_id", "n_candidates", F.when(reuse, "REUSE").otherwise("VERIFY").alias("decision"), F.when(reuse, F.col("_first")).otherwise("").alias("term_id"))


# fixed values: the events that change a record; any other one adds it
CHANGES = ("DEPRECATE", "UNLINK", "UPDATE_SUPPORTS")


def evidence_state(events: DataFrame, *, key: Column, target: Column, kind: str, order: str, payload: Sequence[str], updates: Mapping[str, str], guard: str) -> DataFrame:
    """Fold of an event log in the order of ``order``: (id, payload, updated columns, state).

    An addition (any kind but CHANGES, or none) sets the record and starts it anew. DEPRECATE marks it. UPDATE_SUPPORTS
    counts only if ``guard`` is not null; then each of ``updates`` (column -> column of the update) that is not null there
    replaces the record's. UNLINK changes nothing; events on unknown targets or before the last addition are lost. A single
    aggregation, combined before the shuffle: what came last of each kind, and whether that was after the last addition.
    """
    is_add = F.col(kind).isNull() | ~F.col(kind).isin(*CHANGES)
    e = events.withColumn("_add", is_add).withColumn("_id", F.nullif(strip(F.when(is_add, key).otherwise(target)), F.lit(""))).where("_id IS NOT NULL")
    last = lambda when: F.when(when, F.col(order))
    update = (F.col(kind) == "UPDATE_SUPPORTS") & F.col(guard).isNotNull()
    newest = [f(i, update & F.col(c).isNotNull(), c) for i, c in enumerate(updates.values()) for f in (lambda i, w, c: F.max(last(w)).alias(f"_u{i}"), lambda i, w, c: F.max_by(F.struct(F.col(c).alias("v")), last(w)).alias(f"_n{i}"))]
    fold = e.groupBy("_id").agg(
        F.max_by(F.struct(*payload, *updates, F.col("status")), last(F.col("_add"))).alias("_r"), F.max(last(F.col("_add"))).alias("_at"), F.max(last(F.col(kind) == "DEPRECATE")).alias("_dep"), *newest
    ).where("_at IS NOT NULL")
    replaced = [F.when(F.col(f"_u{i}") > F.col("_at"), F.col(f"_n{i}.v")).otherwise(F.col(f"_r.{c}")).alias(c) for i, c in enumerate(updates)]
    return fold.select(
        F.col("_id").alias("id"), *[F.col(f"_r.{p}") for p in payload], *replaced,
        F.when(F.col("_dep") > F.col("_at"), "DEPRECATED").otherwise(F.coalesce(F.col("_r.status"), F.lit("ACTIVE"))).alias("state"),
    )


def evidence_links(terms: DataFrame, state: DataFrame, *, term_id: str, english: str, ids: Column) -> DataFrame:
    """(term_id, evidence_id, issue): links to evidence that is UNKNOWN, DEPRECATED, or does not support the term (UNSUPPORTED)."""
    links = terms.select(F.col(term_id).alias("term_id"), component(F.col(english)).alias("_t"), F.explode(ids).alias("evidence_id"))
    j = links.join(state.select(F.col("id").alias("evidence_id"), "state", F.transform("supports", component).alias("_s"), F.lit(True).alias("_known")), "evidence_id", "left")
    issue = F.when(F.col("_known").isNull(), "UNKNOWN").when(F.col("state") == "DEPRECATED", "DEPRECATED").when(~F.coalesce(F.array_contains("_s", F.col("_t")), F.lit(False)), "UNSUPPORTED")
    return j.withColumn("issue", issue).where("issue IS NOT NULL").select("term_id", "evidence_id", "issue").distinct()


def overclaimed_evidence(state: DataFrame, *, level: str = "evidence_type") -> DataFrame:
    """Ids of source-reported evidence (TE7) that supports more than what it reported."""
    extra = F.size(F.array_except(F.coalesce("supports", F.array().cast("array<string>")), F.coalesce("reported_terms", F.array().cast("array<string>")))) > 0
    return state.where((F.col(level) == "TE7") & extra).select("id")


def usage_counts(uses: DataFrame, *, term: str, paper: str, at: str) -> DataFrame:
    """(term, n_papers, first_used, last_used): a paper counts once for a term however often it uses it."""
    return uses.where(F.col(term).isNotNull() & F.col(paper).isNotNull()).groupBy(F.col(term).alias("term")).agg(F.countDistinct(paper).alias("n_papers"), F.min(at).alias("first_used"), F.max(at).alias("last_used"))


def record_usage(registry: DataFrame, uses: DataFrame, *, key: str = "term_id") -> DataFrame:
    """Registry rows with usage merged in: ``uses`` is (key, paper_id, used_on). Only papers not yet listed add to usage_count."""
    new = uses.groupBy(key).agg(F.array_sort(F.collect_set("paper_id")).alias("_papers"), F.max("used_on").alias("_last"))
    j = registry.join(new, key, "left")
    old = F.coalesce("used_by", F.array().cast("array<string>"))
    merged = F.array_distinct(F.concat(old, F.coalesce("_papers", F.array().cast("array<string>"))))
    return j.withColumn("usage_count", F.coalesce("usage_count", F.lit(0)) + F.size(merged) - F.size(old)).withColumn("used_by", merged).withColumn("last_used", F.greatest("last_used", "_last")).drop("_papers", "_last")


def term_choices(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """(paper_id, term_id, issue) of a paper's terms against the registry: UNKNOWN id, or PREFERRED wording that differs.

    Terms with domain, subdomain or context are compared in these too (``context_issues``).
    """
    r = registry.groupBy(F.upper(strip(F.col("term_id"))).alias("_id")).agg(F.collect_set(strip(F.col("preferred_chinese"))).alias("_ok"))
    # distinct wordings first: a term used everywhere is few rows when it meets the registry
    used = terms.where("term_id IS NOT NULL AND trim(term_id) <> ''").select("paper_id", F.upper(strip(F.col("term_id"))).alias("_id"), F.coalesce(strip(F.col("preferred_chinese")), F.lit("")).alias("_w")).distinct()
    j = used.join(r, "_id", "left")
    issue = F.when(F.col("_ok").isNull(), "UNKNOWN").when(~F.array_contains("_ok", F.col("_w")), "PREFERRED")
    out = j.withColumn("issue", issue).where("issue IS NOT NULL").select("paper_id", F.col("_id").alias("term_id"), "issue").distinct()
    return out.unionByName(context_issues(terms, registry)) if set(CONTEXT) & set(terms.columns) else out


CONTEXT = ("domain", "subdomain", "context")


def context_issues(terms: DataFrame, registry: DataFrame) -> DataFrame:
    """(paper_id, term_id, issue) of terms whose id is in the registry, case and outer blanks ignored.

    AMBIGUOUS: more than one id that isn't deprecated has the English term, and the paper gives no domain or no context.
    DOMAIN, SUBDOMAIN, CONTEXT: given by the paper, and different in every row of the id.
    """
    fold = lambda c: F.lower(text_or_blank(F.col(c)))
    ident = F.upper(strip(F.col("term_id")))
    r = registry.groupBy(ident.alias("_id")).agg(*[F.collect_set(fold(f)).alias(f"_r_{f}") for f in CONTEXT])
    shared = registry.where("status IS NULL OR status <> 'DEPRECATED'").groupBy(fold("english_term").alias("_e")).agg(F.countDistinct(ident).alias("_n")).where("_n > 1")
    given = [fold(f).alias(f) if f in terms.columns else F.lit("").alias(f) for f in CONTEXT]
    used = terms.select("paper_id", ident.alias("_id"), fold("english_term").alias("_e"), *given).where("_id <> ''").distinct()
    j = used.join(r, "_id").join(shared, "_e", "left")
    ambiguous = F.when(F.col("_n").isNotNull() & ((F.col("domain") == "") | (F.col("context") == "")), "AMBIGUOUS")
    differs = [F.when((F.col(f) != "") & ~F.array_contains(f"_r_{f}", F.col(f)), f.upper()) for f in CONTEXT]
    return j.select("paper_id", F.col("_id").alias("term_id"), F.explode(F.array_compact(F.array(ambiguous, *differs))).alias("issue")).distinct()


def wording_in_texts(terms: DataFrame, texts: DataFrame, *, text_id: str, text: str, scope: Sequence[str] = ()) -> DataFrame:
    """(scope, text_id, english_term, preferred_chinese, issue, wording): texts that use a term otherwise than was chosen.

    ``terms`` has english_term, preferred_chinese, alternative_chinese (separated by ; or ；) and context_note. A text uses a term if it
    holds the English term (case ignored), the preferred or an alternative wording. PREFERRED_ABSENT: used without the preferred wording.
    ALTERNATIVE_WITHOUT_NOTE: an alternative stands there and the term has no context note; one row for each. Terms without English or
    preferred wording are left out. Columns of ``scope`` (a paper), if given, must agree between term and text.
    """
    none = F.array().cast("array<string>")
    others = F.filter(F.transform(F.split(text_or_blank(F.col("alternative_chinese")), "[;；]"), strip), lambda a: a != "")
    c = terms.select(*scope, strip(F.col("english_term")).alias("english_term"), strip(F.col("preferred_chinese")).alias("preferred_chinese"), F.array_sort(F.array_distinct(others)).alias("_others"), (text_or_blank(F.col("context_note")) != "").alias("_noted"))
    c = c.where("english_term <> '' AND preferred_chinese <> ''").distinct()
    wordings = c.withColumn("_w", F.explode(F.array_union("_others", F.array("preferred_chinese"))))
    keys = c.columns

    def uses(given: DataFrame, by: str, ignore_case: bool, seen: Column) -> DataFrame:
        hits = terms_in_texts(given, texts, term=by, text_id=text_id, text=text, ignore_case=ignore_case)
        if scope:
            hits = hits.join(texts.select(F.col(text_id).alias("text_id"), *scope), "text_id")
        return given.join(hits.withColumnRenamed("term", by), [*scope, by]).select(*keys, "text_id", seen.alias("_seen"))

    found = uses(c, "english_term", True, F.lit(None).cast("string")).unionByName(uses(wordings, "_w", False, F.col("_w")))
    per = found.groupBy(*keys, "text_id").agg(F.collect_set("_seen").alias("_seen"))
    issue = lambda name, w: F.struct(F.lit(name).alias("issue"), w.alias("wording"))
    absent = F.array_compact(F.array(F.when(~F.array_contains("_seen", F.col("preferred_chinese")), issue("PREFERRED_ABSENT", F.lit(None).cast("string")))))
    stray = F.when(F.col("_noted"), none).otherwise(F.filter(F.array_intersect("_others", "_seen"), lambda a: a != F.col("preferred_chinese")))
    out = per.select(*scope, "text_id", "english_term", "preferred_chinese", F.explode(F.concat(absent, F.transform(stray, lambda a: issue("ALTERNATIVE_WITHOUT_NOTE", a)))).alias("_i"))
    return out.select(*scope, "text_id", "english_term", "preferred_chinese", "_i.*").distinct()


def wording_conflicts(terms: DataFrame, *, english: str, chinese: str) -> DataFrame:
    """(english, n_wordings): terms of one paper or registry written in more than one way."""
    return terms.groupBy(component(F.col(english)).alias("english")).agg(F.countDistinct(strip(F.col(chinese))).alias("n_wordings")).where("english <> '' AND n_wordings > 1")


def reconcile(target: DataFrame, updates: DataFrame, *, key: str, fields: Sequence[str], reason: str) -> tuple[DataFrame, DataFrame]:
    """``target`` with non-null updated fields, and the audit rows (key, field, old_value, new_value, reason) of what really changed.

    An update must meet exactly one row: updates whose key is not unique in either table change nothing.
    """
    single = target.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key)
    u = updates.join(updates.groupBy(key).agg(F.count("*").alias("_n")).where("_n = 1").select(key), key, "left_semi").join(single, key, "left_semi")
    u = u.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    j = target.join(u, key, "left")
    changed = lambda f: F.col(f"_new_{f}").isNotNull() & ~F.col(f"_new_{f}").eqNullSafe(F.col(f))
    rows = F.array(*[F.when(changed(f), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("old_value"), F.col(f"_new_{f}").cast("string").alias("new_value"))) for f in fields])
    audit = j.select(key, F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select(key, "r.*", F.lit(reason).alias("reason"))
    return j.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in target.columns]), audit


def append_new(target: DataFrame, rows: DataFrame, keys: Sequence[Sequence[str]]) -> DataFrame:
    """Rows that may be appended one after the other (in the order of all columns): those that share no key with ``target`` or with a row appended before.

    A key with a null in it matches nothing. With one key a round decides all; with several, a row that
    shares a key with a refused one only is decided in the next round.
    """
    fresh = rows
    for k in keys:
        fresh = fresh.join(target.select(*k).distinct(), list(k), "left_anti")
    left = materialize(fresh.orderBy(*rows.columns).withColumn("_n", F.monotonically_increasing_id()), "fresh-rows")
    out = None
    while True:
        judged, first = left, F.lit(True)
        for i, k in enumerate(keys):
            judged = judged.join(left.groupBy(*k).agg(F.min("_n").alias(f"_f{i}")), list(k), "left")
            first = first & (F.col(f"_f{i}").isNull() | (F.col(f"_f{i}") == F.col("_n")))
        taken = materialize(judged.where(first).select(*left.columns), "appended-rows")
        out = taken if out is None else out.unionByName(taken)
        left = left.join(taken.select("_n"), "_n", "left_anti")
        for k in keys:
            left = left.join(taken.select(*k).distinct(), list(k), "left_anti")
        left = materialize(left.select(*taken.columns), "fresh-rows") if len(keys) > 1 else None
        if left is None or left.isEmpty():
            return out.select(*rows.columns)


def change_preferred(registry: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New preferred wordings (term_id, preferred_chinese, note): the old wording is kept as an alternative; the events of real changes.

    A change without a note, or to the same wording, does nothing.
    """
    c = changes.where("preferred_chinese IS NOT NULL AND trim(coalesce(note, '')) <> ''").groupBy("term_id").agg(F.max_by(F.struct("preferred_chinese", "note"), F.struct("preferred_chinese", "note")).alias("_c"))
    j = registry.join(c, "term_id", "left")
    differs = F.col("_c").isNotNull() & ~F.col("_c.preferred_chinese").eqNullSafe(F.col("preferred_chinese"))
    events = j.where(differs).select("term_id", F.col("preferred_chinese").alias("old_preferred_chinese"), F.col("_c.preferred_chinese").alias("new_preferred_chinese"), F.col("_c.note").alias("reason"))
    kept = F.array_join(F.filter(ordered_union(F.col("alternative_chinese"), F.col("preferred_chinese"), separators=";"), lambda v: v != F.col("_c.preferred_chinese")), "; ")
    out = j.withColumn("alternative_chinese", F.when(differs, kept).otherwise(F.col("alternative_chinese"))).withColumn("preferred_chinese", F.when(differs, F.col("_c.preferred_chinese")).otherwise(F.col("preferred_chinese")))
    return out.select(*registry.columns), events


def unlink(registry: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registry without the given (term_id, evidence_id) links, and an UNLINK event for each link that was there."""
    l = links.groupBy("term_id").agg(F.collect_set("evidence_id").alias("_gone"))
    j = registry.join(l, "term_id", "left").withColumn("_ids", ordered_union(F.col("evidence_ids")))
    none = F.array().cast("array<string>")
    events = j.select("term_id", F.explode(F.array_intersect("_ids", F.coalesce("_gone", none))).alias("target_evidence_id")).withColumn("event_type", F.lit("UNLINK"))
    return j.withColumn("evidence_ids", F.when(F.col("_gone").isNull(), F.col("evidence_ids")).otherwise(F.array_join(F.array_except("_ids", F.coalesce("_gone", none)), "; "))).select(*registry.columns), events


def renamed_schema(df: DataFrame, renames: Mapping[str, str], defaults: Mapping[str, Column]) -> DataFrame:
    """Schema migration: columns renamed where present, missing ones filled; nothing else is touched."""
    out = df.withColumnsRenamed({a: b for a, b in renames.items() if a in df.columns and b not in df.columns})
    return out.withColumns({c: v for c, v in defaults.items() if c not in out.columns})


def add_evidence(log: DataFrame, new: DataFrame, *, key: str = "evidence_id") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused) additions to an evidence log: the id in its format and in no addition so far, the date real, one supported term or more, a role.

    ``refused`` has the first ``problem``. Of additions with one id the first by all columns is accepted.
    """
    filled_list = lambda c: F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: strip(x) != "")) > 0
    known = log.where(F.col("event_type").isNull() | ~F.col("event_type").isin(*CHANGES)).select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_known", F.lit(True))
    problem = (
        F.when(~is_id(F.col(key), "evidence"), "ID").when(F.col("_known").isNotNull(), "KNOWN").when(~is_iso_date(F.col("verified_date")), "DATE").when(~filled_list("supports"), "SUPPORTS").when(~filled_list("roles"), "ROLES")
    )
    judged = new.join(known, key, "left").withColumn("problem", problem).drop("_known")
    columns = new.columns
    first = judged.where("problem IS NULL").groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*columns), F.to_json(F.struct(*columns))).alias("_r"))
    return first.select("_r.*").select(*columns), judged.where("problem IS NOT NULL")


def exact_migration(frames: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frames and ledger of the former layout in the present one: roles inferred, flags by role and action, and only units of frames to translate."""
    role = inferred_role(F.col("kind"), F.col("translation_action"), F.col("retain_reason"), F.col("source_text"))
    made = F.col("translation_action") == "TRANSLATE"
    f = frames.withColumn("role", role).withColumn("translatable", made).withColumn("preserve_english", ~made).withColumn("replacement_status", F.when(made, "TRANSLATED").otherwise("INTENTIONAL_PRESERVE"))
    return f, ledger.join(f.where("translatable").select("frame_id").distinct(), "frame_id", "left_semi")
