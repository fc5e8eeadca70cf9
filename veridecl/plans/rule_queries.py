"""Queries of rules, decisions, reviews and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compliance as co
from ..operators import rules as ru
from ..sources import schemas
from ..sources.adapters import view, with_views
from .registry import inspected, query

#: The day on which the versions made of lines are looked at.
PAST = "1996-06-01"
_CASE = """list_contains(coalesce(product_categories, []), 'ALL') OR len(coalesce(product_categories, [])) = 0"""
_MATCH = "category = c OR starts_with(category, c || ' >') OR contains(category, ' > ' || c || ' > ')"
RULED = f"""
app AS (SELECT i.id, i.category, i.package_type, i.day, r.rule_version_id, r.rule_key, r.version, r.effective_date, r.product_categories, r.exclude_categories, r.package_type AS rpt, r.validation_type, r.field, r.pattern, r.must_contain,
  row_number() OVER (PARTITION BY i.id ORDER BY r.effective_date, r.version, r.rule_version_id) AS rule_order
  FROM i JOIN rules_v r ON r.effective_date <= i.day AND (r.end_date IS NULL OR r.end_date > i.day)
  AND ({_CASE} OR len(list_filter(r.product_categories, lambda c: {_MATCH} OR ends_with(category, ' > ' || c))) > 0)),
best AS (SELECT inspection_id, field_type, text, confidence, ord FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id, field_type ORDER BY coalesce(confidence, 0) DESC, ord) rn FROM declarations_v) WHERE rn = 1),
g AS (SELECT app.*, b.text, CASE WHEN NOT ({_CASE} OR len(list_filter(product_categories, lambda c: {_MATCH})) > 0) THEN 'category'
  WHEN coalesce(list_contains(exclude_categories, category), FALSE) THEN 'excluded'
  WHEN coalesce(rpt, '') <> '' AND package_type IS DISTINCT FROM rpt THEN 'package' END AS gate
  FROM app LEFT JOIN best b ON app.id = b.inspection_id AND app.field = b.field_type),
k AS (SELECT *, list_filter(coalesce(must_contain, []), lambda x: NOT contains(text, x))[1] AS lacking, coalesce(pattern, '') <> '' AND NOT regexp_matches(text, pattern) AS unmatched FROM g),
v AS (SELECT id AS inspection_id, rule_version_id, rule_key, rule_order, text,
 CASE WHEN gate IS NULL AND validation_type IN ('regex_and_presence', 'presence_only', 'format_check') THEN field END AS field_type,
 CASE WHEN gate IS NOT NULL THEN 'NOT_APPLICABLE' WHEN validation_type IS NULL THEN 'PASS'
  WHEN validation_type IN ('regex_and_presence', 'presence_only') AND text IS NULL THEN 'FAIL' WHEN validation_type = 'format_check' AND text IS NULL THEN 'NOT_APPLICABLE'
  WHEN validation_type IN ('regex_and_presence', 'format_check') AND unmatched THEN 'FAIL' WHEN validation_type = 'regex_and_presence' AND lacking IS NOT NULL THEN 'FAIL' ELSE 'PASS' END AS verdict,
 CASE WHEN gate IS NOT NULL THEN 'NOT_APPLICABLE' WHEN validation_type IS NULL THEN 'PRESENCE'
  WHEN validation_type IN ('regex_and_presence', 'presence_only') AND text IS NULL THEN 'MISSING' WHEN validation_type = 'format_check' AND text IS NULL THEN 'NOT_APPLICABLE'
  WHEN validation_type IN ('regex_and_presence', 'format_check') THEN 'FORMAT' ELSE 'PRESENCE' END AS verdict_type,
 CASE WHEN gate IS NOT NULL THEN 'Not applicable: ' || gate WHEN validation_type IS NULL THEN 'No validation configured'
  WHEN validation_type IN ('regex_and_presence', 'presence_only') AND text IS NULL THEN 'Declaration ''' || field || ''' not found'
  WHEN validation_type = 'format_check' AND text IS NULL THEN 'Declaration ''' || field || ''' not found, format check skipped'
  WHEN validation_type IN ('regex_and_presence', 'format_check') AND unmatched THEN 'Value ''' || text || ''' does not match ''' || pattern || ''''
  WHEN validation_type = 'regex_and_presence' AND lacking IS NOT NULL THEN 'Value ''' || text || ''' must contain ''' || lacking || ''''
  WHEN validation_type IN ('regex_and_presence', 'format_check') THEN 'Declaration ''' || field || ''' matches'
  WHEN validation_type = 'presence_only' THEN 'Declaration ''' || field || ''' is present' ELSE 'Unknown validation type ''' || validation_type || '''' END AS detail FROM k),
f AS (SELECT v.*, coalesce(nullif(field_type, ''), rule_key) AS fld, CASE WHEN verdict = 'PASS' THEN 1.0 WHEN verdict = 'FAIL' THEN CASE WHEN verdict_type = 'MISSING' THEN 0.0 ELSE 1.0 END END AS fc,
 CASE WHEN verdict_type = 'MISSING' THEN CASE WHEN field_type IN ('mrp','manufacturer_name','net_quantity','mfg_date','country_of_origin') THEN 'critical' ELSE 'major' END
  WHEN verdict_type = 'FORMAT' AND field_type IN ('mrp','mfg_date','pkd_date') THEN 'major' ELSE 'minor' END AS severity,
 sha256(v.inspection_id || '~' || v.rule_version_id) AS check_id FROM v),
ext AS (SELECT inspection_id, count(*) FILTER (WHERE length(text) > 0) AS n_extracted, coalesce(string_agg(DISTINCT CASE WHEN text IS NULL THEN field_type END, ',' ORDER BY CASE WHEN text IS NULL THEN field_type END), '') AS empty_fields FROM declarations_v GROUP BY 1),
cnt AS (SELECT inspection_id, count(*) FILTER (WHERE verdict='PASS') p, count(*) FILTER (WHERE verdict='FAIL') fl, count(*) FILTER (WHERE verdict='NOT_APPLICABLE') na FROM v GROUP BY 1),
d AS (SELECT i.id AS inspection_id, coalesce(e.n_extracted, 0) n_extracted, coalesce(p, 0) n_pass, coalesce(fl, 0) n_fail, coalesce(na, 0) n_na FROM inspections_v i LEFT JOIN ext e ON i.id = e.inspection_id LEFT JOIN cnt c ON i.id = c.inspection_id),
dec AS (SELECT *, CASE WHEN n_extracted < 3 THEN 'INSUFFICIENT_EVIDENCE' WHEN n_fail = 0 THEN 'COMPLIANT' WHEN n_pass = 0 THEN 'NON_COMPLIANT' ELSE 'PARTIALLY_COMPLIANT' END AS overall_status,
 CASE WHEN n_extracted < 3 THEN 'Only ' || n_extracted || ' fields extracted.' WHEN n_fail = 0 AND n_pass > 0 THEN 'All ' || n_pass || ' applicable rule(s) passed.' WHEN n_fail > 0 AND n_pass = 0 THEN 'All ' || n_fail || ' applicable rule(s) failed.'
  WHEN n_fail > 0 THEN n_pass || ' rule(s) passed, ' || n_fail || ' rule(s) failed.' ELSE 'No applicable rules found for this product category and date.' END AS status_reason,
 CASE WHEN n_extracted < 3 THEN 0 ELSE n_fail END AS n_violations FROM d)
"""
#: From inspections ``i``, rules_v and declarations_v to decisions.
CHAIN = (
    with_views("products_v", "inspections_v", "rules_v", "declarations_v")
    + """,
i AS (SELECT i.id, p.category, i.package_type, CAST(i.created_at AS DATE) AS day FROM inspections_v i LEFT JOIN products_v p ON i.product_id = p.id),"""
    + RULED
)
OPEN = "inspection_id NOT IN (SELECT inspection_id FROM dec WHERE overall_status = 'INSUFFICIENT_EVIDENCE')"


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def verdicts(spark, sf):
    return ru.evaluate_rules(inspected(spark, sf), view(spark, sf, "rules_v"), view(spark, sf, "declarations_v"))


def decisions(spark, sf, found=None):
    return co.evaluate_compliance(view(spark, sf, "inspections_v"), found or verdicts(spark, sf), view(spark, sf, "declarations_v"))


def outcomes(spark, sf):
    return co.outcomes(view(spark, sf, "inspections_v"), verdicts(spark, sf), view(spark, sf, "declarations_v"), view(spark, sf, "images_v"))


@query(CHAIN + "SELECT id, rule_version_id, rule_order FROM app")
def e1_applicable_rules(spark, sf):
    return ru.applicable_rules(inspected(spark, sf), view(spark, sf, "rules_v")).select("id", "rule_version_id", F.col("rule_order").cast("long").alias("rule_order"))


def _category_query(match, suffix):
    def run(spark, sf):
        rules = view(spark, sf, "rules_v").select("rule_version_id", "product_categories")
        products = view(spark, sf, "products_v").select("id", "category")
        return ru.matching_rules(products, rules, match).select("id", "rule_version_id")

    tail = " OR ends_with(category, ' > ' || c)" if suffix else ""
    return run, with_views("products_v", "rules_v") + f" SELECT p.id, r.rule_version_id FROM products_v p JOIN rules_v r ON ({_CASE} OR len(list_filter(r.product_categories, lambda c: {_MATCH}{tail})) > 0)"


for _name, _match, _suffix in (("e2_category_selected", ru.category_selected, True), ("e3_category_applies", ru.category_applies, False)):
    _run, _text = _category_query(_match, _suffix)
    _run.__name__ = _name
    query(_text)(_run)


@query(CHAIN + "SELECT id, rule_version_id, coalesce(gate, 'none') AS gate FROM g")
def e4_applies_when_gate(spark, sf):
    rows = ru.applicable_rules(inspected(spark, sf), view(spark, sf, "rules_v"))
    return rows.select("id", "rule_version_id", F.coalesce(ru.applies_when_gate(F.col("category"), F.col("package_type")), F.lit("none")).alias("gate"))


@query(CHAIN + "SELECT inspection_id, field_type, text, confidence, ord FROM best")
def e5_best_declaration(spark, sf):
    return ru.best_declaration(view(spark, sf, "declarations_v"))


@query(CHAIN + "SELECT rule_version_id, coalesce(field, '') AS target, count(*) AS n FROM app GROUP BY ALL")
def e6_target_field(spark, sf):
    rows = ru.applicable_rules(inspected(spark, sf), view(spark, sf, "rules_v"))
    content = F.struct(F.struct(F.col("field").alias("field")).alias("validation"), F.lit(None).cast("string").alias("required_field"))
    return rows.groupBy("rule_version_id", ru.target_field(content).alias("target")).agg(F.count("*").alias("n"))


def _of_type(name, keys, where):
    def run(spark, sf):
        rules = view(spark, sf, "rules_v").filter(F.coalesce("validation_type", F.lit("none")).isin(*keys))
        found = ru.evaluate_rules(inspected(spark, sf), rules, view(spark, sf, "declarations_v"))
        return found.select("inspection_id", "rule_version_id", "verdict", "verdict_type", "detail")

    run.__name__ = name
    query(CHAIN + f"SELECT v.inspection_id, v.rule_version_id, v.verdict, v.verdict_type, v.detail FROM v JOIN rules_v r USING (rule_version_id) WHERE {where}")(run)


_of_type("e7_regex_and_presence", ["regex_and_presence"], "r.validation_type = 'regex_and_presence'")
_of_type("e8_presence_only", ["presence_only"], "r.validation_type = 'presence_only'")
_of_type("e9_format_check", ["format_check"], "r.validation_type = 'format_check'")
_of_type("e10_default", ["numeric_range", "none"], "coalesce(r.validation_type, 'numeric_range') = 'numeric_range'")


@query(CHAIN + "SELECT inspection_id, rule_version_id, rule_order, field_type, verdict, verdict_type, detail FROM v")
def e11_evaluate_rules(spark, sf):
    return verdicts(spark, sf).select("inspection_id", "rule_version_id", F.col("rule_order").cast("long").alias("rule_order"), "field_type", "verdict", "verdict_type", "detail")


@query(CHAIN + "SELECT DISTINCT a.id AS inspection_id, a.field AS field_type FROM app a WHERE a.validation_type IN ('regex_and_presence','presence_only') AND NOT EXISTS (SELECT 1 FROM declarations_v d WHERE d.inspection_id = a.id AND d.field_type = a.field AND d.text IS NOT NULL)")
def e12_missing_declarations(spark, sf):
    return ru.missing_declarations(inspected(spark, sf), view(spark, sf, "rules_v"), view(spark, sf, "declarations_v"))


def _as_versions(spark, sf):
    """Each part as a rule whose versions are its lines by ship date: for the interval operators at size."""
    l = spark.read.parquet(f"{sf}/lineitem.parquet")
    start = F.to_date("l_shipdate")
    return l.select(F.col("l_partkey").cast("string").alias("rule_key"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").alias("rule_version_id"), F.col("l_linenumber").cast("int").alias("version"), start.alias("effective_date"), F.when(F.col("l_linestatus") == "F", F.date_add(start, 30)).alias("end_date"), (F.col("l_returnflag") != "R").alias("is_published")).dropDuplicates(["rule_version_id"])


_VERSIONS = "WITH w AS (SELECT DISTINCT ON (rule_version_id) * FROM (SELECT CAST(l_partkey AS VARCHAR) rule_key, concat_ws('-', l_orderkey, l_linenumber, l_suppkey, l_partkey) rule_version_id, l_linenumber AS version, CAST(l_shipdate AS DATE) effective_date, CASE WHEN l_linestatus='F' THEN CAST(l_shipdate AS DATE) + 30 END end_date, l_returnflag <> 'R' is_published, l_partkey FROM lineitem)) "


_CURRENT = f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rule_key ORDER BY effective_date DESC, version DESC, rule_version_id) rn FROM w WHERE is_published AND (end_date IS NULL OR end_date >= DATE '{PAST}')) WHERE rn = 1)"


@query(
    _VERSIONS
    + """SELECT rule_version_id, rule_key, version, strftime(effective_date, '%Y-%m-%d') effective_date, is_published, CASE l_partkey % 3 WHEN 0 THEN 'mrp' WHEN 1 THEN 'needed' END AS field,
 CASE l_partkey % 3 WHEN 0 THEN 'format_check' WHEN 1 THEN 'presence_only' END AS validation_type, CASE WHEN l_partkey % 3 = 0 THEN '^v' || rule_key END AS pattern FROM w"""
)
def a2_load_rules(spark, sf):
    """Rules whose versions are lines, written as JSON content and parsed: with all of a validation, without its type, and without one."""
    rows = _as_versions(spark, sf)
    n = F.col("rule_key").cast("long") % 3
    whole = F.to_json(F.struct(F.struct(F.lit("format_check").alias("type"), F.lit("mrp").alias("field"), F.concat(F.lit("^v"), "rule_key").alias("pattern")).alias("validation")))
    typeless = F.lit('{"required_field": "needed", "validation": {"field": ""}}')
    content = F.when(n == 0, whole).when(n == 1, typeless).otherwise(F.lit("{}"))
    rules = rows.select("rule_key").distinct().select(F.sha2("rule_key", 256).alias("id"), "rule_key", F.col("rule_key").alias("title"))
    versions = rows.select(F.col("rule_version_id").alias("id"), F.sha2("rule_key", 256).alias("rule_id"), "version", content.alias("content"), "effective_date", "end_date", F.when(F.col("is_published"), F.lit("2020-01-01").cast("timestamp")).alias("published_at"))
    out = ru.load_rules(rules, versions)
    return out.select("rule_version_id", "rule_key", "version", _day("effective_date"), "is_published", F.nullif(F.col("field"), F.lit("")).alias("field"), "validation_type", "pattern")


@query(_VERSIONS + f"SELECT rule_key, rule_version_id, version, strftime(effective_date, '%Y-%m-%d') effective_date FROM {_CURRENT}")
def e13_current_version(spark, sf):
    return ru.current_version(_as_versions(spark, sf), PAST).select("rule_key", "rule_version_id", "version", _day("effective_date"))


@query(_VERSIONS + f"SELECT rule_key, rule_version_id FROM {_CURRENT} WHERE rule_key ILIKE '%1%' AND effective_date >= DATE '1995-01-01' ORDER BY rule_key LIMIT 20 OFFSET 20")
def e14_list_rules(spark, sf):
    return ru.list_rules(_as_versions(spark, sf), PAST, like="1", after="1995-01-01", page=2, page_size=20).select("rule_key", "rule_version_id")


@query(_VERSIONS + "SELECT rule_key, string_agg(CAST(version AS VARCHAR), ',' ORDER BY version) versions, count(*) FILTER (WHERE is_published) n_published, min(version) FILTER (WHERE is_published) current_version FROM w GROUP BY 1")
def e15_rule_detail(spark, sf):
    return ru.rule_detail(_as_versions(spark, sf))


@query(_VERSIONS + ", x AS (SELECT rule_key, rule_version_id, effective_date, coalesce(end_date, DATE '9999-12-31') AS last FROM w WHERE is_published) SELECT a.rule_key, count(*) AS n FROM x a JOIN x b ON a.rule_key = b.rule_key AND a.rule_version_id < b.rule_version_id AND a.effective_date <= b.last AND a.last >= b.effective_date GROUP BY 1")
def e16_overlapping_versions(spark, sf):
    return ru.overlapping_versions(_as_versions(spark, sf)).groupBy("rule_key").agg(F.count("*").alias("n"))


@query(_VERSIONS + "SELECT rule_key, max(version) + 1 AS next_version FROM w GROUP BY 1")
def e17_next_version(spark, sf):
    return ru.next_version(_as_versions(spark, sf))


@query(with_views("products_v") + "SELECT id, CASE WHEN p_size_flag THEN 'already_published' WHEN blank THEN 'no_legal_reference' WHEN n > 1 THEN 'duplicate_key' ELSE 'none' END AS issue FROM (SELECT id, CAST(id AS BIGINT) % 3 = 0 AS p_size_flag, CAST(id AS BIGINT) % 5 = 0 AS blank, count(*) OVER (PARTITION BY product_name) n FROM products_v)")
def e18_publish_issues(spark, sf):
    n = F.col("id").cast("long")
    versions = view(spark, sf, "products_v").select("id", F.col("product_name").alias("rule_key"), (n % 3 == 0).alias("is_published"), F.when(n % 5 == 0, " ").otherwise("Act").alias("legal_reference"))
    return ru.publish_issues(versions).select("id", F.coalesce("issue", F.lit("none")).alias("issue"))


@query(CHAIN + "SELECT inspection_id, n_extracted, empty_fields FROM ext")
def f1_count_extracted(spark, sf):
    return co.count_extracted(view(spark, sf, "declarations_v"))


@query(CHAIN + "SELECT i.id AS inspection_id, coalesce(n_extracted, 0) n_extracted, coalesce(empty_fields, '') empty_fields FROM inspections_v i LEFT JOIN ext e ON i.id = e.inspection_id WHERE coalesce(n_extracted, 0) < 3")
def f2_insufficient_evidence(spark, sf):
    return co.insufficient_evidence(view(spark, sf, "inspections_v"), view(spark, sf, "declarations_v"))


@query(CHAIN + ", c AS (SELECT f.*, b.confidence FROM f LEFT JOIN best b ON f.inspection_id = b.inspection_id AND f.field_type = b.field_type) SELECT inspection_id, string_agg(fld, ', ' ORDER BY rule_order, fld) AS fields, count(*) AS n FROM c WHERE verdict <> 'PASS' AND verdict_type <> 'MISSING' AND coalesce(confidence, 1.0) < 0.5 GROUP BY 1")
def f3_low_confidence_fields(spark, sf):
    """Verdicts with the confidence of the declaration that they rest on."""
    best = ru.best_declaration(view(spark, sf, "declarations_v")).select("inspection_id", "field_type", F.col("confidence").alias("c"))
    rows = verdicts(spark, sf).join(best, ["inspection_id", "field_type"], "left").withColumn("confidence", F.col("c"))
    return co.low_confidence_fields(rows).withColumn("n", F.col("n").cast("long"))


@query(CHAIN + "SELECT inspection_id, rule_version_id, fld AS field_type, verdict AS status, CAST(fc AS DOUBLE) AS field_confidence FROM f")
def f4_field_compliance(spark, sf):
    return co.field_compliance(verdicts(spark, sf)).select("inspection_id", "rule_version_id", "field_type", "status", "field_confidence")


@query(CHAIN + "SELECT severity, verdict_type, count(*) AS n FROM f WHERE verdict = 'FAIL' GROUP BY ALL")
def f5_severity(spark, sf):
    rows = verdicts(spark, sf).filter("verdict = 'FAIL'")
    return rows.groupBy(co.severity(F.col("field_type"), F.col("verdict_type")).alias("severity"), "verdict_type").agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT inspection_id, rule_version_id, fld AS field, severity, detail AS issue_description, text AS detected_value FROM f WHERE verdict = 'FAIL'")
def f6_violations(spark, sf):
    return co.violations(verdicts(spark, sf)).drop("rule_key")


@query(CHAIN + "SELECT n_pass, n_fail, CASE WHEN n_fail = 0 THEN 'COMPLIANT' WHEN n_pass = 0 THEN 'NON_COMPLIANT' ELSE 'PARTIALLY_COMPLIANT' END AS status, count(*) AS n FROM d GROUP BY ALL")
def f7_decide(spark, sf):
    rows = decisions(spark, sf)
    return rows.groupBy("n_pass", "n_fail", co.decide(F.col("n_pass"), F.col("n_fail"))[0].alias("status")).agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT inspection_id, overall_status, status_reason, n_extracted, n_pass, n_fail, n_na, n_violations FROM dec")
def f8_evaluate_compliance(spark, sf):
    return decisions(spark, sf)


@query(CHAIN + f"SELECT check_id AS id, inspection_id, rule_version_id, fld AS field_type, lower(verdict) AS verdict, CAST(fc AS DOUBLE) AS confidence FROM f WHERE {OPEN}")
def f9_compliance_checks(spark, sf):
    return outcomes(spark, sf).select("inspection_id", F.inline("checks"))


@query(CHAIN + f"SELECT inspection_id, rule_version_id, fld AS field, severity, check_id AS compliance_check_id FROM f WHERE verdict = 'FAIL' AND {OPEN}")
def f10_violation_rows(spark, sf):
    return outcomes(spark, sf).select("inspection_id", F.inline("violations")).select("inspection_id", "rule_version_id", "field", "severity", "compliance_check_id")


@query(with_views("inspections_v") + "SELECT id, CASE overall_status WHEN 'COMPLIANT' THEN 'approved' WHEN 'NON_COMPLIANT' THEN 'flagged' WHEN 'PARTIALLY_COMPLIANT' THEN 'flagged' WHEN 'NEEDS_HUMAN_REVIEW' THEN 'pending_review' WHEN 'INSUFFICIENT_EVIDENCE' THEN 'insufficient' ELSE 'pending' END AS status FROM inspections_v")
def f11_inspection_status(spark, sf):
    return view(spark, sf, "inspections_v").select("id", co.inspection_status(F.col("overall_status")).alias("status"))


_LATEST = "(SELECT inspection_id, CAST(arg_max(id, uploaded_at) AS BIGINT) image_id FROM images_v GROUP BY 1)"
IMAGES = CHAIN + ", images_v AS (SELECT doc_id id, CAST(doc_id AS VARCHAR) inspection_id, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CAST(doc_id AS BIGINT)) uploaded_at FROM documents) "


@query(IMAGES + f"SELECT f.inspection_id, f.rule_version_id, image_id, count(*) OVER (PARTITION BY f.inspection_id) AS n_evidence FROM f JOIN {_LATEST} USING (inspection_id) WHERE verdict = 'FAIL' AND {OPEN}")
def f12_evidence(spark, sf):
    """Evidence rows, each with how many its inspection has."""
    return outcomes(spark, sf).select("inspection_id", F.size("evidence").cast("long").alias("n_evidence"), F.inline("evidence")).drop("id")


@query("SELECT doc_id AS id, doc_id % 100 / 100.0 < 0.7 AS low, CASE WHEN doc_id % 100 / 100.0 < 0.7 THEN printf('Low image quality: %.2f', CAST(doc_id % 100 / 100.0 AS DOUBLE)) END AS warning FROM documents")
def f13_pipeline_warnings(spark, sf):
    images = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 100 / F.lit(100.0)).alias("quality_score"))
    return co.pipeline_warnings(images).select("id", (~F.col("pipeline_passed")).alias("low"), "warning")


REPORTS = IMAGES + f""", fd AS (SELECT inspection_id, count(*) nf, string_agg(fld || ':' || CASE WHEN verdict = 'PASS' AND coalesce(fc, 0) < 0.5 THEN 'LOW_CONF' ELSE verdict END, ',' ORDER BY rule_version_id) AS declarations FROM f WHERE {OPEN} GROUP BY 1),
vd AS (SELECT inspection_id, string_agg(n || ':' || upper(severity) || ':' || fld || ':' || detail || ':Section ' || rule_key, ';' ORDER BY rule_version_id) AS violations, count(*) nv,
 string_agg(DISTINCT 'Section ' || rule_key, ',' ORDER BY 'Section ' || rule_key) AS legal_references
 FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id ORDER BY rule_version_id) n FROM f WHERE verdict = 'FAIL' AND {OPEN}) GROUP BY 1),
reports AS (SELECT sha256('report~' || dec.inspection_id) AS report_id, dec.inspection_id, overall_status AS compliance_status, status_reason, overall_status = 'COMPLIANT' AS seal, coalesce(declarations, '') AS declarations, coalesce(violations, '') AS violations, coalesce(legal_references, '') AS legal_references,
 CASE WHEN l.image_id IS NULL OR nv IS NULL THEN '' ELSE array_to_string(list_transform(range(nv), lambda k: CAST(l.image_id AS VARCHAR)), ',') END AS evidence FROM dec LEFT JOIN fd USING (inspection_id) LEFT JOIN vd USING (inspection_id) LEFT JOIN {_LATEST} l USING (inspection_id))
"""


def reports(spark, sf):
    from ..operators.reports import report_facts

    rules = view(spark, sf, "rules_v")
    references = rules.select("rule_version_id", F.col("rule_key").alias("title"), F.concat(F.lit("Section "), "rule_key").alias("legal_reference"))
    return report_facts(view(spark, sf, "inspections_v"), verdicts(spark, sf), view(spark, sf, "declarations_v"), view(spark, sf, "images_v"), references)


def spelled(facts):
    """Reports with their nested columns as text."""
    spell = lambda a, f, sep=",": F.array_join(F.transform(a, f), sep).alias(a)
    parts = ("number", "severity", "field_type", "detail", "legal_reference")
    return facts.select(
        "report_id", "inspection_id", "compliance_status", "status_reason", "seal", spell("declarations", lambda x: F.concat_ws(":", x["field_type"], x["status"])), spell("violations", lambda x: F.concat_ws(":", *(x[c] for c in parts)), ";"),
        F.array_join("legal_references", ",").alias("legal_references"), spell("evidence", lambda x: x["image_id"].cast("string")),
    )


@query(REPORTS + "SELECT * FROM reports")
def l5_report_facts(spark, sf):
    return spelled(reports(spark, sf))


@query(CHAIN + "SELECT sha256('report~' || i.id) AS report_id, i.id AS inspection_id, count(d.ord) AS n_notes, coalesce(string_agg(d.field_type || ':' || coalesce(d.text, '') || ':' || printf('%.2f', d.confidence), ',' ORDER BY d.ord, d.field_type), '') AS notes FROM i LEFT JOIN declarations_v d ON d.inspection_id = i.id AND coalesce(d.confidence, 1.0) < 0.5 GROUP BY i.id")
def l5_confidence_notes(spark, sf):
    """Of each report the declarations that were read with little confidence."""
    said = F.transform("notes", lambda x: F.concat_ws(":", x["field_type"], F.coalesce(x["text"], F.lit("")), F.format_string("%.2f", x["confidence"])))
    return reports(spark, sf).select("report_id", "inspection_id", F.size("notes").cast("long").alias("n_notes"), F.array_join(said, ",").alias("notes"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' THEN 'done' WHEN o_orderstatus = 'O' THEN 'cancelled' ELSE 'scheduled' END AS new_status FROM orders")
def l6_due_reports(spark, sf):
    from ..operators.reports import due_reports

    orders = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "cancelled").otherwise("scheduled").alias("status"), F.col("o_orderdate").cast("timestamp").alias("scheduled_time"))
    return due_reports(orders, "1998-01-01 00:00:00").select("id", "new_status")


@query(with_views("inspections_v") + "SELECT overall_status, region, count(*) AS n FROM inspections_v GROUP BY ALL")
def a1_load(spark, sf):
    """Inspections written as the typed entity and scanned again."""
    import uuid

    from .stream_queries import folder

    rows = view(spark, sf, "inspections_v")
    columns = [c.strip().split(" ") for c in schemas.SCHEMAS["inspections"].split(",")]
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in columns]).write.parquet(f"{path}/inspections.parquet")
    return schemas.load(spark, path, "inspections").groupBy("overall_status", "region").agg(F.count("*").alias("n"))


@query(CHAIN + "SELECT r.k AS rule_key, count(*) AS n FROM i JOIN (SELECT unnest(['MRP','NET_QUANTITY','MANUFACTURER','MFG_DATE','CONSUMER_CARE']) AS k) r ON TRUE WHERE day >= DATE '2020-01-01' GROUP BY 1")
def a3_seed_rules(spark, sf):
    return ru.applicable_rules(inspected(spark, sf), ru.seed_rules(spark)).groupBy("rule_key").agg(F.count("*").alias("n"))
