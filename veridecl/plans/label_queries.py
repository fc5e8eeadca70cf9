"""Queries of text normalisation, extraction and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import classify as cl
from ..operators import extract as ex
from ..sources.adapters import view, with_views
from .registry import query

TOKENS = with_views("ocr_tokens_v")
_WORDS = "|".join(sorted(t.UNITS, key=lambda w: (-len(w), w)))
_UNIT_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in t.UNITS.items()) + "}"
_FIX = lambda c: f"CASE WHEN regexp_matches({c}, '[0-9]') THEN translate({c}, 'OolISBZ', '0011582') ELSE {c} END"


def _currency(c: str) -> tuple[str, str]:
    money, rest = "CASE", "CASE"
    for m in t.CURRENCY_MARKS:
        money += f" WHEN starts_with({c}, '{m}') OR ends_with({c}, '{m}') THEN 'INR'"
        rest += f" WHEN starts_with({c}, '{m}') THEN regexp_replace(trim(substr({c}, {len(m) + 1})), '^[./:]+', '') WHEN ends_with({c}, '{m}') THEN trim(substr({c}, 1, length({c}) - {len(m)}))"
    return money + f" WHEN contains({c}, '₹') THEN 'INR' END", rest + f" WHEN contains({c}, '₹') THEN trim(replace({c}, '₹', '')) ELSE {c} END"


def _month(c: str) -> str:
    out = "coalesce("
    for p, m, y in ((r"(\d{1,2})[/\-.](\d{4})", 1, 2), (r"(\d{4})[/\-](\d{1,2})", 2, 1), (r"(\d{1,2})/(\d{1,2})/(\d{4})", 2, 3)):
        mm, yy = (f"TRY_CAST(regexp_extract({c}, '{p}', {g}) AS INT)" for g in (m, y))
        out += f"CASE WHEN {mm} BETWEEN 1 AND 12 AND {yy} BETWEEN 2020 AND 2030 THEN printf('%04d-%02d', {yy}, {mm}) END, "
    return out + "NULL)"


_MONEY, _REST = _currency("normalized")
NORM = (
    TOKENS
    + f""", n0 AS (SELECT inspection_id, seq, trim(text) AS original, {_FIX("trim(text)")} AS normalized, confidence FROM ocr_tokens_v WHERE trim(text) <> ''),
n1 AS (SELECT *, {_MONEY} AS currency, {_REST} AS rest FROM n0),
n2 AS (SELECT *, lower(trim(rest)) AS low, regexp_extract(lower(trim(rest)), '^(.*?)({_WORDS})$', 2) AS word FROM n1),
n3 AS (SELECT *, CASE WHEN word <> '' THEN {_UNIT_MAP}[word] END AS unit, CASE WHEN word <> '' THEN trim(regexp_extract(low, '^(.*?)({_WORDS})$', 1)) ELSE rest END AS vt FROM n2),
n4 AS (SELECT *, coalesce({_month("vt")}, {_month("normalized")}) AS month FROM n3),
tok AS (SELECT inspection_id, seq, original, normalized, currency, unit, month, month IS NOT NULL AS is_date, currency IS NOT NULL AS is_currency, regexp_matches(replace(vt, ' ', ''), '^[0-9,.]+$') AS is_numeric,
 CASE WHEN month IS NULL AND regexp_matches(replace(vt, ' ', ''), '^[0-9,.]+$') THEN TRY_CAST(replace(replace(vt, ' ', ''), ',', '') AS DOUBLE) END AS value, confidence FROM n4),
am AS (SELECT *, CASE WHEN NOT is_date THEN coalesce(value, TRY_CAST(replace(regexp_extract(normalized, '[0-9,.]+'), ',', '') AS DOUBLE)) END AS amount FROM tok),
sp AS (SELECT *, CASE WHEN amount = floor(amount) THEN CAST(CAST(amount AS BIGINT) AS VARCHAR) ELSE CAST(amount AS VARCHAR) END AS spelled FROM am),
cand AS (SELECT inspection_id, 'mrp' AS field_type, '₹' || spelled AS value, original AS raw_value, confidence, seq FROM sp WHERE amount IS NOT NULL AND is_currency
 UNION ALL SELECT inspection_id, 'net_quantity', spelled || ' ' || unit, original, confidence, seq FROM sp WHERE amount IS NOT NULL AND unit IS NOT NULL),
bestc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY inspection_id, field_type ORDER BY confidence DESC, seq) rn FROM cand) WHERE rn = 1),
lab AS (SELECT inspection_id, string_agg(original, ' ' ORDER BY seq) AS all_text FROM tok GROUP BY 1),
words AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in ex.DATE_WORDS.items())}) w(word, field_type)),
dfound AS (SELECT l.inspection_id, w.field_type, k.month AS value, k.confidence, w.word, k.seq FROM lab l JOIN words w ON contains(lower(l.all_text), w.word) JOIN tok k ON k.inspection_id = l.inspection_id AND k.is_date),
dall AS (SELECT * FROM dfound UNION ALL SELECT l.inspection_id, x.f, 'NOT_FOUND', 0.0, '', -1 FROM lab l CROSS JOIN (SELECT unnest(['mfg_date', 'packing_date']) AS f) x WHERE NOT EXISTS (SELECT 1 FROM dfound d WHERE d.inspection_id = l.inspection_id AND d.field_type = x.f)),
m0 AS (SELECT inspection_id, all_text, trim(regexp_extract(all_text, '(?i){ex.MAKER_PATTERNS[0]}', 1)) a, trim(regexp_extract(all_text, '(?i){ex.MAKER_PATTERNS[1]}', 1)) b FROM lab),
maker AS (SELECT inspection_id, CASE WHEN length(a) > 3 THEN a WHEN length(b) > 3 THEN b END AS v FROM m0),
care AS (SELECT inspection_id, CASE WHEN {" OR ".join(f"contains(lower(all_text), '{w}')" for w in ex.CARE_WORDS)} THEN trim(all_text) END AS v FROM lab),
orig AS (SELECT inspection_id, CASE WHEN {" OR ".join(f"contains(lower(all_text), '{w}')" for w in ex.ORIGIN_WORDS)} THEN nullif(regexp_extract(trim(regexp_extract(all_text, '(?i){ex.ORIGIN_PATTERN}', 1)), '^\\S+'), '') END AS v FROM lab),
pname AS (SELECT inspection_id, CASE WHEN length(trim(all_text)) > 3 THEN trim(all_text) END AS v FROM lab),
fld AS (SELECT l.inspection_id, x.f AS field_type, coalesce(b.value, 'NOT_FOUND') AS value, coalesce(b.confidence, 0.0) AS confidence FROM lab l CROSS JOIN (SELECT unnest(['mrp', 'net_quantity']) f) x LEFT JOIN bestc b ON b.inspection_id = l.inspection_id AND b.field_type = x.f
 UNION ALL SELECT inspection_id, field_type, value, confidence FROM dall
 UNION ALL SELECT inspection_id, 'manufacturer', coalesce(v, 'NOT_FOUND'), CASE WHEN v IS NULL THEN 0.0 ELSE 0.8 END FROM maker
 UNION ALL SELECT inspection_id, 'consumer_care', coalesce(v, 'NOT_FOUND'), CASE WHEN v IS NULL THEN 0.0 ELSE 0.7 END FROM care
 UNION ALL SELECT inspection_id, 'country_of_origin', coalesce(v, 'NOT_FOUND'), CASE WHEN v IS NULL THEN 0.0 ELSE 0.7 END FROM orig
 UNION ALL SELECT inspection_id, 'product_name', coalesce(v, 'NOT_FOUND'), CASE WHEN v IS NULL THEN 0.0 ELSE 0.6 END FROM pname),
full_ AS (SELECT * FROM fld UNION ALL SELECT l.inspection_id, x.f, 'NOT_FOUND', 0.0 FROM lab l CROSS JOIN (SELECT unnest([{", ".join(f"'{f}'" for f in ex.FIELD_TYPES)}]) f) x WHERE NOT EXISTS (SELECT 1 FROM fld d WHERE d.inspection_id = l.inspection_id AND d.field_type = x.f))
"""
)
_C = "round(CAST(confidence AS DOUBLE), 6) AS confidence"


def _c():
    return F.round("confidence", 6).alias("confidence")


def tokens(spark, sf):
    return ex.normalize_tokens(view(spark, sf, "ocr_tokens_v"))


def _raw(spark, sf):
    return view(spark, sf, "ocr_tokens_v")


@query(TOKENS + f"SELECT inspection_id, seq, {_FIX('text')} AS fixed FROM ocr_tokens_v")
def b1_fix_ocr(spark, sf):
    return _raw(spark, sf).select("inspection_id", "seq", t.fix_ocr(F.col("text")).alias("fixed"))


@query(TOKENS + f", w AS (SELECT *, regexp_extract(lower(trim(text)), '^(.*?)({_WORDS})$', 2) AS word FROM ocr_tokens_v) SELECT inspection_id, seq, CASE WHEN word <> '' THEN {_UNIT_MAP}[word] END AS unit, CASE WHEN word <> '' THEN trim(regexp_extract(lower(trim(text)), '^(.*?)({_WORDS})$', 1)) ELSE text END AS rest FROM w")
def b2_normalize_unit(spark, sf):
    return _raw(spark, sf).withColumn("u", t.normalize_unit(F.col("text"))).select("inspection_id", "seq", "u.unit", "u.rest")


@query(TOKENS + ", w AS (SELECT inspection_id, seq, text, trim(text) AS normalized FROM ocr_tokens_v) SELECT inspection_id, seq, " + _MONEY + " AS currency, " + _REST.replace("ELSE normalized END", "ELSE text END") + " AS rest FROM w")
def b3_normalize_currency(spark, sf):
    return _raw(spark, sf).withColumn("c", t.normalize_currency(F.col("text"))).select("inspection_id", "seq", "c.currency", "c.rest")


@query(TOKENS + f"SELECT inspection_id, seq, {_month('text')} AS month FROM ocr_tokens_v")
def b4_parse_month(spark, sf):
    return _raw(spark, sf).withColumn("d", t.parse_month(F.col("text"))).select("inspection_id", "seq", F.when(F.col("d").isNotNull(), F.format_string("%04d-%02d", "d.y", "d.m")).alias("month"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, s, CASE WHEN regexp_matches(replace(s, ' ', ''), '^[0-9,.]+$') THEN TRY_CAST(replace(replace(s, ' ', ''), ',', '') AS DOUBLE) END AS number FROM (SELECT *, CASE l_partkey % 4 WHEN 0 THEN '1,2' || l_suppkey WHEN 1 THEN l_suppkey || '.5' WHEN 2 THEN '1.2.' || l_suppkey ELSE 'x' || l_suppkey END AS s FROM lineitem)")
def b5_parse_number(spark, sf):
    k, s = F.col("l_partkey") % 4, F.col("l_suppkey").cast("string")
    text = F.when(k == 0, F.concat(F.lit("1,2"), s)).when(k == 1, F.concat(s, F.lit(".5"))).when(k == 2, F.concat(F.lit("1.2."), s)).otherwise(F.concat(F.lit("x"), s))
    return spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", text.alias("s"), t.parse_number(text).alias("number"))


@query(NORM + f"SELECT inspection_id, seq, original, normalized, currency, unit, month, is_date, is_currency, is_numeric, value, {_C} FROM tok")
def b6_normalize_tokens(spark, sf):
    return tokens(spark, sf).withColumn("confidence", _c())


@query(TOKENS + ", w AS (SELECT *, length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) h, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) a FROM ocr_tokens_v) SELECT inspection_id, seq, CASE WHEN h + a > 0 AND h / (h + a) > 0.3 THEN 'hi' WHEN a > 0 THEN 'en' ELSE 'unknown' END AS language FROM w")
def b7_detect_language(spark, sf):
    return _raw(spark, sf).select("inspection_id", "seq", t.detect_language(F.col("text")).alias("language"))


@query("SELECT doc_id, sha256(trim(substr(text, 1, 500), E' \\n\\t\\r')) AS line, n_chars % 100 / 100.0 < 0.5 AS is_low_confidence FROM documents")
def b8_clean_ocr_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", (F.col("n_chars") % 100 / F.lit(100.0)).alias("confidence"))
    return ex.clean_ocr_lines(docs).select("doc_id", F.sha2("text", 256).alias("line"), "is_low_confidence")


@query(TOKENS + ", w AS (SELECT *, length(regexp_replace(text, '[^\\x{0900}-\\x{097F}]', '', 'g')) h, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) a FROM ocr_tokens_v), x AS (SELECT *, CASE WHEN h + a > 0 AND h / (h + a) > 0.3 THEN 'hi' WHEN a > 0 THEN 'en' END AS language FROM w) SELECT inspection_id, count(*) FILTER (WHERE confidence >= 0.5) n_high, count(*) FILTER (WHERE confidence < 0.5) n_low, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(text, E'\\n' ORDER BY seq) FILTER (WHERE text <> '') AS full_text FROM x GROUP BY 1")
def b9_ocr_summary(spark, sf):
    return ex.ocr_summary(_raw(spark, sf))


@query(with_views("images_v") + "SELECT id, 'minio://labels/' || substr(content_hash, 1, 32) || '.jpg' AS url, 'labels' AS bucket, substr(content_hash, 1, 32) || '.jpg' AS key FROM images_v")
def b10_storage_url(spark, sf):
    rows = view(spark, sf, "images_v").select("id", t.storage_url("labels", F.col("content_hash")).alias("url")).withColumn("p", t.parse_storage_url(F.col("url")))
    return rows.select("id", "url", "p.bucket", "p.key")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def b11_content_hash(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", t.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT event_id, length(trim(substr('  ok then  ', 1, CAST(event_id % 11 AS INT)))) >= 5 AS valid FROM events")
def b12_valid_reason(spark, sf):
    reason = F.substring(F.lit("  ok then  "), F.lit(1), (F.col("event_id") % 11).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", t.valid_reason(reason).alias("valid"))


@query(NORM + "SELECT inspection_id, all_text FROM lab")
def c1_label_text(spark, sf):
    return ex.label_text(tokens(spark, sf))


def _field(name, field, cte_field=None):
    def run(spark, sf):
        made = ex.extract_field if field in ("mrp", "net_quantity") else ex.extract_text_field
        return made(tokens(spark, sf), field).withColumn("confidence", _c())

    run.__name__ = name
    query(NORM + f"SELECT inspection_id, field_type, value, {_C} FROM fld WHERE field_type = '{field}'")(run)


_field("c2_mrp", "mrp")
_field("c3_net_quantity", "net_quantity")
_field("c5_manufacturer", "manufacturer")
_field("c6_consumer_care", "consumer_care")
_field("c7_country_of_origin", "country_of_origin")
_field("c8_product_name", "product_name")


@query(NORM + f"SELECT inspection_id, field_type, value, {_C}, word, seq FROM dall")
def c4_dates(spark, sf):
    return ex.extract_dates(tokens(spark, sf)).withColumn("confidence", _c())


@query(NORM + ", p AS (SELECT inspection_id, field_type, value, confidence FROM bestc) SELECT inspection_id, field_type, value, " + _C + " FROM p UNION ALL SELECT l.inspection_id, x.f, 'NOT_FOUND', 0.0 FROM (SELECT DISTINCT inspection_id FROM p) l CROSS JOIN (SELECT unnest([" + ", ".join(f"'{f}'" for f in ex.FIELD_TYPES) + "]) f) x WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.inspection_id = l.inspection_id AND p.field_type = x.f)")
def c9_complete_fields(spark, sf):
    return ex.complete_fields(ex.best_candidates(ex.declaration_candidates(tokens(spark, sf)))).withColumn("confidence", _c())


@query(NORM + f"SELECT inspection_id, field_type, value, {_C} FROM full_")
def c10_extract_declarations(spark, sf):
    return ex.extract_declarations(tokens(spark, sf)).select("inspection_id", "field_type", "value", _c())


@query(NORM + "SELECT inspection_id, count(*) FILTER (WHERE value <> 'NOT_FOUND') n_found, coalesce(string_agg(DISTINCT CASE WHEN value <> 'NOT_FOUND' THEN field_type END, ',' ORDER BY CASE WHEN value <> 'NOT_FOUND' THEN field_type END), '') found_fields, coalesce(string_agg(DISTINCT CASE WHEN value = 'NOT_FOUND' THEN field_type END, ',' ORDER BY CASE WHEN value = 'NOT_FOUND' THEN field_type END), '') missing_fields FROM full_ GROUP BY 1")
def c11_field_status(spark, sf):
    return ex.field_status(ex.extract_declarations(tokens(spark, sf)))


@query(NORM + f"SELECT inspection_id, field_type, value, raw_value, {_C}, seq FROM cand")
def c12_declaration_candidates(spark, sf):
    return ex.declaration_candidates(tokens(spark, sf)).withColumn("confidence", _c())


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r' || r_regionkey, r_name FROM region")
def a4_category_paths(spark, sf):
    """The two-level tree of regions and nations as paths."""
    n, r = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("nation", "region"))
    root = lambda c: F.concat(F.lit("r"), F.col(c).cast("string"))
    tree = n.select(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"), root("n_regionkey").alias("parent_id")).unionByName(r.select(root("r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id")))
    return cl.category_paths(tree)


@query(NORM + ", s AS (SELECT inspection_id, CASE field_type WHEN 'mrp' THEN 0 ELSE 1 END AS o, value FROM bestc) SELECT CAST(d.doc_id AS VARCHAR) inspection_id, d.source || coalesce(' ' || s.said, '') AS text FROM documents d LEFT JOIN (SELECT inspection_id, string_agg(value, ' ' ORDER BY o) said FROM s GROUP BY 1) s ON s.inspection_id = CAST(d.doc_id AS VARCHAR)")
def d1_classifier_text(spark, sf):
    found = ex.best_candidates(ex.declaration_candidates(tokens(spark, sf))).withColumn("ord", F.when(F.col("field_type") == "mrp", 0).otherwise(1))
    names = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").cast("string").alias("inspection_id"), F.col("source").alias("product_name"))
    return cl.classifier_text(names, found)


@query(
    with_views("products_v")
    + """, w AS (SELECT id, ' ' || unnest(string_split_regex(lower(product_name), '\\s+')) || ' ' AS w FROM products_v),
g AS (SELECT id, unnest([substr(w, i, n) FOR i IN range(1, greatest(length(w) - n + 1, 1) + 1)]) AS gram FROM w CROSS JOIN (SELECT unnest([2, 3, 4]) AS n) WHERE w <> '  ' AND (n = 2 OR length(w) >= n)),
c AS (SELECT id, gram, count(*) AS n FROM g GROUP BY ALL),
k AS (SELECT gram, sum(n) AS total, count(*) AS df FROM c GROUP BY gram ORDER BY total DESC, gram LIMIT 5000),
r AS (SELECT id, gram, (ln(n) + 1) * (ln((1 + (SELECT count(*) FROM products_v)) / (1 + df)) + 1) AS w FROM c JOIN k USING (gram))
SELECT id, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM r"""
)
def d2_char_ngram_tfidf(spark, sf):
    rows = cl.char_ngram_tfidf(view(spark, sf, "products_v").select("id", F.col("product_name").alias("text")))
    return rows.withColumn("weight", F.round("weight", 6))


def labelled_products(spark, sf):
    """Products as texts with the key of their category."""
    keys = F.create_map(*[F.lit(x) for key, path in cl.CATEGORIES.items() for x in (path, key)])
    return view(spark, sf, "products_v").select("id", F.concat_ws(" ", "product_name", "manufacturer_name").alias("text"), F.coalesce(keys[F.col("category")], F.lit("other_uncategorized")).alias("known"))


def _held_out(products):
    """One product of five, by a hash, is not trained on."""
    out = F.pmod(F.xxhash64("id"), F.lit(5)) == 0
    return products.filter(~out), products.filter(out)


@query()
def d3_train_classifier(spark, sf):
    """A model of four products of five, and how often it is right on the fifth, by category."""
    train, rest = _held_out(labelled_products(spark, sf))
    scored = cl.classify(rest, cl.train_classifier(train.select("text", F.col("known").alias("label"))))
    return scored.groupBy("known").agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("known")).alias("right"))


@query()
def d4_classify(spark, sf):
    """Every product by the model of four of five."""
    products = labelled_products(spark, sf)
    model = cl.train_classifier(_held_out(products)[0].select("text", F.col("known").alias("label")))
    return cl.classify(products, model).select("id", "label", F.round("confidence", 6).alias("confidence"))


@query("SELECT p_partkey, k AS label, c AS confidence, c >= 0.6 AS is_confident, c < 0.6 AS needs_manual_selection, CASE k WHEN 'industrial_bulk' THEN 'Industrial/Bulk' WHEN 'household_cleaning' THEN 'Household > Cleaning Products' ELSE 'Other/Uncategorized' END AS path FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'industrial_bulk' WHEN 1 THEN 'household_cleaning' ELSE 'no_such' END AS k, CAST(p_partkey % 10 / 10.0 AS DOUBLE) AS c FROM part)")
def d5_route_category(spark, sf):
    key = F.element_at(F.array(F.lit("industrial_bulk"), F.lit("household_cleaning"), F.lit("no_such")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return cl.route_category(spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", key.alias("label"), (F.col("p_partkey") % 10 / F.lit(10.0)).alias("confidence")))
