"""Declarations from recognised label text, one row set per inspection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t

# The closed vocabulary of declarations, and the words that point at some of them.
FIELD_TYPES = [
    "manufacturer", "packer", "importer", "net_quantity", "mrp", "mfg_date", "packing_date", "import_date",
    "consumer_care", "country_of_origin", "product_name", "batch_number", "ingredients", "dimensions",
]
DATE_WORDS = {
    "mfg": "mfg_date", "manufactured": "mfg_date", "manufacture": "mfg_date", "mfd": "mfg_date", "mfgd": "mfg_date",
    "packed": "packing_date", "packing": "packing_date", "pkd": "packing_date", "pkdt": "packing_date",
    "imported": "import_date", "import": "import_date", "imp": "import_date",
}
CARE_WORDS = ["consumer care", "consumer complaint", "customer care", "helpline", "toll free", "toll-free", "contact us", "customer service", "grievance"]
ORIGIN_WORDS = ["country of origin", "made in", "product of", "origin", "manufactured in", "produced in"]
MAKER_PATTERNS = [
    r"(?:manufactured?\s+by|packed?\s+by|marketed?\s+by|produced?\s+by)[:\s]+(.+?)(?:\n|$|,|\.)",
    r"(?:mfr|maker|company)[:\s]+(.+?)(?:\n|$|,|\.)",
]
ORIGIN_PATTERN = r"(?:origin|made in|product of)[:\s]+([A-Za-z\s]+)"
LOW_CONFIDENCE, LONGEST_LINE = 0.5, 500
MISSING = "NOT_FOUND"
DECLARATION = "struct<field_type:string,value:string,confidence:double,n:int>"


def clean_ocr_lines(tokens: DataFrame) -> DataFrame:
    """Text cut to 500 characters, then stripped; is_low_confidence below 0.5."""
    return tokens.withColumn("text", t.strip(F.substring("text", 1, LONGEST_LINE))).withColumn("is_low_confidence", F.col("confidence") < LOW_CONFIDENCE)


def ocr_summary(tokens: DataFrame) -> DataFrame:
    """Per inspection: lines of high and low confidence, languages found, and the lines that aren't empty, joined."""
    language = t.detect_language(F.col("text"))
    rows = tokens.select("inspection_id", "seq", "text", "confidence", language.alias("language"))
    lines = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("seq", "text"))))
    return rows.groupBy("inspection_id").agg(
        F.count_if(F.col("confidence") >= LOW_CONFIDENCE).alias("n_high"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("n_low"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("language") != "unknown", F.col("language")))), ",").alias("languages"), F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("full_text"),
    )


def normalize_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens with normalized text, unit, currency, number (value) and month; blank lines are dropped."""
    rows = tokens.withColumn("original", t.strip(F.col("text"))).filter("original <> ''")
    # one projection for each value that is used several times: compiled, and worked out once
    steps = {
        "normalized": t.fix_ocr(F.col("original")), "t_text": t.strip(F.col("normalized")), "t_bare": t.without_currency(F.col("t_text")), "t_rest": F.coalesce("t_bare", "normalized"),
        "t_low": t.strip(F.lower("t_rest")), "t_word": t.unit_word(F.col("t_low")), "t_unit": t.unit_and_rest(F.col("t_rest"), F.col("t_low"), F.col("t_word")),
        "t_size": F.col("t_unit")["rest"], "t_month": F.coalesce(t.parse_month(F.col("t_size")), t.parse_month(F.col("normalized"))),
    }
    for name, value in steps.items():
        rows = rows.withColumn(name, value)
    month, size = F.col("t_month"), F.col("t_size")
    token = F.struct(
        "normalized", F.when(F.col("t_bare").isNotNull(), "INR").alias("currency"), F.col("t_unit")["unit"].alias("unit"), F.when(month.isNull(), t.parse_number(size)).alias("value"),
        F.when(month.isNotNull(), F.format_string("%04d-%02d", month["y"], month["m"])).alias("month"), t.is_number(size).alias("is_numeric"), month.isNotNull().alias("is_date"), F.col("t_bare").isNotNull().alias("is_currency"),
    )
    # from one array, so that filters on these columns don't pull the expressions behind them down to the scan again
    return rows.select("inspection_id", "seq", "original", F.inline(F.array(token)), "confidence")


def label_text(tokens: DataFrame) -> DataFrame:
    """Per inspection: the originals joined by one space in the order of recognition."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "original"))), lambda x: x["original"]), " ")
    return tokens.groupBy("inspection_id").agg(joined.alias("all_text"))


def _amount() -> Column:
    """A token's number, else the first run of digits, commas and points; none where the value is a date."""
    first = F.replace(F.regexp_extract("normalized", r"[0-9,.]+", 0), F.lit(","), F.lit(""))
    # without a digit there is nothing to cast, and a cast that fails costs an exception
    return F.when(~F.col("is_date"), F.coalesce("value", t.let(first, lambda x: F.when(x.rlike("[0-9]"), x.try_cast("double")))))


def _spelled(amount: Column) -> Column:
    whole = amount == F.floor(amount)
    return F.when(whole, amount.cast("decimal(20,0)").cast("string")).otherwise(F.regexp_replace(amount.cast("decimal(30,10)").cast("string"), r"0+$", ""))


def declaration_candidates(tokens: DataFrame) -> DataFrame:
    """All competing values of mrp and net_quantity: inspection_id, field_type, value, raw_value, confidence, seq."""
    rows = tokens.withColumn("amount", _amount()).filter("amount is not null")
    # one pass over the tokens, a money and a size of each
    one = lambda field, value: F.struct(F.lit(field).alias("field_type"), value.alias("value"))
    money = F.when(F.col("is_currency"), one("mrp", F.concat(F.lit("₹"), _spelled(F.col("amount")))))
    size = F.when(F.col("unit").isNotNull(), one("net_quantity", F.concat_ws(" ", _spelled(F.col("amount")), "unit")))
    found = rows.select("inspection_id", F.inline(F.array_compact(F.array(money, size))), "original", "confidence", "seq")
    return found.select("inspection_id", "field_type", "value", F.col("original").alias("raw_value"), "confidence", "seq")


def best_candidates(candidates: DataFrame) -> DataFrame:
    """The candidate of the highest confidence, the first of equals."""
    best = F.min_by(F.struct("value", "raw_value", "confidence"), F.struct(-F.col("confidence"), F.col("seq")))
    return candidates.groupBy("inspection_id", "field_type").agg(best.alias("b")).select("inspection_id", "field_type", "b.value", "b.raw_value", "b.confidence")


def extract_field(tokens: DataFrame, field_type: str) -> DataFrame:
    """mrp or net_quantity of every inspection; MISSING at confidence 0 where there is none."""
    ids = tokens.select("inspection_id").distinct()
    best = best_candidates(declaration_candidates(tokens).filter(F.col("field_type") == field_type))
    return ids.join(best, "inspection_id", "left").select("inspection_id", F.lit(field_type).alias("field_type"), F.coalesce("value", F.lit(MISSING)).alias("value"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def extract_dates(tokens: DataFrame) -> DataFrame:
    """A row for each date word in the label and each date token; mfg_date and packing_date are MISSING if absent."""
    # one grouping: a label's tokens are tens
    ts = F.array_sort(F.collect_list(F.struct("seq", "original", "is_date", "month", "confidence")))
    rows = tokens.groupBy("inspection_id").agg(ts.alias("ts"))
    rows = rows.withColumn("low", F.lower(F.array_join(F.transform("ts", lambda x: x["original"]), " "))).withColumn("dated", F.filter("ts", lambda x: x["is_date"]))
    one = lambda field, value, sure, word, seq: F.struct(field.alias("field_type"), value.alias("value"), sure.alias("confidence"), word.alias("word"), seq.alias("seq"))
    as_field = lambda word, field: lambda x: one(F.lit(field), x["month"], x["confidence"], F.lit(word), x["seq"])
    none = F.filter(F.transform("dated", as_field("", "")), lambda x: F.lit(False))
    found = F.flatten(F.array(*[F.when(F.col("low").contains(w), F.transform("dated", as_field(w, f))).otherwise(none) for w, f in DATE_WORDS.items()]))
    rows = rows.select("inspection_id", found.alias("found"))
    lacking = F.array_except(F.array(F.lit("mfg_date"), F.lit("packing_date")), F.transform("found", lambda x: x["field_type"]))
    absent = F.transform(lacking, lambda f: one(f, F.lit(MISSING), F.lit(0.0), F.lit(""), F.lit(-1)))
    return rows.select("inspection_id", F.inline(F.concat("found", absent)))


def manufacturer(all_text: Column) -> Column:
    found = [t.strip(F.regexp_extract(all_text, f"(?iu){pattern}", 1)) for pattern in MAKER_PATTERNS]
    return F.coalesce(*[t.let(value, lambda v: F.when(F.length(v) > 3, v)) for value in found])


def _holds(word: str):
    return lambda line: F.lower(line).contains(word)


def consumer_care(all_text: Column) -> Column:
    lines = F.split(all_text, "\n")
    hits = [F.get(F.filter(lines, _holds(w)), 0) for w in CARE_WORDS]
    return t.strip(F.coalesce(*hits))


def country_of_origin(all_text: Column) -> Column:
    lines = F.split(all_text, "\n")
    name = lambda line: F.get(F.split(t.strip(F.regexp_extract(line, f"(?iu){ORIGIN_PATTERN}", 1)), r"\s+"), 0)
    hits = [F.get(F.filter(F.transform(F.filter(lines, _holds(w)), name), lambda x: x != ""), 0) for w in ORIGIN_WORDS]
    return F.coalesce(*hits)


def product_name(all_text: Column) -> Column:
    lines = F.filter(F.transform(F.split(all_text, "\n"), t.strip), lambda x: x != "")
    longest = F.aggregate(lines, F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    return F.when(F.length(longest) > 3, longest)


TEXT_FIELDS = {"manufacturer": (manufacturer, 0.8), "consumer_care": (consumer_care, 0.7), "country_of_origin": (country_of_origin, 0.7), "product_name": (product_name, 0.6)}


def extract_text_field(tokens: DataFrame, field_type: str) -> DataFrame:
    """One of TEXT_FIELDS of every inspection; MISSING at confidence 0 where there is none."""
    find, sure = TEXT_FIELDS[field_type]
    rows = label_text(tokens).withColumn("v", find(F.col("all_text")))
    return rows.select("inspection_id", F.lit(field_type).alias("field_type"), F.coalesce("v", F.lit(MISSING)).alias("value"), F.when(F.col("v").isNotNull(), sure).otherwise(0.0).alias("confidence"))


def complete_fields(declarations: DataFrame) -> DataFrame:
    """With a MISSING row for every field type that an inspection has no row of."""
    # one grouping, so that what is behind the declarations is worked out once
    rows = declarations.groupBy("inspection_id").agg(F.collect_list(F.struct("field_type", "value", "confidence")).alias("found"))
    lacking = F.array_except(F.array(*map(F.lit, FIELD_TYPES)), F.transform("found", lambda x: x["field_type"]))
    absent = F.transform(lacking, lambda f: F.struct(f.alias("field_type"), F.lit(MISSING).alias("value"), F.lit(0.0).alias("confidence")))
    return rows.select("inspection_id", F.inline(F.concat("found", absent)))


def gathered_declarations(tokens: DataFrame) -> DataFrame:
    """All declarations of every inspection in one row: inspection_id, found (field_type, value, confidence; in order).

    One grouping by inspection gathers its tokens (tens of them); all fields are then found inside the row.
    """
    seq = F.struct("seq", "original", "is_date", "month", "is_currency", "unit", _amount().alias("amount"), "confidence")
    rows = tokens.groupBy("inspection_id").agg(F.sort_array(F.collect_list(seq)).alias("ts"))
    rows = rows.withColumn("all_text", F.array_join(F.transform("ts", lambda x: x["original"]), " ")).withColumn("low", F.lower("all_text"))
    made = lambda field, value, sure: t.let(value, lambda v: F.struct(F.lit(field).alias("field_type"), F.coalesce(v, F.lit(MISSING)).alias("value"), F.when(v.isNotNull(), sure).otherwise(F.lit(0.0)).alias("confidence")))
    first = lambda a, b: F.when(b["confidence"] > a["confidence"], b).otherwise(a)

    def best(keep):
        some = F.filter("ts", lambda x: keep(x) & x["amount"].isNotNull())
        return F.when(F.size(some) > 0, F.aggregate(some, F.get(some, 0), first))

    rows = rows.withColumn("m", best(lambda x: x["is_currency"])).withColumn("q", best(lambda x: x["unit"].isNotNull()))
    dated = F.filter("ts", lambda x: x["is_date"])
    as_field = lambda field: lambda x: made(field, x["month"], x["confidence"])
    dates = F.flatten(F.array(*[F.when(F.col("low").contains(w), F.transform(dated, as_field(f))).otherwise(F.array().cast("array<struct<field_type:string,value:string,confidence:double>>")) for w, f in DATE_WORDS.items()]))
    fixed = [made("mrp", F.concat(F.lit("₹"), _spelled(F.col("m.amount"))), F.col("m.confidence")), made("net_quantity", F.when(F.col("q").isNotNull(), F.concat_ws(" ", _spelled(F.col("q.amount")), F.col("q.unit"))), F.col("q.confidence"))]
    fixed += [made(f, find(F.col("all_text")), F.lit(sure)) for f, (find, sure) in TEXT_FIELDS.items()]
    rows = rows.select("inspection_id", F.concat(F.array(*fixed[:2]), dates, F.array(*fixed[2:])).alias("found"))
    names = F.transform("found", lambda x: x["field_type"])
    absent = F.transform(F.array_except(F.array(*map(F.lit, FIELD_TYPES)), names), lambda f: F.struct(f.alias("field_type"), F.lit(MISSING).alias("value"), F.lit(0.0).alias("confidence")))
    return rows.select("inspection_id", F.concat("found", absent).alias("found"))


def extract_declarations(tokens: DataFrame) -> DataFrame:
    """All declarations of every inspection: inspection_id, field_type, value, confidence, ord."""
    return gathered_declarations(tokens).select("inspection_id", F.posexplode("found").alias("ord", "d")).select("inspection_id", "d.field_type", "d.value", "d.confidence", "ord")


def field_status(declarations: DataFrame) -> DataFrame:
    """Per inspection: how many rows were found, and which field types were found and are missing."""
    found = F.col("value") != MISSING
    names = lambda keep: F.array_join(F.array_sort(F.collect_set(F.when(keep, F.col("field_type")))), ",")
    return declarations.groupBy("inspection_id").agg(F.count_if(found).alias("n_found"), names(found).alias("found_fields"), names(~found).alias("missing_fields"))
