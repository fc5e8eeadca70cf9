"""Text normalisation as column expressions (whole-stage code, no Python)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit words and the units they stand for.
UNITS = {
    "g": "g", "gm": "g", "gms": "g", "gram": "g", "grams": "g",
    "kg": "kg", "kgs": "kg", "kilogram": "kg", "kilograms": "kg",
    "mg": "mg", "milligram": "mg", "milligrams": "mg",
    "ml": "ml", "milliliter": "ml", "millilitre": "ml", "milliliters": "ml", "millilitres": "ml",
    "l": "l", "ltr": "l", "ltrs": "l", "liter": "l", "litre": "l", "liters": "l", "litres": "l",
    "pcs": "pcs", "piece": "pcs", "pieces": "pcs", "nos": "nos", "no": "nos", "units": "units", "unit": "units",
    "pack": "pack", "pkt": "pkt", "packet": "pkt", "packets": "pkt",
    "box": "box", "boxes": "box", "bottle": "bottle", "bottles": "bottle", "can": "can", "cans": "can",
}
# Currency marks, the longest first.
CURRENCY_MARKS = ["Rs.", "INR", "Rs/", "Re.", "Rs", "Re", "₹"]
# White space of Unicode.
SPACE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_FIRST_MONTH, _LAST_MONTH, _FIRST_YEAR, _LAST_YEAR = 1, 12, 2020, 2030
DEVANAGARI_DIGITS = "०१२३४५६७८९"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once, however often it is used: else expressions that use the last one
    several times each grow without bound when the optimizer merges them."""
    return F.get(F.transform(F.array(value), use), 0)


def strip(c: Column) -> Column:
    """Without white space, of Unicode too, at both ends."""
    return F.btrim(c, F.lit(SPACE))


def fix_ocr(c: Column) -> Column:
    """Letters that are often misread digits, as digits, in texts that hold a digit."""
    return F.when(c.rlike(r"\p{Nd}"), F.translate(c, "OolISBZ", "0011582")).otherwise(c)


def unit_word(low: Column) -> Column:
    """The longest unit word that a lower-cased text ends with; empty if none."""
    words = "|".join(w[::-1] for w in sorted(UNITS, key=lambda w: (-len(w), w)))
    # backwards, so that words are tried at one end only
    return F.reverse(F.regexp_extract(F.reverse(low), f"^(?:{words})", 0))


def unit_and_rest(c: Column, low: Column, word: Column) -> Column:
    """struct<unit, rest> of a text c, its lower-cased form and that form's unit word."""
    unit = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])
    rest = strip(F.substring(low, F.lit(1), F.length(low) - F.length(word)))
    return F.struct(F.when(word != "", unit[word]).alias("unit"), F.when(word != "", rest).otherwise(c).alias("rest"))


def normalize_unit(c: Column) -> Column:
    """struct<unit, rest>: the unit that the lower-cased text ends with, the longest word for it, and what stands before."""
    return let(strip(F.lower(c)), lambda low: let(unit_word(low), lambda word: unit_and_rest(c, low, word)))


def without_currency(text: Column) -> Column:
    """A stripped text without the currency mark that it begins or ends with, or the rupee sign in it; null without one."""
    mark = F.lit(0)  # letters of the mark, below 0 if it ends the text
    for m in reversed(CURRENCY_MARKS):
        mark = F.when(text.startswith(m), len(m)).when(text.endswith(m), -len(m)).otherwise(mark)
    behind = lambda n: F.regexp_replace(strip(F.substring(text, n + 1, F.length(text))), r"^[./:]+", "")
    before = lambda n: strip(F.substring(text, F.lit(1), F.length(text) + n))
    return let(mark, lambda n: F.when(n > 0, behind(n)).when(n < 0, before(n)).when(text.contains("₹"), strip(F.replace(text, F.lit("₹"), F.lit("")))))


def normalize_currency(c: Column) -> Column:
    """struct<currency, rest>: INR if a mark begins or ends the text, or the rupee sign is in it; the text without it."""
    split = lambda r: F.struct(F.when(r.isNotNull(), "INR").alias("currency"), F.coalesce(r, c).alias("rest"))
    return let(strip(c), lambda text: let(without_currency(text), split))


def parse_month(c: Column) -> Column:
    """struct<m, y> of the first date of each shape, month first, year first, day first, that names a valid month; else null."""
    part = lambda d, n: F.substring_index(d, "/", n)
    first, middle, last = lambda d: part(d, 1), lambda d: part(part(d, 2), -1), lambda d: part(d, -1)
    valid = lambda d: F.when(d["m"].between(_FIRST_MONTH, _LAST_MONTH) & d["y"].between(_FIRST_YEAR, _LAST_YEAR), d)

    def date(pattern: str, month: Callable[[Column], Column], year: Callable[[Column], Column]) -> Column:
        whole = F.translate(F.regexp_extract(c, f"(?U){pattern}", 0), f"{DEVANAGARI_DIGITS}-.", "0123456789//")
        # a cast that fails costs an exception
        return let(let(whole, lambda d: F.when(d != "", F.struct(month(d).try_cast("int").alias("m"), year(d).try_cast("int").alias("y")))), valid)

    found = [date(r"\d{1,2}[/\-.]\d{4}", first, last), date(r"\d{4}[/\-]\d{1,2}", last, first), date(r"\d{1,2}/\d{1,2}/\d{4}", middle, last)]
    # all shapes have a mark between two digits
    return F.when(c.rlike(r"(?U)\d[/\-.]\d"), F.coalesce(*found))


def parse_number(c: Column) -> Column:
    """The number of a text of digits, commas and points, spaces aside; null if it is none."""
    bare = F.translate(F.replace(c, F.lit(" "), F.lit("")), DEVANAGARI_DIGITS, "0123456789")
    return F.when(bare.rlike(r"^[0-9,.]+$"), F.replace(bare, F.lit(","), F.lit("")).try_cast("double"))


def is_number(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit("")).rlike(r"(?U)^[\d,.]+$")


def detect_language(c: Column) -> Column:
    """hi if over 0.3 of the Devanagari and ASCII letters and digits are Devanagari; else en if any is ASCII; else unknown."""
    hindi = F.length(F.regexp_replace(c, r"[^ऀ-ॿ]", ""))
    ascii_ = F.length(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))
    return F.when((hindi + ascii_ > 0) & (hindi / (hindi + ascii_) > 0.3), "hi").when(ascii_ > 0, "en").otherwise("unknown")


def storage_url(bucket: str, content_hash: Column) -> Column:
    return F.concat(F.lit(f"minio://{bucket}/"), F.substring(content_hash, 1, 32), F.lit(".jpg"))


def parse_storage_url(c: Column) -> Column:
    """struct<bucket, key>."""
    return F.struct(F.parse_url(c, F.lit("HOST")).alias("bucket"), F.ltrim(F.parse_url(c, F.lit("PATH")), F.lit("/")).alias("key"))


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def valid_reason(c: Column) -> Column:
    """Whether a correction's reason has five characters or more, white space at the ends aside."""
    return F.coalesce(F.length(strip(c)) >= 5, F.lit(False))
