"""Scalar building blocks as ``Column -> Column`` functions (no Python UDFs)."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month abbreviations of the reports.
MONTHS_PT = ["jan", "fev", "mar", "abr", "mai", "jun", "jul", "ago", "set", "out", "nov", "dez"]

# Text shapes accepted as a date.
DATE_SHAPES = [
    r"^\d{4}-\d{1,2}(-\d{1,2})?([ T].*)?$",
    r"^\d{4}/\d{1,2}(/\d{1,2})?$",
    r"^\d{1,2}/\d{1,2}/\d{2,4}([ T].*)?$",
    r"^\d{1,2}/\d{4}$",
    r"^\d{1,2}-\d{1,2}-\d{4}$",
]

# Number shapes, decimal comma first, decimal point second.
NUMBER_SHAPE = (r"^[+-]?(\d{1,3}(\.\d{3})+|\d+)(,\d+)?$"
                r"|^[+-]?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?$")
DOT_GROUPED = r"^[+-]?\d{1,3}(\.\d{3})+(,\d+)?$"
COMMA_GROUPED = r"^[+-]?\d{1,3}(,\d{3})+(\.\d+)?$"

# Payment wording, tested in this order.
PAYMENT_RULES = [
    ("PRAZO|FATURA|NOTA", "a_prazo"),
    ("PIX", "pix"),
    ("CREDITO|CARTAO|CARTOES", "credito"),
    ("DEBITO", "debito"),
    ("DINHEIRO", "dinheiro"),
    ("CHEQUE", "cheque"),
]
PAYMENT_OTHER = "outros"

# Product words that mean fuel.
FUEL_WORDS = ["GASOLINA", "ETANOL", "DIESEL", "V-POWER", "GNV", "ALCOOL", "ARLA"]


def text(c: Column) -> Column:
    """Trimmed text, blank becomes null."""
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


# ---------------------------------------------------------------- dates and periods
def month_index(d: Column) -> Column:
    """Months since year 0, January = 0 within the year."""
    return (F.year(d) * 12 + F.month(d) - 1).cast("int")


def day_index(d: Column) -> Column:
    return F.unix_date(F.to_date(d))


def period_index(d: Column, grain: str) -> Column:
    if grain == "month":
        return month_index(d)
    if grain == "day":
        return day_index(d)
    raise ValueError(f"grain must be 'month' or 'day', not {grain!r}")


def month_start(m: Column) -> Column:
    return F.make_date(F.floor(m / 12).cast("int"), (F.pmod(m, F.lit(12)) + 1).cast("int"), F.lit(1))


def month_label(m: Column) -> Column:
    """Month index -> ``YYYY-MM``."""
    return F.date_format(month_start(m), "yyyy-MM")


def period_label(m: Column, grain: str) -> Column:
    return month_label(m) if grain == "month" else F.date_format(F.date_from_unix_date(m), "yyyy-MM-dd")


def months_between_int(a: Column, b: Column) -> Column:
    return month_index(a) - month_index(b)


def looks_like_date(c: Column) -> Column:
    s = text(c)
    hit = F.lit(False)
    for shape in DATE_SHAPES:
        hit = hit | s.rlike(shape)
    return hit


def _checked_date(y: Column, m: Column, d: Column) -> Column:
    stamp = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"),
                        F.lpad(d.cast("string"), 2, "0"))
    return F.to_date(F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd")))


def to_day(c: Column) -> Column:
    """Date written in any accepted shape (day first when ambiguous); unreadable text becomes null."""
    s = text(c)

    def part(pattern: str, i: int) -> Column:
        return F.expr("int(null)") if i == 0 else F.regexp_extract(s, pattern, i).try_cast("int")

    iso = r"^(\d{4})[-/](\d{1,2})(?:[-/](\d{1,2}))?(?:[ T].*)?$"
    dmy = r"^(\d{1,2})[-/](\d{1,2})[-/](\d{4}|\d{2})(?:[ T].*)?$"
    my = r"^(\d{1,2})/(\d{4})$"
    a, b, y = part(dmy, 1), part(dmy, 2), part(dmy, 3)
    year = F.when(y >= 100, y).when(y >= 69, y + 1900).otherwise(y + 2000)
    swapped = (b > 12) & (a <= 12)
    return (F.when(s.rlike(iso), _checked_date(part(iso, 1), part(iso, 2), F.coalesce(part(iso, 3), F.lit(1))))
            .when(s.rlike(my), _checked_date(part(my, 2), part(my, 1), F.lit(1)))
            .when(s.rlike(dmy), _checked_date(year, F.when(swapped, a).otherwise(b), F.when(swapped, b).otherwise(a))))


def to_month(c: Column) -> Column:
    """First day of the month of a date in any accepted shape."""
    return F.to_date(F.trunc(to_day(c), "month"))


def year_month_number_ok(c: Column) -> Column:
    """Integral number that reads as YYYYMM between 190001 and 210012."""
    v = c.cast("double")
    whole = v == F.rint(v)
    n = F.rint(v)
    return whole & n.between(190001, 210012) & F.pmod(n, F.lit(100.0)).between(1, 12)


def year_month_number(c: Column) -> Column:
    n = F.rint(c.cast("double")).cast("bigint")
    return F.when(year_month_number_ok(c), _checked_date(F.floor(n / 100), F.pmod(n, F.lit(100)), F.lit(1)))


def shift_month_text(c: Column, back: Column | int) -> Column:
    """``YYYY-MM`` moved back by N months."""
    n = F.lit(back) if isinstance(back, int) else back
    return F.date_format(F.add_months(F.to_date(F.concat(c, F.lit("-01"))), -n), "yyyy-MM")


def relative_quarter(rel: Column) -> Column:
    """Three-period bucket before exit: -1 for -3..-1, -2 for -6..-4 and so on."""
    return (-(F.floor((-rel - 1) / 3) + 1)).cast("int")


# ---------------------------------------------------------------- ids, categories, numbers
def norm_id(c: Column, numeric: bool = False) -> Column:
    """Identifier as comparable text: ``7.0`` -> ``7``, blanks -> null."""
    if not numeric:
        return text(c)
    v = c.cast("double")
    return F.when(v == F.rint(v), F.rint(v).cast("bigint").cast("string")).otherwise(v.cast("string"))


def norm_value(c: Column) -> Column:
    """Category spelling used for equality tests; null becomes the empty text."""
    t = F.lower(F.trim(c.cast("string")))
    number = F.when(F.translate(t, ",", ".").rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"),
                    F.translate(t, ",", ".").try_cast("double"))
    whole = (number == F.rint(number)) & (F.abs(number) < 1e18)
    return F.coalesce(
        F.when(t.isin("true", "verdadeiro"), F.lit("1"))
        .when(t.isin("false", "falso"), F.lit("0"))
        .when(whole, F.rint(number).cast("bigint").cast("string"))
        .when(number.isNotNull(), number.cast("string"))
        .otherwise(t), F.lit(""))


def looks_numeric(c: Column) -> Column:
    return text(c).rlike(NUMBER_SHAPE)


def text_to_number(c: Column) -> Column:
    """``1.234,5``, ``1,234.5`` and ``3,5`` to double; anything else null."""
    s = text(c)
    return (F.when(s.rlike(COMMA_GROUPED), F.translate(s, ",", ""))
            .when(s.rlike(DOT_GROUPED), F.translate(F.translate(s, ".", ""), ",", "."))
            .otherwise(F.translate(s, ",", "."))).try_cast("double")


def safe_pct(part: Column, whole: Column) -> Column:
    """100 * part / whole, null when the denominator is zero."""
    return F.when(whole > 0, part.cast("double") * 100 / F.nullif(whole.cast("double"), F.lit(0.0)))


def recode(c: Column, mapping: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for old, new in mapping.items():
        out = F.when(c == old, F.lit(new)).otherwise(out)
    return F.coalesce(out, c)


def ordinal(c: Column, levels: list[str]) -> Column:
    """Position of the value in an ordered list of levels (1-based), null when unknown."""
    return F.nullif(F.array_position(F.array(*[F.lit(v) for v in levels]), c).cast("int"), F.lit(0))


def payment_group(c: Column) -> Column:
    s = F.upper(F.coalesce(c.cast("string"), F.lit("")))
    first_pattern, first_group = PAYMENT_RULES[0]
    out = F.when(s.rlike(first_pattern), F.lit(first_group))
    for pattern, group in PAYMENT_RULES[1:]:
        out = out.when(s.rlike(pattern), F.lit(group))
    return out.otherwise(F.lit(PAYMENT_OTHER))


def product_category(c: Column, words: list[str] = FUEL_WORDS, hit: str = "combustivel",
                     miss: str = "conveniencia") -> Column:
    return F.when(F.upper(F.coalesce(c, F.lit(""))).rlike("|".join(words)), F.lit(hit)).otherwise(F.lit(miss))


def margin(total: Column, quantity: Column, unit_cost: Column) -> Column:
    return F.round(total - quantity * F.coalesce(unit_cost, F.lit(0.0)), 2)


# ---------------------------------------------------------------- display text
def _accent_table() -> tuple[str, str]:
    """Latin letters with marks and their plain form, derived from Unicode decomposition."""
    marked, plain = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha():
            marked.append(chr(code))
            plain.append(base[0])
    return "".join(marked), "".join(plain)


ACCENTED, PLAIN = _accent_table()


def search_text(c: Column) -> Column:
    """Accent-free lower case with every other run of characters collapsed to one space."""
    s = F.lower(F.translate(F.coalesce(c.cast("string"), F.lit("")), ACCENTED, PLAIN))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9%]+", " "))


def _swap_separators(s: Column) -> Column:
    return F.translate(s, ",.", ".,")


def number_text(x: Column, places: int | None = None) -> Column:
    """Number with dot grouping, decimal comma and a typographic minus."""
    v = x.cast("double")

    def show(n: int) -> Column:
        return _swap_separators(F.format_number(v, n))

    if places is None:
        body = F.when((F.abs(v - F.rint(v)) < 1e-9) | (F.abs(v) >= 100), show(0)).otherwise(show(1))
    else:
        body = show(places)
    signed = F.when(body.startswith("-"), F.concat(F.lit("−"), F.substr(body, F.lit(2)))).otherwise(body)
    clean = F.when(signed.rlike("^−0(,0+)?$"), F.substr(signed, F.lit(2))).otherwise(signed)
    return F.coalesce(clean, F.lit("—"))


def percent_text(fraction: Column, places: int = 0) -> Column:
    return F.concat(number_text(fraction.cast("double") * 100, places), F.lit("%"))


def money_text(v: Column) -> Column:
    return F.concat(F.lit("R$ "), _swap_separators(F.format_number(v.cast("double"), 0)))


def month_text(d: Column) -> Column:
    """Date -> ``jun/2026``."""
    name = F.element_at(F.array(*[F.lit(m) for m in MONTHS_PT]), F.month(d))
    return F.coalesce(F.concat(name, F.lit("/"), F.year(d).cast("string")), F.lit(""))


# ---------------------------------------------------------------- maths
def round_step(x: Column) -> Column:
    """Closest of 1, 2, 2.5, 5, 10 times a power of ten."""
    v = x.cast("double")
    scale = F.pow(F.lit(10.0), F.floor(F.log10(v)).cast("double"))
    lead = v / scale
    step = (F.when(lead <= 1.5, 1.0).when(lead <= 2.25, 2.0).when(lead <= 3.75, 2.5)
            .when(lead <= 7.5, 5.0).otherwise(10.0))
    return F.when(v > 0, step * scale).otherwise(F.lit(1.0))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def log_loss_term(y: Column, p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    yy = y.cast("double")
    return -(yy * F.log(q) + (1 - yy) * F.log(1 - q))


def finite(c: Column) -> Column:
    """NaN and infinities as null."""
    v = c.cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
