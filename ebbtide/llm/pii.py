"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

A validated number, address or date becomes a pair (a, b) in Z_m x Z_n; eight keyed rounds add a pseudo-random amount to one half that
the other half decides. Every round can be undone, so the whole is a permutation of the values of that format: equal values get
equal pseudonyms in all documents, different ones stay different, and who has the key can turn them back. Mail addresses and secrets are not
numbers: they get keyed digests in their shape.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm.common import documents

ROUNDS = 8
DEMO_KEY = "not a secret: give your own key"
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 270, 271   # 73,170 days, to 2100-05-01

#: What is looked for, in this order. A number is taken only if it is valid as well (``_kind``).
FOUND = "|".join([
    r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)+",
    r"(?<![\p{L}\p{N}.])\d{1,3}(?:\.\d{1,3}){3}(?![\p{L}\p{N}]|\.\d)",
    r"(?<![\p{L}\p{N}-])\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}]|-\d)",
    r"(?<![\p{L}\p{N}/])\d{2}/\d{2}/\d{4}(?![\p{L}\p{N}]|/\d)",
    r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)|\d{2,4})(?:[ .-]?\d{2,4}){2,4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}.-])\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])\d{13,19}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])(?:AKIA|akia)[\p{Alnum}]{16}(?![\p{L}\p{N}])",
    r"(?<=[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]=)[0-9A-Za-z]{8,64}(?![\p{L}\p{N}])",
    r"(?<![\p{L}\p{N}])[0-9A-Fa-f]{32,128}(?![\p{L}\p{N}])",
])
KINDS = ["email", "ip", "date", "ssn", "phone", "card", "secret"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def _drawn(key: str, kind: Column, i: Column, other: Column, modulus: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), modulus.cast("string"), other.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long") % modulus


def feistel(key: str, kind: Column, a: Column, b: Column, m: Column, n: Column, back: bool = False) -> Column:
    """The pair (a, b) of Z_m x Z_n permuted (back: restored) under the key; a struct<a, b> of longs."""
    def step(s: Column, k: Column) -> Column:
        i = ROUNDS - 1 - k if back else k
        even = i % 2 == 0
        by_a, by_b = _drawn(key, kind, i, s["a"], n), _drawn(key, kind, i, s["b"], m)
        new_a = F.pmod(s["a"] - by_b if back else s["a"] + by_b, m)
        new_b = F.pmod(s["b"] - by_a if back else s["b"] + by_a, n)
        return F.struct(F.when(even, new_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(new_b).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def _luhn_sum(digits: Column, parity: int) -> Column:
    """Sum of the digits, those whose distance from the end has this parity doubled (less 9 if over 9)."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == parity, F.element_at(F.array(*[F.lit(2 * x - 9 * (x > 4)) for x in range(10)]), _number(c).cast("int") + 1)).otherwise(_number(c).cast("int")))
    return F.aggregate(d, F.lit(0), lambda s, x: s + x)


def _date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(F.when(text.rlike(r"^\d{4}-"), text), "yyyy-MM-dd"), F.try_to_date(F.when(text.contains("/"), text), "dd/MM/yyyy"))


def _kind(m: Column) -> Column:
    """The kind of a match, or null where it is not valid and stays as it is."""
    octets = F.split(m, r"\.")
    d = _digits(m)
    day = F.datediff(_date(m), F.lit(FIRST_DAY))
    return (F.when(m.contains("@"), "email")
            .when(m.rlike(r"^[\d.]+$") & m.contains("."), F.when((F.size(octets) == 4) & (F.array_max(F.transform(octets, _number)) <= 255), "ip").when(F.length(d) == 10, "phone"))
            .when(m.rlike(r"^\d{4}-\d\d-\d\d$|/"), F.when((day >= 0) & (day < DAYS_A * DAYS_B), "date"))
            .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~m.rlike(r"^(?:000|666|9\d\d)|-00-|-0000$"), "ssn"))
            .when(m.rlike(r"^[+(]|^\d{3}[ .-]\d{3}[ .-]"), F.when(F.length(d).between(10, 15), "phone"))
            .when(m.rlike(r"^[\d -]+$"), F.when(F.length(d).between(13, 19) & ~d.rlike(r"^(\d)\1*$") & (_luhn_sum(d, 1) % 10 == 0), "card"))
            .otherwise(F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), "secret")))


def _fill(shape: Column, digits: Column) -> Column:
    """The digits of shape replaced one by one."""
    return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(c.rlike("[0-9]"), digits.substr(F.length(_digits(shape.substr(F.lit(1), i + 1))), F.lit(1))).otherwise(c)), "")


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), 19, "0").substr(F.lit(20) - n, n)


def _tens(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**i).cast("long") for i in range(11)]), n.cast("int") + 1)


def _halves(text: Column, kind: Column) -> Column:
    """a, b, m, n of a valid value."""
    d = _digits(text)
    octet = F.transform(F.split(text, r"\."), _number)
    day = F.datediff(_date(text), F.lit(FIRST_DAY)).cast("long")
    area = _number(F.substring(d, 1, 3))
    body = F.length(d) - 1
    half = F.floor(body / 2)
    pair = lambda a, b, m, n: F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"), m.cast("long").alias("m"), n.cast("long").alias("n"))
    return (F.when(kind == "ip", pair(F.get(octet, F.lit(0)) * 256 + F.get(octet, F.lit(1)), F.get(octet, F.lit(2)) * 256 + F.get(octet, F.lit(3)), F.lit(65536), F.lit(65536)))
            .when(kind == "date", pair(F.floor(day / DAYS_B), day % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B)))
            .when(kind == "ssn", pair((area - 1 - (area > 666).cast("long")) * 99 + _number(F.substring(d, 4, 2)) - 1, _number(F.substring(d, 6, 4)) - 1, F.lit(898 * 99), F.lit(9999)))
            .when(kind == "phone", pair(_number(F.substring(d, -10, 5)), _number(F.substring(d, -5, 5)), F.lit(100_000), F.lit(100_000)))
            .when(kind == "card", pair(_number(d.substr(F.lit(1), half)), _number(d.substr(half + 1, body - half)), _tens(half), _tens(body - half))))


def _written(text: Column, kind: Column, p: Column) -> Column:
    """The pair p in the format of text."""
    a, b, d = p["a"], p["b"], _digits(text)
    day = F.date_add(F.lit(FIRST_DAY), (a * DAYS_B + b).cast("int"))
    area = F.floor(a / 99) + 1
    body = F.length(d) - 1
    half = F.floor(body / 2)
    card = F.concat(_padded(a, half), _padded(b, body - half))
    return (F.when(kind == "ip", F.concat_ws(".", F.floor(a / 256).cast("string"), (a % 256).cast("string"), F.floor(b / 256).cast("string"), (b % 256).cast("string")))
            .when(kind == "date", F.when(text.contains("/"), F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(day, "yyyy-MM-dd")))
            .when(kind == "ssn", F.concat_ws("-", _padded(area + (area >= 666).cast("long"), F.lit(3)), _padded(a % 99 + 1, F.lit(2)), _padded(b + 1, F.lit(4))))
            .when(kind == "phone", _fill(text, F.concat(d.substr(F.lit(1), F.length(d) - 10), _padded(a, F.lit(5)), _padded(b, F.lit(5)))))
            .when(kind == "card", _let(card, lambda c: _fill(text, F.concat(c, F.pmod(-_luhn_sum(c, 0), F.lit(10)).cast("string"))))))


def _digest(text: Column, kind: Column, key: str) -> Column:
    """A keyed digest in the shape of a mail address or a secret."""
    h = F.sha2(F.concat_ws("|", F.lit(key), kind, F.lower(text)).cast("binary"), 512)
    secret = F.when(text.rlike("^(?i)AKIA"), F.concat(F.substring(text, 1, 4), F.substring(h, 1, 16))).otherwise(h.substr(F.lit(1), F.length(text)))
    return F.when(kind == "email", F.concat(F.lit("u"), F.substring(h, 1, 10), F.lit("@m"), F.substring(h, 11, 8), F.lit(".example"))).otherwise(
        F.when(text == F.upper(text), F.upper(secret)).otherwise(secret))


def pseudonym(text: Column, kind: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one value; back restores all but mail addresses and secrets."""
    def permuted(h: Column) -> Column:
        return _let(feistel(key, kind, h["a"], h["b"], h["m"], h["n"], back), lambda p: _written(text, kind, p))

    return F.when(kind.isin("email", "secret"), _digest(text, kind, key)).when(kind.isNull(), text).otherwise(_let(_halves(text, kind), permuted))


def pseudonymise(docs: DataFrame, key: str, column: str = "text", found: str = "pii_found") -> DataFrame:
    """The documents with the column rewritten, and (added or replaced) found: array<struct<kind, pseudonym>> in order.

    Null text: stays null, nothing found (empty array), as with an empty one. Texts without digit and @ are not searched. Values that are not
    valid (failed check digit, octets above 255, no such date) stay. Rows and other columns stay as they are, null and
    repeated doc_ids too. No shuffle.
    """
    text = F.col(column)
    values = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)))
    typed = F.transform(values, lambda m: _let(_kind(m), lambda k: F.struct(k.alias("kind"), m.alias("value"), pseudonym(m, k, key).alias("pseudonym"))))
    whole = _let(F.split(text, FOUND, -1), lambda parts: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col("_pii"), i)["pseudonym"], F.lit("")))), ""))
    kept = F.transform(F.filter(F.coalesce("_pii", F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")), lambda x: x["kind"].isNotNull()),
                       lambda x: F.struct(x["kind"].alias("kind"), x["pseudonym"].alias("pseudonym")))
    return (docs.withColumn("_pii", typed).withColumn(column, F.when(F.size("_pii") > 0, whole).otherwise(text)).withColumn(found, kept).drop("_pii"))


def rewritten(docs: DataFrame, key: str) -> DataFrame:
    """The documents with the same columns, text pseudonymised and n_chars (if there) counted anew."""
    done = pseudonymise(docs, key, found="_found")
    counted = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
    return counted.select(*docs.columns)


def op9_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text and how many values of each kind it held."""
    done = pseudonymise(documents(spark, sf_dir).select("doc_id", "text"), DEMO_KEY)
    kinds = F.col("pii_found.kind")
    return done.select("doc_id", "text", *[F.size(F.array_compact(F.transform(kinds, lambda x: F.when(x.isin(k), x)))).cast("long").alias(f"n_{k}") for k in KINDS])
