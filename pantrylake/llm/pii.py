"""Format-preserving pseudonyms for personal data.

Values found in a text are validated (card numbers by their check digit, dates by the calendar, addresses by their
range) and then permuted by a keyed Feistel network within their own format: digits stay digits, letters letters,
valid cards valid cards, valid dates valid dates, and phone numbers stay within those of their class (numbers of the
North American plan, and the two kinds that break its rules). The permutation depends on the key and the format alone,
so equal values get equal pseudonyms in every document, unequal ones stay unequal, and a pseudonym is found again by the
same patterns. DataFrame functions only; the round function is SHA-256 of key, kind, round and half.

Whoever has the key can invert the network: the caller gives it, or the session's conf KEY_CONF holds it. The queries of
this repository, which nobody gives a key, fall back to DEMO_KEY, which protects nothing.

Defined cases: a null text stays null; a text without personal data stays as it is; numbers that fail validation
stay; repeated rows are treated alike; an empty table gives no rows; all other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_CONF, DEMO_KEY = "spark.pantrylake.pseudonyms.key", "demo"
ROUNDS = 8
#: What is looked for, in order of precedence at one place.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
PHONE = r"(?<![0-9])(?:\+?1[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|\([2-9][0-9]{2}\) ?[0-9]{3}-[0-9]{4}|\+?1[-. ][0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}|[2-9][0-9]{2}-[2-9][0-9]{2}-[0-9]{4})(?![0-9])"
SOCIAL = r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
DATE = r"(?<![0-9/.-])(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/(?:19|20)[0-9]{2})(?![0-9/-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
ADDRESS = rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}[ -]){3}[0-9]{4}(?![0-9])|(?<![0-9])[0-9]{13,19}(?![0-9])"
KINDS = {"email": EMAIL, "phone": PHONE, "social": SOCIAL, "date": DATE, "address": ADDRESS, "card": CARD}
ANY = "|".join(KINDS.values())
#: Days from 1900-01-01 to 2099-12-31: 73,049 = 319 x 229.
FIRST_DAY, DAYS_A, DAYS_B = "1900-01-01", 319, 229


def session_key(spark: SparkSession) -> str:
    """The key that the session's conf holds, or the demo key."""
    return spark.conf.get(KEY_CONF, DEMO_KEY)


def _digest(kind: str, step: Column, half: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), step.cast("string"), half.cast("string")), 256)


def _number(digest: Column, modulus: Column) -> Column:
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") % modulus


def _shift(part: Column, digest: Column) -> Column:
    """Move each digit or letter of `part` within its own class, by what the digest says for its place."""

    def moved(c: Column, i: Column) -> Column:
        by = F.conv(F.substr(digest, F.lit(4) * (i % 16) + 1, F.lit(4)), 16, 10).cast("int")
        turn = lambda first, size: F.char((F.ascii(c) - first + by) % size + first)
        return (
            F.when((c >= "0") & (c <= "9"), turn(48, 10)).when((c >= "a") & (c <= "z"), turn(97, 26)).when((c >= "A") & (c <= "Z"), turn(65, 26)).otherwise(c)
        )

    return F.array_join(F.transform(F.split(part, ""), moved), "")


def permuted_text(value: Column, kind: str, key: str) -> Column:
    """A Feistel network over the halves of a string: a permutation of the strings of the same classes."""
    half = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), half).alias("l"), F.substr(value, half + 1, F.length(value)).alias("r"))
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.struct(s["r"].alias("l"), _shift(s["l"], _digest(kind, i, s["r"], key)).alias("r")),
        lambda s: F.concat(s["l"], s["r"]),
    )
    return done


def permuted_number(value: Column, a: int, b: int, kind: str, key: str) -> Column:
    """A Feistel network over Z_a x Z_b: a permutation of 0 .. a*b-1."""
    start = F.struct(F.floor(value / b).cast("long").alias("l"), (value % b).cast("long").alias("r"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)),
        start,
        lambda s, i: F.when(
            i % 2 == 1, F.struct(((s["l"] + _number(_digest(kind, i, s["r"], key), F.lit(a))) % a).alias("l"), s["r"].alias("r"))
        ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _number(_digest(kind, i, s["l"], key), F.lit(b))) % b).alias("r"))),
        lambda s: s["l"] * b + s["r"],
    )


def _luhn_sum(digits: Column, double_first: bool) -> Column:
    """Sum of digits from the right, every second one doubled (the first one from the right, if told so)."""
    back = F.split(F.reverse(digits), "")
    turn = 0 if double_first else 1
    worth = F.transform(back, lambda c, i: F.when(i % 2 == turn, F.expr("0") + (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), lambda x, y: x + y)


def is_card(value: Column) -> Column:
    return _luhn_sum(F.regexp_replace(value, "[ -]", ""), False) % 10 == 0


def _card(value: Column, key: str) -> Column:
    """All digits but the last are permuted; the last one is the new check digit."""
    n = F.length(value)
    body = permuted_text(F.substr(value, F.lit(1), n - 1), "card", key)
    check = (F.lit(10) - _luhn_sum(F.regexp_replace(body, "[ -]", ""), True) % 10) % 10
    return F.concat(body, check.cast("string"))


def _date(value: Column, key: str) -> Column:
    """Valid dates of two centuries are permuted; the pattern they are written in stays."""
    iso = F.substring(value, 5, 1) == "-"
    day = F.when(iso, F.try_to_date(value, "yyyy-MM-dd")).otherwise(F.try_to_date(value, "MM/dd/yyyy"))
    moved = F.date_add(F.lit(FIRST_DAY).cast("date"), permuted_number(F.datediff(day, F.lit(FIRST_DAY).cast("date")).cast("long"), DAYS_A, DAYS_B, "date", key).cast("int"))
    return F.when(day.isNull(), value).when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(F.date_format(moved, "MM/dd/yyyy"))


def _address(value: Column, key: str) -> Column:
    part = F.split(value, r"\.")
    whole = F.aggregate(part, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    moved = permuted_number(whole, 65536, 65536, "address", key)
    return F.array_join(F.transform(F.array(*[F.lit(k) for k in (24, 16, 8, 0)]), lambda k: (F.floor(moved / F.pow(F.lit(2), k)).cast("long") % 256).cast("string")), ".")


def _social(value: Column, key: str) -> Column:
    """Valid numbers only: 898 areas (not 000, 666 or 9xx) x 99 groups x 9,999 serials."""
    area, group, serial = (F.split(value, "-")[k].cast("long") for k in range(3))
    place = (F.when(area > 666, area - 2).otherwise(area - 1) * 99 + group - 1) * 9999 + serial - 1
    moved = permuted_number(place, 898 * 99, 9999, "social", key)
    index = F.floor(moved / (99 * 9999)).cast("long")
    return F.format_string(
        "%03d-%02d-%04d", F.when(index >= 665, index + 2).otherwise(index + 1), F.floor(moved / 9999).cast("long") % 99 + 1, moved % 9999 + 1
    )


def kind_of(value: Column) -> Column:
    """The kind of a match, or null where it fails validation."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(F.contains(value, F.lit("@")), "email")
        .when(F.rlike(value, F.lit(r"^(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})$")), F.when(_date_ok(value), "date"))
        .when(F.rlike(value, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")), "social")
        .when(F.rlike(value, F.lit(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")), "address")
        .when((digits >= 13) & F.rlike(value, F.lit(r"^[0-9 -]+$")), F.when(is_card(value), "card"))
        .otherwise("phone")
    )


def _date_ok(value: Column) -> Column:
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "MM/dd/yyyy")).isNotNull()


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one matched value; a value that fails validation stays."""
    kind, at = kind_of(value), F.instr(value, "@")
    return (
        F.when(kind == "email", F.concat(permuted_text(F.substr(value, F.lit(1), at - 1), "email", key), F.substr(value, at, F.length(value))))
        .when(kind == "phone", _phone(value, key))
        .when(kind == "social", _social(value, key))
        .when(kind == "date", _date(value, key))
        .when(kind == "address", _address(value, key))
        .when(kind == "card", _card(value, key))
        .otherwise(value)
    )


def _permuted_phone(digits: Column, key: str) -> Column:
    """Ten digits within their class: valid numbers (area and exchange from 200), valid areas only, and the rest."""
    area, exchange, line = F.substring(digits, 1, 3).cast("long"), F.substring(digits, 4, 3).cast("long"), F.substring(digits, 7, 4).cast("long")
    valid = permuted_number(((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, 80_000, "phone", key)
    half = permuted_number(((area - 200) * 200 + exchange) * 10_000 + line, 40_000, 40_000, "phone-area", key)
    other = permuted_number((area * 1000 + exchange) * 10_000 + line, 40_000, 50_000, "phone-other", key)
    whole = lambda x, first, size, least: F.format_string("%03d%03d%04d", F.floor(x / (size * 10_000)).cast("long") + first, F.floor(x / 10_000).cast("long") % size + least, x % 10_000)
    return F.when(area < 200, whole(other, 0, 1000, 0)).when(exchange < 200, whole(half, 200, 200, 0)).otherwise(whole(valid, 200, 800, 200))


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the ten digits are permuted together, so a number is linked however it is spaced."""
    code = F.regexp_extract(value, r"^(\+?1[ .-]?(?=[(0-9 .-]))?", 1)
    code = F.when(F.length(F.regexp_replace(value, "[^0-9]", "")) > 10, code).otherwise("")
    rest = F.substr(value, F.length(code) + 1, F.length(value))
    moved = _permuted_phone(F.regexp_replace(rest, "[^0-9]", ""), key)
    # the digits return to their places: area, exchange and line with what stands between them
    marks = [F.regexp_extract(rest, r"^(\D*)\d{3}(\D*)\d{3}(\D*)\d{4}$", k) for k in (1, 2, 3)]
    return F.concat(code, marks[0], F.substring(moved, 1, 3), marks[1], F.substring(moved, 4, 3), marks[2], F.substring(moved, 7, 4))


def pseudonymised(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """docs with each personal value of `text` replaced; counts: also how many of each kind (n_<kind>)."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("_text"))
    rows = rows.withColumn("_found", F.when(F.rlike("_text", F.lit("[0-9]|@")), F.regexp_extract_all("_text", F.lit(f"({ANY})"), F.lit(0))))
    some = F.size(F.coalesce("_found", F.array().cast("array<string>"))) > 0
    gaps = F.split("_text", ANY, -1)
    new = F.transform("_found", lambda m: pseudonym(m, key))
    joined = F.array_join(F.zip_with(gaps, F.array_append(new, F.lit("")), lambda gap, value: F.concat(gap, value)), "")
    rows = rows.withColumn("_new", F.when(some, joined).otherwise(F.col("_text")))
    out = [F.col("_new").alias(c) if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in docs.columns]
    if counts:
        kinds = F.when(some, F.transform("_found", kind_of)).otherwise(F.array().cast("array<string>"))
        rows = rows.withColumn("_kinds", kinds)
        out += [F.size(F.filter("_kinds", _is(name))).cast("long").alias(f"n_{name}") for name in KINDS]
    return rows.select(*out)


def _is(name: str):
    return lambda kind: kind == name


def op5(docs: DataFrame) -> DataFrame:
    return pseudonymised(docs.select("doc_id", "text"), session_key(docs.sparkSession), counts=True)
