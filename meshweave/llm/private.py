"""Format-preserving pseudonyms for personal data, keyed Feistel permutations in SQL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshweave.llm.common import free_name

ROUNDS = 10
#: What is looked for, the first that fits at a place; each is validated after that.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}",
    "secret": r"(?<![\p{L}\p{N}])[0-9a-f]{32,128}(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\p{L}\p{N}/-])",
    "ssn": r"(?<![\p{L}\p{N}-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}-])",
    "ip": r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])",
    "phone": r"(?<![\p{L}\p{N}])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![\p{L}\p{N}])",
    "card": r"(?<![\p{L}\p{N}.-])[0-9](?:[ -]?[0-9]){12,18}(?![\p{L}\p{N}])",
}
ANY = "|".join(f"({x})" for x in PATTERNS.values())
#: Days of the dates that are permuted: 271 * 271 of them from 1900-01-01 on (to 2101-01-27).
FIRST_DAY, DAY_SIDE = "1900-01-01", 271
#: Days of the months of a common year. Years of the dates that are written month before day.
MONTHS = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
TURNED_YEARS = (1900, 2100)


def keyed(secret: str, *parts: Column) -> Column:
    """60 bits of SHA-256 over the key and the parts, as a long."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(secret), *(x.cast("string") for x in parts)), 256), 1, 15), 16, 10).cast("long")


def feistel(x: Column, a: Column | int, b: Column | int, secret: str, tweak: Column) -> Column:
    """A keyed permutation of 0 .. a*b-1: the halves x div b and x mod b add a keyed hash of each other in turn."""
    a, b = (v if isinstance(v, Column) else F.lit(v).cast("long") for v in (a, b))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s.l + F.pmod(keyed(secret, tweak, i, s.r), a), a)
        right = F.pmod(s.r + F.pmod(keyed(secret, tweak, i, s.l), b), b)
        return F.struct(F.when(i % 2 == 0, left).otherwise(s.l).alias("l"), F.when(i % 2 == 1, right).otherwise(s.r).alias("r"))

    start = F.struct(F.call_function("div", x, b).alias("l"), F.pmod(x, b).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s.l * b + s.r)


def power(base: int, n: Column) -> Column:
    return F.aggregate(F.array_repeat(F.lit(base).cast("long"), n.cast("int")), F.lit(1).cast("long"), lambda x, y: x * y)


def digits_permuted(digits: Column, secret: str, tweak: str, base: int = 10) -> Column:
    """A digit string of at most 18 decimal or 14 hexadecimal digits, permuted among those of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    value = digits.cast("long") if base == 10 else F.conv(digits, 16, 10).cast("long")
    made = feistel(value, power(base, n - low), power(base, low), secret, F.concat(F.lit(f"{tweak}:"), n))
    return F.lpad(made.cast("string") if base == 10 else F.lower(F.hex(made)), n, "0")


def luhn_sum(digits: Column, odd: int) -> Column:
    """The Luhn sum of a digit string; every second digit from the right is doubled, beginning with place `odd`."""
    seen = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == odd, F.element_at(F.array(*map(F.lit, (0, 2, 4, 6, 8, 1, 3, 5, 7, 9))), c.cast("int") + 1)).otherwise(c.cast("int")))
    return F.aggregate(seen, F.lit(0), lambda x, y: x + y)


def reshaped(pattern: Column, digits: Column) -> Column:
    """`digits` in the places of the digits of `pattern`, whose other characters stay."""
    marks = F.split(pattern, "")
    put = F.aggregate(
        marks,
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(s.s, F.substr(digits, s.n + 1, F.lit(1))).alias("s"), (s.n + 1).alias("n"))).otherwise(F.struct(F.concat(s.s, c).alias("s"), s.n.alias("n"))),
        lambda s: s.s,
    )
    return put


def card(x: Column, secret: str) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    body = digits_permuted(F.left(digits, F.length(digits) - 1), secret, "card")
    check = F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string")
    return F.when(F.length(digits).between(13, 19) & (luhn_sum(digits, 1) % 10 == 0), reshaped(x, F.concat(body, check)))


def phone(x: Column, secret: str) -> Column:
    own = F.regexp_extract(x, r"^(\+[0-9]{1,3}[ .-]?)?(.*)$", 2)
    country = F.left(x, F.length(x) - F.length(own))
    digits = F.regexp_replace(own, "[^0-9]", "")
    return F.concat(country, reshaped(own, digits_permuted(digits, secret, "phone")))


def ip(x: Column, secret: str) -> Column:
    """IPv4 in its plain form, without leading zeros."""
    parts = F.transform(F.split(x, r"\."), lambda p: p.cast("long"))
    valid = F.forall(parts, lambda p: p <= 255) & ~x.rlike(r"(?:^|\.)0[0-9]")
    made = feistel(F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p), 65536, 65536, secret, F.lit("ip"))
    return F.when(valid, F.concat_ws(".", *(F.pmod(F.shiftright(made, k), F.lit(256)).cast("string") for k in (24, 16, 8, 0))))


def ssn(x: Column, secret: str) -> Column:
    area, group, serial = (F.substring(x, *at).cast("long") for at in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    packed = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1
    made = feistel(packed, 898 * 99, 9999, secret, F.lit("ssn"))
    at = F.floor(made / (99 * 9999))
    return F.when(valid, F.format_string("%03d-%02d-%04d", at + F.when(at >= 665, 2).otherwise(1), F.pmod(F.floor(made / 9999), F.lit(99)) + 1, F.pmod(made, F.lit(9999)) + 1))


def turned_date(x: Column, mark: str, secret: str) -> Column:
    """Month before day, where only that is a date: the day is 13 or more. These dates are permuted among themselves, as
    place 0..220 in the year (29 February apart, among the leap years), so no pseudonym reads as day before month."""
    month, day, year = (F.substring(x, *at).try_cast("int") for at in ((1, 2), (4, 2), (7, 4)))
    # the places before each month, and one behind December: a month has its days less twelve
    before = [sum(n - 12 for n in MONTHS[:k]) for k in range(13)]
    first = F.array(*map(F.lit, before))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last_day = F.when((month == 2) & leap, 29).otherwise(F.get(F.array(*map(F.lit, MONTHS)), month - 1))
    put = lambda m, d, y: F.format_string(f"%02d{mark}%02d{mark}%04d", m, d, y)
    made = feistel(((year - TURNED_YEARS[0]) * before[12] + F.get(first, month - 1) + day - 13).cast("long"), TURNED_YEARS[1] - TURNED_YEARS[0] + 1, before[12], secret, F.lit("turned"))
    place = F.pmod(made, F.lit(before[12])).cast("int")
    m = F.size(F.filter(first, lambda c: c <= place))
    plain = put(m, place - F.get(first, m - 1) + 13, F.floor(made / before[12]) + TURNED_YEARS[0])
    # leap years from 1904 to 2096: 49
    leaps = put(F.lit(2), F.lit(29), feistel(((year - 1904) / 4).cast("long"), 7, 7, secret, F.lit("leap")) * 4 + 1904)
    valid = month.between(1, 12) & (day >= 13) & (day <= last_day) & year.between(*TURNED_YEARS)
    return F.when(valid, F.when((month == 2) & (day == 29), leaps).otherwise(plain))


def date(x: Column, secret: str) -> Column:
    """ISO dates, and day before month with / or . (month before day where only that is a date)."""

    def permuted(form: str) -> Column:
        day = F.datediff(F.try_to_timestamp(x, F.lit(form)).cast("date"), F.lit(FIRST_DAY).cast("date")).cast("long")
        made = feistel(day, DAY_SIDE, DAY_SIDE, secret, F.lit("date"))
        return F.when(day.between(0, DAY_SIDE**2 - 1), F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), made.cast("int")), form))

    def by_day(mark: str, form: str) -> Column:
        only_turned = F.substring(x, 4, 2).try_cast("int") > 12
        return F.when(only_turned, turned_date(x, mark, secret)).otherwise(permuted(form))

    return F.when(x.contains("-"), permuted("yyyy-MM-dd")).when(x.contains("/"), by_day("/", "dd/MM/yyyy")).otherwise(by_day(".", "dd.MM.yyyy"))


def secret_string(x: Column, secret: str) -> Column:
    """Hexadecimal digits, by groups of 8; each group's permutation also depends on those before it."""
    groups = F.transform(F.sequence(F.lit(0), F.floor((F.length(x) - 1) / 8).cast("int")), lambda i: F.substr(x, i * 8 + 1, F.lit(8)))

    def one(g: Column, i: Column) -> Column:
        n = F.length(g)
        low = F.floor(n / 2).cast("int")
        made = feistel(F.conv(g, 16, 10).cast("long"), power(16, n - low), power(16, low), secret, F.concat(F.lit("secret:"), F.left(x, i * 8)))
        return F.lpad(F.lower(F.hex(made)), n, "0")

    return F.when(x.rlike("[0-9]") & x.rlike("[a-f]"), F.concat_ws("", F.transform(groups, one)))


def email(x: Column, secret: str) -> Column:
    """No number: a keyed hash takes the place of the name and the host."""
    return F.concat(F.lit("p"), F.substring(F.sha2(F.concat(F.lit(f"{secret}|email|"), F.lower(x)), 256), 1, 16), F.lit("@example.invalid"))


KINDS = {"email": email, "secret": secret_string, "date": date, "ssn": ssn, "ip": ip, "phone": phone, "card": card}


def is_kind(kind: str):
    return lambda hit: hit.kind == kind


def pseudonyms(docs: DataFrame, secret: str, text: str = "text", found: str = "_pii") -> DataFrame:
    """`docs` with personal data in `text` replaced, and, last, the column `found`: array of (kind, value, pseudonym). If
    `docs` has a column of that name, underscores are added to ours; all columns of `docs` stay.

    Validated numbers and dates are permuted within their format under the key `secret`, so equal values get equal
    pseudonyms in all documents and different ones stay different: cards (Luhn, which the pseudonym passes too), phone
    numbers (the country code stays), IPv4 addresses, US social security numbers, dates from 1900 to 2101-01-27 (to
    2100 where the month stands first), and hexadecimal secrets of 32 digits or more. E-mail addresses get a keyed hash. What fails its validation stays as it
    is. Null texts stay null; every other column and row is unchanged.
    """
    seen = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))

    def kind_of(x: Column) -> Column:
        tests = {
            "email": x.contains("@"), "secret": x.rlike("^[0-9a-f]{32,}$"), "date": x.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2[0-9]{4})$"),
            "ssn": x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ip": x.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "phone": x.rlike(r"^(\+[0-9]{1,3}[ .-]?)?(\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}$"),
        }
        return reduce(lambda rest, k: F.when(tests[k], F.lit(k)).otherwise(rest), reversed(tests), F.lit("card"))

    def replaced(s: Column) -> Column:
        made = reduce(lambda rest, k: F.when(s.kind == k, KINDS[k](s.value, secret)).otherwise(rest), KINDS, F.lit(None).cast("string"))
        return F.struct(s.kind.alias("kind"), s.value.alias("value"), made.alias("pseudonym"))

    hits = F.transform(F.transform(seen, lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value"))), replaced)
    may = F.col(text).rlike("[0-9@]") & F.col(text).rlike(ANY)
    empty = F.array().cast("array<struct<kind:string,value:string,pseudonym:string>>")
    held = free_name(docs, "_hits")
    marked = docs.withColumn(held, F.when(may, hits).otherwise(empty))
    between = F.split(F.col(text), ANY, -1)
    put = F.array_join(F.zip_with(between, F.col(held), lambda g, h: F.concat(g, F.coalesce(h.pseudonym, h.value, F.lit("")))), "")
    return marked.withColumn(text, F.when(F.size(held) > 0, put).otherwise(F.col(text))).withColumn(free_name(docs, found), F.filter(held, lambda h: h.pseudonym.isNotNull())).drop(held)
