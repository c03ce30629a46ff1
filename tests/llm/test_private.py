import datetime
import hashlib
import re

import regex

from meshweave.llm import private, queries
from pyspark.sql import functions as F

from tests.llm.texts import empty, odd


def luhn(x):
    total = 0
    for i, c in enumerate(reversed(re.sub(r"\D", "", x))):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def made(spark, text, key="k"):
    row = private.pseudonyms(spark.createDataFrame([(1, text)], "doc_id long, text string"), key).first()
    return row.text, [(h.kind, h.value, h.pseudonym) for h in row._pii]


def test_every_kind_keeps_its_format(spark):
    text = "mail a.b@mail5.example.com, card 4111 1111 1111 1111; not 4111 1111 1111 1112. call +1 (323) 555-9830 or 212-555-0134, ip 8.196.197.208 not 300.1.1.1, ssn 123-45-6789 not 000-12-3456, born 1984-02-29 or 29/02/1984 or 31.12.1999, not 2023-02-30; token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""
    got, hits = made(spark, text)
    kinds = [h[0] for h in hits]
    assert kinds == ["email", "card", "phone", "phone", "ip", "ssn", "date", "date", "date", "secret"]
    for kind, value, new in hits:
        assert value != new and value not in got and new in got
        if kind != "email":
            assert len(new) == len(value) or kind == "ip"
            assert re.sub(r"[0-9a-f]", "0", new) == re.sub(r"[0-9a-f]", "0", value) or kind == "ip"
    assert luhn(hits[1][2]) and hits[2][2].startswith("+1 (")
    assert hits[6][2] == "-".join(reversed(hits[7][2].split("/")))
    assert made(spark, "hosts 10.001.2.3 and 10.1.2.3")[0].startswith("hosts 10.001.2.3 and ")
    for kept in ("4111 1111 1111 1112", "300.1.1.1", "000-12-3456", "2023-02-30"):
        assert kept in got
    assert made(spark, text, "other")[0] != got and made(spark, text)[0] == got


def test_permutes(spark):
    x = spark.range(271 * 13).select(private.feistel(F.col("id"), 271, 13, "k", F.lit("t")).alias("y"))
    assert sorted(r.y for r in x.collect()) == list(range(271 * 13))
    d = spark.range(1000).select(private.digits_permuted(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("y"))
    assert sorted(r.y for r in d.collect()) == [f"{i:03d}" for i in range(1000)]
    h = spark.range(256).select(private.secret_string(F.concat(F.lit("a1"), F.lpad(F.lower(F.hex("id")), 2, "0")), "k").alias("y"))
    assert len({r.y for r in h.collect()}) == 256


def keyed(secret, *parts):
    return int(hashlib.sha256("|".join([secret, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def feistel(x, a, b, secret, tweak):
    left, right = divmod(x, b)
    for i in range(private.ROUNDS):
        if i % 2:
            right = (right + keyed(secret, tweak, i, left) % b) % b
        else:
            left = (left + keyed(secret, tweak, i, right) % a) % a
    return left * b + right


def plain_digits(x, secret, tweak):
    low = len(x) // 2
    return str(feistel(int(x), 10 ** (len(x) - low), 10**low, secret, f"{tweak}:{len(x)}")).zfill(len(x))


def put(pattern, digits):
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in pattern)


def plain_date(x, secret):
    forms = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}
    mark = next(c for c in x if not c.isdigit())
    first = datetime.date(1900, 1, 1)
    if mark != "-" and int(x[3:5]) > 12:
        try:
            day = datetime.date(int(x[6:]), int(x[:2]), int(x[3:5]))
        except ValueError:
            return None
        if not 1900 <= day.year <= 2100:
            return None
        if (day.month, day.day) == (2, 29):
            new = datetime.date(1904 + 4 * feistel((day.year - 1904) // 4, 7, 7, secret, "leap"), 2, 29)
        else:  # by listing the year
            places = [(m + 1, d) for m, n in enumerate(private.MONTHS) for d in range(13, n + 1)]
            year, place = divmod(feistel((day.year - 1900) * 221 + places.index((day.month, day.day)), 201, 221, secret, "turned"), 221)
            new = datetime.date(1900 + year, *places[place])
        return new.strftime(f"%m{mark}%d{mark}") + f"{new.year:04d}"
    try:
        day = (datetime.datetime.strptime(x, forms[mark]).date() - first).days
    except ValueError:
        return None
    return (first + datetime.timedelta(feistel(day, 271, 271, secret, "date"))).strftime(forms[mark]) if 0 <= day < 271**2 else None


def plain(kind, x, secret):
    """What the operator puts in the place of x, by the same permutations in plain Python."""
    digits = re.sub(r"\D", "", x)
    if kind == "email":
        return "p" + hashlib.sha256(f"{secret}|email|{x.lower()}".encode()).hexdigest()[:16] + "@example.invalid"
    if kind == "secret":
        if not re.search("[0-9]", x) or not re.search("[a-f]", x):
            return None
        out = []
        for at in range(0, len(x), 8):
            g = x[at : at + 8]
            low = len(g) // 2
            out.append(format(feistel(int(g, 16), 16 ** (len(g) - low), 16**low, secret, f"secret:{x[:at]}"), "x").zfill(len(g)))
        return "".join(out)
    if kind == "date":
        return plain_date(x, secret)
    if kind == "ssn":
        area, group, serial = map(int, x.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        rest, serial = divmod(feistel((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, 898 * 99, 9999, secret, "ssn"), 9999)
        return f"{areas[rest // 99]:03d}-{rest % 99 + 1:02d}-{serial + 1:04d}"
    if kind == "ip":
        parts = x.split(".")
        if any(int(p) > 255 or str(int(p)) != p for p in parts):
            return None
        return ".".join(map(str, feistel(int.from_bytes(map(int, parts)), 65536, 65536, secret, "ip").to_bytes(4)))
    if kind == "phone":
        country = re.match(r"(\+[0-9]{1,3}[ .-]?)?", x)[0]
        return country + put(x[len(country) :], plain_digits(re.sub(r"\D", "", x[len(country) :]), secret, "phone"))
    if not luhn(digits):
        return None
    body = plain_digits(digits[:-1], secret, "card")
    return put(x, body + next(c for c in "0123456789" if luhn(body + c)))


#: The order in which the kinds of one place are told apart.
SHAPES = (
    ("email", "@"), ("secret", r"^[0-9a-f]{32,}$"), ("date", r"^(\d{4}-\d\d-\d\d|\d\d([/.])\d\d\2\d{4})$"), ("ssn", r"^\d{3}-\d\d-\d{4}$"), ("ip", r"^\d{1,3}(\.\d{1,3}){3}$"),
    ("phone", r"^(\+\d{1,3}[ .-]?)?(\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}$"), ("card", ""),
)


def brute(text, secret):
    def one(m):
        kind = next(k for k, shape in SHAPES if re.search(shape, m[0]))
        return plain(kind, m[0], secret) or m[0]

    return None if text is None else regex.sub(private.ANY, one, text)


def test_query_equals_plain_python(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r.text for r in queries.op7_pii(spark, small).collect()}
    assert got == {d: brute(t, queries.PII_KEY) for d, t in docs.items()} and got != docs


def test_dates_never_collide(spark):
    days = [datetime.date(1900, 1, 1) + datetime.timedelta(k) for k in range(0, 271**2, 5)] + [datetime.date(y, 2, 29) for y in range(1904, 2097, 4)]
    texts = sorted({d.strftime(f) for d in days for f in ("%d/%m/%Y", "%m/%d/%Y")} | {"13/13/2000", "02/30/2000", "01/13/2101", "02/29/1900"})
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = {r.text: r.made or r.text for r in frame.select("text", private.date(F.col("text"), "k").alias("made")).collect()}
    assert len(rows) == len(set(rows.values())) == len(texts)
    assert rows == {t: plain_date(t, "k") or t for t in texts}


def test_query_leaves_no_value_and_no_other_change(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_pii(spark, small).collect()}
    assert got.keys() == docs.keys()
    pii = re.compile(r"[\w.]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{16}\b|\b[0-9a-f]{40}\b")
    for doc, text in docs.items():
        for value in pii.findall(text):
            if not (len(value) == 16 and value.isdigit() and not luhn(value)):
                assert value not in got[doc].text, value
        if not re.search(r"[0-9@]", text):
            assert got[doc].text == text


def test_odd_rows(spark):
    docs = odd(spark, True, True)
    rows = private.pseudonyms(docs, "k")
    assert rows.columns == [*docs.columns, "_pii_"] and rows.where("_pii = '11' and _hits = '12'").count() == 11
    assert sorted((str(r.doc_id), r.text or "") for r in rows.collect()) == sorted((str(r.doc_id), r.text or "") for r in docs.collect())
    assert private.pseudonyms(empty(spark), "k").count() == 0
