"""Archives by round trip, pseudonyms by format, linkage and one-to-one mapping."""

import base64
import datetime
import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowguard.llm import pseudonyms, warc

from .cases import SCHEMA, awkward, row, table

PAGES = "page_id long, url string, html string, digest string, first long"


def _pages():
    html = ["<html>%d</html>" % (i % 7) * (i % 7) for i in range(60)] + ["é" * 50_000, None, ""]
    rows = [(i, None if i % 5 == 0 else f"http://x.org/{i}?q=é\r\nEvil: 1", h, "d", 1) for i, h in enumerate(html)]
    return rows + [(4, "http://again", html[4], "d", 1), (None, None, html[3], "d", 1), (None, None, "only without id", "d", 1)]


def test_round_trip(spark, tmp_path):
    rows = _pages()
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES).repartition(3), f"{tmp_path}/w", archive_bytes=3_000)
    got = warc.read_archives(archives).collect()
    assert len(got) == len(rows) and all(g.problem is None for g in got)
    first = {}
    for page, _, html, *_ in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    expected = []
    for page, _, html, *_ in rows:
        data = (html or "").encode()
        to = first.get(html or "")
        revisit = to is not None and page != to
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        expected.append((page, len(data), digest, "revisit" if revisit else "response", to if revisit else None, None if revisit else data))
    assert Counter((g.page_id, g.payload_bytes, g.payload_digest, g.record_type, g.refers_to, g.payload and bytes(g.payload)) for g in got) == Counter(
        (*e[:5], e[5] or (None if e[5] is None else e[5])) for e in expected
    )


def test_small_payloads_are_responses(spark, tmp_path):
    rows = [(1, "u", "abc", "", 0), (2, "u", "abc", "", 0), (3, "u", "abcdef", "", 0), (4, "u", "abcdef", "", 0)]
    archives = warc.write_archives(spark.createDataFrame(rows, PAGES), f"{tmp_path}/w", least_revisit_bytes=5)
    got = {g.page_id: g.refers_to for g in warc.read_archives(archives, payloads=False).collect()}
    assert got == {1: None, 2: None, 3: None, 4: 3}
    empty = warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/e")
    assert warc.read_archives(empty).collect() == []


def test_damage_is_told(spark, tmp_path):
    rows = [(i, "u", f"page {i} " * 40, "", 0) for i in range(20)]
    (path,) = [r.path for r in warc.write_archives(spark.createDataFrame(rows, PAGES).coalesce(1), f"{tmp_path}/w").collect()]
    name = path.removeprefix("file:")
    data = open(name, "rb").read()
    open(name, "wb").write(data[:-10])
    got = warc.read_archives(spark.createDataFrame([(path,)], "path string")).orderBy("number").collect()
    assert [g.problem is None for g in got] == [True] * 19 + [False]
    # Damage in the middle costs the records it hits, and one row for each gap.
    frame = lambda i: [m.start() for m in re.finditer(re.escape(warc.ZSTD_MAGIC), data)][i]
    for at, lost in ((frame(6) + 1, 1), (frame(6) + 30, 1), (frame(19) + 2, 1), (None, 0)):
        hurt = bytearray(data)
        if at is not None:
            hurt[at] ^= 0xFF
        open(name, "wb").write(hurt)
        got = warc.read_archives(spark.createDataFrame([(path,)], "path string")).orderBy("number").collect()
        assert sum(g.problem is not None for g in got) == lost and len(got) == 20, (at, [g.problem for g in got])
    good = warc.record(7, "http://a", b"body", False, None, "2024-01-01T00:00:00Z")
    assert warc.parse_record(good)["problem"] is None
    for bad in (
        good.replace(b"WARC/1.1", b"WARK/1.1"), good.replace(b"WARC-Date", b"X-Date"), good[:-4], good.replace(b"body", b"bodY"),
        good.replace(b"Content-Length: 4\r", b"Content-Length: 5\r"), good.replace(b"WARC-Type: response", b"WARC-Type: revisit"),
    ):
        assert warc.parse_record(bad)["problem"]


def _luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def _shape(s):
    return re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))


VALID = {
    "email": ["und.34@mail7.example.com", "a@b.org"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "date": ["2020-05-13", "13.05.2020", "05/13/2020", "29.02.2024"],
    "social": ["123-45-6789", "899-99-9999"],
    "address": ["97.51.17.173", "8.8.8.8"],
    "card": ["4041894974608795", "4041-8949-7460-8795", "4041 8949 7460 8795"],
    "phone": ["+1 (389) 555-5010", "+44 20 7946 0958", "(389) 555-5010"],
}
INVALID = ["4041894974608796", "2020-02-30", "1850-01-01", "000-12-3456", "666-12-3456", "300.1.1.1", "1.2.3.4.5", "DE88370400440532013000", "v4.0.", "x1234567812345678"]


def _replace(spark, texts, key="k"):
    docs = table(spark, [row(i, t) for i, t in enumerate(texts)])
    return {r.doc_id: r for r in pseudonyms.pseudonymise(docs, key).collect()}


def test_values_keep_their_format(spark):
    flat = [(k, v) for k, vs in VALID.items() for v in vs]
    texts = [f"é {v}, and {v}!! \n{v}" for _, v in flat] + [f"a {v} b" for v in INVALID]
    got = _replace(spark, texts)
    for i, (kind, value) in enumerate(flat):
        found = re.fullmatch(r"é (.*), and \1!! \n\1", got[i].text, re.S)
        assert found and found[1] != value and got[i][f"n_{kind}"] == 3, (value, got[i].text)
        new = found[1]
        if kind != "address":
            assert _shape(new) == _shape(value)
        if kind == "card":
            assert _luhn(re.sub(r"\D", "", new))
        if kind == "iban":
            plain = new.replace(" ", "")
            assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
        if kind == "address":
            assert all(0 <= int(o) <= 255 for o in new.split(".")) and new.count(".") == 3
    for i, v in enumerate(INVALID, len(flat)):
        assert got[i].text == f"a {v} b"
    cards = {re.sub(r"\D", "", got[i].text.split(", and")[0]) for i, (k, _) in enumerate(flat) if k == "card"}
    days = {got[i].text.split()[1].strip(",") for i, (k, v) in enumerate(flat) if k == "date" and "2020" in v}
    assert len(cards) == 1 and len({tuple(sorted(re.split(r"\D", d))) for d in days}) == 1
    assert _replace(spark, texts, "other")[0].text != got[0].text


def test_permutations_are_one_to_one(spark):
    days = pseudonyms.permute_number(F.col("id"), (11, 13), "k", "x")
    assert sorted(r[0] for r in spark.range(143).select(days).collect()) == list(range(143))
    for n in (1, 3, 4):
        texts = pseudonyms.permute_text(F.lpad(F.col("id").cast("string"), n, "0"), "k", "x")
        assert sorted(r[0] for r in spark.range(10**n).select(texts).collect()) == [f"{i:0{n}d}" for i in range(10**n)]


@pytest.mark.parametrize("value,size", [("899-99-9999", 898 * 99 * 9_999 - 1), ("001-01-0001", 0)])
def test_social_ends(spark, value, size):
    area, group, serial = map(int, value.split("-"))
    assert ((area - 1 - (area > 666)) * 99 + group - 1) * 9_999 + serial - 1 == size


def test_awkward_rows(spark):
    rows = awkward()
    got = pseudonyms.pseudonymise(table(spark, rows), "k")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], r[1]) for r in rows)
    assert pseudonyms.pseudonymise(spark.createDataFrame([], SCHEMA), "k").collect() == []


MORE = {
    "iban": ["BE68 5390 0754 7034", "PL61 1090 1014 0000 0712 1981 2874", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "BE68539007547034"],
    "card": ["3782 822463 10005", "3782-822463-10005", "3056 930902 5904", "4041 8949 7460 8795", "4041 8949 7460 8790 007"],
    "phone": ["838-555-7235", "838.555.7235", "838 555 7235", "1-838-555-7235", "020 7946 0958", "0171/1234567", "01 23 45 67 89"],
}


@pytest.mark.parametrize("token", ["EUR", "PLN 5", "123", "x", "and 838-555-7235", "838 555 7235"])
def test_values_before_a_token(spark, token):
    flat = [(k, v) for k, vs in MORE.items() for v in vs]
    got = _replace(spark, [f"a {v} {token}" for _, v in flat])
    for i, (kind, value) in enumerate(flat):
        new = got[i].text[2 : 2 + len(value)]
        assert got[i][f"n_{kind}"] >= 1 and new != value and _shape(new) == _shape(value), (value, got[i].text)
        if "838" not in token:
            assert got[i].text == f"a {new} {token}"
        if kind == "card":
            assert _luhn(re.sub(r"\D", "", new))


def test_slash_dates_stay_apart_and_the_key_out_of_plans(spark):
    """All dates of the range in both slash forms: as many pseudonyms as texts, each of its own kind."""
    day = F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int"))
    days = spark.range(0, 319 * 229, 5).select(day.alias("day"))
    texts = days.select(F.date_format("day", "MM/dd/yyyy").alias("text")).union(days.select(F.date_format("day", "dd/MM/yyyy").alias("text"))).distinct()
    key = "very-secret"
    valid, value = pseudonyms._date(F.col("text"), key)
    made = texts.select("text", value.alias("new"), valid.alias("valid"))
    found = made.collect()
    rows = [r for r in found if r.valid]
    # Days of the last month, read with the month first, may lie behind the range.
    assert len(found) - len(rows) < 5 and len({r.new for r in rows}) == len(rows)
    assert all((int(r.text[:2]) > 12) == (int(r.new[:2]) > 12) for r in rows)
    whole = pseudonyms.pseudonymise(spark.createDataFrame([(1, "on 25/12/2020")], "doc_id long, text string"), key)
    assert key not in made._jdf.queryExecution().toString() and key not in whole._jdf.queryExecution().toString()


# --- the permutations in plain Python


def py_keyed(key, kind, *parts):
    own = hashlib.sha256(f"{kind}:{key}".encode()).hexdigest()
    return int(hashlib.sha256(":".join([own, *map(str, parts)]).encode()).hexdigest()[:15], 16)


def py_number(n, sizes, key, kind):
    a, b = divmod(n, sizes[1])
    for i in range(1, 11):
        if i % 2:
            a = (a + py_keyed(key, kind, i, b)) % sizes[0]
        else:
            b = (b + py_keyed(key, kind, i, a)) % sizes[1]
    return a * sizes[1] + b


def py_text(text, key, kind):
    n = len(text)
    a, b = text[: n // 2], text[n // 2 :]

    def moved(half, other, i):
        out = ""
        for at, c in enumerate(half):
            by = py_keyed(key, kind, n, i, at, other)
            for first, size in (("0", 10), ("a", 26), ("A", 26)):
                if 0 <= ord(c) - ord(first) < size and c.isascii():
                    c = chr(ord(first) + (ord(c) - ord(first) + by) % size)
                    break
            out += c
        return out

    for i in range(1, 11):
        if i % 2:
            a = moved(a, b, i)
        else:
            b = moved(b, a, i)
    return a + b


def py_refill(shape, digits):
    digits = iter(digits)
    return "".join(next(digits) if c.isascii() and c.isdigit() else c for c in shape)


def py_value(kind, m, key):
    only = re.sub(r"[^0-9]", "", m)
    if kind == "email":
        local, domain = m.rsplit("@", 1)
        return py_text(local.lower(), key, kind) + "@" + domain
    if kind == "social":
        area, group, serial = map(int, m.split("-"))
        x = py_number(((area - 1 - (area > 666)) * 99 + group - 1) * 9_999 + serial - 1, (898 * 99, 9_999), key, kind)
        area, group, serial = x // (99 * 9_999), x // 9_999 % 99, x % 9_999
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
    if kind == "address":
        x = py_number(int.from_bytes(bytes(map(int, m.split("."))), "big"), (1 << 16, 1 << 16), key, kind)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "card":
        body = py_text(only[:-1], key, kind)
        return py_refill(m, body + next(d for d in "0123456789" if _luhn(body + d)))
    if kind == "iban":
        plain = m.replace(" ", "")
        body = py_refill(plain[4:], py_text(re.sub(r"[^0-9]", "", plain[4:]), key, kind))
        check = 98 - int("".join(str(int(c, 36)) for c in body + plain[:2] + "00")) % 97
        return py_refill(m, f"{check:02d}" + re.sub(r"[^0-9]", "", body))
    if kind == "phone":
        code = re.match(r"(\+[0-9]{1,3})(?=[ .(-])", m)
        code = code[1] if code else ""
        rest = m[len(code) :]
        return code + py_refill(rest, py_text(re.sub(r"[^0-9]", "", rest), key, kind))
    form = next(f for f in ("%Y-%m-%d", "%d.%m.%Y", "%m/%d/%Y", "%d/%m/%Y") if _parses(m, f))
    first = datetime.date(1900, 1, 1)
    x = (datetime.datetime.strptime(m, form).date() - first).days
    while True:
        x = py_number(x, (319, 229), key, kind)
        day = first + datetime.timedelta(days=x)
        if form != "%d/%m/%Y" or day.day > 12:
            return day.strftime(form)


def _parses(text, form):
    try:
        return len(text) == 10 and datetime.datetime.strptime(text, form) is not None
    except ValueError:
        return False


def test_whole_texts_equal_a_plain_program(spark):
    r = np.random.default_rng(4)
    flat = [(k, v) for group in (VALID, MORE) for k, vs in group.items() for v in vs] + [("date", "31/12/1999"), ("date", "12/31/1999")]
    texts, want = [], []
    for _ in range(60):
        chosen = [flat[i] for i in r.integers(0, len(flat), 4)]
        texts.append("; ".join(f"é {v}" for _, v in chosen))
        want.append("; ".join(f"é {py_value(k, v, "k")}" for k, v in chosen))
    got = _replace(spark, texts, "k")
    assert [got[i].text for i in range(len(texts))] == want
