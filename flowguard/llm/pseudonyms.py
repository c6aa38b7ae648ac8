"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Found values are validated, then permuted by a keyed Feistel network inside
their own format: a card number becomes a card number with a right check digit,
a date another date. Equal values get equal pseudonyms in every document, and
different values of a format different pseudonyms. Everything is Spark expressions: a text is
cut at the matches of one pattern, the matches are permuted, the parts joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import whole

#: Even, so that both halves are changed equally often.
ROUNDS = 10

# How long the IBANs of a country are, by the registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """An IBAN of its country's length, so that it doesn't take in a token behind it, or else of any length."""
    forms = []
    for n, countries in IBAN_LENGTHS.items():
        groups, rest = divmod(n - 4, 4)
        tail = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
        forms.append(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{tail}")
    known = f"(?:{'|'.join(forms)})(?![0-9A-Za-z_])"
    return rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{known}|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?)"


# What each kind looks like, as it stands between other characters than letters, digits and _.
PATTERNS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "iban": _iban_pattern(),
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4}",
    "social": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "address": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.[0-9])",
    "card": (
        r"[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}(?![.-][0-9]| [0-9]{3}[ .-][0-9]{4})|[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"
        r"|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}"
    ),
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}"
    # National forms: three groups with the area first, or a trunk 0.
    r"|(?<![0-9][.-])(?:(?:1[ .-])?[2-9][0-9]{2}[ .-][2-9][0-9]{2}[ .-][0-9]{4}"
    r"|0[0-9]{1,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}|0[0-9](?:[ .-][0-9]{2}){4}|0[0-9]{2,4}[ /-][0-9]{5,8})",
}
ANY = r"(?<![0-9A-Za-z_])(?:" + "|".join(PATTERNS.values()) + r")(?![0-9A-Za-z_])"
DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy", "MM/dd/yyyy", "dd/MM/yyyy")
# 73,051 days from 1900-01-01 to 2100-01-02, a number with two factors of about one size.
FIRST_DAY, DAYS = "1900-01-01", (319, 229)
# Three of five days can't be months: the odds of so many turns are below 10^-50.
MOST_TURNS = 128
# Social numbers: areas 001-899 but 666, groups 01-99, serials 0001-9999.
SOCIAL = (898 * 99, 9_999)
ADDRESSES = (1 << 16, 1 << 16)


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def round_key(key: str, kind: str) -> str:
    """What a kind's rounds are keyed with. Plans, and so event logs, hold this and not the key."""
    return hashlib.sha256(f"{kind}:{key}".encode()).hexdigest()


def _keyed(key: str, kind: str, *parts: Column) -> Column:
    """60 bits of SHA-256 over the kind's round key and the parts."""
    text = F.concat_ws(":", F.lit(round_key(key, kind)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(start: Column, change: Callable[[str, Column, Column, Column], Column], finish: Callable[[Column], Column]) -> Column:
    """ROUNDS alternating rounds over the fields a and b: each changes one by a function of the other."""

    def turn(state: Column, i: Column) -> Column:
        odd = i % 2 == 1
        a = F.when(odd, change("a", state["a"], state["b"], i)).otherwise(state["a"])
        b = F.when(odd, state["b"]).otherwise(change("b", state["b"], state["a"], i))
        return F.struct(a.alias("a"), b.alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, finish)


def permute_number(number: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. sizes[0] * sizes[1] - 1, by adding in each factor's residues."""
    left, right = sizes
    start = F.struct(
        F.floor(number / right).cast("long").alias("a"), F.pmod(number, F.lit(right)).cast("long").alias("b")
    )

    def change(half: str, value: Column, other: Column, i: Column) -> Column:
        size = F.lit(left if half == "a" else right).cast("long")
        return F.pmod(value + F.pmod(_keyed(key, kind, i, other), size), size)

    return _feistel(start, change, lambda s: s["a"] * right + s["b"])


def _shifted(char: Column, by: Column) -> Column:
    """The character ``by`` places on among digits, small or capital letters; others stay."""
    code = F.ascii(char)
    turn = lambda first, size: F.char(F.lit(first) + F.pmod(code - first + F.pmod(by, F.lit(size)), F.lit(size)))
    return (
        F.when(code.between(48, 57), turn(48, 10)).when(code.between(97, 122), turn(97, 26))
        .when(code.between(65, 90), turn(65, 26)).otherwise(char)
    )


def permute_text(text: Column, key: str, kind: str) -> Column:
    """A keyed permutation of texts of one shape: digits stay digits, letters letters of their case.

    Each round shifts the characters of one half by hashes of the other half,
    the length and their places.
    """
    n = F.length(text)
    cut = F.floor(n / 2).cast("int")
    start = F.struct(F.substring(text, F.lit(1), cut).alias("a"), F.substring(text, cut + 1, n - cut).alias("b"))

    def change(half: str, value: Column, other: Column, i: Column) -> Column:
        moved = lambda c, at: _shifted(c, _keyed(key, kind, n, i, at, other))
        return F.array_join(F.transform(_chars(value), moved), "")

    return _feistel(start, change, lambda s: F.concat(s["a"], s["b"]))


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order by those of ``digits``."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def put(state: Column, char: Column) -> Column:
        is_digit = char.between("0", "9")
        text = F.concat(state["text"], F.when(is_digit, F.substring(digits, state["next"], F.lit(1))).otherwise(char))
        return F.struct(text.alias("text"), (state["next"] + is_digit.cast("int")).alias("next"))

    return F.aggregate(_chars(shape), start, put, lambda s: s["text"])


def _luhn(digits: Column, doubled: int) -> Column:
    """The Luhn sum; from the right, digits at places with the parity ``doubled`` count double."""
    single = lambda d: d.cast("int")
    double = lambda d: d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    weighed = F.transform(F.reverse(_chars(digits)), lambda d, i: F.when(i % 2 == doubled, double(d)).otherwise(single(d)))
    return F.aggregate(weighed, F.lit(0), lambda s, x: s + x)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    right = lambda d: F.length(d).between(13, 19) & (_luhn(d, 1) % 10 == 0)
    # Three digits behind a card of 16 are part of it or, as a check value is, another number.
    tail = F.when(right(_digits(m)), F.lit("")).otherwise(F.regexp_extract(m, r"^[0-9]{4}(?:[ -][0-9]{4}){3}([ -][0-9]{3})$", 1))
    digits = _digits(F.substring(m, F.lit(1), F.length(m) - F.length(tail)))
    valid = right(digits)
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    checked = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - _luhn(b, 0) % 10, F.lit(10)).cast("string")))
    return valid, _refilled(m, F.concat(checked[0], _digits(tail)))


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    # The country code stays where it stands apart.
    code = F.regexp_extract(m, r"^(\+[0-9]{1,3})[ .(-]", 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.length(_digits(m)).between(8, 15), F.concat(code, _refilled(rest, permute_text(_digits(rest), key, "phone")))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    # Case doesn't tell addresses apart: linked values are permuted in small letters.
    return F.lit(True), F.concat(permute_text(F.lower(local), key, "email"), F.lit("@"), F.substring_index(m, "@", -1))


def _date(m: Column, key: str) -> tuple[Column, Column]:
    parsed = [F.try_to_timestamp(m, F.lit(f)).cast("date") for f in DATE_FORMATS]
    first = F.lit(FIRST_DAY).cast("date")
    day = F.datediff(F.coalesce(*parsed), first).cast("long")
    inside = F.coalesce(day.between(0, DAYS[0] * DAYS[1] - 1), F.lit(False))
    # With slashes, the month stands first wherever that can be; a text that only a day can
    # begin stays one, so that the two kinds of texts never meet.
    day_first = parsed[3].isNotNull() & parsed[2].isNull()

    def walk(found: Column, _: Column) -> Column:
        """Permutes again until the day can't be a month: a permutation of the days of that kind."""
        again = found["turns"].isNull() | (F.dayofmonth(F.date_add(first, found["day"].cast("int"))) <= 12)
        moved = permute_number(found["day"], DAYS, key, "date")
        turns = F.coalesce(found["turns"], F.lit(0)) + 1
        return F.when(again, F.struct(moved.alias("day"), turns.alias("turns"))).otherwise(found)

    start = F.struct(day.alias("day"), F.lit(None).cast("int").alias("turns"))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(MOST_TURNS)), start, walk, lambda f: f["day"])
    moved = F.when(day_first, walked).otherwise(permute_number(day, DAYS, key, "date")).cast("int")
    out = None
    for found, form in zip(parsed, DATE_FORMATS, strict=True):
        written = F.date_format(F.date_add(first, moved), form)
        out = F.when(found.isNotNull(), written) if out is None else out.when(found.isNotNull(), written)
    return inside, out


def _social(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = (area - 1 - (area > 666).cast("int")).cast("long") * 99 + group - 1
    moved = permute_number(index * SOCIAL[1] + serial - 1, SOCIAL, key, "social")
    parts = F.transform(
        F.array(moved),
        lambda x: F.struct(F.floor(x / (99 * SOCIAL[1])).alias("area"), F.pmod(F.floor(x / SOCIAL[1]), F.lit(99)).alias("group"), F.pmod(x, F.lit(SOCIAL[1])).alias("serial")),
    )
    shown = F.transform(
        parts, lambda p: F.format_string("%03d-%02d-%04d", p["area"] + 1 + (p["area"] >= 665).cast("int"), p["group"] + 1, p["serial"] + 1)
    )
    return valid, shown[0]


def _address(m: Column, key: str) -> tuple[Column, Column]:
    octets = F.split(m, r"\.")
    valid = F.forall(octets, lambda o: (o.cast("int") <= 255) & (o == o.cast("int").cast("string")))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o.cast("long"))
    shown = F.transform(
        F.array(permute_number(number, ADDRESSES, key, "address")),
        lambda x: F.concat_ws(".", *[F.shiftright(x, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]),
    )
    return valid, shown[0]


def _mod97(text: Column) -> Column:
    """The remainder by 97 of a text in which letters stand for 10 to 35."""

    def add(state: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code <= 57, state * 10 + code - 48).otherwise(state * 100 + code - 55) % 97

    return F.aggregate(_chars(text), F.lit(0), add)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    valid = F.length(plain).between(15, 34) & (_mod97(F.concat(body, F.substring(plain, 1, 4))) == 1)
    # Letters stay; all digits but the check digits are permuted.
    digits = permute_text(_digits(body), key, "iban")
    made = F.transform(
        F.array(digits),
        lambda d: F.concat(F.lpad((98 - _mod97(F.concat(_refilled(body, d), country, F.lit("00")))).cast("string"), 2, "0"), d),
    )
    return valid, _refilled(m, made[0])


KINDS: dict[str, Callable[[Column, str], tuple[Column, Column]]] = {
    "email": _email, "iban": _iban, "date": _date, "social": _social, "address": _address, "card": _card, "phone": _phone,
}


def pseudonym(match: Column, key: str) -> Column:
    """struct(kind, value) for a match of ``ANY``; kind is NULL and the value unchanged where it isn't valid."""
    out = None
    for kind, rule in KINDS.items():
        valid, value = rule(match, key)
        is_kind = match.rlike(f"^(?:{PATTERNS[kind]})$") & valid
        made = F.struct(F.lit(kind).alias("kind"), value.alias("value"))
        out = F.when(is_kind, made) if out is None else out.when(is_kind, made)
    return out.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), match.alias("value")))


def pseudonymise(docs: DataFrame, key: str, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, the number of values of each kind, and the text with pseudonyms.

    Values are found in the whole text: e-mail addresses (the local part is
    permuted, in small letters), IBANs, calendar dates from 1900 to 2099, social
    security numbers, IPv4 addresses, card numbers with a right Luhn digit and
    telephone numbers (a country code that stands apart stays). What isn't
    valid stays as it is. NULL texts give NULL and no values; NULL and repeated
    ids are passed on; an empty table gives no rows; other columns are ignored.
    Who holds ``key`` can undo it, so keep it apart from the texts. The plan, and
    so an event log, has keys derived from it, which undo it as well, but don't
    tell the key.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    # Most texts have nothing to look for.
    may = F.coalesce(F.col("text").rlike("[0-9@]"), F.lit(False))
    found = rows.withColumn("found", F.when(may, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))))
    made = found.withColumn("made", F.transform("found", lambda m: pseudonym(m, key)))
    parts = F.zip_with(
        F.split("text", ANY, -1), F.transform("made", lambda p: p["value"]), lambda gap, new: F.concat(gap, F.coalesce(new, F.lit("")))
    )
    count = lambda kind: F.coalesce(F.size(F.filter("made", lambda p: p["kind"] == kind)), F.lit(0))
    return made.select(
        F.col("id").alias(id_col),
        *[F.when(F.col("made").isNull(), 0).otherwise(count(k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.when(F.size("found") > 0, F.array_join(parts, "")).otherwise(F.col("text")).alias("text"),
    )
