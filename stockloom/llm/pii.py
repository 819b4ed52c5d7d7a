"""Format-preserving pseudonyms for personal numbers, dates and addresses. DataFrame functions only.

A value that validates (Luhn, octets, calendar, mod 97, number ranges) is permuted by a keyed Feistel network within the
set of values of its format. Equal values get equal pseudonyms in all documents, whatever separators they are written
with, and who holds the key can invert them. What doesn't validate is left as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ROUNDS = 8
#: The demonstration key of the registered queries; real jobs pass their own.
KEY = "stockloom demonstration key"

# Lengths of IBANs by country code.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
    28: "AL AZ BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU",
}


def iban_pattern() -> str:
    """Groups of four up to the country's length, so that a word behind stays out; any length for other codes."""
    fixed = [
        rf"(?:{codes.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(length - 4) // 4}}}"
        + (rf" ?[A-Z0-9]{{{length % 4}}}" if length % 4 else "") for length, codes in IBAN_LENGTHS.items()]
    known = "|".join(codes.replace(" ", "|") for codes in IBAN_LENGTHS.values())
    other = rf"(?!{known})[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?"
    return rf"(?<![\p{{L}}\p{{N}}])(?=[A-Z]{{2}}\d{{2}})(?:{'|'.join([*fixed, other])})(?![\p{{L}}\p{{N}}])"


# What is looked for, in the order in which formats are tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,62})\.)+[A-Za-z]{2,24}",
    "ip": r"(?<![\p{L}\p{N}.])(?:\d{1,3}\.){3}\d{1,3}(?![\p{L}\p{N}]|\.\d)",
    "iban": iban_pattern(),
    "iso_date": r"(?<![\p{L}\p{N}/.-])\d{4}-\d{2}-\d{2}(?:(?=T\d{2})|(?![\p{L}\p{N}]|[/.-]\d))",
    "day_date": r"(?<![\p{L}\p{N}/.-])\d{1,2}(?<part>[./])\d{1,2}\k<part>\d{4}(?![\p{L}\p{N}]|[/.-]\d)",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}]|-\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}+])\+\d{1,3}(?:[ .-]?\d{1,4}){2,5}(?![\p{L}\p{N}])"
             r"|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\p{L}\p{N}]|[.-]\d)",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?<gap>[ -])\d{4}\k<gap>\d{4}\k<gap>\d{4}|3\d{3}(?<space>[ -])\d{6}\k<space>\d{5}|\d{13,19})(?![\p{L}\p{N}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Alphabets within which characters are permuted.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ",
)
# Capitals of the alphabets, letter by letter. Letters outside of these (ß, İ and others) have no capital of one letter, and stay.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŸ", ALPHABETS[1] + ALPHABETS[3]
# Country codes of one and two digits; the others have three.
COUNTRY_CODE = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"
#: 400 Gregorian years have 146,097 = 189 * 773 days; dates are permuted within those that start here.
CYCLE_START, CYCLE = "1800-01-01", (189, 773)


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def digest(key: str, kind: str, i: Column, half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), half), 256)


def number_of(hashed: Column, at: int | Column = 1, digits: int = 13) -> Column:
    return F.conv(F.substr(hashed, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def shifted(half: Column, hashed: Column) -> Column:
    """Every character moved within its alphabet by a byte pair of the hash; others stay."""
    def move(c, j):
        by = number_of(hashed, (j % 16) * 4 + 1, 4)
        out = c
        for alphabet in ALPHABETS:
            place = F.instr(F.lit(alphabet), c)
            out = F.when(place > 0, F.substr(F.lit(alphabet), F.pmod(place - 1 + by, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.split(half, ""), move), "")


def feistel_text(value: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the strings whose characters have the same alphabets at the same places.

    The halves take turns; so their lengths, and the alphabets at each place, stay. Of a value of one character only the
    character itself is moved, by an amount that the key alone gives.
    """
    middle = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substr(value, F.lit(1), middle).alias("a"), F.substr(value, middle + 1, F.length(value)).alias("b"))

    def turn(s, i):
        even = i % 2 == 0
        return F.struct(
            F.when(even & (F.length(s["a"]) > 0), shifted(s["a"], digest(key, kind, i, s["b"]))).otherwise(s["a"]).alias("a"),
            F.when(~even, shifted(s["b"], digest(key, kind, i, s["a"]))).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(value: Column, key: str, kind: str, a: int, b: int) -> Column:
    """A keyed permutation of the numbers 0 to a * b - 1, as pairs of a remainder of a and one of b."""
    start = F.struct(F.floor(value / b).cast("long").alias("a"), F.pmod(value, F.lit(b)).cast("long").alias("b"))

    def turn(s, i):
        even = i % 2 == 0
        by = number_of(digest(key, kind, i, F.when(even, s["b"]).otherwise(s["a"]).cast("string")))
        return F.struct(
            F.when(even, F.pmod(s["a"] + by, F.lit(a))).otherwise(s["a"]).alias("a"),
            F.when(even, s["b"]).otherwise(F.pmod(s["b"] + by, F.lit(b))).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["a"] * b + s["b"])


def refilled(template: Column, filling: Column, wanted: str) -> Column:
    """The template with the characters that match ``wanted`` replaced by those of ``filling``, one after another;
    capitals of the template stay capitals."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def put(s, c):
        new = F.substr(filling, s["at"], F.lit(1))
        cased = F.when(F.instr(F.lit(CAPITALS), c) > 0, F.translate(new, SMALL, CAPITALS)).otherwise(new)
        return F.when(c.rlike(wanted), F.struct(F.concat(s["out"], cased).alias("out"), (s["at"] + 1).alias("at"))).otherwise(
            F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at")))

    return F.aggregate(F.split(template, ""), start, put, lambda s: s["out"])


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; ``doubled`` is 1 if the last digit counts once, 0 if it counts double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(
        i % 2 == doubled, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def mod_97(code: Column) -> Column:
    """The remainder of an IBAN's letters and digits, its first four characters read last."""
    turned = F.concat(F.substr(code, F.lit(5), F.length(code)), F.substr(code, F.lit(1), F.lit(4)))

    def step(s, c):
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (s * 10 + c.cast("int")) % 97).otherwise((s * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def email(m: Column, key: str) -> Column:
    local, rest = F.substring_index(m, "@", 1), F.substr(m, F.instr(m, F.lit("@")), F.length(m))
    return F.concat(refilled(local, feistel_text(F.translate(local, CAPITALS, SMALL), key, "email"), "(?s)."), rest)


def ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    new = lambda n: F.concat_ws(".", *[F.pmod(F.floor(n / (256 ** k)), F.lit(256)).cast("string") for k in (3, 2, 1, 0)])
    return F.when(F.forall(parts, lambda p: p < 256), once(feistel_number(number, key, "ip", 65536, 65536), new)).otherwise(m)


def iban(m: Column, key: str) -> Column:
    code = F.regexp_replace(m, " ", "")

    def renewed(account):
        blank = F.concat(F.substr(code, F.lit(1), F.lit(2)), F.lit("00"), account)
        return F.concat(F.substr(code, F.lit(1), F.lit(2)), F.lpad((98 - mod_97(blank)).cast("string"), 2, "0"), account)

    new = once(feistel_text(F.substr(code, F.lit(5), F.length(code)), key, "iban"), renewed)
    return F.when(mod_97(code) == 1, refilled(m, new, "[A-Z0-9]")).otherwise(m)


def date_shift(day: Column, key: str) -> Column:
    start = F.lit(CYCLE_START).cast("date")
    moved = feistel_number(F.datediff(day, start).cast("long"), key, "date", *CYCLE)
    return F.date_add(start, moved.cast("int"))


def in_cycle(day: Column) -> Column:
    return day.isNotNull() & (day >= F.lit(CYCLE_START).cast("date")) & (day < F.lit("2200-01-01").cast("date"))


def iso_date(m: Column, key: str) -> Column:
    day = F.try_to_date(m, "yyyy-MM-dd")
    return F.when(in_cycle(day), F.date_format(date_shift(day, key), "yyyy-MM-dd")).otherwise(m)


def day_date(m: Column, key: str) -> Column:
    """Day first; where that is no date, month first. Written without leading zeros if the value is."""
    plain = F.translate(m, "/", ".")
    padded = F.regexp_replace(plain, r"(?<!\d)(\d\.)", "0$1")
    first, second = F.try_to_date(padded, "dd.MM.yyyy"), F.try_to_date(padded, "MM.dd.yyyy")

    def written_out(day: Column, wide: str, narrow: str) -> Column:
        moved = date_shift(day, key)
        return F.when(plain == padded, F.date_format(moved, wide)).otherwise(F.date_format(moved, narrow))

    dotted = F.when(in_cycle(first), written_out(first, "dd.MM.yyyy", "d.M.yyyy")).when(
        in_cycle(second), written_out(second, "MM.dd.yyyy", "M.d.yyyy")).otherwise(plain)
    return F.when(F.contains(m, F.lit("/")), F.translate(dotted, ".", "/")).otherwise(dotted)


def ssn(m: Column, key: str) -> Column:
    """Areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999."""
    area, group, serial = (F.substr(m, F.lit(at), F.lit(n)).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    number = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def written_out(n):
        a = F.floor(n / (99 * 9999)) + 1
        return F.concat_ws(
            "-", F.lpad((a + F.when(a > 665, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))

    return F.when(valid, once(feistel_number(number, key, "ssn", 898 * 99, 9999), written_out)).otherwise(m)


def phone(m: Column, key: str) -> Column:
    """The country code behind a plus stays, whether or not it is set apart; numbers of fewer than 7 or more than 15 digits are none."""
    code = F.regexp_extract(m, rf"^\+(?:{COUNTRY_CODE})", 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    new = F.concat(code, refilled(rest, feistel_text(digits_of(rest), key, "phone"), "[0-9]"))
    return F.when(F.length(digits_of(m)).between(7, 15), new).otherwise(m)


def card(m: Column, key: str) -> Column:
    """The first digit stays; the last one is the check digit of the new number."""
    digits = digits_of(m)
    inner = F.substr(digits, F.lit(2), F.length(digits) - 2)

    def checked(body):
        return F.concat(body, F.pmod(10 - luhn_sum(body, 0) % 10, F.lit(10)).cast("string"))

    new = once(F.concat(F.substr(digits, F.lit(1), F.lit(1)), feistel_text(inner, key, "card")), checked)
    return F.when(luhn_sum(digits, 1) % 10 == 0, refilled(m, new, "[0-9]")).otherwise(m)


FORMATS = {
    "email": email, "ip": ip, "iban": iban, "iso_date": iso_date, "day_date": day_date, "ssn": ssn, "phone": phone,
    "card": card,
}


def pseudonym(m: Column, key: str) -> Column:
    """The pseudonym of one match of PATTERN; the match itself if it doesn't validate."""
    out = m
    for name in reversed(FORMATS):
        out = F.when(m.rlike(f"^(?:{PATTERNS[name]})$"), FORMATS[name](m, key)).otherwise(out)
    return out


def pseudonymised(docs: DataFrame, key: str = KEY, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal values of the whole text replaced; all else stays, also repeated rows and extra columns.

    ``count`` names a column for the number of replaced values, in place of one that has this name. A null text stays null
    (count 0), an empty one empty; an empty table gives no rows.
    """
    # the row is kept apart, so that its columns may have any names
    apart = docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text"))
    found = apart.withColumn("_found", F.regexp_extract_all("_text", F.lit(PATTERN), 0))
    named = found.withColumn("_new", F.transform("_found", lambda m: pseudonym(m, key)))
    woven = F.array_join(F.flatten(F.zip_with(
        F.split("_text", PATTERN, -1), "_new", lambda gap, new: F.array(gap, F.coalesce(new, F.lit(""))))), "")
    replaced = F.when(F.size("_found") > 0, woven).otherwise(F.col("_text"))
    changed = F.coalesce(F.aggregate(
        F.zip_with("_found", "_new", lambda a, b: (a != b).cast("int")), F.lit(0), lambda s, x: s + x), F.lit(0))
    kept = [replaced.alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns if c != count]
    return named.select(*kept, *([changed.alias(count)] if count else []))
