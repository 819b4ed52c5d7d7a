from __future__ import annotations

import hashlib
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from stockloom.llm import pii


def replaced(spark, *texts, key=pii.KEY):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymised(rows, key).orderBy("doc_id").collect()]


def plain_text(value, key, kind, back=False):
    """The text network by loops; ``back`` undoes it."""
    middle = len(value) // 2
    a, b = value[:middle], value[middle:]
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        moving, other = (a, b) if i % 2 == 0 else (b, a)
        hashed = hashlib.sha256(f"{key}|{kind}|{i}|{other}".encode()).hexdigest()
        out = ""
        for j, c in enumerate(moving):
            by = int(hashed[j % 16 * 4:j % 16 * 4 + 4], 16) * (-1 if back else 1)
            for alphabet in pii.ALPHABETS:
                if c in alphabet:
                    c = alphabet[(alphabet.index(c) + by) % len(alphabet)]
                    break
            out += c
        a, b = (out, b) if i % 2 == 0 else (a, out)
    return a + b


def plain_number(value, key, kind, p, q, back=False):
    a, b = divmod(value, q)
    for i in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        hashed = hashlib.sha256(f"{key}|{kind}|{i}|{b if i % 2 == 0 else a}".encode()).hexdigest()
        by = int(hashed[:13], 16) * (-1 if back else 1)
        a, b = ((a + by) % p, b) if i % 2 == 0 else (a, (b + by) % q)
    return a * q + b


def test_pseudonyms_are_those_of_plain_networks_and_can_be_undone(spark):
    phones = ["+1 743 555 3824", "(743) 555-3824", "+493012345678", "+353 1 234 5678"]
    mails = ["und.34@a.org", "GROẞE.STRAßE@a.org", "ÉLAN.İ-x@a.org", "a@a.org"]
    for text, new in zip(phones, replaced(spark, *phones)):
        digits, moved = re.sub(r"\D", "", text), re.sub(r"\D", "", new)
        code = 0 if text[0] != "+" else 1 if digits[0] == "1" else 2 if digits[:2] == "49" else 3
        assert moved == digits[:code] + plain_text(digits[code:], pii.KEY, "phone")
        assert plain_text(moved[code:], pii.KEY, "phone", back=True) == digits[code:]
        assert re.sub(r"\d", "0", new) == re.sub(r"\d", "0", text)
    small, capitals = str.maketrans(pii.CAPITALS, pii.SMALL), pii.CAPITALS
    for text, new in zip(mails, replaced(spark, *mails)):
        local, moved = text.split("@")[0], new.split("@")[0]
        assert len(moved) == len(local) and [c in capitals for c in moved] == [c in capitals for c in local]
        assert moved.translate(small) == plain_text(local.translate(small), pii.KEY, "email")
        assert plain_text(moved.translate(small), pii.KEY, "email", back=True) == local.translate(small)
    day, = replaced(spark, "2020-05-17")
    start = date.fromisoformat(pii.CYCLE_START)
    n = (date(2020, 5, 17) - start).days
    assert (date.fromisoformat(day) - start).days == plain_number(n, pii.KEY, "date", *pii.CYCLE)
    assert plain_number(plain_number(n, "k", "d", *pii.CYCLE), "k", "d", *pii.CYCLE, back=True) == n


def test_one_phone_number_has_one_pseudonym(spark):
    forms = ["+15551234567", "+1 555 123 4567", "+1 (555) 123-4567", "+1-555-123-4567", "+1.555.123.4567"]
    assert len({re.sub(r"\D", "", new) for new in replaced(spark, *forms)}) == 1


def test_dates_in_timestamps_and_without_zeros(spark):
    plain, stamp, spaced, wide, narrow, slashed = replaced(
        spark, "2021-03-04", "2021-03-04T10:15:00Z", "2021-03-04 10:15", "04.03.2021", "4.3.2021", "4/3/2021")
    assert plain != "2021-03-04" and stamp == f"{plain}T10:15:00Z" and spaced == f"{plain} 10:15"
    year, month, day = plain.split("-")
    assert wide == f"{day}.{month}.{year}" and narrow == f"{int(day)}.{int(month)}.{year}" == slashed.replace("/", ".")
    assert replaced(spark, "2021-03-04Tx", "2021-03-045") == ["2021-03-04Tx", "2021-03-045"]


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def test_formats_stay_valid(spark):
    card, spaced, ip, day, other, ssn, iban, phone, mail = replaced(
        spark, "4845168114407329", "4111 1111 1111 1111", "227.5.221.1", "2024-02-29", "31/12/1999", "123-45-6789",
        "GB82 WEST 1234 5698 7654 32", "+1 (743) 555-3824", "und.34@mail7.example.com")
    assert luhn(card) and card[0] == "4" and card != "4845168114407329"
    assert luhn(spaced.replace(" ", "")) and re.fullmatch(r"4\d{3}( \d{4}){3}", spaced)
    assert ip != "227.5.221.1" and all(int(p) < 256 for p in ip.split("."))
    assert date.fromisoformat(day) != date(2024, 2, 29)
    assert date(int(other[6:]), int(other[3:5]), int(other[:2]))
    assert re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}", ssn) and ssn != "123-45-6789"
    code = iban.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 and re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d", iban)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (743) 555-3824"
    assert re.fullmatch(r"[a-z]{3}\.\d\d@mail7\.example\.com", mail) and mail != "und.34@mail7.example.com"


def test_ibans_end_at_their_country_length(spark):
    codes = [
        "BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466",
        "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "BE68539007547034"]
    behind = ["", " EUR 500", " BIC", " 123", " 1234 X", " 4111 1111 1111 1111", ", A", " AT61 1904 3002 3457 3201"]
    pairs = [(code, tail) for code in codes for tail in behind]
    alone = dict(zip([*codes, *behind], replaced(spark, *codes, *behind)))
    assert all(alone[code] != code and alone[code][:2] == code[:2] for code in codes)
    assert replaced(spark, *[code + tail for code, tail in pairs]) == [alone[code] + alone[tail] for code, tail in pairs]


def test_equal_values_stay_linked(spark):
    a, b, c, d, e, f = replaced(
        spark, "call +1 (743) 555-3824!", "+1 743 555 3824", "UND.34@mail7.example.com", "und.34@mail7.example.com",
        "2020-05-17", "17.05.2020")
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b)
    assert c.lower() == d and c != d
    assert e.split("-") == f.split(".")[::-1]


def test_other_keys_give_other_pseudonyms(spark):
    assert replaced(spark, "227.5.221.1", key="a") != replaced(spark, "227.5.221.1", key="b")


@pytest.mark.parametrize("text", [
    "4845168114407320", "999.1.1.1", "1.2.3.4.5", "2023-02-29", "000-12-3456", "666-12-3456", "version 2.0. CC BY-NC 4.0.",
    "GB82 WEST 1234 5698 7654 33", "a@b", "12345", "", None, "x4111111111111111", "plain words only", "99/99/2000"])
def test_what_does_not_validate_stays(spark, text):
    assert replaced(spark, text) == [text]


def test_text_around_values_stays(spark):
    text = "é 227.5.221.1, 227.5.221.1!! 4845168114407329 4845168114407329\n\n$$$ 227.5.221.1"
    new, = replaced(spark, text)
    ip, card = re.search(r"\d+\.\d+\.\d+\.\d+", new)[0], re.search(r"\d{16}", new)[0]
    assert new == text.replace("227.5.221.1", ip).replace("4845168114407329", card)


def test_networks_are_permutations(spark):
    dates = spark.range(146_097).select(pii.feistel_number(F.col("id"), "k", "d", *pii.CYCLE).alias("y"))
    assert dates.distinct().count() == 146_097 and dates.agg(F.min("y"), F.max("y")).first()[:] == (0, 146_096)
    words = spark.range(10_000).select(pii.feistel_text(F.lpad(F.col("id").cast("string"), 4, "0"), "k", "d").alias("y"))
    assert words.distinct().count() == 10_000 and words.filter(~F.col("y").rlike("^[0-9]{4}$")).count() == 0


def test_odd_rows(odd_docs, no_docs):
    out = pii.pseudonymised(odd_docs, count="n")
    assert set(out.columns) == set(odd_docs.columns)
    same = out.drop("n").exceptAll(odd_docs.drop("n").select(*out.drop("n").columns))
    assert same.count() == 0 and out.agg(F.sum("n")).first()[0] == 0
    assert pii.pseudonymised(no_docs).count() == 0


def test_no_python_in_the_plan(odd_docs):
    plan = pii.pseudonymised(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
