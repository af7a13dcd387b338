import hashlib
import random
import re
import time

from marlstone.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def brute(text):
    text = text or ""
    out = []
    for rank, (kind, pat) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in pat.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else True,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    out.sort()
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.digest(pii.find_personal_data(df)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for doc_id, text in rows:
        want = brute(text)
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in want)
        for r in by[doc_id]:
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest(), (text, joined, r)
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == x for *_, k in want) for x in ("email", "ip", "card", "phone")]
            base = [x for x in r["spans"].split(",") if x and x.split(":")[0] in pii.BASE]
            assert ",".join(base) == joined
    return by


def test_hand_cases(spark):
    rows = [
        (0, None), (1, ""), (2, "mail a.b@c.de and x@a.b_c@d.ef, a@b.c@d.e.f"),
        (3, "999.1.2.3.4.5.6.7 and 1.2.3.4.5.6.7.8 255.255.255.255 256.1.1.1 0001.2.3.4"),
        (4, "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4111111111111111"),
        (5, "call +49 (30) 1234-5678. or +1 555 or ++4915112345678+4915112345679 +1234567890123456"),
        (6, "é😀 +49 30 12345678 😀 a@b.cd 4012888888881881--4012888888881881"),
        (7, "1" * 70000 + " " + "a" * 70000 + "@b.c " + "1 " * 30000 + ("x" * 50 + "@") * 2000),
        (8, "a@b.c " * 3000 + "1.2.3.4 " * 3000),
        (9, "iban DE89 3704 0044 0532 0130 00 ok, GB82WEST12345698765432; DE89370400440532013001"),
        (10, "phone: 555-123-4567, 555-123-4567"), (10, "phone: 555-123-4567, 555-123-4567"),
    ]
    by = check(spark, rows)
    assert by[9][0]["spans"].count("iban") == 2
    assert by[10][0]["spans"].count("tel") >= 1 and len(by[10]) == 2


def test_random_strings(spark):
    rng = random.Random(7)
    alphabet = "0123456789" * 3 + "ab@@..--++() \n_é"
    pieces = ["4111111111111111", "1.2.3.4", "a@b.c", "+4930123456", "@", ".", " ", "-"]
    rows = []
    for i in range(1500):
        rows.append((i, "".join(rng.choice(pieces) if rng.random() < 0.15 else rng.choice(alphabet) for _ in range(rng.randint(0, 80)))))
    check(spark, rows)


def test_sf(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    by = check(spark, rows)
    assert sum(r["n_email"] + r["n_card"] for rs in by.values() for r in rs) > 0


def test_empty_and_clashing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, pii string")
    assert pii.digest(pii.find_personal_data(df)).count() == 0


def test_context_reaches_over_earlier_spans(spark):
    text = "tel 555-123-4567, " + "555-123-4568, " * 6
    row = check(spark, [(1, text), (2, "x" * 60 + text), (3, "call: a@b.c a@b.c a@b.c 555-123-4567")])
    starts = lambda i: [int(s.split(":")[1]) for s in row[i][0]["spans"].split(",") if s.startswith("tel")]
    # those within 48 characters of the word
    assert starts(1) == [4, 18, 32, 46] and starts(2) == [64, 78, 92, 106] and starts(3) == [24]


def test_many_spans_in_one_text_take_linear_time(spark):
    def took(n):
        df = spark.createDataFrame([(1, "a@b.cde x " * n)], "doc_id long, text string")
        began = time.perf_counter()
        assert pii.digest(pii.find_personal_data(df)).first()["n_email"] == n
        return time.perf_counter() - began

    took(100)
    few, many = took(20_000), took(60_000)
    assert many < 6 * max(few, 1)
