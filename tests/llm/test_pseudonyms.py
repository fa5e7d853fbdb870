import re

from tidegauge.llm import pseudonyms as ps
from tidegauge.llm.queries import op2

from pyspark.sql import functions as F


def luhn(digits):
    doubled = [int(d) * 2 - 9 * (int(d) > 4) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0


def moved(make, values, key=ps.KEY):
    rows = ps.pseudonymised(make([(i, f"x {v} y") for i, v in enumerate(values)], "id int, text string"), key=key).orderBy("id").collect()
    return [r.text[2:-2] for r in rows]


def test_cards_keep_layout_and_check_digit_and_link(make):
    a, b, c, odd = moved(make, ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112"])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) == c != "4111111111111111" and luhn(c)
    assert a[4] == " " and b[4] == "-" and odd == "4111111111111112"


def test_every_kind_stays_valid(make):
    date, dmy, ip, ssn, iban, phone, mail = moved(make, [
        "2024-02-29", "31/12/1999", "192.168.1.20", "123-45-6789", "DE89370400440532013000", "+1 (555) 123-4567", "Ann.Lee7@mail.example.com"])
    assert re.fullmatch(r"(19|20)\d\d-\d\d-\d\d", date) and date != "2024-02-29"
    assert re.fullmatch(r"\d\d/\d\d/(19|20)\d\d", dmy)
    assert all(0 <= int(o) <= 255 for o in ip.split(".")) and ip != "192.168.1.20"
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn[:3] not in ("000", "666") and ssn[0] != "9" and ssn != "123-45-6789"
    assert iban[:2] == "DE" and int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban != "DE89370400440532013000"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phone) and phone != "+1 (555) 123-4567"
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{2}\d@mail\.example\.com", mail) and mail != "Ann.Lee7@mail.example.com"


def test_invalid_values_stay(make):
    values = ["2023-02-29", "300.1.1.1", "000-12-3456", "DE89370400440532013001", "99/99/2001", "1234567890123456"]
    assert moved(make, values) == values


def test_numbers_beside_other_groups(make):
    card, iban, date = moved(make, ["4111 1111 1111 1111", "BE68 5390 0754 7034", "2024-02-29"])
    plain = [v.replace(" ", "") for v in (card, iban)]
    around = ["4111 1111 1111 1111 12/26", "4111111111111111 123", "12 4111111111111111", "7 4111 1111 1111 1111", "BE68 5390 0754 7034 EUR", "BE68539007547034 BIC",
              "2024-02-29T10:00:00Z", "2024-02-29/x", "2024-02-29/2024-02-29", "BE68 5390 0754 7034 4111 1111 1111 1111"]
    assert moved(make, around) == [f"{card} 12/26", f"{plain[0]} 123", f"12 {plain[0]}", f"7 {card}", f"{iban} EUR", f"{plain[1]} BIC",
                                   f"{date}T10:00:00Z", f"{date}/x", f"{date}/{date}", f"{iban} {card}"]


def test_feistel_is_a_permutation(spark):
    out = spark.range(17 * 61).select(ps.feistel(F.floor(F.col("id") / 61), F.col("id") % 61, F.lit(17), F.lit(61), "t", "k").alias("s")).select("s.*")
    pairs = {tuple(r) for r in out.collect()}
    assert len(pairs) == 17 * 61 and all(0 <= x < 17 and 0 <= y < 61 for x, y in pairs)
    digits = spark.range(1000).select(ps.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "d", "k").alias("d")).collect()
    assert len({r.d for r in digits}) == 1000 and all(len(r.d) == 3 for r in digits)


def test_keys_differ(make):
    assert moved(make, ["4111111111111111"], "a") != moved(make, ["4111111111111111"], "b")


def test_edges(make):
    text = "word " * 50_000 + "4111111111111111" + "a" * 100_000
    rows = [(1, None, 5), (2, "", 5), (3, text, 5), (3, text, 5)]
    out = ps.pseudonymised(make(rows, "doc_id long, text string, n_values long"), count="n_changed").collect()
    assert sorted((r.doc_id, r.text is None, r.n_changed, r.n_values) for r in out)[:2] == [(1, True, 0, 5), (2, False, 0, 5)]
    long = [r for r in out if r.doc_id == 3]
    assert len(long) == 2 and long[0].text == long[1].text
    assert ps.pseudonymised(make([], "doc_id long, text string")).count() == 0


def test_query_changes_only_values(spark, sf_dir, documents):
    before = dict(documents.select("doc_id", "text").collect())
    value = re.compile(r"(?<!\w)\d{13,19}(?!\w)")
    for r in op2(spark, sf_dir).collect():
        old = before[r.doc_id]
        if r.n_values == 0:
            assert r.text == old
        kept = set(re.findall(r"[^\W\d]+", old)) - set(re.findall(r"[^\W\d]+", r.text))
        assert all("@" in old for _ in kept)
        for m in value.findall(old):
            assert (m in r.text) != luhn(m)


def test_hosts_of_many_labels_do_not_end_the_session(make):
    long = "jane@" + "a." * 100_000 + "com"
    got = moved(make, [long, "jane@x.de", "jane@x.de..", "jane@x..de", "jane@x.de...com", "jane@a"])
    assert got[0].endswith("@" + "a." * 100_000 + "com") and got[0] != long
    assert got[1] != "jane@x.de" and got[2] == got[1] + ".." and got[3] == "jane@x..de" and got[4] == got[1] + "...com" and got[5] == "jane@a"


def test_telephone_numbers_link_however_they_are_written(make):
    for spellings in (["+1 555 123 4567", "+15551234567", "+1.555.123.4567", "+1-555-123-4567", "+1 (555) 123-4567"], ["+44 20 7946 0958", "+442079460958"], ["+353 1 234 5678", "+35312345678"]):
        got = moved(make, spellings)
        assert len({re.sub(r"[^+0-9]", "", x) for x in got}) == 1 and got[0] != spellings[0]
        code = spellings[0].split(" ")[0]
        assert all(x.startswith(code) and re.sub(r"[0-9]", "0", x) == re.sub(r"[0-9]", "0", y) for x, y in zip(got, spellings))


def test_one_letter_names_are_permuted(make):
    letters = "abcdefghijklmnopqrstuvwxyz"
    got = [x[0] for x in moved(make, [f"{c}@x.com" for c in letters])]
    assert sorted(got) == list(letters) and len({(ord(a) - ord(b)) % 26 for a, b in zip(got, letters)}) > 2
    assert sorted(x[0] for x in moved(make, [f"{d}@x.com" for d in range(10)])) == list("0123456789")
