"""Format-preserving pseudonyms: validated numbers and dates are permuted inside their own format by a keyed Feistel network.

Every kind of value is a set of valid values numbered 0 .. p*q - 1.  The number is split into (x, y) with x < p, y < q, and rounds
alternate x += F(y) mod p and y += F(x) mod q, F from a keyed SHA-256.  That is a permutation of the valid values, so the
result is valid again (check digits, calendar, octets), keeps its layout, and equal values get equal pseudonyms in every document
whatever their separators.  Text outside of values is returned byte for byte.  Only DataFrame functions are used.

Kinds: payment cards (Luhn), telephone numbers, dotted IPv4 addresses,
e-mail addresses (their local parts and host labels, letters and digits), US social security numbers, IBANs (ISO 7064), ISO and
day/month/year dates.  Null texts stay null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

KEY = "rotate me"
ROUNDS = 10

# How the kinds look.  A value never starts or ends inside a longer run of letters or digits.
EMAIL = r"(?<![A-Za-z0-9._%+\-À-ɏ])[A-Za-z0-9._%+\-À-ɏ]++@[A-Za-z0-9\-][A-Za-z0-9.\-]*\.[A-Za-z]{2,}"  # flat: a group repeated for every label would recurse; empty labels are cut off in _email
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
DATE = r"(?:(?<![\w./-])|(?<=[0-9]-[0-9]{2}/))(?:(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2})(?!(?!T[0-9])\w|-|\.[0-9])"
IPV4 = r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])"
SSN = r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"
CARD = r"(?<![\w])[0-9](?:[ -]?[0-9]){12,18}(?![\w])"
PHONE = r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w])|(?<![\w+])\+[0-9](?:[ .-]?[0-9]){7,13}(?![\w])"
VALUE = "|".join((EMAIL, IBAN, DATE, IPV4, SSN, CARD, PHONE))

# Country codes of the international numbering plan: the world's and Russia's one digit, those of two digits, all others of three.
DIAL = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"

# Lengths by the first digits: what cards have most often, and what they have at times.
USUAL = r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})$"
RARE = r"^(?:4(?:[0-9]{12}|[0-9]{18})|3[0689][0-9]{12}|6[0-9]{15,18})$"
IBAN_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
                23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
                28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 33: "RU"}
IBAN_KNOWN = "^(?:" + "|".join(f"(?:{v.replace(' ', '|')}).{{{n - 2}}}" for n, v in IBAN_LENGTHS.items()) + ")$"

DAYS = (17, 4297)  # days from 1900-01-01 to 2099-12-31: 17 x 4297
SSN_PARTS = (898, 99 * 9999)  # areas 001-899 without 666; groups 01-99 and serials 0001-9999


def _f(key: str, domain: Column | str, i: int, value: Column, modulus: Column) -> Column:
    """Round function: 60 bits of SHA-256 over key, domain, round and the other half."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    seen = F.sha2(F.concat_ws("|", F.lit(key), d, F.lit(str(i)), value.cast("string")).cast("binary"), 256)
    return F.pmod(F.conv(F.substring(seen, 1, 15), 16, 10).cast("long"), modulus)


def feistel(x: Column, y: Column, p: Column, q: Column, domain: Column | str, key: str) -> Column:
    """Permutes (x, y), x < p and y < q, as struct<x,y>; both moduli below 2^62."""
    start = F.struct(x.cast("long").alias("x"), y.cast("long").alias("y"))
    # a fold over the round numbers: the state is computed once per round instead of being written out 2^rounds times
    rounds = F.sequence(F.lit(0), F.lit(ROUNDS // 2 - 1))

    def pair(acc: Column, r: Column) -> Column:
        d = F.concat_ws("/", F.lit(domain) if isinstance(domain, str) else domain, r.cast("string"))
        nx = F.pmod(acc["x"] + _f(key, d, 0, acc["y"], p), p)
        return F.get(F.transform(F.array(nx), lambda v: F.struct(
            v.alias("x"), F.pmod(acc["y"] + _f(key, d, 1, v, q), q).alias("y"))), F.lit(0))

    return F.aggregate(rounds, start, pair)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def permute_digits(digits: Column, domain: str, key: str) -> Column:
    """Digits (1 to 36 of them) to as many digits."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    out = feistel(F.coalesce(F.substring(digits, F.lit(1), left).try_cast("long"), F.lit(0)), F.substring(digits, left + 1, n - left).try_cast("long"),
                  _power(left), _power(n - left), F.concat_ws(":", F.lit(domain), n.cast("string")), key)
    return _bind(out, lambda s: F.concat(
        F.when(left > 0, F.lpad(s["x"].cast("string"), left, F.lit("0"))).otherwise(F.lit("")), F.lpad(s["y"].cast("string"), n - left, F.lit("0"))))


def _bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """Sum of Luhn's weights, the last digit counting once."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when(
        (n - i) % 2 == 0, F.substring(digits, i, F.lit(1)).cast("int")).otherwise(
        F.element_at(F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9]), F.substring(digits, i, F.lit(1)).cast("int") + 1)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def refill(layout: Column, digits: Column) -> Column:
    """Puts digits, one by one, in place of the digits of a layout."""
    chars = F.split(layout, "")
    zero = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))
    return F.aggregate(chars, zero, lambda acc, c: F.when(
        c.rlike("^[0-9]$"), F.struct((acc["at"] + 1).alias("at"), F.concat(acc["out"], F.substring(digits, acc["at"], F.lit(1))).alias("out"))
    ).otherwise(F.struct(acc["at"].alias("at"), F.concat(acc["out"], c).alias("out"))), lambda acc: acc["out"])


def _runs(groups: Column, first_only: bool) -> Column:
    """Runs of consecutive groups: struct<i, j, text>."""
    n = F.size(groups)
    of = lambda i: F.transform(F.sequence(i, n), lambda j: F.struct(
        i.cast("int").alias("i"), j.alias("j"), F.array_join(F.slice(groups, i, j - i + 1), "").alias("text")))
    return of(F.lit(1)) if first_only else F.flatten(F.transform(F.sequence(F.lit(1), n), of))


def _card(m: Column, key: str) -> Column:
    """First digit stays (the kind of card), the others are permuted, the check digit is computed anew.

    The number is the run of whole groups whose check digit is right, that of a card's usual length before others and a longer before
    a shorter one: an expiry, security code or quantity beside it stays.  Without such a run nothing is a card and all stays."""
    def moved(piece: Column) -> Column:
        def of(d: Column) -> Column:
            body = F.substring(d, F.lit(2), F.length(d) - 2)
            head = F.concat(F.substring(d, 1, 1), permute_digits(body, "card", key))
            return refill(piece, _bind(head, lambda h: F.concat(h, ((10 - luhn_sum(F.concat(h, F.lit("0"))) % 10) % 10).cast("string"))))

        return _bind(digits_of(piece), of)

    def of(groups: Column) -> Column:
        runs = F.transform(_runs(groups, False), lambda r: F.struct(r.alias("r"), digits_of(r["text"]).alias("d")))
        right = F.filter(F.filter(runs, lambda x: F.length(x["d"]).between(13, 19)), lambda x: luhn_sum(x["d"]) % 10 == 0)
        ranked = F.transform(right, lambda x: F.struct(
            F.when(x["d"].rlike(USUAL), 0).when(x["d"].rlike(RARE), 1).otherwise(2).alias("rank"), (-F.length(x["d"])).alias("size"), x["r"].alias("r")))
        return _bind(F.array_min(ranked), lambda best: F.when(best.isNull(), m).otherwise(F.concat(
            F.array_join(F.slice(groups, F.lit(1), best["r"]["i"] - 1), ""), moved(best["r"]["text"]),
            F.array_join(F.slice(groups, best["r"]["j"] + 1, F.size(groups)), ""))))

    return _bind(F.regexp_extract_all(m, F.lit("[0-9]+[ -]?"), F.lit(0)), of)


def _phone(m: Column, key: str) -> Column:
    """The country code of a number with a plus stays, by the numbering plan, so a number moves alike however it is written."""
    def of(digits: Column) -> Column:
        code = F.when(F.startswith(m, F.lit("+")), F.regexp_extract(digits, DIAL, 0)).otherwise(F.lit(""))
        return _bind(code, lambda known: refill(m, F.concat(known, permute_digits(F.substring(digits, F.length(known) + 1, F.length(digits)), "phone", key))))

    return _bind(digits_of(m), of)


def _date(m: Column, key: str) -> Column:
    """Valid days of 1900 to 2099; anything else stays as it is."""
    def of(p: Column) -> Column:
        iso = F.contains(m, F.lit("-"))
        numbers = F.transform(p, lambda s: s.cast("int"))
        y = F.when(iso, F.get(numbers, F.lit(0))).otherwise(F.get(numbers, F.lit(2)))
        a, b = F.get(numbers, F.lit(1)), F.when(iso, F.get(numbers, F.lit(2))).otherwise(F.get(numbers, F.lit(0)))
        month_first = ~iso & (F.try_to_date(F.concat_ws("-", y, F.lpad(a.cast("string"), 2, F.lit("0")), F.lpad(b.cast("string"), 2, F.lit("0")))).isNull())
        month, day = F.when(month_first, b).otherwise(a), F.when(month_first, a).otherwise(b)
        valid = F.try_to_date(F.concat_ws("-", y.cast("string"), F.lpad(month.cast("string"), 2, F.lit("0")), F.lpad(day.cast("string"), 2, F.lit("0"))))
        number = F.date_diff(valid, F.lit("1900-01-01").cast("date"))
        moved = feistel(F.floor(number / DAYS[1]), number % DAYS[1], F.lit(DAYS[0]), F.lit(DAYS[1]), "date", key)
        new = _bind(moved, lambda s: F.date_add(F.lit("1900-01-01").cast("date"), (s["x"] * DAYS[1] + s["y"]).cast("int")))
        dot = F.when(F.contains(m, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
        two = lambda v: F.lpad(v.cast("string"), 2, F.lit("0"))
        first, second = (lambda d: F.when(month_first, F.month(d)).otherwise(F.day(d))), (lambda d: F.when(month_first, F.day(d)).otherwise(F.month(d)))
        other = _bind(new, lambda d: F.concat(two(first(d)), dot, two(second(d)), dot, F.year(d).cast("string")))
        return F.when(valid.isNull(), m).when(iso, new.cast("string")).otherwise(other)

    return _bind(F.split(m, "[-./]"), of)


def _ipv4(m: Column, key: str) -> Column:
    """Four octets as two halves of 16 bits; numbers with an octet above 255 stay as they are."""
    def of(o: Column) -> Column:
        v = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        moved = feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536), F.lit(65536), "ipv4", key)
        new = _bind(moved, lambda s: F.concat_ws(".", *[x.cast("string") for x in (
            F.floor(s["x"] / 256), s["x"] % 256, F.floor(s["y"] / 256), s["y"] % 256)]))
        return F.when(reduce(lambda a, b: a & b, [x <= 255 for x in v]), new).otherwise(m)

    return _bind(F.split(m, r"\."), of)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (F.substring(m, i, n).cast("int") for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    moved = feistel(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(SSN_PARTS[0]), F.lit(SSN_PARTS[1]), "ssn", key)
    new = _bind(moved, lambda s: _bind(s["x"] + 1, lambda a: F.format_string(
        "%03d-%02d-%04d", a + F.when(a >= 666, 1).otherwise(0), F.floor(s["y"] / 9999) + 1, s["y"] % 9999 + 1)))
    return F.when(valid, new).otherwise(m)


def _mod97(x: Column) -> Column:
    """Remainder of a long number, letters counting 10 to 35."""
    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), lambda acc, c: F.when(
        c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    """Country and layout stay, digits of the account are permuted, letters stay, check digits are computed anew.

    The number is the longest run of groups from the country on that is right modulo 97, one of the country's length before others; a
    word behind it stays, a card behind it is moved."""
    def moved(piece: Column) -> Column:
        def of(plain: Column) -> Column:
            account = F.substring(plain, F.lit(5), F.length(plain))
            new = _bind(refill(account, permute_digits(digits_of(account), "iban", key)), lambda a: F.concat(F.lpad((98 - _mod97(F.concat(
                a, F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, F.lit("0")), digits_of(a)))
            return refill(piece, new)

        return _bind(F.regexp_replace(piece, " ", ""), of)

    def of(groups: Column) -> Column:
        runs = F.transform(_runs(groups, True), lambda r: F.struct(r.alias("r"), F.regexp_replace(r["text"], " ", "").alias("d")))
        right = F.filter(F.filter(runs, lambda x: F.length(x["d"]) >= 12), lambda x: _mod97(F.concat(
            F.substring(x["d"], F.lit(5), F.length(x["d"])), F.substring(x["d"], 1, 4))) == 1)
        ranked = F.transform(right, lambda x: F.struct(F.when(x["d"].rlike(IBAN_KNOWN), 0).otherwise(1).alias("rank"), (-F.length(x["d"])).alias("size"), x["r"].alias("r")))
        rest = lambda t: F.when(t.rlike(f"^(?:{CARD})$"), _card(t, key)).otherwise(t)
        return _bind(F.array_min(ranked), lambda best: F.when(best.isNull(), m).otherwise(F.concat(
            moved(best["r"]["text"]), _bind(F.array_join(F.slice(groups, best["r"]["j"] + 1, F.size(groups)), ""), rest))))

    return _bind(F.regexp_extract_all(m, F.lit("[A-Z0-9]+ ?"), F.lit(0)), of)


def _email(m: Column, key: str) -> Column:
    """Letters and digits of everything but the last two host labels move: letters within a-z, digits within 0-9, by the keyed hash
    of the whole lower-case address chained over positions (a Feistel walk in halves of the local part)."""
    def of(parts: Column) -> Column:
        local, host = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        half = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))

        def stream(seed: Column, text: Column) -> Column:
            """Moves each letter by a letter's step and each digit by a digit's, from a hash of the other half."""
            code = F.sha2(seed.cast("binary"), 256)
            chars = F.filter(F.split(text, ""), lambda c: c != "")
            return F.array_join(F.transform(chars, lambda c, i: _bind(
                F.conv(F.substring(code, (i * 3) % 60 + 1, F.lit(3)), 16, 10).cast("int") + i, lambda k: F.when(
                    c.rlike("[0-9]"), ((c.try_cast("int") + k) % 10).cast("string")).when(
                    c.rlike("[a-z]"), F.char(F.pmod(F.ascii(c) - 97 + k, F.lit(26)) + 97)).when(
                    c.rlike("[A-Z]"), F.char(F.pmod(F.ascii(c) - 65 + k, F.lit(26)) + 65)).otherwise(c))), "")

        def pair(acc: Column, r: Column) -> Column:
            seed = lambda side, x: F.concat_ws("|", F.lit(key), F.lit(f"email-{side}"), r.cast("string"), F.lower(host), F.lower(x))
            return F.get(F.transform(F.array(stream(seed("a", acc["b"]), acc["a"])), lambda a: F.struct(
                a.alias("a"), stream(seed("b", a), acc["b"]).alias("b"))), F.lit(0))

        # a single letter or digit has no halves: it is permuted as a number
        code, base = F.ascii(F.lower(local)), F.when(local.rlike("[0-9]"), 48).otherwise(97)
        rows = F.when(local.rlike("[0-9]"), 5).otherwise(13)
        number = code - base
        one = _bind(feistel(F.floor(number / rows), number % rows, F.lit(2), rows, F.concat_ws("|", F.lit("email-one"), F.lower(host)), key), lambda s: F.char(s["x"] * rows + s["y"] + base))
        single = F.when(local.rlike("[A-Z]"), F.upper(one)).otherwise(one)
        moved = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, pair)
        return F.when(local.rlike("^[A-Za-z0-9]$"), F.concat(single, F.lit("@"), host)).otherwise(_bind(moved, lambda s: F.concat(s["a"], s["b"], F.lit("@"), host)))

    def valid(at: Column) -> Column:
        """What stands before the first empty label, if that is an address, moves."""
        head = F.when(at > 0, F.substring(m, F.lit(1), at - 1)).otherwise(m)
        tail = F.when(at > 0, F.substring(m, at, F.length(m))).otherwise(F.lit(""))
        return F.when(head.rlike(r"@.*\.[A-Za-z]{2,}$"), F.concat(_bind(F.split(head, "@"), of), tail)).otherwise(m)

    start_of_host = F.locate("@", m)
    empty = F.locate("..", F.substring(m, start_of_host, F.length(m)))
    return _bind(F.when(empty > 0, empty + start_of_host - 1).otherwise(F.lit(0)), valid)


KINDS = (("email", EMAIL, _email), ("iban", IBAN, _iban), ("date", DATE, _date), ("ipv4", IPV4, _ipv4), ("ssn", SSN, _ssn),
         ("card", CARD, _card), ("phone", PHONE, _phone))


def pseudonym(value: Column, key: str = KEY) -> Column:
    """Pseudonym of one matched value."""
    out = F.when(value.rlike(f"^(?:{KINDS[0][1]})$"), KINDS[0][2](value, key))
    for _, pattern, how in KINDS[1:]:
        out = out.when(value.rlike(f"^(?:{pattern})$"), how(value, key))
    return out.otherwise(value)


def kind_of(value: Column) -> Column:
    out = F.when(value.rlike(f"^(?:{KINDS[0][1]})$"), F.lit(KINDS[0][0]))
    for name, pattern, _ in KINDS[1:]:
        out = out.when(value.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def pseudonymised(docs: DataFrame, text: str = "text", key: str = KEY, out: str | None = None, count: str = "n_values") -> DataFrame:
    """docs with the text pseudonymised (in place, or in ``out``) and the number of values changed.

    One pass, no shuffle.  Texts without a value are passed through; in the others only the values are worked on, and
    the parts between them are put back as they were."""
    t = F.col(text)
    gaps, found = F.split(t, VALUE), F.regexp_extract_all(t, F.lit(VALUE), F.lit(0))
    may = F.regexp_like(t, F.lit("[0-9@]"))  # most texts have no digit at all
    staged = docs.withColumn("__found", F.when(may, found).otherwise(F.array().cast("array<string>")))
    moved = F.transform(F.col("__found"), lambda v: pseudonym(v, key))
    staged = staged.withColumn("__moved", moved)
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.col("__moved"), lambda g, v: F.array(g, F.coalesce(v, F.lit(""))))), "")
    changed = F.size(F.filter(F.zip_with("__found", "__moved", lambda a, b: a != b), lambda x: x)).cast("long")
    return staged.withColumn(count, changed).withColumn(out or text, F.when(F.size("__found") > 0, joined).otherwise(t)).drop("__found", "__moved")


__all__ = ["KINDS", "VALUE", "feistel", "kind_of", "permute_digits", "pseudonym", "pseudonymised"]
