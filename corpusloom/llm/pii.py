"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Candidates are validated (Luhn's check digit, octets, calendar, number plans),
and valid ones are replaced by a keyed Feistel permutation of their own format.
What is permuted is the value without its separators, so a number has one
pseudonym however it is written; different values get different ones, and a
pseudonym passes the same validation.  The rounds are HMAC-SHA256.  All of it is
DataFrame expressions; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

# Candidate patterns (Java's dialect), without repeated groups of
# unbounded number, on which its engine recurses.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]++"
PHONE = r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[ -]?[0-9]{4}|\+[0-9]{1,3}(?:[ .-][0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}"
IPV4 = r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
DATE_ISO = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"
DATE_DMY = r"[0-9]{2}[./][0-9]{2}[./][0-9]{4}"
SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
CARD = r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{13,19}"
NUMBERS = rf"(?<![0-9A-Za-z_])(?:{PHONE}|{IPV4}|{DATE_ISO}|{DATE_DMY}|{SSN}|{CARD})(?![0-9A-Za-z_])"
EITHER = f"{NUMBERS}|{EMAIL}"
KINDS = ("email", "phone", "ip", "date", "ssn", "card")

#: Dates are permuted within 800 Gregorian years: 378 * 773 days.
EPOCH, DAYS_A, DAYS_B = "1600-01-01", 378, 773
#: SSNs that are issued: areas 001 to 899 but 666, groups 01 to 99, serials 0001 to 9999.
AREAS, GROUPS, SERIALS = 898, 99, 9999
#: Characters of an address's name and domain at most.
MOST_NAME, MOST_DOMAIN = 64, 255

Mac = Callable[..., Column]


def pads(key: str) -> tuple[bytes, bytes]:
    """What HMAC-SHA256 puts before the message and before its hash."""
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = key.encode()
    if len(secret) > 64:
        secret = hashlib.sha256(secret).digest()
    secret = secret.ljust(64, b"\0")
    return bytes(c ^ 0x36 for c in secret), bytes(c ^ 0x5C for c in secret)


def keyed(key: str) -> Mac:
    """:func:`keyed_by` with the key's pads as literals, which a plan shows."""
    return keyed_by(*map(F.lit, pads(key)))


def keyed_by(inner: Column, outer: Column) -> Mac:
    """HMAC-SHA256 by the pads of a key, as hexadecimal digits, of the parts joined by |."""

    def mac(*parts_: Column) -> Column:
        message = F.encode(F.concat_ws("|", *(p.cast("string") for p in parts_)), "UTF-8")
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)

    return mac


def whole_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def feistel_number(x: Column, a: Column, b: Column, mac: Mac, kind: str) -> Column:
    """A keyed permutation of 0 to a * b - 1, a and b being at most 10**9."""
    start = F.struct(whole_div(x, b).alias("l"), (x % b).alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        word = F.conv(F.substring(mac(F.lit(kind), s["a"], s["b"], i, s["r"]), 1, 15), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), ((s["l"] + word % s["a"]) % s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    # After an even number of rounds the halves are back in place.
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def feistel_digits(digits: Column, mac: Mac, kind: str) -> Column:
    """A keyed permutation of the numbers of as many digits, 2 to 18, but 0."""
    n = F.length(digits)
    half = whole_div(n, F.lit(2)).cast("int")
    power = lambda k: F.element_at(F.lit([10**i for i in range(10)]).cast("array<long>"), k + 1)
    # What would come to 0 takes 0's place in its cycle.
    once = lambda y: feistel_number(y, power(n - half), power(half), mac, kind)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(2)), digits.cast("long"), lambda y, i: F.when((i == 1) | (y == 0), once(y)).otherwise(y))
    return F.lpad(found.cast("string"), n, F.lit("0"))


def feistel_name(s: Column, mac: Mac, kind: str) -> Column:
    """A keyed permutation of the strings of ``s``'s length and classes: digits
    and ASCII letters, whose case stays and tells no names apart."""
    chars = F.split(s, "")
    half = whole_div(F.length(s), F.lit(2)).cast("int")
    start = F.struct(F.slice(chars, F.lit(1), half).alias("l"), F.slice(chars, half + 1, F.length(s) - half).alias("r"))

    def turn(x: Column, i: Column) -> Column:
        digest = mac(F.lit(kind), F.length(s), i, F.lower(F.array_join(x["r"], "")))

        def one(c: Column, j: Column) -> Column:
            code = F.ascii(c)
            by = F.conv(F.substring(digest, j % 32 * 2 + 1, F.lit(2)), 16, 10).cast("int")
            move = lambda first, n: F.chr(F.lit(first) + (code - first + by) % n)
            return F.when(code.between(48, 57), move(48, 10)).when(code.between(97, 122), move(97, 26)).when(code.between(65, 90), move(65, 26)).otherwise(c)

        return F.struct(x["r"].alias("l"), F.transform(x["l"], one).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda x: F.array_join(F.concat(x["l"], x["r"]), ""))


def digits_of(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def filled(v: Column, digits: Column) -> Column:
    """``v`` with its digits replaced, one by one, by ``digits``."""
    put = lambda c, i: F.when(c.between("0", "9"), F.substring(digits, F.length(digits_of(F.substring(v, F.lit(1), i + 1))), F.lit(1))).otherwise(c)
    return F.when(F.length(v) == F.length(digits), digits).otherwise(F.array_join(F.transform(F.split(v, ""), put), ""))


def luhn_digit(body: Column) -> Column:
    """The check digit that belongs behind the digits ``body``."""

    def add(total: Column, c: Column) -> Column:
        d = c["c"].cast("int")
        return total + F.when(c["twice"], F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    digits = F.transform(F.split(F.reverse(body), ""), lambda c, i: F.struct(c.alias("c"), (i % 2 == 0).alias("twice")))
    return ((10 - F.aggregate(digits, F.lit(0), add) % 10) % 10).cast("string")


def octets(v: Column) -> Column:
    return F.split(v, r"\.").cast("array<long>")


def address_of(v: Column) -> Column:
    """A candidate address without the marks that end its sentence."""
    return F.rtrim(v, F.lit(".-"))


def is_address(v: Column) -> Column:
    at = F.locate("@", v)
    domain = F.substring(v, at + 1, F.length(v))
    short = (at <= MOST_NAME + 1) & (F.length(v) - at <= MOST_DOMAIN)
    return short & domain.rlike(r"\.[A-Za-z]{2,}$") & ~domain.contains("..") & ~domain.rlike("^[.-]")


def kind_of(v: Column) -> Column:
    """What a candidate is, null if it fails the validation."""
    whole = lambda p: v.rlike(f"^(?:{p})$")
    digits = digits_of(v)
    iso, dmy = F.try_to_date(v, "yyyy-MM-dd"), F.try_to_date(F.translate(v, ".", "/"), "dd/MM/yyyy")
    in_range = lambda d: d.between(F.lit(EPOCH).cast("date"), F.lit("2399-12-31").cast("date"))
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return (
        F.when(v.contains("@"), F.when(is_address(address_of(v)), "email"))
        .when(whole(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"), F.when(F.forall(octets(v), lambda o: o < 256), "ip"))
        .when(whole(DATE_ISO), F.when(in_range(iso), "date"))
        .when(whole(DATE_DMY), F.when(in_range(dmy), "date"))
        .when(whole(SSN), F.when(~v.rlike("^(?:000|666|9)|-00-|-0000$"), "ssn"))
        .when(whole(CARD), F.when((luhn_digit(body) == F.substring(digits, -1, 1)) & ~digits.rlike("^0+$"), "card"))
        .when(F.length(digits).between(8, 15), "phone")
    )


def pseudonym(v: Column, kind: Column, mac: Mac) -> Column:
    """The pseudonym of a valid candidate, in its own format."""
    n = F.lit
    # Addresses keep their domain.
    at = F.locate("@", v)
    email = F.concat(feistel_name(F.substring(v, n(1), at - 1), mac, "email"), F.substring(v, at, F.length(v)))
    # Phone numbers keep their country code.
    code = F.length(F.regexp_extract(v, r"^(?:\+[0-9]{1,3})?", 0))
    local = F.substring(v, code + 1, F.length(v))
    phone = F.concat(F.substring(v, n(1), code), filled(local, feistel_digits(digits_of(local), mac, "phone")))
    address = feistel_number(F.aggregate(octets(v), n(0).cast("long"), lambda x, o: x * 256 + o), n(65536), n(65536), mac, "ip")
    ip = F.concat_ws(".", *((whole_div(address, n(256**k)) % 256).cast("string") for k in (3, 2, 1, 0)))
    iso = v.rlike("^[0-9]{4}-")
    day = F.coalesce(F.try_to_date(v, "yyyy-MM-dd"), F.try_to_date(F.translate(v, ".", "/"), "dd/MM/yyyy"))
    moved = F.date_add(n(EPOCH).cast("date"), feistel_number(F.datediff(day, n(EPOCH).cast("date")).cast("long"), n(DAYS_A), n(DAYS_B), mac, "date").cast("int"))
    dmy = F.date_format(moved, "dd/MM/yyyy")
    date = F.when(iso, F.date_format(moved, "yyyy-MM-dd")).otherwise(filled(v, digits_of(dmy)))
    # Issued SSNs are numbered without gaps.
    area, group, serial = (F.substring(v, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    place = ((area - 1 - (area > 666).cast("long")) * GROUPS + group - 1) * SERIALS + serial - 1
    new = feistel_number(place, n(AREAS * GROUPS), n(SERIALS), mac, "ssn")
    new_area = whole_div(new, n(GROUPS * SERIALS)) + 1
    ssn = F.format_string("%03d-%02d-%04d", new_area + (new_area > 665).cast("long"), whole_div(new, n(SERIALS)) % GROUPS + 1, new % SERIALS + 1)
    digits = digits_of(v)
    body = feistel_digits(F.substring(digits, n(1), F.length(digits) - 1), mac, "card")
    card = filled(v, F.concat(body, luhn_digit(body)))
    return F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", ssn).when(kind == "card", card).otherwise(v)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """Replace the personal values of every whole text by pseudonyms.

    Returns doc_id, text (null where it was), and n_email, n_phone, n_ip,
    n_date, n_ssn, n_card: how many values were replaced.  ``key`` must not be
    empty.  Candidates that fail the validation stay as they are: addresses of
    over 64 characters before or 255 behind the @ among them, and runs of
    digits of any other length.  Dates with ``.`` and ``/`` are read as day,
    month, year.  Null and empty texts have no values; very long texts are read
    whole, in time linear in their length; a null doc_id stays null; repeated
    rows are treated alike; an empty table gives no rows; other columns are not
    read.

    The key comes to the rows as the value of a subquery over a table of one
    row, so no plan, and no log of plans, shows it.
    """
    held = docs.sparkSession.createDataFrame([pads(key)], "inner binary, outer binary")
    mac = keyed_by(F.col("_inner"), F.col("_outer"))
    text = F.col("text")
    mailed = text.contains("@")
    empty = F.array().cast("array<string>")
    source = docs.select(F.col("doc_id").cast("long"), "text", held.select("inner").scalar().alias("_inner"), held.select("outer").scalar().alias("_outer"))
    found = F.when(mailed, F.regexp_extract_all("text", F.lit(EITHER), F.lit(0))).when(text.rlike("[0-9]"), F.regexp_extract_all("text", F.lit(NUMBERS), F.lit(0)))
    parted = source.select("doc_id", "text", "_inner", "_outer", F.coalesce(found, empty).alias("found"))
    judged = parted.withColumn("found", F.transform("found", lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind"))))
    some = F.exists("found", lambda x: x["kind"].isNotNull())
    between = F.when(mailed, F.split("text", EITHER, -1)).otherwise(F.split("text", NUMBERS, -1))
    new = F.transform("found", lambda x: pseudonym(x["v"], x["kind"], mac))
    woven = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return judged.select("doc_id", F.when(some, woven).otherwise(text).alias("text"), *map(count, KINDS))
