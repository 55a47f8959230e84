"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations, in SQL functions only.

Every kind of value is permuted inside its own format, so the result is valid where the value was, equal values
stay equal over all documents under one key, and the key's holder can undo it (inverse=True).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

ROUNDS = 8
#: The key of the query op8_pseudonyms alone; whoever publishes pseudonyms gives a secret of their own.
QUERY_KEY = "op8"

#: Patterns by kind, in the order they are tried at a place. Possessive runs and the look-behinds keep a scan linear.
PATTERNS = {
    "email": r"(?<![\p{L}0-9._%+-])[\p{L}0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30}+)(?![A-Za-z0-9])",
    "keyed": r"(?<![A-Za-z0-9_-])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|glpat-[0-9A-Za-z_-]{20}|xox[abpr]-[0-9A-Za-z-]{10,80}|sk-[0-9A-Za-z_-]{20,200}|AIza[0-9A-Za-z_-]{35})(?![A-Za-z0-9_-])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "phone": r"(?<![0-9])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]|[0-9]{3}[.-][0-9]{3}[.-])[0-9]{4}|\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4})(?![0-9])",
    "abroad": r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?\([0-9]{1,4}\)|[ .-]?[0-9]{2,12}){1,5}(?![0-9])",
    "ip": r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
}
ANY = "|".join(PATTERNS.values())
#: What a text with any of these values must hold, in one quick scan; most prose goes no further.
MAY = r"@|[0-9]{2}|[0-9]\.[0-9]|A[KS]IA|gh[pousr]_|glpat-|xox[abpr]-|sk-|AIza|[a-f]{32}|[A-F]{32}"
_HEX = "0123456789abcdef"
#: The Gregorian calendar repeats after 400 years, 189 * 773 days.
_CYCLE, _CA, _CB = 146_097, 189, 773


def _number(key: str, kind: str, i, x) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string"))), 1, 12), 16, 10).cast("long")


def _rounds(inverse: bool) -> Column:
    return F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))


def permute_pair(a: Column, b: Column, ma, mb, key: str, kind: str, inverse: bool = False) -> Column:
    """The permuted pair (a, b) of numbers below ma and mb: even rounds add to a what b gives, odd ones the other way."""
    ma, mb = (F.lit(m).cast("long") if isinstance(m, int) else m for m in (ma, mb))
    sign = -1 if inverse else 1

    def turn(x, i):
        even = i % 2 == 0
        return F.struct(F.when(even, F.pmod(x["a"] + sign * (_number(key, kind, i, x["b"]) % ma), ma)).otherwise(x["a"]).alias("a"),
                        F.when(even, x["b"]).otherwise(F.pmod(x["b"] + sign * (_number(key, kind, i, x["a"]) % mb), mb)).alias("b"))

    return F.aggregate(_rounds(inverse), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), turn)


def _shift(s: Column, by: Column, sign: int, hexadecimal: bool) -> Column:
    """Each character moved on inside its class by two hex digits of `by`; other characters stay."""
    def one(c, i):
        v = F.conv(F.substring(by, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int") * sign
        if hexadecimal:
            low = F.lower(c)
            moved = F.substring(F.lit(_HEX), F.pmod(F.instr(F.lit(_HEX), low) - 1 + v, F.lit(16)) + 1, F.lit(1))
            return moved
        n = F.ascii(c)
        move = lambda base, size: F.chr((F.pmod(n - base + v, F.lit(size)) + base).cast("long"))
        return F.when((n >= 48) & (n <= 57), move(48, 10)).when((n >= 65) & (n <= 90), move(65, 26)).when((n >= 97) & (n <= 122), move(97, 26)).otherwise(c)

    return F.when(F.length(s) == 0, s).otherwise(F.concat_ws("", F.transform(F.split(s, ""), one)))


def permute_string(s: Column, key: str, kind: str, inverse: bool = False, hexadecimal: bool = False) -> Column:
    """s with its halves shifted by turns, character by character inside each class."""
    half = F.floor(F.length(s) / 2).cast("int")
    sign = -1 if inverse else 1

    def turn(x, i):
        even = i % 2 == 0
        other = F.when(even, x["b"]).otherwise(x["a"])
        by = F.sha2(F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), F.length(s).cast("string"), other), 512)
        return F.struct(F.when(even, _shift(x["a"], by, sign, hexadecimal)).otherwise(x["a"]).alias("a"), F.when(even, x["b"]).otherwise(_shift(x["b"], by, sign, hexadecimal)).alias("b"))

    return F.aggregate(_rounds(inverse), F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b")), turn, lambda x: F.concat(x["a"], x["b"]))


def luhn_sum(digits: Column) -> Column:
    """Sum of the Luhn rule over all digits, the last one a check digit."""
    n = F.length(digits)

    def one(c, i):
        d = c.cast("int")
        return F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def _refill(pattern_of: Column, values: Column, letters: bool = False) -> Column:
    """The digits (and letters) of a formatted value replaced one after the other by others; all else stays."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def one(a, c):
        taken = c.between("0", "9") | c.between("A", "Z") if letters else c.between("0", "9")
        return F.struct(F.concat(a["s"], F.when(taken, F.substring(values, a["i"], F.lit(1))).otherwise(c)).alias("s"), (a["i"] + taken.cast("int")).alias("i"))

    return F.aggregate(F.split(pattern_of, ""), start, one, lambda a: a["s"])


def _pad(x: Column, n) -> Column:
    return F.lpad(x.cast("string"), n, "0")


def card(m: Column, key: str, inverse: bool = False) -> Column:
    """A number of 13 to 19 digits with a right check digit; null for others. The new check digit is right too."""
    d = F.regexp_replace(m, "[ -]", "")
    n = F.length(d) - 1
    la = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    x = permute_pair(F.substring(d, F.lit(1), la).cast("long"), F.substring(d, la + 1, n - la).cast("long"), ten(la), ten(n - la), key, "card", inverse)
    body = F.concat(_pad(x["a"], la), _pad(x["b"], n - la))
    whole = F.concat(body, ((F.lit(10) - luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    return F.when(F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0), _refill(m, whole))


def phone(m: Column, key: str, inverse: bool = False) -> Column:
    """The last ten digits. Area codes from 200 with exchanges from 200, area codes from 200 with lower exchanges, and
    lower area codes are three sets, each permuted in itself."""
    all_ = F.regexp_replace(m, "[^0-9]", "")
    lead = F.substring(all_, F.lit(1), F.length(all_) - 10)
    d = F.substring(all_, F.length(all_) - 9, F.lit(10))
    area, rest = F.substring(d, 1, 3).cast("long"), F.substring(d, 4, 7).cast("long")
    low_a, high_a = F.when(area >= 200, 200).otherwise(0), F.when(area >= 200, 1000).otherwise(200)
    low_b = F.when((area >= 200) & (rest >= 2_000_000), 2_000_000).otherwise(0)
    high_b = F.when((area >= 200) & (rest < 2_000_000), 2_000_000).otherwise(10_000_000)
    x = permute_pair(area - low_a, rest - low_b, high_a - low_a, high_b - low_b, key, "phone", inverse)
    return _refill(m, F.concat(lead, _pad(x["a"] + low_a, 3), _pad(x["b"] + low_b, 7)))


def abroad(m: Column, key: str, inverse: bool = False) -> Column:
    """A number of 8 to 15 digits after a plus sign, null for others. The country stays: one digit for 1 and 7, else
    two, however the number is spaced; a single digit in brackets, as in +49 (0)30 ..., is for calls inside the country: it stays, and
    the number links with the same one written without it."""
    inside = F.regexp_extract(m, r"\(([0-9])\)", 1)
    bare = F.regexp_replace(m, r"\([0-9]\)", "(\u0001)")
    d = F.regexp_replace(bare, "[^0-9]", "")
    lead = F.when(d.rlike("^[17]"), 1).otherwise(2)
    rest = permute_string(F.substring(d, lead + 1, F.length(d)), key, "abroad", inverse)
    return F.when(F.length(d).between(8, 15), F.replace(_refill(bare, F.concat(F.substring(d, F.lit(1), lead), rest)), F.lit("\u0001"), inside))


def ssn(m: Column, key: str, inverse: bool = False) -> Column:
    """A national id of the form area-group-serial, areas 001 to 899 without 666, no part zero; null for others."""
    area, group, serial = (F.substring(m, F.lit(i), F.lit(n)).cast("long") for i, n in ((1, 3), (5, 2), (8, 4)))
    at = area - 1 - (area > 666).cast("int")
    x = permute_pair(at * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn", inverse)
    new = F.floor(x["a"] / 99) + 1
    new = new + (new >= 666).cast("int")
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), F.concat_ws("-", _pad(new, 3), _pad(x["a"] % 99 + 1, 2), _pad(x["b"] + 1, 4)))


def _mod97(s: Column) -> Column:
    """The number that s stands for, A = 10 to Z = 35, modulo 97."""
    def one(a, c):
        n = F.ascii(c)
        return F.when(n >= 65, (a * 100 + n - 55) % 97).otherwise((a * 10 + n - 48) % 97)

    return F.aggregate(F.split(s, ""), F.lit(0), one)


def iban(m: Column, key: str, inverse: bool = False) -> Column:
    """An account number of 15 to 34 characters with right check digits; null for others. Country and the classes
    of all characters stay, and the new check digits are right."""
    c = F.regexp_replace(m, " ", "")
    land, own = F.substring(c, 1, 2), F.substring(c, F.lit(5), F.length(c))
    check = lambda body: _pad(F.lit(98) - _mod97(F.concat(body, land, F.lit("00"))), 2)
    new = permute_string(own, key, "iban", inverse)
    return F.when(F.length(c).between(15, 34) & (F.substring(c, 3, 2) == check(own)), _refill(m, F.concat(land, check(new), new), True))


def ip(m: Column, key: str, inverse: bool = False) -> Column:
    """An IPv4 address, as two halves of 16 bits; null if a part is over 255."""
    p = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    x = permute_pair(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip", inverse)
    octets = [F.floor(x["a"] / 256), x["a"] % 256, F.floor(x["b"] / 256), x["b"] % 256]
    return F.when(F.array_max(p) <= 255, F.concat_ws(".", *[o.cast("long").cast("string") for o in octets]))


def date(m: Column, key: str, inverse: bool = False) -> Column:
    """A calendar date in its cycle of 400 years; null if there is no such day.

    Years first: any day goes to any day. Years last: day and month may stand in either order with slashes, and with
    or without leading zeros, so each of the two keeps its width and its range (1 to 12, 13 to 28), which is a
    day in every month and year; days from 29 keep day and month, and the year changes (29 February: to a leap year).
    """
    first = F.lit("2000-01-01").cast("date")
    day = F.datediff(F.try_to_timestamp(F.regexp_replace(m, "/", "-"), F.lit("yyyy-MM-dd")).cast("date"), first)
    cycle = F.floor(day / _CYCLE)
    k = (day - cycle * _CYCLE).cast("long")
    x = permute_pair(F.floor(k / _CB), k % _CB, _CA, _CB, key, "date", inverse)
    new = F.date_format(F.date_add(first, (cycle * _CYCLE + x["a"] * _CB + x["b"]).cast("int")), "yyyy-MM-dd")
    year_first = F.when(day.isNotNull(), F.when(m.contains("/"), F.regexp_replace(new, "-", "/")).otherwise(new))

    mark = F.when(m.contains("/"), "/").otherwise(".")
    part = lambda i: F.regexp_extract(m, r"^([0-9]{1,2})[/.]([0-9]{1,2})[/.]([0-9]{4})$", i)
    s, t, y = part(1), part(2), part(3).cast("long")
    a, b = s.cast("long"), t.cast("long")
    swapped = (mark == "/") & (b > 12)
    dd, mm = F.when(swapped, b).otherwise(a), F.when(swapped, a).otherwise(b)
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    most = F.when(mm == 2, F.when(leap, 29).otherwise(28)).when(mm.isin(4, 6, 9, 11), 30).otherwise(31)
    low = lambda text, v: F.when((F.length(text) == 2) & (v > 12), 13).otherwise(1)
    size = lambda text, v: F.when(F.length(text) == 1, 9).when(v > 12, 16).otherwise(12).cast("long")
    year = y % 400
    z = permute_pair((a - low(s, a)) * size(t, b) + b - low(t, b), year, size(s, a) * size(t, b), 400, key, "day", inverse)
    usual = F.concat(F.lpad((F.floor(z["a"] / size(t, b)) + low(s, a)).cast("string"), F.length(s), "0"), mark, F.lpad((z["a"] % size(t, b) + low(t, b)).cast("string"), F.length(t), "0"), mark, _pad(y - year + z["b"], 4))
    late = permute_pair(F.floor(year / 20), year % 20, 20, 20, key, "late", inverse)
    # the 97 leap years of a cycle: 0, 4, ..., 96, 104, ..., 396
    rank = F.floor(year / 4) - F.when(year > 300, 3).when(year > 200, 2).when(year > 100, 1).otherwise(0)
    moved = F.pmod(rank + (-1 if inverse else 1) * _number(key, "leap", F.lit(0), F.lit(0)), F.lit(97))
    leap_year = 4 * (moved + F.when(moved > 72, 3).when(moved > 48, 2).when(moved > 24, 1).otherwise(0))
    new_year = F.when((dd == 29) & (mm == 2), leap_year).otherwise(late["a"] * 20 + late["b"])
    kept = F.concat(s, mark, t, mark, _pad(y - year + new_year, 4))
    year_last = F.when(dd.between(1, most) & mm.between(1, 12), F.when(dd > 28, kept).otherwise(usual))
    return F.when(m.rlike("^[0-9]{4}"), year_first).otherwise(year_last)


def _email(m: Column, key: str, inverse: bool) -> Column:
    name = F.substring_index(m, "@", 1)
    return F.concat(permute_string(name, key, "email", inverse), F.substring(m, F.length(name) + 1, F.length(m)))


def _secret(m: Column, key: str, inverse: bool) -> Column:
    low = permute_string(F.lower(m), key, "secret", inverse, hexadecimal=True)
    return F.when(m == F.lower(m), low).otherwise(F.upper(low))


def _keyed(m: Column, key: str, inverse: bool) -> Column:
    lead = F.regexp_extract(m, "^(A[KS]IA|gh[pousr]_|glpat-|xox[abpr]-|sk-|AIza)", 1)
    return F.concat(lead, permute_string(F.substring(m, F.length(lead) + 1, F.length(m)), key, "keyed", inverse))


KINDS = {"email": _email, "iban": iban, "keyed": _keyed, "secret": _secret, "ssn": ssn, "card": card, "phone": phone, "abroad": abroad, "ip": ip, "date": date}


def replaced(m: Column, key: str, inverse: bool = False) -> Column:
    """The pseudonym of one found value, or null if it is not valid."""
    out = None
    for kind, f in KINDS.items():
        case = F.when(m.rlike("^(?:" + PATTERNS[kind] + ")$"), f(m, key, inverse))
        out = case if out is None else F.coalesce(out, case)
    return out


def pseudonymize(docs: DataFrame, key: str, inverse: bool = False, column: str = "text") -> DataFrame:
    """docs with pseudonyms for personal data in `column`, and n_replaced.

    Kinds: e-mail names; account numbers (IBAN) with right check digits; access keys with a well-known beginning;
    hexadecimal secrets of 32 to 64 digits; national ids of the form 123-45-6789; payment cards with a right check
    digit; phone numbers of ten digits, with or without +1 or 1 before them and with any of the usual marks between them (one number is one
    pseudonym in all these forms), or of 8 to 15 after a plus sign; IPv4 addresses; dates with years of four digits.
    A value that fails its check stays as it is. Left alone are names and street addresses, IPv6 addresses, JSON web tokens, passwords,
    ten digits without a mark between them or with spaces alone, dates that begin with the day and have dashes, dates with names of months, and
    dates without a year of four digits. A null text stays null with n_replaced 0. Whole texts are
    scanned; narrow, so repeated rows and skew do not matter. A column n_replaced already there stays, and the
    added one gets a name with "_" behind.
    """
    keep, count = docs.columns, "n_replaced"
    while count in keep:
        count += "_"
    found, new = "_found", "_new"
    while {found, new} & set(keep):
        found, new = found + "_", new + "_"
    t = F.col(column)
    out = docs.select(*keep).withColumn(found, F.when(t.rlike(MAY), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))))
    out = out.withColumn(new, F.when(F.size(found) > 0, F.transform(found, lambda m: replaced(m, key, inverse))))
    gaps = F.split(t, ANY, -1)
    text = F.concat_ws("", F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(F.col(new), i), F.get(F.col(found), i), F.lit("")))))
    out = out.withColumn(column, F.when(F.col(new).isNull(), t).otherwise(text))
    return out.select(*keep, F.coalesce(F.size(F.filter(new, lambda x: x.isNotNull())), F.lit(0)).alias(count))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
