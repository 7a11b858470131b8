r"""PII pseudonyms: validated numbers, dates and identifiers are permuted by a keyed Feistel network within their format.

Only built-in expressions are used.  One pattern finds candidates, a check per kind (Luhn, mod 97, calendar, ranges)
decides, and the value is replaced by another valid value of the same shape.  The permutation depends on the key, the kind
and the canonical value alone, so equal values stay equal across documents and different ones stay different:

* cards: 13-19 digits that pass Luhn; all but the last digit are permuted and the check digit is computed anew
* IBAN: country kept, account part permuted by character class, check digits computed anew
* US social security numbers: permuted within the valid ones; phones with ``+``: calling code kept, other digits permuted,
  the same in any grouping; phones without ``+``: all digits permuted
* IPv4 addresses: permuted within 32 bits; dates from 1900-01-01 on: permuted within 72,900 days, any notation
* e-mail: local part permuted by character class, domain kept; secrets assigned in quotes of either kind, of 8 characters or more: value permuted likewise

Numbers that fail their check stay as they are.
"""
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import let

ROUNDS = 8
DIGITS, HEX = "0123456789", "0123456789abcdef"
EPOCH, DAYS_SIDE = "1900-01-01", 270
AREAS, GROUPS, SERIALS = 898, 99, 9999
WALK = 16

# Calling codes of one and two digits; all others have three.
CALLING_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
HEX_SHAPE = "^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{16,}$"

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Area code and groups of two digits, or three and then two: one separator throughout.
PAIRS = "|".join(rf"{s}\d{{1,4}}(?:{s}\d{{3}}{s}\d\d{s}\d\d|(?:{s}\d\d){{3,4}})" for s in (" ", "-", r"\."))
#: Candidates by kind, tried in this order.  Each starts at the border of a run, so that long runs are read once.
KINDS: dict[str, str] = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "secret": r"(?<![A-Za-z])(?i:token|secret|password|passwd|api_?key)[\"']?\s{0,3}[=:]\s{0,3}(?:\"[^\"\s]{8,}+\"|'[^'\s]{8,}+')",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}(?!\w)"
             r"|(?<![\w+])\+\d{1,3}[ .-]\d{1,4}[ .-]\d{3,4}[ .-]?\d{3,4}(?!\w|[.-]\d)"
             rf"|(?<![\w+])\+\d{{1,3}}(?:{PAIRS})(?!\w|[.-]\d)"
             r"|(?<![\w+])\+\d{8,15}(?!\w)|(?<![\w.-])\d{3}(?:[.-]\d{3}[.-]| \d{3} )\d{4}(?!\w|[.-]\d)",
    "date": r"(?<![\w.-])(?:\d{4}([-/.])\d{1,2}\{ymd}\d{1,2}|\d{1,2}([-/.])\d{1,2}\{dmy}\d{4})(?!(?![Tt]\d)\w|[.-]\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{OCTET}\.){{3}}{OCTET}(?!\w|\.\d)",
    "card": r"(?<!\w)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)",
}


def _pattern() -> str:
    date = KINDS["date"].replace(r"\{ymd}", r"\1").replace(r"\{dmy}", r"\2")
    return "|".join(f"(?:{date if kind == 'date' else p})" for kind, p in KINDS.items())


PATTERN = _pattern()


def _number(c: Column) -> Column:
    return c.cast("long")


def _hash(key: str, kind: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}|{kind}|"), i.cast("string"), F.lit("|"), value), 256)


def _hash_number(key: str, kind: str, i: Column, value: Column) -> Column:
    return F.conv(F.substring(_hash(key, kind, i, value.cast("string")), 1, 12), 16, 10).cast("long")


def permute_pair(left: Column, right: Column, a: int, b: int, key: str, kind: str) -> Column:
    """Feistel over numbers (left < a, right < b) with addition modulo a or b: a permutation for any a and b."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")),
        lambda acc, i: F.when(i % 2 == 1, F.struct(
            F.pmod(acc["l"] + _hash_number(key, kind, i, acc["r"]), F.lit(a).cast("long")).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), F.pmod(acc["r"] + _hash_number(key, kind, i, acc["l"]), F.lit(b).cast("long")).alias("r"))))
    return step


def _shifted(text: Column, pad: Column, hexadecimal: Column) -> Column:
    """Every character moved within its class (digits, a-z, A-Z; or hex digits) by a byte of the pad; others stay."""
    def char(c: Column, i: Column, p: Column) -> Column:
        by = F.conv(F.substring(p, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int")
        at = F.ascii(c)
        moved = lambda first, n: F.chr(F.pmod(at - first + by, F.lit(n)) + first)
        return (F.when(hexadecimal, F.substring(F.lit(HEX), F.pmod(F.instr(F.lit(HEX), c) - 1 + by, F.lit(16)) + 1, F.lit(1)))
                .when(c.between("0", "9"), moved(48, 10)).when(c.between("a", "z"), moved(97, 26))
                .when(c.between("A", "Z"), moved(65, 26)).otherwise(c))

    return F.when(F.length(text) == 0, text).otherwise(let(pad, lambda p: F.array_join(
        F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: char(c, i, p)), "")))


def permute_text(value: Column, key: str, kind: str) -> Column:
    """Feistel over the two halves of a string, character classes kept in place.  A value of one character (there is no
    other half to draw from) is moved by a fixed keyed step.

    Strings of hex shape are permuted among all hex strings of their length, others class by class.  An image of the other shape
    is permuted again, so that either set maps onto itself; an image leaves its set with a chance below one in a thousand at
    hex shape, and after ``WALK`` steps it is left as it is."""
    def rounds(v: Column, is_hex: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        last = F.aggregate(
            F.sequence(F.lit(1), F.lit(ROUNDS)),
            F.struct(F.substring(v, F.lit(1), half).alias("l"), F.substring(v, half + 1, F.length(v)).alias("r")),
            lambda acc, i: F.struct(acc["r"].alias("l"), _shifted(acc["l"], _hash(key, kind, i, acc["r"]), is_hex).alias("r")))
        return let(last, lambda s: F.concat(s["l"], s["r"]))

    def walk(v: Column) -> Column:
        is_hex = v.rlike(HEX_SHAPE)
        start = F.struct(v.alias("v"), F.lit(False).alias("done"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), start, lambda at, i: F.when(at["done"], at).otherwise(
            let(rounds(at["v"], is_hex), lambda new: F.struct(new.alias("v"), (new.rlike(HEX_SHAPE) == is_hex).alias("done")))))
        return end["v"]

    return let(value, walk)


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn_sum(digits: Column, double_from: int) -> Column:
    """Sum over digits from the right; those at even (1) or odd (0) distance are doubled."""
    chars = F.split(F.reverse(digits), "")
    values = F.transform(F.filter(chars, lambda c: c != ""), lambda c, i: F.when(
        i % 2 == double_from, F.when(_number(c) > 4, _number(c) * 2 - 9).otherwise(_number(c) * 2)).otherwise(_number(c)))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 1) % 10 == 0


def _refill(shape: Column, digits: Column) -> Column:
    """``digits`` in the places of the digits of ``shape``."""
    at = lambda i: F.length(digits_of(F.substring(shape, F.lit(1), i)))
    return let(digits, lambda d: F.array_join(F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(
        F.substring(shape, i, F.lit(1)).between("0", "9"), F.substring(d, at(i), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))), ""))


def _card(m: Column, key: str) -> Column:
    def new(d: Column) -> Column:
        body = permute_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda b: F.concat(b, F.pmod(10 - _luhn_sum(b, 0), F.lit(10)).cast("string")))

    ok = lambda d: F.length(d).between(13, 19) & luhn_valid(d)
    return let(digits_of(m), lambda d: F.when(ok(d), _refill(m, new(d))))


def _mod97(c: Column) -> Column:
    values = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.when(
        x.between("0", "9"), _number(x)).otherwise((F.ascii(x) - 55).cast("long")))
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: F.pmod(F.when(x > 9, a * 100 + x).otherwise(a * 10 + x), F.lit(97).cast("long")))


def _iban(m: Column, key: str) -> Column:
    def new(v: Column) -> Column:
        country = F.substring(v, 1, 2)
        body = permute_text(F.substring(v, F.lit(5), F.length(v)), key, "iban")
        return let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    def spaced(v: Column) -> Column:  # groups of four where the original had spaces
        return F.when(m.contains(" "), F.rtrim(F.regexp_replace(v, "(.{4})", "$1 "))).otherwise(v)

    ok = lambda v: F.length(v).between(15, 34) & (_mod97(F.concat(F.substring(v, F.lit(5), F.length(v)), F.substring(v, 1, 4))) == 1)
    return let(F.replace(m, F.lit(" "), F.lit("")), lambda v: F.when(ok(v), spaced(new(v))))


def _phone(m: Column, key: str) -> Column:
    def new(digits: Column) -> Column:
        code = F.when(m.startswith("+"), F.regexp_extract(digits, CALLING_CODE, 0)).otherwise("")
        return let(code, lambda c: F.concat(c, permute_text(F.substring(digits, F.length(c) + 1, F.length(digits)), key, "phone")))

    return _refill(m, let(digits_of(m), new))


def _ip(m: Column, key: str) -> Column:
    octets = F.transform(F.split(m, r"\."), _number)
    pair = let(octets, lambda o: permute_pair(F.get(o, 0) * 256 + F.get(o, 1), F.get(o, 2) * 256 + F.get(o, 3), 65536, 65536, key, "ip"))
    return let(pair, lambda p: F.concat_ws(".", *[x.cast("long").cast("string") for s in ("l", "r") for x in (F.floor(p[s] / 256), p[s] % 256)]))


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = (_number(F.substring(m, a, n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    pair = permute_pair(index * GROUPS + group - 1, serial - 1, AREAS * GROUPS, SERIALS, key, "ssn")
    number = lambda p: F.floor(p["l"] / GROUPS).cast("long")
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    return F.when(ok, let(pair, lambda p: F.concat_ws(
        "-", pad(F.when(number(p) >= 665, number(p) + 2).otherwise(number(p) + 1), 3), pad(p["l"] % GROUPS + 1, 2), pad(p["r"] + 1, 4))))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")


def _date(m: Column, key: str) -> Column:
    """Day first where that is a calendar date, else month first; the new date is written in the same order."""
    first = F.substring(m, 1, 4).rlike(r"^\d{4}$")
    mark = F.regexp_extract(m, r"([-/.])", 1)
    parts = F.transform(F.split(m, "[-/.]"), lambda x: x)

    def new(p: Column) -> Column:
        y = F.when(first, F.get(p, 0)).otherwise(F.get(p, 2))
        day_first = _day(y, F.get(p, 1), F.when(first, F.get(p, 2)).otherwise(F.get(p, 0)))
        month_first = F.when(~first, _day(y, F.get(p, 0), F.get(p, 1)))
        return let(F.struct(day_first.alias("d"), month_first.alias("m")), shaped)

    def shaped(found: Column) -> Column:
        index = F.datediff(F.coalesce(found["d"], found["m"]), F.lit(EPOCH).cast("date"))
        pair = permute_pair(F.floor(index / DAYS_SIDE), index % DAYS_SIDE, DAYS_SIDE, DAYS_SIDE, key, "date")
        moved = let(pair, lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s["l"] * DAYS_SIDE + s["r"]).cast("int")))
        written = let(moved, lambda x: F.when(first, F.date_format(x, "yyyy-MM-dd")).when(
            found["d"].isNotNull(), F.date_format(x, "dd-MM-yyyy")).otherwise(F.date_format(x, "MM-dd-yyyy")))
        return F.when(index.between(0, DAYS_SIDE * DAYS_SIDE - 1), F.replace(written, F.lit("-"), mark))

    return let(parts, new)


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(permute_text(F.lower(F.substring(m, F.lit(1), at - 1)), key, "email"), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    lead = F.length(F.regexp_extract(m, r"""^(\w+["']?\s*[=:]\s*["'])""", 1))
    value = F.substring(m, lead + 1, F.length(m) - lead - 1)
    return F.concat(F.substring(m, F.lit(1), lead), permute_text(value, key, "secret"), F.right(m, F.lit(1)))


REPLACE = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "date": _date, "ssn": _ssn, "ip": _ip, "card": _card}
#: Which kind a candidate is; the order decides.
SHAPES = {"email": "@.*[A-Za-z]$", "secret": "[\"']$", "iban": "^[A-Z]", "phone": r"^(\+|\()|^\d{3}[ .-]\d{3}[ .-]\d{4}$",
          "date": r"^(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})$", "ssn": r"^\d{3}-\d\d-\d{4}$", "ip": r"^\d+\.\d+\.\d+\.\d+$", "card": r"^\d"}


def pseudonym(m: Column, key: str) -> Column:
    """(kind, new value) of a candidate; null where its check fails."""
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, shape in reversed(SHAPES.items()):
        out = F.when(m.rlike(shape), _tagged(REPLACE[kind](m, key), kind)).otherwise(out)
    return out


def _tagged(value: Column, kind: str) -> Column:
    return let(value, lambda v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value"))))


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``text`` rewritten, and ``pseudonyms``: array of (kind, value) put in.

    A null text stays null, an empty one empty, both without pseudonyms; texts of any length are read whole.  Rows are
    independent: repeated rows give equal rows; an empty table stays empty.  A column of the table named ``pseudonyms`` is
    replaced, all others are kept whatever their names.  Texts without a digit or ``@`` or quoted value are skipped.
    """
    t = F.col(f"`{text}`")

    def rewritten(found: Column) -> Column:
        new = F.transform(found, lambda m: let(pseudonym(m, key), lambda p: F.struct(
            F.coalesce(p["value"], m).alias("v"), p["kind"].alias("kind"))))
        return let(new, lambda n: F.struct(
            F.array_join(F.zip_with(F.split(t, PATTERN, -1), n, lambda a, b: F.concat(a, F.coalesce(b["v"], F.lit("")))), "").alias("text"),
            F.transform(F.filter(n, lambda x: x["kind"].isNotNull()), lambda x: F.struct(x["kind"].alias("kind"), x["v"].alias("value"))).alias("found")))

    none = F.array().cast("array<struct<kind:string,value:string>>")
    result = F.when(t.rlike("""[0-9@"]|[=:]\\s{0,3}'"""), let(F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)), lambda f: F.when(F.size(f) > 0, rewritten(f))))
    new = "_new"
    while new in docs.columns:
        new += "_"
    out = docs.withColumn(new, result)
    rest = [F.coalesce(F.col(f"{new}.text"), F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`")
            for c in docs.columns if c != "pseudonyms"]
    return out.select(*rest, F.coalesce(f"{new}.found", none).alias("pseudonyms"))
