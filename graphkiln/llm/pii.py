"""Personal data by format-preserving Feistel pseudonyms.

Numbers, dates and addresses are found by pattern, validated, and moved by a keyed permutation to another valid value of
the same format, so a value becomes the same pseudonym in every document and different values stay apart:

- card numbers of 12 to 19 digits (Luhn digit right; other lengths than 16 only with a first digit that cards of that length
  have): all but the last digit are permuted, the last becomes the new check digit
- telephone numbers: up to ten last digits, without the country code or leading zero; a bare 3-3-4 group is one only if area and
  exchange are North American ones. IPv4 addresses: as 2 x 16 bits
- US social security numbers (valid area, group, serial): as their rank among the valid ones
- IBANs (registered country and its length, mod 97 right): all account digits, with new check digits; letters stay
- dates (valid ones from 1800 to 2199; day, month and year in either order or year first): as their day among the 146,097 of
  the 400 years
- e-mail addresses: letters and digits of the local part (ASCII letters become lower case, others become ASCII ones drawn
  by a keyed hash of the address), the domain stays
- hexadecimal secrets of 32 digits and more, of any length, with a letter and a digit: all digits

Two Feistel networks do this. Values that are a rank below a x b go through one that alternately adds a keyed hash of one
half to the other; strings of digits of any length through one that adds a keyed stream made from one half to the other.
Both are bijections for every key and tweak. The key has no default: who knows it can undo the pseudonyms.
Native: DataFrame functions inside the row, no shuffle.

Defined results: null stays null; text without personal data is returned unchanged, byte for byte; what fails its
validation (a date that isn't one, an IBAN with wrong check digits, a number without a right Luhn digit) stays. Very long
texts, and very long addresses or secrets, take time in proportion to their length (no pattern recurses by length).
Repeated rows are treated alike; an empty table gives no rows; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphkiln.llm.common import let

ROUNDS = 8
DATES_FROM, DATES = "1800-01-01", 146_097
#: Digits that a word of the string network holds; 36^11 and a 60-bit hash add up to less than 2^63.
WORD = 11
#: Country codes of telephone numbers, by length.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: The registered countries of IBANs by length.
IBANS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR",
    27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
#: In telephone numbers: what may stand between two digits, and what can't follow.
_GAP, _END = r"\)?[ .\-/]?\(?", r"(?![0-9]|[\-/.:,][0-9])"
#: Telephone numbers of a country code whose length is known, of three groups behind an area code, of any other country code,
#: and national ones: pairs, behind a zero (9 to 13 digits), and nine digits without one.
PHONES = (
    rf"(?<![0-9+])\+(?:1(?:{_GAP}[0-9]){{10}}|3[34](?:[ ]?\(0\))?(?:{_GAP}[0-9]){{9}}|44(?:[ ]?\(0\))?(?:{_GAP}[0-9]){{10}}){_END}",
    r"(?:(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{2,4}\)|[0-9]{3})[ .\-]?[0-9]{3}|\([0-9]{2,4}\)[ .\-]?[0-9]{3}|(?<![0-9+])(?<![0-9][.\-/])[2-9][0-9]{2}[ .\-]?[2-9][0-9]{2})[ .\-][0-9]{4}(?![0-9])",
    rf"(?<![0-9+])\+[0-9](?:{_GAP}[0-9]){{7,14}}{_END}",
    r"(?<![0-9+])\+[0-9]{8,15}(?![0-9])",
    rf"(?<![0-9+:.,/\-])0[1-9](?:[ .\-][0-9]{{2}}){{4}}{_END}",
    rf"(?<![0-9+:.,/\-])(?=\(?0[0-9]{{1,5}}\)?[ /\-])\(?0(?:\)?[ /\-]?[0-9]){{8,12}}{_END}",
    rf"(?<![0-9+:.,/\-])(?<![0-9][ ])(?:[6-9][0-9]{{2}}(?: [0-9]{{3}} [0-9]{{3}}(?! [0-9])|-[0-9]{{3}}-[0-9]{{3}}|(?:[ \-][0-9]{{2}}){{3}})|9[0-9] [0-9]{{3}} [0-9]{{2}} [0-9]{{2}}){_END}",
)
#: Alternatives of the search pattern, by kind, in order of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+(?:\.[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+)++",
    "iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}[0-9]{2} ?[A-Z0-9])(?:" + "|".join(f"(?:{'|'.join(of.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, of in IBANS.items()) + r")(?![\p{L}\p{N}])",
    "secret": r"(?<![\p{L}\p{N}])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![\p{L}\p{N}])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9\-/.])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}|[0-9]{1,2}[/.][0-9]{1,2}[/.][0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![0-9]|[\-/.][0-9])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "number": r"(?<![0-9])(?:[0-9]{4}([ \-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{6}\1[0-9]{4,5})|[0-9]{12,19})(?![0-9])",
    "phone": "|".join(PHONES),
}
SEARCH = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _powers(base: int, most: int) -> Column:
    return F.array(*[F.lit(base**k).cast("long") for k in range(most + 1)])


def _long(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def feistel(left: Column, right: Column, a: Column, b: Column, tweak: Column, key: str) -> Column:
    """struct(l, r): the permuted pair; a and b at most 36^12."""

    def mixed(r: Column, x: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), x.cast("string")).cast("binary"), 256)
        return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")

    def turn(acc: Column, r: Column) -> Column:
        l, x = acc["l"], acc["r"]
        even = r % 2 == 0
        return F.struct(F.when(even, F.pmod(l + mixed(r, x), a)).otherwise(l).alias("l"), F.when(even, x).otherwise(F.pmod(x + mixed(r, l), b)).alias("r"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def luhn(payload: Column) -> Column:
    """The check digit that belongs after a string of digits."""
    digits = F.transform(F.reverse(F.split(payload, "")), lambda c, i: F.when(i % 2 == 0, 2 * _long(c) - F.when(c >= "5", 9).otherwise(0)).otherwise(_long(c)))
    return F.pmod(-F.aggregate(digits, F.lit(0).cast("long"), lambda s, d: s + d), F.lit(10))


def mod97(text: Column) -> Column:
    """An IBAN's remainder (country and check digits last, letters as 10 to 35)."""
    turned = F.split(F.concat(F.substring(text, 5, 100), F.substring(text, 1, 4)), "")

    def step(acc: Column, c: Column) -> Column:
        v = _long(F.conv(c, 36, 10))
        return F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))

    return F.aggregate(turned, F.lit(0).cast("long"), step)


def refill(text: Column, where: str, new: Column) -> Column:
    """``text`` with its characters that match ``where`` replaced by those of ``new`` in turn."""

    def put(chars: Column) -> Column:
        spots = F.transform(chars, lambda c, i: F.struct(i.alias("i"), c.alias("c")))
        at = F.filter(spots, lambda x: x["c"].rlike(where))
        filled = F.zip_with(at, F.slice(F.split(new, ""), 1, F.size(at)), lambda x, c: F.struct(x["i"].alias("i"), F.coalesce(c, x["c"]).alias("c")))
        return F.array_join(F.transform(F.sort_array(F.concat(filled, F.filter(spots, lambda x: ~x["c"].rlike(where)))), lambda x: x["c"]), "")

    return let(F.split(text, ""), put)


def permuted(text: Column, base: Column, tweak: Column, key: str) -> Column:
    """A string of lower-case digits of a base (10, 16 or 36) of any length, permuted among the strings of its length."""
    powers = F.when(base == 10, _powers(10, WORD)).when(base == 16, _powers(16, WORD)).otherwise(_powers(36, WORD))

    def added(x: Column, other: Column, r: Column) -> Column:
        def word(seed: Column, w: Column, i: Column) -> Column:
            stream = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 15), 16, 10).cast("long")
            v = F.pmod(F.call_function("conv", w, base, F.lit(10)).cast("long") + stream, F.get(powers, F.length(w)))
            return F.lpad(F.lower(F.call_function("conv", v.cast("string"), F.lit(10), base)), F.length(w), F.lit("0"))

        seed = F.sha2(F.concat_ws("|", F.lit(key), tweak, r.cast("string"), other).cast("binary"), 256)
        return let(seed, lambda s: F.array_join(F.transform(F.regexp_extract_all(x, F.lit(f".{{1,{WORD}}}"), F.lit(0)), lambda w, i: word(s, w, i)), ""))

    def turn(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        return F.struct(F.when(even, added(acc["l"], acc["r"], r)).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(added(acc["r"], acc["l"], r)).alias("r"))

    half = (F.length(text) / 2).cast("int")
    start = F.struct(F.substr(text, F.lit(1), half).alias("l"), F.substr(text, half + 1, F.length(text)).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda acc: F.concat(acc["l"], acc["r"]))


def _kind(m: Column) -> Column:
    found = F.when(m.contains("@"), "email")
    for kind in ("iban", "secret", "ip", "date", "ssn", "number", "phone"):
        found = found.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return found.otherwise("none")


def _date(m: Column) -> Column:
    """struct(day, form): days since DATES_FROM, null unless valid; form: ymd, dmy or mdy."""
    part = lambda *at: F.try_to_date(F.concat_ws("-", *[F.get(F.split(m, r"[/.\-]"), F.lit(k)) for k in at]), "yyyy-M-d")
    dmy = part(2, 1, 0)
    form = F.when(m.rlike("^[0-9]{4}"), "ymd").when(dmy.isNotNull(), "dmy").otherwise("mdy")
    day = F.when(m.rlike("^[0-9]{4}"), part(0, 1, 2)).otherwise(F.coalesce(dmy, part(2, 0, 1)))
    n = F.date_diff(day, F.lit(DATES_FROM).cast("date"))
    return F.struct(F.when((n >= 0) & (n < DATES), n).cast("long").alias("day"), form.alias("form"))


def _subscriber(m: Column, d: Column) -> Column:
    """A telephone number's last digits, at most ten, without country code and leading zero."""
    known = F.when(m.startswith("+"), F.regexp_extract(d, f"^{COUNTRY}", 0)).when(m.rlike(f"^(?:{PHONES[1]})$"), "").otherwise(F.regexp_extract(d, f"^(?:00{COUNTRY}|0)", 0))
    left = F.length(d) - F.length(known) - m.contains("(0)").cast("int")
    return F.right(d, F.least(F.lit(10), left))


def _card(d: Column) -> Column:
    """Whether digits have a right Luhn digit and, unless they are 16, a first digit that cards of their length have."""
    n = F.length(d)
    known = (n == 16) | (n.isin(14, 15) & d.startswith("3")) | (~n.isin(14, 15, 16) & d.rlike("^[4-6]"))
    return known & (luhn(F.substr(d, F.lit(1), n - 1)) == _long(F.right(d, F.lit(1))))


def _parts(m: Column) -> Column:
    """What the networks get for a match: kind, valid; body, base (strings); form, l, r, a, b (ranks); tweak."""
    lit = lambda n: F.lit(n).cast("long")

    def parts(x: Column) -> Column:
        kind, d, local, day = x["kind"], x["d"], x["local"], x["date"]["day"]
        body = (
            F.when(kind == "number", F.substr(d, F.lit(1), F.length(d) - 1)).when(kind == "phone", _subscriber(m, d)).when(kind == "iban", F.substr(d, F.lit(3), F.length(d)))
            .when(kind == "email", F.regexp_replace(local, "[^a-z0-9]", "")).when(kind == "secret", F.lower(m)).otherwise("")
        )
        area, group, serial = _long(F.substring(d, 1, 3)), _long(F.substring(d, 4, 2)), _long(F.substring(d, 6, 4))
        octet = lambda k: _long(F.get(F.split(m, r"\."), F.lit(k)))
        valid = (
            F.when(kind == "ssn", (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0))
            .when(kind == "date", day.isNotNull())
            .when(kind == "iban", mod97(F.regexp_replace(m, " ", "")) == 1)
            .when(kind == "number", _card(d))
            .otherwise(kind != "none")
        )
        of = lambda ssn, date, ip: F.when(kind == "ssn", ssn).when(kind == "date", date).when(kind == "ip", ip)
        other = F.when(kind == "email", F.regexp_replace(local, r"[\x00-\x7F]", "")).when(kind == "iban", F.concat(F.substring(m, 1, 2), F.regexp_replace(F.substring(m, 5, 100), "[^A-Z]", "")))
        return F.struct(
            kind.alias("kind"), valid.alias("valid"), body.alias("body"), F.when(kind == "secret", 16).when(kind == "email", 36).otherwise(10).alias("base"), x["date"]["form"].alias("form"),
            of((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, F.floor(day / 773), octet(0) * 256 + octet(1)).alias("l"),
            of(serial - 1, F.pmod(day, lit(773)), octet(2) * 256 + octet(3)).alias("r"),
            of(lit(898 * 99), lit(DATES // 773), lit(65536)).alias("a"), of(lit(9999), lit(773), lit(65536)).alias("b"),
            F.concat_ws(":", kind, F.length(body).cast("string"), other).alias("tweak"),
        )

    digits = F.when(~m.contains("@"), F.regexp_replace(m, "[^0-9]", "")).otherwise("")
    return let(F.struct(_kind(m).alias("kind"), digits.alias("d"), F.lower(F.substring_index(m, "@", 1)).alias("local"), _date(m).alias("date")), parts)


def _render(m: Column, x: Column, y: Column, digits: Column, key: str) -> Column:
    """The pseudonym of the match ``m`` with parts ``x``, permuted rank ``y`` and permuted body ``digits``."""
    kind = x["kind"]
    pad = lambda v, n: F.lpad(v.cast("string"), n, F.lit("0"))
    d = F.regexp_replace(m, "[^0-9]", "")
    number = refill(m, "[0-9]", F.concat(digits, luhn(digits).cast("string")))
    phone = refill(m, "[0-9]", F.concat(F.substr(d, F.lit(1), F.length(d) - F.length(x["body"])), digits))
    ip = F.concat_ws(".", F.floor(y["l"] / 256).cast("string"), F.pmod(y["l"], F.lit(256)).cast("string"), F.floor(y["r"] / 256).cast("string"), F.pmod(y["r"], F.lit(256)).cast("string"))
    rank = F.floor(y["l"] / 99)
    ssn = F.concat_ws("-", pad(rank + F.when(rank >= 665, 2).otherwise(1), F.lit(3)), pad(F.pmod(y["l"], F.lit(99)) + 1, F.lit(2)), pad(y["r"] + 1, F.lit(4)))
    day = F.date_add(F.lit(DATES_FROM).cast("date"), (y["l"] * 773 + y["r"]).cast("int"))
    fields = F.when(m.rlike("(?<![0-9])[0-9](?![0-9])"), F.date_format(day, "d M yyyy")).otherwise(F.date_format(day, "dd MM yyyy"))
    field = lambda k: F.get(F.split(fields, " "), F.lit(k))
    mark = lambda k: F.get(F.regexp_extract_all(m, F.lit("[^0-9]"), F.lit(0)), F.lit(k))
    order = lambda i, j, k: F.concat(field(i), mark(0), field(j), mark(1), field(k))
    date = F.when(x["form"] == "ymd", order(2, 1, 0)).when(x["form"] == "dmy", order(0, 1, 2)).otherwise(order(1, 0, 2))
    local = refill(F.lower(F.substring_index(m, "@", 1)), "[a-z0-9]", digits)
    drawn = lambda seed, i: F.char(97 + F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", seed, i.cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("long"), F.lit(26)))
    seeded = lambda seed: F.array_join(F.transform(F.split(local, ""), lambda c, i: F.when(c.rlike(r"[^\x00-\x7F]"), drawn(seed, i)).otherwise(c)), "")
    foreign = let(F.sha2(F.concat_ws("|", F.lit(key), F.lit("letters"), F.lower(F.substring_index(m, "@", 1))).cast("binary"), 256), seeded)
    email = F.concat(F.when(m.rlike(r"^[^@]*+(?<=[^\x00-\x7F])|^[\x00-\x7F]*+[^\x00-\x7F@]"), foreign).otherwise(local), F.lit("@"), F.lower(F.substring_index(m, "@", -1)))
    solid = F.regexp_replace(m, " ", "")
    moved = F.concat(F.substring(solid, 1, 2), F.lit("00"), refill(F.substring(solid, 5, 100), "[0-9]", digits))
    checked = let(moved, lambda v: F.concat(F.substring(v, 1, 2), pad(98 - mod97(v), F.lit(2)), F.substring(v, 5, 100)))
    iban = let(checked, lambda v: refill(m, "[A-Z0-9]", v))
    secret = F.when(m == F.upper(m), F.upper(digits)).otherwise(digits)
    chosen = F.when(kind == "number", number).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "date", date).when(kind == "email", email).when(kind == "iban", iban).when(kind == "secret", secret)
    return F.when(x["valid"], chosen).otherwise(m)


def pseudonyms(matches: Column, key: str) -> Column:
    """array<struct<kind, value>>: the pseudonym of every match; kind is null where validation failed and the value stays."""

    def one(m: Column) -> Column:
        def value(x: Column) -> Column:
            rank = F.when(x["valid"] & x["l"].isNotNull(), feistel(x["l"], x["r"], x["a"], x["b"], x["tweak"], key))
            digits = F.when(x["valid"], permuted(x["body"], x["base"], x["tweak"], key))
            both = F.struct(rank.alias("rank"), digits.alias("digits"))
            return let(both, lambda y: F.struct(F.when(x["valid"], x["kind"]).alias("kind"), _render(m, x, y["rank"], y["digits"], key).alias("value")))

        return let(_parts(m), value)

    return F.transform(matches, one)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", report: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; ``report`` names an added array<struct<kind, value>> of what was replaced, in text order."""
    if not key:
        raise ValueError("pseudonyms need a key")
    t = F.col("_text")
    near = t.rlike("[0-9@]")
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_all"), F.col(f"`{text}`").alias("_text"))
    found = rows.select("*", F.when(near, F.regexp_extract_all(t, F.lit(SEARCH), F.lit(0))).otherwise(none).alias("_found"))
    found = found.select("*", F.when(F.size("_found") > 0, pseudonyms(F.col("_found"), key)).otherwise(F.array().cast("array<struct<kind:string,value:string>>")).alias("_new"))
    joined = F.array_join(F.zip_with(F.split(t, SEARCH, -1), F.col("_new"), lambda part, new: F.concat(part, F.coalesce(new["value"], F.lit("")))), "")
    changed = F.when(F.size("_found") > 0, joined).otherwise(t)
    out = [changed.alias(c) if c == text else F.col(f"_all.`{c}`").alias(c) for c in docs.columns if c != report]
    if report:
        out.append(F.filter("_new", lambda x: x["kind"].isNotNull()).alias(report))
    return found.select(*out)
