"""PII: format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Numbers and dates that pass their format's checks are mapped one to one to another valid value
of that format, so equal values stay equal in all documents and different ones stay different:
each format's valid values are a product of two ranges, and an even number of rounds
``(l, r) -> (r, l + F(r))`` permutes such a product; F is keyed SHA-256.

====== ==================================================================== =======================
kind   what is recognised                                                   what stays
====== ==================================================================== =======================
email  local part and domain                                                domain, character classes
iban   two letters and digits that pass mod 97                              country, letters, layout
card   13 to 19 digits that pass Luhn's check                               length, layout
phone  international or 3-3-4 numbers of 7 to 15 digits                      country code, layout
ip     four numbers up to 255                                               dotted form
ssn    ddd-dd-dddd with an area, group and serial that can occur            layout
date   calendar dates 1900 to 2099, yyyy-mm-dd, dd/mm/yyyy, dd.mm.yyyy,     layout
       or mm/dd/yyyy where the day is over 12
====== ==================================================================== =======================

What looks alike but fails the check stays as it is. Card numbers and IBANs are looked for among
all runs of whole groups, so neighbours don't hide them; what is left of such runs is searched
again for the other kinds.

Defined results: a null text stays null and an empty one empty; other columns pass through
unchanged; repeated rows get the same pseudonyms; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Example key. A real one is a secret of the job.
KEY = "lodestrata example key"
ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ip", "ssn", "date")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_BEFORE, _AFTER = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
PATTERNS = tuple(
    (
        r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}" + _AFTER,
        _BEFORE + "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _AFTER,
        _BEFORE + r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}" + _AFTER,
        r"(?<![0-9A-Za-z_+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}" + _AFTER,
        r"(?<![0-9A-Za-z_.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![A-Za-z_]|\.?[0-9])",
        _BEFORE + "[0-9]{4}-[0-9]{2}-[0-9]{2}" + _AFTER,
        _BEFORE + "[0-9]{2}([/.])[0-9]{2}\\1[0-9]{4}" + _AFTER,
        _BEFORE + "[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER,
        # the whole run of groups, with letters that are glued to the last
        _BEFORE + "(?=(?:[0-9][ -]?){12})[0-9][0-9 -]{12,}+(?:(?<=[0-9])[A-Za-z_][0-9A-Za-z_]*+)?+",
    )
)
PATTERN = "|".join(PATTERNS)
#: What is looked for in turn: all, then what a run of the kinds before may have swallowed.
PASSES = (PATTERN, "|".join(x for i, x in enumerate(PATTERNS) if i != 1), "|".join(x for i, x in enumerate(PATTERNS[:-1]) if i != 1))
_CARD, _USUAL_CARD = "^(?:[0-9][ -]?){12,18}[0-9]$", "^(?:[0-9]{13,19}|[0-9]{4}(?:([ -])[0-9]{4}\\1[0-9]{4}\\1[0-9]{4}|[ -][0-9]{6}[ -][0-9]{4,5}))$"
_IBAN = "^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?$"
# Lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ DJ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_USUAL_IBAN = "^(?:" + "|".join(f"(?:{c.replace(' ', '|')})(?: ?[A-Z0-9]){{{n - 2}}}" for n, c in IBAN_LENGTHS.items()) + ")$"
# Country codes of telephone numbers, and digits behind them by country; others have 7 to 14.
_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_PHONE_LENGTHS = {
    " 10 ": "1 7 20 30 52 63 90 91 92 98", " 9 ": "27 31 33 34 40 41 48 51 56 61 66 351 353 380 420 421 966 971 972", " 8 ": "45 47 53 65 852 853 370 371", " 8 9 ": "32 36 60 62 64 84 94", " 9 10 ": "39 44 57 81",
    " 10 11 ": "49 55 86", " 7 8 9 ": "46 43 82 354 358", " 7 ": "372 960", " 8 10 ": "54 58",
}
# A private character, and what stands behind it: itself in a text, or the values put in by a pass.
_PRIVATE, _ITSELF = "\ue000", "\ue00f"
_FIRST_DAY, _DAYS = "1900-01-01", (319, 229)  # 319 * 229 days end with 2099


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digest(key: str, tag: Column, turn: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), tag, turn.cast("string"), value.cast("string")), 256)


def permute(left: Column, right: Column, a: Column, b: Column, key: str, tag: Column) -> Column:
    """struct(l, r): the keyed permutation of (left, right) among 0..a-1 x 0..b-1."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"), a.cast("long").alias("a"), b.cast("long").alias("b"))

    def turn(s: Column, i: Column) -> Column:
        f = F.conv(F.substr(_digest(key, tag, i, s["r"]), F.lit(1), F.lit(15)), 16, 10).cast("long")
        return F.struct(s["r"].alias("l"), F.pmod(s["l"] + F.pmod(f, s["a"]), s["a"]).alias("r"), s["b"].alias("a"), s["a"].alias("b"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """The digits permuted among all strings of as many digits."""

    def of(d: Column) -> Column:
        n = F.length(d)
        k = F.floor(n / 2).cast("int")
        power = lambda x: F.rpad(F.lit("1"), x + 1, F.lit("0")).cast("long")
        moved = permute(F.substr(d, F.lit(1), k), F.substr(d, k + 1, n), power(k), power(n - k), key, F.concat(F.lit(kind), n.cast("string")))
        return _let(moved, lambda p: F.concat(F.lpad(p["l"].cast("string"), k, F.lit("0")), F.lpad(p["r"].cast("string"), n - k, F.lit("0"))))

    return _let(digits, of)


def _laid_out(match: Column, digits: Column) -> Column:
    """The match with its digits replaced, one by one."""
    start = F.struct(F.lit("").alias("done"), digits.alias("rest"))

    def put(s: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(F.concat(s["done"], F.when(is_digit, F.substr(s["rest"], F.lit(1), F.lit(1))).otherwise(c)).alias("done"), F.when(is_digit, F.substr(s["rest"], F.lit(2), F.length(s["rest"]))).otherwise(s["rest"]).alias("rest"))

    return F.aggregate(F.regexp_extract_all(match, F.lit("(?s)."), F.lit(0)), start, put, lambda s: s["done"])


def _luhn_digit(body: Column) -> Column:
    """The check digit behind ``body``."""

    def of(d: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            x = F.substr(d, F.length(d) - i + 1, F.lit(1)).cast("int") * (1 + i % 2)
            return s + x - F.when(x > 9, 9).otherwise(0)

        return F.pmod(-F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add), F.lit(10)).cast("string")

    return _let(body, of)


def _mod97(text: Column) -> Column:
    """The remainder by 97 of letters and digits read as one number, A being 10."""

    def add(s: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.pmod(s * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(s * 100 + F.ascii(c) - 55, F.lit(97)))

    return F.aggregate(F.regexp_extract_all(text, F.lit("."), F.lit(0)), F.lit(0), add)


def _card(m: Column, key: str) -> Column:
    def of(d: Column) -> Column:
        body = F.substr(d, F.lit(1), F.length(d) - 1)
        moved = _let(_permuted_digits(body, key, "card"), lambda b: F.concat(b, _luhn_digit(b)))
        return F.when(F.length(d).between(13, 19) & (F.substr(d, F.length(d), F.lit(1)) == _luhn_digit(body)), _laid_out(m, moved))

    return _let(_digits(m), of)


def _iban(m: Column, key: str) -> Column:
    def of(t: Column) -> Column:
        country, account = F.substr(t, F.lit(1), F.lit(2)), F.substr(t, F.lit(5), F.length(t))
        moved = _laid_out(account, _permuted_digits(_digits(account), key, "iban"))
        check = lambda x: F.lpad((98 - _mod97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0")
        valid = F.length(t).between(15, 34) & (_mod97(F.concat(account, country, F.substr(t, F.lit(3), F.lit(2)))) == 1) & (F.length(_digits(account)) >= 7)
        return F.when(valid, _let(moved, lambda x: _laid_out(m, F.concat(check(x), _digits(x)))))

    return _let(F.regexp_replace(m, " ", ""), of)


def _phone(m: Column, key: str) -> Column:
    """The pseudonym of a whole number: a country code and 7 to 14 digits, or 10 digits."""
    code = F.regexp_extract(m, _CODE, 0)
    rest = F.substr(m, F.length(code) + 1, F.length(m))
    n = F.length(_digits(rest))
    return F.when(n.between(7, 14), F.concat(code, _laid_out(rest, _permuted_digits(_digits(rest), key, "phone"))))


def _phone_part(m: Column) -> Column:
    """The leading whole groups of an international number that its country's numbers have; all of it where none fit."""
    code = F.regexp_extract(m, _CODE, 0)
    groups = F.regexp_extract_all(F.substr(m, F.length(code) + 1, F.length(m)), F.lit("[^0-9]*[0-9]+[)]?"), F.lit(0))
    known = F.create_map(*(x for n, codes in _PHONE_LENGTHS.items() for c in codes.split() for x in (F.lit(f"+{c}"), F.lit(n))))

    def cut(parts: Column) -> Column:
        prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda j: F.array_join(F.slice(parts, 1, j), ""))
        fits = F.filter(prefixes, lambda x: F.coalesce(known[code], F.lit("")).contains(F.concat(F.lit(" "), F.length(_digits(x)).cast("string"), F.lit(" "))))
        return F.when((F.length(code) > 1) & (F.size(fits) > 0), F.concat(code, F.element_at(fits, -1))).otherwise(m)

    return F.when((F.length(code) > 1) & (F.size(groups) > 0), _let(groups, cut)).otherwise(m)


def _ip(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, r"\."), i).cast("long")
    moved = permute(part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    octets = lambda x: (F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _let(moved, lambda p: F.concat_ws(".", *octets(p["l"]), *octets(p["r"])))


def _ssn(m: Column, key: str) -> Column:
    part = lambda i: F.element_at(F.split(m, "-"), i).cast("int")
    area, group, serial = part(1), part(2), part(3)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    index = area - 1 - F.when(area > 666, 1).otherwise(0)  # of 898 areas
    moved = permute(index * 99 + group - 1, serial - 1, F.lit(898 * 99), F.lit(9999), key, F.lit("ssn"))

    def text(p: Column) -> Column:
        area = F.floor(p["l"] / 99) + 1
        area = area + F.when(area >= 666, 1).otherwise(0)
        pad = lambda x, n: F.lpad(x.cast("long").cast("string"), n, "0")
        return F.concat_ws("-", pad(area, 3), pad(p["l"] % 99 + 1, 2), pad(p["r"] + 1, 4))

    return F.when(valid, _let(moved, text))


def _date(m: Column, key: str) -> Column:
    part = lambda a, n: F.substr(m, F.lit(a), F.lit(n))
    iso = m.rlike("^[0-9]{4}-")
    day_first = part(4, 2).cast("int") <= 12
    written = F.when(iso, m).when(day_first, F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(F.concat_ws("-", part(7, 4), part(1, 2), part(4, 2)))
    day = F.datediff(written.try_cast("date"), F.lit(_FIRST_DAY).cast("date"))
    a, b = _DAYS
    tag = F.when(iso, "iso").when(day_first, "dmy").otherwise("mdy")

    def text(p: Column) -> Column:
        date = F.date_add(F.lit(_FIRST_DAY).cast("date"), (p["l"] * b + p["r"]).cast("int"))
        form = lambda x: F.date_format(date, x)
        mark = part(3, 1)
        return F.when(iso, form("yyyy-MM-dd")).when(day_first, F.concat(form("dd"), mark, form("MM"), mark, form("yyyy"))).otherwise(F.concat(form("MM"), mark, form("dd"), mark, form("yyyy")))

    return _let(day, lambda n: F.when(n.between(0, a * b - 1), _let(permute(F.floor(n / b), n % b, F.lit(a), F.lit(b), key, tag), text)))


def _email(m: Column, key: str) -> Column:
    """The local part's letters and digits move within their class by amounts that the other half gives."""

    def of(local: Column) -> Column:
        half = F.floor(F.length(local) / 2).cast("int")
        start = F.struct(F.substr(local, F.lit(1), half).alias("l"), F.substr(local, half + 1, F.length(local)).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            def char(h: Column) -> Column:
                def one(c: Column, j: Column) -> Column:
                    by = F.conv(F.substr(h, (j * 2) % 60 + 1, F.lit(4)), 16, 10).cast("int")
                    at = lambda first, n: F.chr(F.pmod(F.ascii(c) - first + by, F.lit(n)) + first)
                    return F.when(c.rlike("[a-z]"), at(97, 26)).when(c.rlike("[A-Z]"), at(65, 26)).when(c.rlike("[0-9]"), at(48, 10)).otherwise(c)

                return F.array_join(F.transform(F.regexp_extract_all(s["l"], F.lit("."), F.lit(0)), one), "")

            return F.struct(s["r"].alias("l"), _let(_digest(key, F.lit("email"), i, s["r"]), char).alias("r"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["l"], s["r"]))

    parts = F.split(m, "@")
    return F.concat(_let(F.element_at(parts, 1), of), F.lit("@"), F.element_at(parts, 2))


def _made(match: Column, key: str, mark: Column) -> Column:
    """struct(raw, made) of one value: the mark and its pseudonym, or itself and none if it fails its check."""
    kind = (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(match.rlike(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[/.][0-9]{2}[/.][0-9]{4})$"), "date")
        .when(match.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .otherwise("phone")
    )
    made = F.lit(None).cast("string")
    for name, make in (("phone", _phone), ("ssn", _ssn), ("date", _date), ("ip", _ip), ("email", _email)):
        made = F.when(kind == name, make(match, key)).otherwise(made)
    one = F.struct(kind.alias("kind"), made.alias("text"))
    return _let(one, lambda s: F.when(s["text"].isNotNull(), _piece(mark, F.array(s))).otherwise(_piece(match, F.array().cast(_MADE))))


_MADE = "array<struct<kind:string,text:string>>"


def _piece(raw: Column, made: Column) -> Column:
    return F.struct(raw.alias("raw"), made.cast(_MADE).alias("made"))


def _picked(match: Column, key: str, mark: Column, kind: str) -> Column:
    """struct(raw, made) of a run of groups: the runs of whole groups in it that pass the check, the usual layouts first, then the longest."""
    shape, usual, make = (_CARD, _USUAL_CARD, _card) if kind == "card" else (_IBAN, _USUAL_IBAN, _iban)

    def in_parts(run: Column) -> Column:
        groups, n = run["groups"], F.size(run["groups"])
        text = lambda i, j: F.array_join(F.zip_with(F.slice(groups, i, j - i + 1), F.slice(run["seps"], i, j - i), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
        start = lambda i: F.transform(F.sequence(i, F.least(n, i + 18)), lambda j: F.struct(i.alias("i"), j.alias("j"), text(i, j).alias("w")))
        windows = F.filter(F.flatten(F.transform(F.sequence(F.lit(1), n), start)), lambda x: x["w"].rlike(shape))
        ranked = F.transform(windows, lambda x: F.struct((~x["w"].rlike(usual)).cast("int").alias("rank"), (-F.length(x["w"])).alias("size"), x["i"].alias("i"), x["j"].alias("j"), make(x["w"], key).alias("text")))
        valid = F.array_sort(F.filter(ranked, lambda x: x["text"].isNotNull()))
        none = F.array().cast("array<struct<i:int,j:int,text:string>>")
        taken = F.aggregate(valid, none, lambda have, x: F.when(F.exists(have, lambda y: (y["i"] <= x["j"]) & (x["i"] <= y["j"])), have).otherwise(F.concat(have, F.array(F.struct(x["i"].alias("i"), x["j"].alias("j"), x["text"].alias("text"))))))

        def rest(have: Column) -> Column:
            def group(k: Column) -> Column:
                sep = F.coalesce(F.get(run["seps"], k - 1), F.lit(""))
                inside = F.exists(have, lambda y: (y["i"] <= k) & (k < y["j"]))
                last = F.exists(have, lambda y: y["j"] == k)
                return F.when(inside, F.lit("")).when(last, F.concat(mark, sep)).otherwise(F.concat(F.element_at(groups, k), sep))

            raw = F.array_join(F.transform(F.sequence(F.lit(1), n), group), "")
            return _piece(raw, F.transform(have, lambda y: F.struct(F.lit(kind).alias("kind"), y["text"].alias("text"))))

        return _let(F.array_sort(taken), rest)

    run = F.struct(F.regexp_extract_all(match, F.lit("[0-9A-Za-z_]+"), F.lit(0)).alias("groups"), F.regexp_extract_all(match, F.lit("[ -]+"), F.lit(0)).alias("seps"))
    return _let(run, in_parts)


def pseudonym(match: Column, key: str, mark: Column) -> Column:
    """struct(raw, made) for a match: what is left of it, with ``mark`` for each value, and their kinds and pseudonyms."""
    other = match.rlike(r"@|^[+(]|^[0-9]{1,3}(\.[0-9]{1,3}){3}$|^[0-9]{4}-[0-9]{2}-[0-9]{2}$|^[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$")
    def of_part(part: Column) -> Column:
        """What follows the number is left to be searched again."""
        rest = F.substr(match, F.length(part) + 1, F.length(match))
        return _let(_made(part, key, mark), lambda x: _piece(F.concat(x["raw"], rest), x["made"]))

    return F.when(match.startswith("+"), _let(_phone_part(match), of_part)).when(other, _made(match, key, mark)).when(match.rlike("^[A-Z]"), _picked(match, key, mark, "iban")).otherwise(_picked(match, key, mark, "card"))


def _woven(gaps: Column, found: Column) -> Column:
    """The texts between with the found ones in their places."""
    return F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda g, x: F.concat(g, x)), ""), F.element_at(gaps, -1))


def _passes(raw: Column, key: str) -> Column:
    """struct(raw, found, again): the text with marks after all passes, and each pass's values; one fold, so the plan has the rules once."""
    none = F.array().cast(f"array<{_MADE}>")
    start = F.struct(raw.alias("raw"), none.alias("found"), F.lit(True).alias("again"))
    steps = F.array(*(F.struct(F.lit(p).alias("pattern"), F.lit(_PRIVATE + chr(ord(_PRIVATE) + i + 1)).alias("mark"), F.lit(i).alias("turn")) for i, p in enumerate(PASSES)))

    def turn(s: Column, p: Column) -> Column:
        def with_matches(matches: Column) -> Column:
            def with_pieces(pieces: Column) -> Column:
                some = F.size(pieces) > 0
                new = F.when(some, _woven(F.split(s["raw"], p["pattern"], -1), F.transform(pieces, lambda x: x["raw"]))).otherwise(s["raw"])
                made = F.flatten(F.transform(pieces, lambda x: x["made"]))
                # a run of groups that is not one value alone may hold more
                left = F.when(p["turn"] == 0, F.exists(pieces, lambda x: F.length(x["raw"]) > F.length(p["mark"]))).otherwise(s["again"])
                return F.struct(new.alias("raw"), F.concat(s["found"], F.array(made)).alias("found"), left.alias("again"))

            return _let(F.transform(matches, lambda m: pseudonym(m, key, p["mark"])), with_pieces)

        nothing = F.array().cast("array<string>")
        return _let(F.when(s["again"], F.regexp_extract_all(s["raw"], p["pattern"], F.lit(0))).otherwise(nothing), with_matches)

    return F.aggregate(steps, start, turn)


def pseudonymise(docs: DataFrame, key: str = KEY, found_as: str | None = None) -> DataFrame:
    """The rows with pseudonyms in ``text``; ``found_as``: a new column with the array of kinds found."""
    text, raw, done = F.col("text").cast("string"), "_pii_raw", "_pii_done"
    has = text.rlike("[0-9@]") & text.rlike(PATTERN)  # nothing else can match
    marked = docs.withColumn(done, F.when(has, _passes(F.replace(text, F.lit(_PRIVATE), F.lit(_PRIVATE + _ITSELF)), key)))
    marked = marked.withColumn(raw, F.col(f"{done}.raw"))
    for i in reversed(range(len(PASSES))):
        mark, found = _PRIVATE + chr(ord(_PRIVATE) + i + 1), F.get(F.col(f"{done}.found"), F.lit(i))
        marked = marked.withColumn(raw, F.when(F.size(found) > 0, _woven(F.split(raw, mark, -1), F.transform(found, lambda x: x["text"]))).otherwise(F.col(raw)))
    out = marked.withColumn("text", F.when(F.col(raw).isNotNull(), F.replace(raw, F.lit(_PRIVATE + _ITSELF), F.lit(_PRIVATE))).otherwise(text))
    if found_as:
        out = out.withColumn(found_as, F.coalesce(F.transform(F.flatten(F.col(f"{done}.found")), lambda x: x["kind"]), F.array().cast("array<string>")))
    return out.drop(raw, done)


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, and how many of each kind they have."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    out = pseudonymise(docs, found_as="found")
    counts = [(F.size("found") - F.size(F.array_remove("found", kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"), *counts)
