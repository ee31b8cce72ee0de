r"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Validated values in a text are replaced by a keyed permutation of themselves
within their own format: a valid card number becomes a valid card number of the
same issuer digit and layout, a date another date, an address another address.
Equal values get equal pseudonyms in every document, and different values of a
kind different ones, so links between documents stay.

A value is a vector of digits, each with its own radix:

* phone: the ten digits; an area or exchange that starts with 2-9 still does
* intl (``+``, 8 to 15 digits): all digits but the first two, which hold the
  country code
* card (12 to 19 digits, Luhn): all but the first digit and the check digit,
  which is worked out anew
* ssn: area (001-899 without 666), group, serial, none of them zero
* ip: four octets
* iban (its country's length, mod 97): letters and digits after the check
  digits, each within its class; the check digits are worked out anew
* date, and day (day first): the day within the 400-year cycle from 1800-01-01,
  146097 days, as (day div 773, day mod 773), 189 * 773 values
* month_first: a day that only reads month first, because it is over the 12th,
  among the 88497 such days of the cycle, as 9 * 9833 values. The result is such
  a day again, so no day that reads day first has the same pseudonym
* email: the letters and digits of the part before ``@``, each within its class;
  the domain stays
* key (``AKIA`` and 16 characters): each within its class
* secret (16 to 64 hex digits right after ``=``, ``:`` or a quote)

The vector is split in halves, and in each round one half is shifted, digit by
digit modulo the radices, by a keyed SHA-256 of the other: a Feistel network,
which is a permutation whatever the round function. Matches that fail their
kind's check (octets, calendar, mod 97) are left as they are. A card is matched only as
digits that pass the Luhn sum, so other numbers next to one, a blank or hyphen
away, do not hide it: usual layouts come first, then longer spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}


def _iban_pattern() -> str:
    """Each country's check digits and groups of four, with a blank before each group or none."""
    by_length: dict[int, list[str]] = {}
    for country, n in IBAN_LENGTHS.items():
        by_length.setdefault(n, []).append(country)
    bodies = (f"(?:{'|'.join(names)})[0-9]{{2}}(?: ?[0-9A-Z]{{4}}){{{(n - 4) // 4}}}" + (f" ?[0-9A-Z]{{{(n - 4) % 4}}}" if n % 4 else "") for n, names in sorted(by_length.items()))
    return f"(?<![0-9A-Za-z])(?:{'|'.join(bodies)})(?![0-9A-Za-z])"


#: Pattern of each kind, in order of precedence.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "date": r"(?<![0-9A-Za-z-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9A-Za-z-])",
    "day": r"(?<![0-9A-Za-z/.])[0-9]{2}[/.][0-9]{2}[/.][0-9]{4}(?![0-9A-Za-z/])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+(])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    "intl": r"(?<![0-9A-Za-z+(])\+[2-9][0-9](?:[ .-]?[0-9]){6,13}(?![0-9A-Za-z])",
    "iban": _iban_pattern(),
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){11,18}(?![0-9A-Za-z])",
    "key": r"(?<![0-9A-Za-z])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "secret": r"(?<=[=:\"'])[0-9a-f]{16,64}(?![0-9A-Za-z])",
}
#: Layouts that a card has for itself, whatever numbers stand next to it.
LAYOUTS = r"^(?:[0-9]{12,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
_NEVER = "(?!)"
_CYCLE = "date'1800-01-01'"
#: Days of the cycle that are over the 12th of their month, and their radices.
_LATE, _LATE_RADICES = 146_097 - 12 * 4800, (9, 9833)


def _bare(pattern: str) -> str:
    """A kind's pattern without what must stand around it, for a whole string."""
    body = pattern
    if body.startswith(("(?<!", "(?<=")):
        body = body[body.index(")", body.index("]")) + 1 :]
    return f"^(?:{body[: body.rindex('(?!')] if '(?!' in body else body})$"


def _digits(text: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c.cast("long"))


def _luhn(digits: Column) -> Column:
    """Luhn sum of an array of digits."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 1, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x)


def _pattern(text: Column) -> Column:
    """The pattern of all kinds for a text: in place of the card's, the spans of the text that pass the Luhn sum."""
    before, after = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
    # A span of each number of digits from each place where a number starts; spans overlap.
    spans = [F.regexp_extract_all(text, F.lit(f"{before}(?=([0-9](?:[ -]?[0-9]){{{n - 1}}}){after})"), F.lit(1)) for n in range(19, 11, -1)]
    valid = F.filter(F.array_distinct(F.flatten(F.array(*spans))), lambda m: _luhn(_digits(m)) % 10 == 0)

    def cards(valid: Column) -> Column:
        usual = F.filter(valid, lambda m: m.rlike(LAYOUTS))
        own = F.when(F.size(usual) > 0, F.concat(F.lit(f"{before}(?:"), F.array_join(usual, "|"), F.lit(f"){after}")))
        parts = [own]
        for n in range(19, 11, -1):
            other = F.filter(valid, lambda m: ~m.rlike(LAYOUTS) & (F.length(F.regexp_replace(m, "[^0-9]", "")) == n))  # noqa: B023
            # Not where a card in a usual layout starts inside.
            inside = F.concat(F.lit(f"(?![0-9](?:[ -]?[0-9]){{0,{n - 2}}}[ -]"), F.coalesce(own, F.lit(_NEVER)), F.lit(")"))
            parts.append(F.when(F.size(other) > 0, F.concat(F.lit(before), inside, F.lit("(?:"), F.array_join(other, "|"), F.lit(f"){after}"))))
        return F.concat_ws("|", *parts)

    some = F.when(text.rlike(KINDS["card"]), F.element_at(F.transform(F.array(valid), cards), 1))
    card = F.when(F.coalesce(some, F.lit("")) == "", F.lit(_NEVER)).otherwise(some)
    return F.concat_ws("|", *(card if kind == "card" else F.lit(p) for kind, p in KINDS.items()))


def _day(m: Column) -> Column:
    """Ordinal of a date in the cycle, or null."""
    at = F.coalesce(*(F.try_to_timestamp(m, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "dd/MM/yyyy", "dd.MM.yyyy", "MM/dd/yyyy", "MM.dd.yyyy")))
    n = F.datediff(at, F.expr(_CYCLE))
    return F.when((n >= 0) & (n < 146_097), n.cast("long"))


def _reads_day_first(m: Column) -> Column:
    return F.coalesce(*(F.try_to_timestamp(m, F.lit(f)) for f in ("dd/MM/yyyy", "dd.MM.yyyy"))).isNotNull()


def _late_rank(day: Column) -> Column:
    """The place of a day of the cycle among those over the 12th of their month."""
    at = F.date_add(F.expr(_CYCLE), day.cast("int"))
    return day - 12 * ((F.year(at) - 1800) * 12 + F.month(at)).cast("long")


def _late_day(rank: Column) -> Column:
    """The day of the cycle with that place."""

    def before(month: Column) -> Column:
        """Places before a month of the cycle."""
        first = F.make_date((1800 + F.floor(month / 12)).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))
        return F.datediff(first, F.expr(_CYCLE)).cast("long") - 12 * month

    # Months have 16 to 19 such days, in all but the same number up to any month: the estimate is off by one at most.
    guess = F.floor(rank * 4800 / _LATE)
    month = F.array_max(F.filter(F.array(F.greatest(guess - 1, F.lit(0)), guess, guess + 1), lambda x: before(x) <= rank))
    return rank + 12 * (month + 1)


def _mod97(text: Column) -> Column:
    """The number modulo 97 that an IBAN's characters stand for, check digits last."""

    def step(acc: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.when(code < 58, (acc * 10 + code - 48) % 97).otherwise((acc * 100 + code - 55) % 97)

    return F.aggregate(F.split(F.concat(F.substring(text, 5, 40), F.substring(text, 1, 4)), ""), F.lit(0), step)


def _kind(m: Column) -> Column:
    """The kind of a match that passes its check, or null."""
    octets = F.transform(F.split(m, r"\."), lambda x: F.when(F.length(x) <= 3, x.cast("long")).otherwise(256))
    ssn = F.split(m, "-")
    valid = {
        "date": _day(m).isNotNull(),
        "day": _day(m).isNotNull(),
        "iban": (_mod97(_packed(m)) == 1) & F.substring(_packed(m), 3, 2).between("02", "98"),
        "ip": F.forall(octets, lambda x: x < 256),
        "card": _luhn(_digits(m)) % 10 == 0,
        "ssn": (ssn[0] != "000") & (ssn[0] != "666") & (ssn[0] < "900") & (ssn[1] != "00") & (ssn[2] != "0000"),
    }
    out = None
    for kind, pattern in KINDS.items():
        name = F.when(_reads_day_first(m), F.lit("day")).otherwise(F.lit("month_first")) if kind == "day" else F.lit(kind)
        result = F.when(valid[kind], name) if kind in valid else name
        out = F.when(m.rlike(_bare(pattern)), result) if out is None else out.when(m.rlike(_bare(pattern)), result)
    return out


def _packed(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _cell(value: Column, radix, offset) -> Column:
    lit = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return F.struct(lit(value).alias("v"), lit(radix).alias("r"), lit(offset).alias("o"))


def _chars(text: Column, hexadecimal: bool = False) -> Column:
    """Characters as digits within their class; other characters have radix 1."""

    def cell(c: Column) -> Column:
        code = F.ascii(c)
        if hexadecimal:
            return _cell(F.conv(c, 16, 10).cast("long"), 16, 0)
        cells = F.when(code.between(48, 57), _cell(code - 48, 10, 48)).when(code.between(97, 122), _cell(code - 97, 26, 97)).when(code.between(65, 90), _cell(code - 65, 26, 65))
        return cells.otherwise(_cell(F.lit(0), 1, code))

    return F.transform(F.split(text, ""), cell)


def _vector(m: Column, kind: Column) -> Column:
    digits = _digits(m)
    plain = lambda x: _cell(x, 10, 0)
    ten = F.slice(digits, -10, 10)
    phone = F.transform(ten, lambda d, i: F.when(i.isin(0, 3) & (d >= 2), _cell(d - 2, 8, 2)).when(i.isin(0, 3), _cell(d, 2, 0)).otherwise(plain(d)))
    part = lambda i: F.split(m, "-")[i].cast("long")
    ssn = F.array(_cell(part(0) - F.when(part(0) > 666, 2).otherwise(1), 898, 0), _cell(part(1) - 1, 99, 0), _cell(part(2) - 1, 9999, 0))
    day = F.array(_cell(F.floor(_day(m) / 773), 189, 0), _cell(_day(m) % 773, 773, 0))
    late = _late_rank(_day(m))
    return (
        F.when(kind == "email", _chars(F.substring_index(m, "@", 1)))
        .when(kind.isin("date", "day"), day)
        .when(kind == "month_first", F.array(_cell(F.floor(late / _LATE_RADICES[1]), _LATE_RADICES[0], 0), _cell(late % _LATE_RADICES[1], _LATE_RADICES[1], 0)))
        .when(kind == "intl", F.transform(F.slice(digits, F.lit(3), F.size(digits) - 2), plain))
        .when(kind == "iban", _chars(F.substring(_packed(m), 5, 40)))
        .when(kind == "ssn", ssn)
        .when(kind == "ip", F.transform(F.split(m, r"\."), lambda x: _cell(x.cast("long"), 256, 0)))
        .when(kind == "phone", phone)
        .when(kind == "card", F.transform(F.slice(digits, F.lit(2), F.size(digits) - 2), plain))
        .when(kind == "key", _chars(F.substring(m, 5, 16)))
        .when(kind == "secret", _chars(m, True))
    )


def _feistel(cells: Column, kind: Column, key: str) -> Column:
    """The permuted values of a vector."""
    n, half = F.size(cells), F.floor(F.size(cells) / 2).cast("int")
    halves = F.struct(
        F.transform(F.slice(cells, F.lit(1), half), lambda c: c.v).alias("a"),
        F.transform(F.slice(cells, half + 1, n - half), lambda c: c.v).alias("b"),
    )

    def shifted(own: Column, other: Column, first: Column, turn: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))

        def shift(v: Column, j: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws("|", seed, j.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
            return (v + noise) % F.get(cells, first + j).r

        return F.transform(own, shift)

    def turn(acc: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(acc.a.alias("a"), shifted(acc.b, acc.a, half, i).alias("b"))).otherwise(F.struct(shifted(acc.a, acc.b, F.lit(0), i).alias("a"), acc.b.alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), halves, turn, lambda acc: F.concat(acc.a, acc.b))


def _refill(m: Column, digits: Column, kept: str = "[^0-9]") -> Column:
    """``m`` with its last digits replaced, in order, by the given ones; other characters (``kept``) and earlier digits stay."""
    chars = F.split(m, "")
    skip = F.length(F.regexp_replace(m, kept, "")) - F.size(digits)

    def put(acc: Column, c: Column) -> Column:
        is_digit = ~c.rlike(kept)
        taken = F.when(is_digit & (acc.n >= skip), F.get(digits, acc.n - skip).cast("string")).otherwise(c)
        return F.struct(F.concat(acc.s, taken).alias("s"), (acc.n + F.when(is_digit, 1).otherwise(0)).alias("n"))

    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(0).alias("n")), put, lambda acc: acc.s)


def _format(m: Column, kind: Column, cells: Column, values: Column) -> Column:
    """The pseudonym of a match from its permuted vector."""
    written = F.array_join(F.transform(F.zip_with(cells, values, lambda c, v: c.o + v), lambda x: F.char(x)), "")
    plain = F.zip_with(cells, values, lambda c, v: c.o + v)
    day = F.date_add(F.expr(_CYCLE), (values[0] * 773 + values[1]).cast("int"))
    slashed = F.regexp_replace(m, "[0-9]", "")
    ssn = F.concat_ws("-", F.lpad((values[0] + F.when(values[0] > 664, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((values[1] + 1).cast("string"), 2, "0"), F.lpad((values[2] + 1).cast("string"), 4, "0"))
    body = F.concat(F.slice(_digits(m), F.lit(1), F.lit(1)), plain)
    check = (10 - _luhn(F.concat(body, F.array(F.lit(0).cast("long")))) % 10) % 10
    late = F.date_add(F.expr(_CYCLE), _late_day(values[0] * _LATE_RADICES[1] + values[1]).cast("int"))
    spelt = F.when(kind == "day", F.date_format(day, "dd/MM/yyyy")).otherwise(F.date_format(late, "MM/dd/yyyy"))
    country = F.substring(m, 1, 2)
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), written))).cast("string"), 2, "0"), written)
    return (
        F.when(kind == "email", F.concat(written, F.lit("@"), F.substring_index(m, "@", -1)))
        .when(kind == "date", F.date_format(day, "yyyy-MM-dd"))
        .when(kind.isin("day", "month_first"), F.when(slashed == "//", spelt).otherwise(F.replace(spelt, F.lit("/"), F.lit("."))))
        .when(kind == "ssn", ssn)
        .when(kind == "ip", F.array_join(F.transform(values, lambda v: v.cast("string")), "."))
        .when(kind.isin("phone", "intl"), _refill(m, plain))
        .when(kind == "iban", _refill(m, F.split(iban, ""), " "))
        .when(kind == "card", _refill(m, F.concat(plain, F.array(check))))
        .when(kind == "key", F.concat(F.lit("AKIA"), written))
        .when(kind == "secret", F.lower(F.array_join(F.transform(values, lambda v: F.conv(v.cast("string"), 10, 16)), "")))
        .otherwise(m)
    )


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text with pseudonyms, n_pii, kinds.

    ``kinds`` are the kinds of the values replaced, in order of place, and
    ``n_pii`` their number. Null text stays null, with none. Repeated rows are
    each kept; an empty table gives an empty result; other columns of ``docs``
    are not read. ``key`` is a secret: who has it can undo the pseudonyms.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    source = source.withColumn("pattern", _pattern(F.col("text")))
    found = source.withColumn("m", F.when(F.col("text").rlike("[0-9@=:\"']"), F.regexp_extract_all("text", "pattern", F.lit(0))))
    typed = found.withColumn("m", F.transform("m", lambda m: F.struct(m.alias("m"), _kind(m).alias("k"))))
    vectors = typed.withColumn("m", F.transform("m", lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), _vector(x.m, x.k).alias("c"))))
    permuted = vectors.withColumn("m", F.transform("m", lambda x: F.struct(x.m.alias("m"), x.k.alias("k"), x.c.alias("c"), F.when(x.k.isNotNull(), _feistel(x.c, x.k, key)).alias("v"))))
    named = permuted.withColumn("m", F.transform("m", lambda x: F.struct(_format(x.m, x.k, x.c, x.v).alias("p"), x.k.alias("k"))))
    # The pieces between the matches are one more than the matches.
    whole = F.array_join(F.zip_with(F.split("text", F.col("pattern"), -1), F.col("m.p"), lambda piece, p: F.concat(piece, F.coalesce(p, F.lit("")))), "")
    kinds = F.coalesce(F.filter("m.k", lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return named.select("doc_id", F.when(F.coalesce(F.size("m"), F.lit(0)) > 0, whole).otherwise(F.col("text")).alias("text"), F.size(kinds).alias("n_pii"), kinds.alias("kinds"))
