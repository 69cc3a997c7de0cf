"""Operator 3: personal data replaced by format-preserving Feistel pseudonyms, in column expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitchline.llm.common import bound, table
from pitchline.llm.registry import register

ROUNDS = 10
#: What is looked for, in this order. The look-behinds let a match begin only where its run of characters begins, so
#: a text without matches is read in linear time.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+",
    "hex": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    "ipv4": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![0-9+])\+[1-9][0-9]{0,2}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9])",
    "local": r"(?<![0-9.+-])(?:\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4})(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Days from 1900-01-01 to 2099-12-31: 73049 = 17 * 4297, so a pair of digits in these bases is a day and each pair is one.
EPOCH, BASES = "1900-01-01", (17, 4297)


def _keystream(hash_: Column, i: Column) -> Column:
    return F.conv(F.substr(hash_, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def permute(values: Column, bases: Column, tweak: Column | str, key: str, reverse: bool = False) -> Column:
    """A keyed permutation of digit sequences: ``values[i]`` is below ``bases[i]`` before and after, at most 64 digits.

    A Feistel network over the two halves of the sequence. Each round adds, digit by digit and modulo its base, a
    SHA-512 keystream of the key, the round, the tweak and the other half; whatever that is, the round can be undone.
    ``reverse`` runs the rounds backwards. Bases of 1 keep their place.
    """
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak
    half = F.floor(F.size(values) / 2).cast("int")

    def step(state: Column, j: Column) -> Column:
        left, right = (state["r"], state["l"]) if reverse else (state["l"], state["r"])
        seen = F.sha2(F.concat_ws(",", F.lit(key), j.cast("string"), tweak, F.array_join(F.transform(right, lambda x: x["v"].cast("string")), ",")), 512)
        moved = bound(seen, lambda h: F.transform(left, lambda x, i: F.struct(
            F.pmod(x["v"] - _keystream(h, i) if reverse else x["v"] + _keystream(h, i), x["b"]).alias("v"), x["b"].alias("b"))))
        return F.struct(moved.alias("l"), right.alias("r")) if reverse else F.struct(right.alias("l"), moved.alias("r"))

    rounds = F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if reverse else F.sequence(F.lit(1), F.lit(ROUNDS))

    def run(p: Column) -> Column:
        start = F.struct(F.slice(p, F.lit(1), half).alias("l"), F.slice(p, half + 1, F.size(p) - half).alias("r"))
        done = F.aggregate(rounds, start, step)
        return F.transform(F.concat(done["l"], done["r"]), lambda x: x["v"])

    zipped = F.zip_with(values, bases, lambda v, b: F.struct(v.cast("int").alias("v"), b.cast("int").alias("b")))
    return bound(zipped, run)


def _digit(c: Column) -> Column:
    """Value of a digit or letter in its alphabet, 0 for other characters."""
    code = F.ascii(c)
    return F.when(code.between(48, 57), code - 48).when(code.between(97, 122), code - 97).when(code.between(65, 90), code - 65).otherwise(0)


def _characters(text: Column, tweak: str, key: str, reverse: bool, digits_only: bool = False) -> Column:
    """Digits become digits and letters letters of the same case; other characters stay. Case doesn't change the value."""
    def base(c: Column) -> Column:
        code = F.ascii(c)
        letters = F.lit(1) if digits_only else F.when(code.between(97, 122) | code.between(65, 90), 26).otherwise(1)
        return F.when(code.between(48, 57), 10).otherwise(letters)

    def run(c: Column) -> Column:
        moved = permute(F.transform(c, lambda x: F.when(base(x) > 1, _digit(x)).otherwise(0)), F.transform(c, base), tweak, key, reverse)
        return F.array_join(F.zip_with(c, moved, lambda x, v: F.when(base(x) == 1, x).otherwise(
            F.char(v + F.when(F.ascii(x) >= 97, 97).when(F.ascii(x) >= 65, 65).otherwise(48)))), "")

    return bound(F.split(text, ""), run)


def _refill(text: Column, digits: Column) -> Column:
    """``text`` with its digits replaced in order by those of the string ``digits``."""
    def run(d: Column) -> Column:
        merged = F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike("[0-9]"), F.substr(d, s["at"], F.lit(1))).otherwise(c)).alias("out"),
            (s["at"] + c.rlike("[0-9]").cast("int")).alias("at")))
        return merged["out"]

    return bound(digits, run)


def _check_digit(payload: Column) -> Column:
    """Luhn check digit of a payload of digits."""
    def add(total: Column, d: Column) -> Column:
        twice = d["i"] % 2 == 0
        v = F.when(twice, d["v"] * 2).otherwise(d["v"])
        return total + F.when(v > 9, v - 9).otherwise(v)

    digits = F.transform(F.split(F.reverse(payload), ""), lambda c, i: F.struct(c.cast("int").alias("v"), i.alias("i")))
    return F.pmod(-F.aggregate(digits, F.lit(0), add), F.lit(10)).cast("string")


def _card(m: Column, key: str, reverse: bool) -> Column:
    """A run of 13 to 19 digits that ends in its Luhn digit. With more than 16 digits and a separator after the sixteenth these sixteen are
    the card and what follows (a code, the first digits of a date) isn't: one reading alone, so the way back takes the same."""
    sixteen = F.regexp_extract(m, "^([0-9](?:[ -]?[0-9]){15})[ -]", 1)

    def one(card: Column, rest: Column) -> Column:
        def run(d: Column) -> Column:
            payload = F.left(d, F.length(d) - 1)
            moved = _characters(payload, "card", key, reverse)
            changed = F.concat(_refill(card, bound(moved, lambda p: F.concat(p, _check_digit(p)))), rest)
            return F.when(_check_digit(payload) == F.right(d, F.lit(1)), changed).otherwise(m)

        return bound(F.regexp_replace(card, "[^0-9]", ""), run)

    head = F.when(sixteen != "", sixteen).otherwise(m)
    return bound(head, lambda card: one(card, F.substr(m, F.length(card) + 1, F.length(m))))


def _phone(m: Column, key: str, reverse: bool) -> Column:
    """The country code (the digits up to the first separator, two if there is none soon) stays; the other digits are one number however they
    are written, so a number is linked with and without its country code."""
    code = F.when(m.startswith("+"), F.coalesce(F.nullif(F.regexp_extract(m, r"^\+([0-9]{1,3})(?![0-9])", 1), F.lit("")), F.substr(m, F.lit(2), F.lit(2)))) \
        .otherwise("")

    def run(d: Column) -> Column:
        national = F.substr(d, F.length(code) + 1, F.length(d))
        moved = bound(_characters(national, "phone", key, reverse), lambda n: F.concat(code, n))
        return F.when(F.length(d).between(8, 15), _refill(m, moved)).otherwise(m)

    return bound(F.regexp_replace(m, "[^0-9]", ""), run)


def _iban(m: Column, key: str, reverse: bool) -> Column:
    """Country and layout stay, the account changes and the check digits follow it."""
    def check(account: Column, country: Column) -> Column:
        value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0),
                           lambda t, c: F.pmod(t * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))
        return F.lpad((98 - rest).cast("string"), 2, "0")

    def run(c: Column) -> Column:
        country, given, account = F.left(c, F.lit(2)), F.substr(c, F.lit(3), F.lit(2)), F.substr(c, F.lit(5), F.length(c))

        def written(a: Column) -> Column:
            new = bound(F.concat(country, check(a, country), a), lambda n: F.aggregate(
                F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, x: F.struct(
                    F.concat(s["out"], F.when(x == " ", x).otherwise(F.substr(n, s["at"], F.lit(1)))).alias("out"),
                    (s["at"] + (x != " ").cast("int")).alias("at"))))
            return new["out"]

        return F.when(check(account, country) == given, bound(_characters(account, "iban", key, reverse), written)).otherwise(m)

    return bound(F.replace(m, F.lit(" "), F.lit("")), run)


def _ssn(m: Column, key: str, reverse: bool) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001, before and after."""
    part = lambda i: F.get(F.split(m, "-"), i).cast("int")
    area = F.when(part(0) > 666, part(0) - 2).otherwise(part(0) - 1)
    moved = permute(F.array(area, part(1) - 1, part(2) - 1), F.array(F.lit(898), F.lit(99), F.lit(9999)), "ssn", key, reverse)
    pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
    written = bound(moved, lambda v: F.concat_ws("-", pad(F.when(F.get(v, 0) >= 665, F.get(v, 0) + 2).otherwise(F.get(v, 0) + 1), 3),
                                                 pad(F.get(v, 1) + 1, 2), pad(F.get(v, 2) + 1, 4)))
    good = part(0).between(1, 899) & (part(0) != 666) & (part(1) > 0) & (part(2) > 0)
    return F.when(good, written).otherwise(m)


def _ipv4(m: Column, key: str, reverse: bool) -> Column:
    def run(o: Column) -> Column:
        good = F.forall(o, lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
        return F.when(good, F.array_join(F.transform(permute(o, F.array_repeat(F.lit(256), 4), "ipv4", key, reverse),
                                                     lambda x: x.cast("string")), ".")).otherwise(m)

    return bound(F.split(m, "\\."), run)


def _fields(year: Column, month: Column, day: Column, months: tuple[Column, Column], days: tuple[Column, Column], tweak: str, key: str,
            reverse: bool) -> Column:
    """(year, month, day) permuted with month and day staying in their ranges (first, number); of days from 29 on only the year changes, and
    29 February stays."""
    late = day > 28
    bases = F.array(F.when(late & (month == 2), 1).otherwise(200), F.when(late, 1).otherwise(months[1]), F.when(late, 1).otherwise(days[1]))
    lows = F.array(F.when(late & (month == 2), year).otherwise(1900), F.when(late, month).otherwise(months[0]), F.when(late, day).otherwise(days[0]))
    given = F.array(year, month, day)
    return F.zip_with(permute(F.zip_with(given, lows, lambda v, low: v - low), bases, tweak, key, reverse), lows, lambda v, low: v + low)


def _date(m: Column, key: str, reverse: bool) -> Column:
    """Year first, and day first with two digits each, are one kind of date and linked. What can only be month first stays so, and a date
    of single digits keeps its numbers of digits; these are kinds of their own, or the way back couldn't tell them."""
    number = lambda i: F.get(F.split(m, "[./-]"), i).cast("int")
    year_first = F.length(F.get(F.split(m, "[./-]"), 0)) == 4
    month_first = m.contains("/") & ~year_first & (number(0) <= 12) & (number(1) > 12)
    short = m.contains(".") & (F.length(m) < 10)
    iso = F.when(year_first, F.replace(m, F.lit("/"), F.lit("-"))).otherwise(
        F.concat_ws("-", F.right(m, F.lit(4)), F.substr(m, F.lit(4), F.lit(2)), F.left(m, F.lit(2))))

    def run(day: Column) -> Column:
        moved = permute(F.array(F.floor(day / BASES[1]).cast("int"), day % BASES[1]), F.array(*map(F.lit, BASES)), "date", key, reverse)
        to = bound(moved, lambda v: F.date_add(F.lit(EPOCH).cast("date"), F.get(v, 0) * BASES[1] + F.get(v, 1)))
        written = F.when(m.contains("-"), F.date_format(to, "yyyy-MM-dd")).when(year_first, F.date_format(to, "yyyy/MM/dd")) \
            .when(m.contains("/"), F.date_format(to, "dd/MM/yyyy")).otherwise(F.date_format(to, "dd.MM.yyyy"))
        return F.when(day.between(0, BASES[0] * BASES[1] - 1), written).otherwise(m)

    year, two = F.right(m, F.lit(4)).cast("int"), lambda v: F.lpad(v.cast("string"), 2, "0")
    valid = lambda month, day: year.between(1900, 2099) & F.concat_ws("-", year.cast("string"), two(month), two(day)).try_cast("date").isNotNull()
    american = bound(_fields(year, number(0), number(1), (F.lit(1), F.lit(12)), (F.lit(13), F.lit(16)), "month first", key, reverse),
                     lambda f: F.concat_ws("/", two(F.get(f, 1)), two(F.get(f, 2)), F.get(f, 0).cast("string")))
    low = lambda v: F.when(v < 10, 1).otherwise(10)
    dotted = bound(_fields(year, number(1), number(0), (low(number(1)), F.when(number(1) < 10, 9).otherwise(3)),
                           (low(number(0)), F.when(number(0) < 10, 9).otherwise(19)), "short", key, reverse),
                   lambda f: F.concat_ws(".", F.get(f, 2).cast("string"), F.get(f, 1).cast("string"), F.get(f, 0).cast("string")))
    plain = F.regexp_extract(m, r"^0|\.0", 0) == ""
    whole = bound(F.coalesce(F.datediff(iso.try_cast("date"), F.lit(EPOCH).cast("date")), F.lit(-1)), run)
    return F.when(month_first, F.when(valid(number(0), number(1)), american).otherwise(m)) \
        .when(short, F.when(plain & valid(number(1), number(0)), dotted).otherwise(m)).otherwise(whole)


def pseudonym(m: Column, key: str, reverse: bool = False) -> Column:
    """What stands for one match. What fails its check (Luhn digit, IBAN check digits, octets, areas, calendar, years 1900 to 2099) stays as it is."""
    def email() -> Column:
        return F.concat(_characters(F.substring_index(m, "@", 1), "email", key, reverse), F.lit("@"), F.substring_index(m, "@", -1))

    def hexadecimal() -> Column:
        values = F.transform(F.split(m, ""), lambda c: F.conv(c, 16, 10).cast("int"))
        low = F.array_join(F.transform(permute(values, F.array_repeat(F.lit(16), F.length(m)), "hex", key, reverse), lambda v: F.lower(F.hex(v))), "")
        return F.when(m.rlike("[A-F]"), F.upper(low)).otherwise(low)

    is_ = lambda kind: m.rlike(f"^(?:{PATTERNS[kind]})$")
    return F.when(m.contains("@"), email()).when(is_("hex"), hexadecimal()).when(is_("ipv4"), _ipv4(m, key, reverse)) \
        .when(is_("iban"), _iban(m, key, reverse)).when(m.startswith("+") | is_("local"), _phone(m, key, reverse)) \
        .when(is_("ssn"), _ssn(m, key, reverse)).when(is_("date"), _date(m, key, reverse)).otherwise(_card(m, key, reverse))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text", reverse: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its text and ``n_found``, the number of matches (valid or not) in it.

    Found are card numbers, IBANs, phone numbers (with a country code behind a plus sign, or ten digits as ``555-123-4567``, ``555.123.4567``
    or ``(555) 123-4567``), social security numbers, IPv4 addresses, dates (year first, day first, month first where it can't be
    the day, and ``1.5.2024``), hexadecimal tokens and the names of e-mail addresses. Left out are names and postal addresses, dates with
    month names or two-digit years, phone numbers of other layouts without a plus sign, and IPv6. A value is permuted within its format by the key alone, so equal values become equal pseudonyms in every document, however
    they are grouped or, for letters, cased; with the key, ``reverse`` gives the texts back. A null text stays null with
    0 matches. Rows are handled one by one: there is no shuffle and nothing is gathered. An input column ``n_found`` is replaced.
    """
    text = F.col(text_column)

    def rebuild(m: Column) -> Column:
        pieces = F.split(text, ANY, -1)
        moved = F.concat(F.transform(m, lambda x: pseudonym(x, key, reverse)), F.array(F.lit("")))
        joined = F.array_join(F.zip_with(pieces, moved, lambda a, b: F.concat(a, b)), "")
        return F.struct(F.when(F.size(m) == 0, text).otherwise(joined).alias("text"), F.size(m).alias("n"))

    found = bound(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY), F.lit(0)), rebuild)
    return docs.withColumn("__found", found).withColumn(text_column, F.when(text.isNotNull(), F.col("__found.text"))) \
        .withColumn("n_found", F.col("__found.n").cast("long")).drop("__found")


@register("op3_feistel_pseudonyms")
def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="key of the registered query")
