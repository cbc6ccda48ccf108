"""Format-preserving pseudonyms for personal data by keyed Feistel networks.

Everything is a DataFrame expression on the row: no shuffle, no table of replacements. A value
is a pair of numbers in a range of its format; ten Feistel rounds keyed with SHA-256 permute the
range, so the same value becomes the same pseudonym in every document, different values stay
different, and whoever has the key can run the rounds backwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.llm.line_quality import bind

ROUNDS = 10  # even, so that both halves end in their own range
# fixed values: formats
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+1[ .-]?\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}(?![0-9])"
ISO_DATE = r"(?<![0-9])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])"
DAY_DATE = r"(?<![0-9])[0-9]{2}[./][0-9]{2}[./][0-9]{4}(?![0-9])"
IPV4 = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
FORMATS = "|".join((EMAIL, PHONE, ISO_DATE, DAY_DATE, IPV4, CARD))
FIRST_DAY, DAYS = "1700-01-01", (27, 5411)  # 400 years; 27 * 5411 days
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
CHUNK = 10


def permute(kind: str, key: str, left: Column, right: Column, left_size, right_size) -> Column:
    """(l, r) of the keyed permutation on range(left_size) x range(right_size)."""
    left_size, right_size = (
        F.lit(s).cast("bigint") if isinstance(s, int) else s for s in (left_size, right_size)
    )

    def step(acc: Column, i: Column) -> Column:
        text = F.concat_ws(
            "|", F.lit(key), F.lit(kind), i.cast("string"), left_size.cast("string"),
            right_size.cast("string"), acc["r"].cast("string"),
        )
        drawn = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
        size = F.when(i % 2 == 0, left_size).otherwise(right_size)
        return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + F.pmod(drawn, size), size).alias("r"))

    start = F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))
    return F.aggregate(F.array(*(F.lit(i) for i in range(ROUNDS))), start, step)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _refill(layout: Column, digits: Column) -> Column:
    """``layout`` with its digits replaced, one by one, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(acc: Column, c: Column) -> Column:
        digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["out"], F.when(digit, F.substr(digits, acc["at"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["at"] + digit.cast("int")).alias("at"),
        )

    return F.aggregate(F.split(layout, ""), start, step, lambda acc: acc["out"])


def luhn_digit(payload: Column) -> Column:
    """Check digit of a digit string."""

    def weigh(acc: Column, k: Column) -> Column:
        d = F.substr(payload, F.length(payload) - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 0, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(payload) - 1), F.lit(0), weigh)
    return F.pmod(-total, F.lit(10)).cast("string")


def is_card(text: Column) -> Column:
    return bind(
        _digits(text),
        lambda d: luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)) == F.right(d, F.lit(1)),
    )


def card(text: Column, key: str) -> Column:
    """First digit, length and layout stay; the check digit is made anew."""

    def build(d: Column) -> Column:
        n = F.length(d) - 2  # permuted digits
        half = F.floor(n / 2).cast("int")
        parts = permute(
            "card", key, F.substr(d, F.lit(2), half), F.substr(d, half + 2, n - half),
            F.pow(F.lit(10), half).cast("bigint"), F.pow(F.lit(10), n - half).cast("bigint"),
        )
        payload = bind(parts, lambda p: F.concat(
            F.substr(d, F.lit(1), F.lit(1)), F.lpad(p["l"].cast("string"), half, F.lit("0")),
            F.lpad(p["r"].cast("string"), n - half, F.lit("0")),
        ))
        return bind(payload, lambda p: F.concat(p, luhn_digit(p)))

    return _refill(text, bind(_digits(text), build))


def phone(text: Column, key: str) -> Column:
    """Country code and layout stay; area and exchange codes begin with 2 to 9."""

    def build(d: Column) -> Column:
        cut = lambda at, n: F.substr(d, F.lit(at), F.lit(n)).cast("bigint")
        parts = permute("phone", key, cut(2, 3) - 200, (cut(5, 3) - 200) * 10000 + cut(8, 4), 800, 8_000_000)
        return bind(parts, lambda p: F.concat(
            F.lit("1"), (p["l"] + 200).cast("string"), (p["r"] + 2_000_000).cast("string")
        ))

    return _refill(text, bind(_digits(text), build))


def is_address(text: Column) -> Column:
    return F.forall(F.split(text, r"\."), lambda x: x.cast("int") <= 255)


def address(text: Column, key: str) -> Column:
    def build(o: Column) -> Column:
        num = lambda i: F.get(o, F.lit(i)).cast("bigint")
        parts = permute("ipv4", key, num(0) * 256 + num(1), num(2) * 256 + num(3), 65536, 65536)
        return bind(parts, lambda p: F.concat_ws(
            ".", *((F.floor(p[s] / 256) if high else p[s] % 256).cast("string")
                   for s in "lr" for high in (True, False))
        ))

    return bind(F.split(text, r"\."), build)


def day_of(text: Column) -> Column:
    """The date, or NULL if there is no such day; day before month where both fit."""
    iso = F.try_to_timestamp(text, F.lit("yyyy-MM-dd"))
    dots = F.regexp_replace(text, "[./]", "/")
    other = F.coalesce(
        F.try_to_timestamp(dots, F.lit("dd/MM/yyyy")), F.try_to_timestamp(dots, F.lit("MM/dd/yyyy"))
    )
    day = F.when(text.contains("-"), iso).otherwise(other).cast("date")
    return F.when((day >= FIRST_DAY) & (F.datediff(day, F.lit(FIRST_DAY).cast("date")) < DAYS[0] * DAYS[1]), day)


def date(text: Column, key: str) -> Column:
    """A day of 1700 to 2099 in the same layout; layouts of one day stay linked."""
    number = F.datediff(day_of(text), F.lit(FIRST_DAY).cast("date")).cast("bigint")
    parts = bind(number, lambda n: permute("date", key, F.floor(n / DAYS[1]), n % DAYS[1], *DAYS))
    day = bind(parts, lambda p: F.date_add(
        F.lit(FIRST_DAY).cast("date"), (p["l"] * DAYS[1] + p["r"]).cast("int")
    ))
    dots = F.regexp_replace(text, "[./]", "/")
    day_first = F.try_to_timestamp(dots, F.lit("dd/MM/yyyy")).isNotNull()
    return bind(day, lambda x: F.when(text.contains("-"), F.date_format(x, "yyyy-MM-dd")).otherwise(
        _refill(text, F.when(day_first, F.date_format(x, "ddMMyyyy")).otherwise(F.date_format(x, "MMddyyyy")))
    ))


def email(text: Column, key: str) -> Column:
    """Letters and digits before the @, ten at a time, as numbers to base 36; the rest stays."""

    def number(chars: Column) -> Column:
        return F.aggregate(
            F.split(chars, ""), F.lit(0).cast("bigint"),
            lambda a, c: a * 36 + F.position(c, F.lit(ALPHABET)) - 1,
        )

    def letters(value: Column, width: Column) -> Column:
        return F.when(width == 0, F.lit("")).otherwise(F.aggregate(
            F.sequence(F.lit(1), F.greatest(width, F.lit(1))), F.lit(""),
            lambda a, k: F.concat(a, F.substr(
                F.lit(ALPHABET),
                (F.floor(value / F.pow(F.lit(36), (width - k).cast("double"))).cast("bigint") % 36 + 1).cast("int"),
                F.lit(1),
            )),
        ))

    def chunk(chars: Column) -> Column:
        half = F.floor(F.length(chars) / 2).cast("int")
        rest = F.length(chars) - half
        left = F.when(half == 0, F.lit(0).cast("bigint")).otherwise(number(F.substr(chars, F.lit(1), half)))
        parts = permute(
            "email", key, left, number(F.substr(chars, half + 1, rest)),
            F.pow(F.lit(36), half).cast("bigint"), F.pow(F.lit(36), rest).cast("bigint"),
        )
        return bind(parts, lambda p: F.concat(letters(p["l"], half), letters(p["r"], rest)))

    def local(name: Column) -> Column:
        pieces = F.regexp_extract_all(name, F.lit(rf"[a-z0-9]{{1,{CHUNK}}}|[^a-z0-9]+"), F.lit(0))
        return F.array_join(
            F.transform(pieces, lambda x: F.when(x.rlike("^[a-z0-9]"), chunk(x)).otherwise(x)), ""
        )

    return F.concat(
        local(F.lower(F.substring_index(text, "@", 1))), F.lit("@"), F.substring_index(text, "@", -1)
    )


def pseudonym(match: Column, key: str) -> Column:
    """The pseudonym of one match of FORMATS; itself if it does not validate."""
    whole = lambda p: match.rlike(f"^(?:{p})$")
    return (
        F.when(match.contains("@"), email(match, key))
        .when(match.startswith("+"), phone(match, key))
        .when(whole(ISO_DATE) | whole(DAY_DATE),
              F.when(day_of(match).isNotNull(), date(match, key)).otherwise(match))
        .when(whole(IPV4), F.when(is_address(match), address(match, key)).otherwise(match))
        .when(is_card(match), card(match, key))
        .otherwise(match)
    )


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` rewritten and ``n_pseudonyms``, the number of values replaced.

    Replaced are card numbers with a right check digit, +1 telephone numbers, calendar dates of
    1700 to 2099, IPv4 addresses and the local parts of e-mail addresses (in lower case). What
    only looks alike, as an impossible date, stays. A pseudonym has the format of its value and
    validates as it does.

    NULL stays NULL (0 replaced), texts without such values stay as they are. Rows are judged
    one by one: repeats, ties and empty tables need no rule. A column named ``n_pseudonyms`` is
    replaced, all others are carried along. ``key`` must be kept secret.
    """
    pieces = F.split(F.col(text), FORMATS, -1)
    matches = F.regexp_extract_all(F.col(text), F.lit(FORMATS), F.lit(0))
    changed = F.transform(matches, lambda m: F.struct(m.alias("was"), pseudonym(m, key).alias("now")))
    names = [c for c in docs.columns if c != "n_pseudonyms"]
    hinted = F.col(text).rlike("[0-9@]")
    rows = docs.select(
        *names, F.when(hinted, pieces).alias("__pieces"), F.when(hinted, changed).alias("__new")
    )
    joined = F.array_join(
        F.flatten(F.zip_with(
            F.col("__pieces"), F.concat(F.col("__new.now"), F.array(F.lit(""))),
            lambda a, b: F.array(a, b),
        )), "",
    )
    count = F.size(F.filter(F.col("__new"), lambda x: x["was"] != x["now"]))
    return rows.select(
        *(F.when(F.col("__new").isNotNull() & (F.size("__new") > 0), joined)
          .otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in names),
        F.when(F.col("__new").isNull(), 0).otherwise(count).cast("bigint").alias("n_pseudonyms"),
    )
