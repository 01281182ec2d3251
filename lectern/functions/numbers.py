"""Numbers, money, times and dates in words, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of the numbers.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "_ _ twenty thirty forty fifty sixty seventy eighty ninety".split()
SCALES = ((1_000_000_000, "billion"), (1_000_000, "million"), (1_000, "thousand"))
IRREGULAR = {"one": "first", "two": "second", "three": "third", "five": "fifth", "eight": "eighth", "nine": "ninth", "twelve": "twelfth"}
MONTHS = "January February March April May June July August September October November December".split()
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _div(n: Column, by: int) -> Column:
    return F.floor(n / by).cast("long")


#: Names of 0 to 99, and of the days of a month, by the rules above.
HUNDRED = [ONES[i] if i < 20 else TENS[i // 10] + (f"-{ONES[i % 10]}" if i % 10 else "") for i in range(100)]


def _day_name(n: int) -> str:
    head, dash, last = HUNDRED[n].rpartition("-")
    return head + dash + IRREGULAR.get(last, last.removesuffix("y") + ("ieth" if last.endswith("y") else "th"))


DAYS = [_day_name(i) for i in range(32)]


def below_hundred(n: Column) -> Column:
    return _pick(HUNDRED, n)


def below_thousand(n: Column) -> Column:
    rest = F.when(n % 100 > 0, F.concat(F.lit(" and "), below_hundred(n % 100))).otherwise("")
    return F.when(n < 100, below_hundred(n % 100)).otherwise(F.concat(_pick(ONES, _div(n, 100)), F.lit(" hundred"), rest))


def cardinal(n: Column) -> Column:
    """one million, two hundred and thirty-four thousand and five; below 10^12. A last group below a hundred is joined by
    "and", any other group by a comma."""
    size, n = n, F.abs(n)
    groups = [F.when(_div(n, scale) % 1000 > 0, F.concat(below_thousand(_div(n, scale) % 1000), F.lit(f" {name}"))) for scale, name in SCALES]
    rest = n % 1000
    joint = F.when((n < 1000) | (rest == 0), F.lit("")).when(rest < 100, F.lit(" and ")).otherwise(F.lit(", "))
    last = F.when((rest > 0) | (n < 1000), below_thousand(rest)).otherwise("")
    return F.concat(F.when(size < 0, F.lit("minus ")).otherwise(""), F.concat_ws(", ", *groups), joint, last)


def ordinal(n: Column) -> Column:
    """The cardinal with its last word made ordinal."""
    marked = F.concat(cardinal(n), F.lit("#"))
    for word, by in (*IRREGULAR.items(), ("", "")):
        marked = F.regexp_replace(marked, rf"\b{word}#", by) if word else F.regexp_replace(F.regexp_replace(marked, "y#", "ieth"), "#", "th")
    return marked


def year(n: Column) -> Column:
    """1905 as nineteen oh-five, 2000 as two thousand, 1900 as nineteen hundred."""
    high, low = _div(n, 100), n % 100
    tail = F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh-"), below_hundred(low))).otherwise(below_hundred(low))
    thousand = F.concat(_pick(ONES, _div(n, 1000) % 10), F.lit(" thousand"), F.when(low > 0, F.concat(F.lit(" and "), below_hundred(low))).otherwise(""))
    round_ = (high % 10 == 0) & (low < 10)
    return F.when((n < 100) | (n >= 10_000), cardinal(n)).when(round_, thousand).otherwise(F.concat(below_hundred(high % 100), F.lit(" "), tail))


def year_of_date(n: Column) -> Column:
    """year() of 1000 to 9999, which needs no cardinals."""
    high, low = _div(n, 100), n % 100
    tail = F.when(low == 0, F.lit("hundred")).when(low < 10, F.concat(F.lit("oh-"), below_hundred(low))).otherwise(below_hundred(low))
    thousand = F.concat(_pick(ONES, _div(n, 1000) % 10), F.lit(" thousand"), F.when(low > 0, F.concat(F.lit(" and "), below_hundred(low))).otherwise(""))
    return F.when((high % 10 == 0) & (low < 10), thousand).otherwise(F.concat(below_hundred(high % 100), F.lit(" "), tail))


def spoken(words: Column) -> Column:
    """Number words as rules give them: without hyphens, commas and "and"."""
    return F.regexp_replace(F.regexp_replace(words, "[-,]", F.lit(" ")), r" +(?:and +)?", " ")


def hundredths(amount: Column) -> Column:
    """The amount's nearest hundredth by its product with 100, as SQL rounds: 1.005 is 1.0 (its product is just below
    100.5), where rounding of the shortest decimal would give 1.01."""
    return F.round(amount * 100) / 100


def _units_and_cents(amount: Column) -> tuple[Column, Column]:
    """Whole units and hundredths, both with the amount's sign."""
    cents_all = F.round(amount * 100).cast("long")
    return ((cents_all - cents_all % 100) / 100).cast("long"), cents_all % 100


def _said(*parts: Column) -> Column:
    """The parts with spaces between; null if one of them is."""
    return F.concat(parts[0], *(x for p in parts[1:] for x in (F.lit(" "), p)))


def dollars(amount: Column) -> Column:
    """A price in dollars: whole, cents, price ("4 99", "4 oh 5") or, from 1,000 and on whole hundreds, the full form. Null
    for null."""
    units, cents = _units_and_cents(amount)
    unit = F.when(units == 1, F.lit("dollar")).otherwise(F.lit("dollars"))
    cent = F.when(cents == 1, F.lit("cent")).otherwise(F.lit("cents"))
    return (
        F.when(cents == 0, _said(units.cast("string"), unit))
        .when(units == 0, _said(cents.cast("string"), cent))
        .when((units >= 1000) | (units % 100 == 0), _said(units.cast("string"), unit, F.lit("and"), cents.cast("string"), cent))
        .otherwise(_said(units.cast("string"), F.when(cents < 10, F.concat(F.lit("oh "), cents.cast("string"))).otherwise(cents.cast("string"))))
    )


def pounds(amount: Column) -> Column:
    """A price in pounds: the unit stands between, without "and" and pence. Null for null."""
    units, cents = _units_and_cents(amount)
    unit = F.when(units == 1, F.lit("pound")).otherwise(F.lit("pounds"))
    return F.when(cents == 0, _said(units.cast("string"), unit)).when(units == 0, _said(cents.cast("string"), F.when(cents == 1, F.lit("penny")).otherwise(F.lit("pence")))).otherwise(_said(units.cast("string"), unit, cents.cast("string")))


def lakh_crore(n: Column) -> Column:
    """1,25,00,000 as 1 crore 25 lakh."""
    part = lambda value, name: F.when(_div(n, value) % 100 > 0, F.concat((_div(n, value) % 100).cast("string"), F.lit(f" {name}")))
    crore = F.when(n >= 10_000_000, F.concat(_div(n, 10_000_000).cast("string"), F.lit(" crore")))
    rest = F.when((n % 1000 > 0) | (n < 1000), (n % 1000).cast("string"))
    return F.concat_ws(" ", crore, part(100_000, "lakh"), part(1_000, "thousand"), rest)


def clock(hour: Column, minute: Column) -> Column:
    """A time without a meridiem: midnight, o'clock up to 12, "hundred" after, "oh m", or hour and minute."""
    h, m = hour.cast("string"), minute.cast("string")
    return (
        F.when((hour == 0) & (minute == 0), F.lit("midnight"))
        .when((minute == 0) & (hour <= 12), F.concat_ws(" ", h, F.lit("o'clock")))
        .when(minute == 0, F.concat_ws(" ", h, F.lit("hundred")))
        .when(minute < 10, F.concat_ws(" ", h, F.lit("oh"), m))
        .otherwise(F.concat_ws(" ", h, m))
    )


def numeric_date(first: Column, second: Column, year_: Column, british: bool) -> Column:
    """D/M/Y or M/D/Y of years 1000 to 9999 in words: a part over 12 is the day, else the voice decides; null where the
    day is none of the month's (29 February always is one)."""
    day_first = (first > 12) | (F.lit(british) & (second <= 12))
    day, month = F.when(day_first, first).otherwise(second), F.when(day_first, second).otherwise(first)
    within = lambda x, top: F.greatest(F.lit(1), F.least(F.lit(top), x))
    longest = F.element_at(F.array(*map(F.lit, (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31))), within(month, 12))
    name, ordinal_, of = _pick(["", *MONTHS], within(month, 12)), _pick(DAYS, within(day, 31)), year_of_date(year_)
    words = F.concat(F.lit("the "), ordinal_, F.lit(" of "), name, F.lit(", "), of) if british else F.concat(name, F.lit(" "), ordinal_, F.lit(", "), of)
    return F.when(month.between(1, 12) & (day >= 1) & (day <= longest), words)


def roman(n: Column) -> Column:
    """Canonical Roman numeral of 1 to 3999; null for any other number."""
    digits = ((1000, " M MM MMM"), (100, " C CC CCC CD D DC DCC DCCC CM"), (10, " X XX XXX XL L LX LXX LXXX XC"), (1, " I II III IV V VI VII VIII IX"))
    return F.when(n.between(1, 3999), F.concat(*(_pick(names.split(" "), _div(n, value) % 10) for value, names in digits)))


def roman_value(text: Column) -> Column:
    """The value of a canonical numeral; null for anything else."""
    tokens = F.regexp_extract_all(text, F.lit("CM|CD|XC|XL|IX|IV|[MDCLXVI]"), F.lit(0))
    worth = F.create_map(*(F.lit(x) for v, t in ROMAN for x in (t, v)))
    total = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, t: a + F.element_at(worth, t))
    return F.when((total > 0) & (roman(total) == text), total)
