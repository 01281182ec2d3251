"""Written forms made of the tables' numbers and dates, and the words that are read for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from .tables import table, values


def cardinal_words(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("o_orderkey") * 7919 % 1_000_000_007
    return table(spark, folder, "orders").select("o_orderkey", N.cardinal(n).alias("words"), N.spoken(N.cardinal(n)).alias("spoken"))


def ordinal_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", N.ordinal(F.col("p_partkey")).alias("words"))


def year_words(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", N.year(F.lit(1000) + F.col("p_partkey") % 1200).alias("words"))


def money_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals as dollars, discounts as cents, whole and British forms."""
    price = F.col("l_extendedprice")
    small = N.hundredths(F.col("l_discount") + F.col("l_tax"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", N.dollars(price).alias("dollars"), N.dollars(small).alias("small"), N.dollars(F.floor(price / 1000).cast("double")).alias("whole"), N.pounds(N.hundredths(price / 10000)).alias("pounds"))


def money_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """The prices of an order as a range with the currency once; a falling or equal pair keeps both."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.floor(F.min("l_extendedprice")).alias("low"), F.floor(F.max("l_extendedprice")).alias("high"))
    text = F.when(F.col("low") < F.col("high"), F.concat_ws(" ", F.col("low").cast("string"), F.lit("to"), F.col("high").cast("string"), F.lit("dollars"))).otherwise(F.concat_ws(" ", F.col("low").cast("string"), F.lit("dollars")))
    return rows.select("l_orderkey", text.alias("words"))


def lakh_crore(spark: SparkSession, folder: str) -> DataFrame:
    n = F.floor(F.col("o_totalprice") * 100 * (F.col("o_orderkey") % 7 + 1)).cast("long")
    return table(spark, folder, "orders").select("o_orderkey", N.lakh_crore(n).alias("words"))


def _dates(british: bool):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        day, month, year = F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")
        swap = F.col("o_orderkey") % 2 == 0
        first, second = F.when(swap, month).otherwise(day), F.when(swap, day).otherwise(month)
        return table(spark, folder, "orders").select("o_orderkey", N.numeric_date(first, second, year, british).alias("words"))

    return query


def iso_dates(spark: SparkSession, folder: str) -> DataFrame:
    """ISO dates written and read: parsed from text, in words."""
    text = F.date_format("l_shipdate", "yyyy-MM-dd")
    part = lambda i: F.regexp_extract(text, r"^(\d{4})-(\d{2})-(\d{2})$", i).cast("int")
    rows = table(spark, folder, "lineitem").select("l_shipdate").distinct()
    return rows.select(text.alias("iso"), N.numeric_date(part(2), part(3), part(1), False).alias("words"))


def clock_readings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", N.clock(F.hour("ts"), F.minute("ts")).alias("words"), N.clock(F.hour("ts"), F.lit(0)).alias("on_the_hour"))


def duration_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds between a user's first and last event as H:MM:SS in words, without parts that are zero."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, folder, "events").groupBy("user_id").agg((F.max(us) - F.min(us)).alias("us"))
    s = F.floor(F.col("us") / 1_000_000).cast("long")
    part = lambda n, name: F.when(n > 0, F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(name)).otherwise(F.lit(name + "s"))))
    words = F.concat_ws(" ", part(F.floor(s / 3600), "hour"), part(F.floor(s / 60) % 60, "minute"), part(s % 60, "second"))
    return rows.select("user_id", F.when(words == "", F.lit("0 seconds")).otherwise(words).alias("words"))


#: Units: symbol, singular, plural. Fixed values.
UNITS = [("kg", "kilogram", "kilograms"), ("km", "kilometer", "kilometers"), ("lb", "pound", "pounds"), ("ft", "foot", "feet"), ("mph", "mile per hour", "miles per hour"), ("GB", "gigabyte", "gigabytes"), ("°C", "degree Celsius", "degrees Celsius")]


def unit_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Quantities written with a unit symbol, read from the text with the unit's singular or plural."""
    units = spark.sql(f"SELECT * FROM {values([(i, *u) for i, u in enumerate(UNITS)], 'k, symbol, one, many')}")
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), (F.col("l_partkey") % len(UNITS)).cast("int").alias("k"))
    written = rows.join(F.broadcast(units), "k").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.col("q").cast("string"), F.col("symbol")).alias("text"))
    read = written.withColumn("n", F.regexp_extract("text", r"^(\d+) (\S+)$", 1)).withColumn("symbol", F.regexp_extract("text", r"^(\d+) (\S+)$", 2)).join(F.broadcast(units), "symbol")
    return read.select("l_orderkey", "l_linenumber", "text", F.concat_ws(" ", "n", F.when(F.col("n") == "1", F.col("one")).otherwise(F.col("many"))).alias("words"))


#: Vulgar fractions and their words. Fixed values.
FRACTIONS = [("½", 1, 2, "one half"), ("⅓", 1, 3, "one third"), ("⅔", 2, 3, "two thirds"), ("¼", 1, 4, "one quarter"), ("¾", 3, 4, "three quarters"), ("⅛", 1, 8, "one eighth"), ("⅝", 5, 8, "five eighths"), ("⅞", 7, 8, "seven eighths")]


def fraction_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Mixed fractions: a whole part, "and", and the fraction's words."""
    fractions = spark.sql(f"SELECT sign, words FROM {values(FRACTIONS, 'sign, top, bottom, words')}")
    rows = table(spark, folder, "part").select("p_partkey", F.concat((F.col("p_size") % 12).cast("string"), F.element_at(F.array(*(F.lit(f[0]) for f in FRACTIONS)), (F.col("p_partkey") % 8 + 1).cast("int"))).alias("text"))
    read = rows.withColumn("sign", F.substring("text", -1, 1)).withColumn("whole", F.expr("substring(text, 1, length(text) - 1)")).join(F.broadcast(fractions), "sign")
    return read.select("p_partkey", F.when(F.col("whole") == "0", F.col("words")).otherwise(F.concat_ws(" and ", "whole", F.regexp_replace("words", "^one (half|quarter|third|eighth)$", "a $1"))).alias("words"))


def roman_values(spark: SparkSession, folder: str) -> DataFrame:
    """Numerals of all part keys up to 3999, and their values read back; misspelt ones have none."""
    n = F.col("p_partkey") % 3999 + 1
    return table(spark, folder, "part").select("p_partkey", N.roman(n).alias("numeral"), N.roman_value(N.roman(n)).alias("value"), N.roman_value(F.concat(N.roman(n), F.lit("IIII"))).alias("misspelt"))


QUERIES = {
    f.__name__: f
    for f in (cardinal_words, ordinal_words, year_words, money_readings, money_ranges, lakh_crore, iso_dates, clock_readings, duration_readings, unit_readings, fraction_readings, roman_values)
} | {"date_readings_us": _dates(False), "date_readings_gb": _dates(True)}

_O = "['" + "','".join(N.ONES) + "']"
_T = "['" + "','".join(N.TENS) + "']"


def _two(n: str) -> str:
    return f"(CASE WHEN ({n}) < 20 THEN {_O}[({n}) + 1] ELSE {_T}[({n}) // 10 + 1] || CASE WHEN ({n}) % 10 > 0 THEN '-' || {_O}[({n}) % 10 + 1] ELSE '' END END)"


def _three(n: str) -> str:
    return f"(CASE WHEN ({n}) < 100 THEN {_two(f'({n}) % 100')} ELSE {_O}[({n}) // 100 + 1] || ' hundred' || CASE WHEN ({n}) % 100 > 0 THEN ' and ' || {_two(f'({n}) % 100')} ELSE '' END END)"


def _cardinal(n: str) -> str:
    groups = ", ".join(f"CASE WHEN ({n}) // {v} % 1000 > 0 THEN {_three(f'({n}) // {v} % 1000')} || ' {w}' END" for v, w in N.SCALES)
    large = f"concat_ws(', ', {groups})"
    rest = _three(f"({n}) % 1000")
    return f"(CASE WHEN ({n}) < 1000 THEN {rest} WHEN ({n}) % 1000 = 0 THEN {large} WHEN ({n}) % 1000 < 100 THEN {large} || ' and ' || {rest} ELSE {large} || ', ' || {rest} END)"


def _ordinal(n: str) -> str:
    """Of numbers below a million, by the last two digits."""
    first = {1: "first", 2: "second", 3: "third", 5: "fifth", 8: "eighth", 9: "ninth", 12: "twelfth"}
    names = [first.get(i, w + "th") for i, w in enumerate(N.ONES)]
    of = "['" + "','".join(names) + "']"
    tens = "['" + "','".join(t[:-1] + "ieth" for t in N.TENS) + "']"
    last = f"(CASE WHEN ({n}) % 100 < 20 THEN {of}[({n}) % 100 + 1] WHEN ({n}) % 10 = 0 THEN {tens}[({n}) % 100 // 10 + 1] ELSE {_T}[({n}) % 100 // 10 + 1] || '-' || {of}[({n}) % 10 + 1] END)"
    hundreds = f"(({n}) - ({n}) % 100)"
    return f"(CASE WHEN ({n}) < 100 THEN {last} WHEN ({n}) % 100 = 0 THEN {_cardinal(hundreds)} || 'th' ELSE {_cardinal(hundreds)} || ' and ' || {last} END)"


def _year(n: str) -> str:
    h, low = f"(({n}) // 100)", f"(({n}) % 100)"
    return f"(CASE WHEN {h} = 0 OR ({h} % 10 = 0 AND {low} < 10) OR {h} >= 100 THEN {_cardinal(n)} ELSE {_two(h)} || ' ' || CASE WHEN {low} = 0 THEN 'hundred' WHEN {low} < 10 THEN 'oh-' || {_two(low)} ELSE {_two(low)} END END)"


def _dollars(cents: str) -> str:
    u, c = f"(({cents}) // 100)", f"(({cents}) % 100)"
    unit, cent = f"CASE WHEN {u} = 1 THEN 'dollar' ELSE 'dollars' END", f"CASE WHEN {c} = 1 THEN 'cent' ELSE 'cents' END"
    return f"(CASE WHEN {c} = 0 THEN {u} || ' ' || {unit} WHEN {u} = 0 THEN {c} || ' ' || {cent} WHEN {u} >= 1000 OR {u} % 100 = 0 THEN {u} || ' ' || {unit} || ' and ' || {c} || ' ' || {cent} WHEN {c} < 10 THEN {u} || ' oh ' || {c} ELSE {u} || ' ' || {c} END)"


def _date(a: str, b: str, y: str, british: bool) -> str:
    names = "['" + "','".join(N.MONTHS) + "']"
    day_first = f"'the ' || {_ordinal(a)} || ' of ' || {names}[{b}] || ', ' || {_year(y)}"
    month_first = f"{names}[{a}] || ' ' || {_ordinal(b)} || ', ' || {_year(y)}"
    us_day_first = f"{names}[{b}] || ' ' || {_ordinal(a)} || ', ' || {_year(y)}"
    gb_month_first = f"'the ' || {_ordinal(b)} || ' of ' || {names}[{a}] || ', ' || {_year(y)}"
    if british:
        return f"CASE WHEN {a} > 12 THEN {day_first} WHEN {b} > 12 THEN {gb_month_first} ELSE {day_first} END"
    return f"CASE WHEN {a} > 12 THEN {us_day_first} ELSE {month_first} END"


def _date_oracle(british: bool) -> str:
    return f"""WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate) ELSE day(o_orderdate) END AS a, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate) ELSE month(o_orderdate) END AS b, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, {_date("a", "b", "y", british)} AS words FROM d"""


ORACLES = {
    "cardinal_words": f"WITH n AS (SELECT o_orderkey, o_orderkey * 7919 % 1000000007 AS n FROM orders), w AS (SELECT o_orderkey, {_cardinal('n')} AS words FROM n) SELECT o_orderkey, words, regexp_replace(regexp_replace(words, '[-,]', ' ', 'g'), ' +(and +)?', ' ', 'g') AS spoken FROM w",
    "ordinal_words": f"SELECT p_partkey, {_ordinal('p_partkey')} AS words FROM part",
    "year_words": f"WITH n AS (SELECT p_partkey, 1000 + p_partkey % 1200 AS n FROM part) SELECT p_partkey, {_year('n')} AS words FROM n",
    "money_readings": f"""WITH c AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS p, CAST(round(round(l_discount + l_tax, 2) * 100) AS BIGINT) AS s, CAST(floor(l_extendedprice / 1000) AS BIGINT) * 100 AS w, CAST(round(round(l_extendedprice / 10000, 2) * 100) AS BIGINT) AS g FROM lineitem)
SELECT l_orderkey, l_linenumber, {_dollars("p")} AS dollars, {_dollars("s")} AS small, {_dollars("w")} AS whole,
CASE WHEN g % 100 = 0 THEN g // 100 || CASE WHEN g // 100 = 1 THEN ' pound' ELSE ' pounds' END WHEN g < 100 THEN g || CASE WHEN g = 1 THEN ' penny' ELSE ' pence' END ELSE g // 100 || CASE WHEN g // 100 = 1 THEN ' pound ' ELSE ' pounds ' END || g % 100 END AS pounds FROM c""",
    "money_ranges": "WITH r AS (SELECT l_orderkey, CAST(floor(min(l_extendedprice)) AS BIGINT) AS a, CAST(floor(max(l_extendedprice)) AS BIGINT) AS b FROM lineitem GROUP BY l_orderkey) SELECT l_orderkey, CASE WHEN a < b THEN a || ' to ' || b || ' dollars' ELSE a || ' dollars' END AS words FROM r",
    "lakh_crore": """WITH n AS (SELECT o_orderkey, CAST(floor(o_totalprice * 100 * (o_orderkey % 7 + 1)) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, concat_ws(' ', CASE WHEN n >= 10000000 THEN n // 10000000 || ' crore' END, CASE WHEN n // 100000 % 100 > 0 THEN n // 100000 % 100 || ' lakh' END, CASE WHEN n // 1000 % 100 > 0 THEN n // 1000 % 100 || ' thousand' END, CASE WHEN n % 1000 > 0 OR n < 1000 THEN CAST(n % 1000 AS VARCHAR) END) AS words FROM n""",
    "iso_dates": f"WITH d AS (SELECT DISTINCT l_shipdate AS s FROM lineitem), e AS (SELECT strftime(s, '%Y-%m-%d') AS iso, month(s) AS a, day(s) AS b, year(s) AS y FROM d) SELECT iso, {_date('a', 'b', 'y', False)} AS words FROM e",
    "clock_readings": """WITH t AS (SELECT event_id, hour(ts) AS h, minute(ts) AS m FROM events)
SELECT event_id, CASE WHEN h = 0 AND m = 0 THEN 'midnight' WHEN m = 0 AND h <= 12 THEN h || ' o''clock' WHEN m = 0 THEN h || ' hundred' WHEN m < 10 THEN h || ' oh ' || m ELSE h || ' ' || m END AS words,
CASE WHEN h = 0 THEN 'midnight' WHEN h <= 12 THEN h || ' o''clock' ELSE h || ' hundred' END AS on_the_hour FROM t""",
    "duration_readings": """WITH d AS (SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS s FROM events GROUP BY user_id),
w AS (SELECT user_id, concat_ws(' ', CASE WHEN s // 3600 > 0 THEN s // 3600 || CASE WHEN s // 3600 = 1 THEN ' hour' ELSE ' hours' END END, CASE WHEN s // 60 % 60 > 0 THEN s // 60 % 60 || CASE WHEN s // 60 % 60 = 1 THEN ' minute' ELSE ' minutes' END END, CASE WHEN s % 60 > 0 THEN s % 60 || CASE WHEN s % 60 = 1 THEN ' second' ELSE ' seconds' END END) AS w FROM d)
SELECT user_id, CASE WHEN w = '' THEN '0 seconds' ELSE w END AS words FROM w""",
    "unit_readings": f"SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) || ' ' || symbol AS text, CAST(l_quantity AS BIGINT) || ' ' || CASE WHEN l_quantity = 1 THEN one ELSE many END AS words FROM lineitem JOIN {values([(i, *u) for i, u in enumerate(UNITS)], 'k, symbol, one, many')} ON k = l_partkey % {len(UNITS)}",
    "fraction_readings": f"""SELECT p_partkey, CASE WHEN p_size % 12 = 0 THEN words ELSE p_size % 12 || ' and ' || CASE WHEN top = 1 THEN 'a' || words[4:] ELSE words END END AS words FROM part JOIN {values([(i, *f) for i, f in enumerate(FRACTIONS)], "k, sign, top, bottom, words")} ON k = p_partkey % 8""",
    "roman_values": """WITH n AS (SELECT p_partkey, p_partkey % 3999 + 1 AS n FROM part)
SELECT p_partkey, ['','M','MM','MMM'][n // 1000 + 1] || ['','C','CC','CCC','CD','D','DC','DCC','DCCC','CM'][n // 100 % 10 + 1] || ['','X','XX','XXX','XL','L','LX','LXX','LXXX','XC'][n // 10 % 10 + 1] || ['','I','II','III','IV','V','VI','VII','VIII','IX'][n % 10 + 1] AS numeral, n AS value, CAST(NULL AS BIGINT) AS misspelt FROM n""",
    "date_readings_us": _date_oracle(False),
    "date_readings_gb": _date_oracle(True),
}
