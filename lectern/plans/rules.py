"""Rewrite rules on literal cases, and on texts written from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import normalize
from .tables import table, values

#: text, what a US voice says, what a British voice says.
CASES = [
    ("It cost $4.99 and £1.05.", "It cost four ninety nine and one pound five.", None),
    ("A $2.5 million deal, then $200.75", "A two point five million dollars deal, then two hundred dollars and seventy five cents", None),
    ("$20-$30 or $0.73", "twenty to thirty dollars or seventy three cents", None),
    ("Rent is $1,200/mo", "Rent is one thousand two hundred dollars a month", None),
    ("Call (415) 555-0132 ext. 23", "Call four one five, five five five, oh one three two extension two three", None),
    ("Boston, MA 02134", "Boston, Massachusetts oh two one three four", None),
    ("1600 Oak Ave. is near", "sixteen hundred Oak Avenue is near", None),
    ("Dr. Lee met Prof. Wu", "Doctor Lee met Professor Wu", None),
    ("Coffee w/ milk, w/o sugar, b/c", "Coffee with milk, without sugar, because", None),
    ("He is 6'2\" tall", "He is six foot two tall", None),
    ("World War II and Henry VIII", "World War two and Henry the eighth", None),
    ("Due 3/4/2024", "Due March fourth, twenty twenty four", "Due the third of April, twenty twenty four"),
    ("On 2024-12-25 at 7:05", "On December twenty fifth, twenty twenty four at seven oh five", "On the twenty fifth of December, twenty twenty four at seven oh five"),
    ("From 9am-5pm on Mon-Fri", "From nine A M to five P M on Monday to Friday", None),
    ("5 kg, 1 lb and 60 mph", "five kilograms, one pound and sixty miles per hour", None),
    ("It is -5 °C or 45°", "It is minus five degrees Celsius or forty five degrees", None),
    ("10% to 3.5%", "ten percent to three point five percent", None),
    ("Rated 4/5, 3/4 done", "Rated four out of five, three quarters done", None),
    ("1990-95, pp. 3-5", "nineteen ninety to nineteen ninety five, pages three to five", None),
    ("Add 2½ cups, approx. 3 times", "Add two and a half cups, approximately 3 times", None),
    ("§ 5 and №3", "section 5 and number 3", None),
    ("See e.g. the 21st c. novel", "See for example, the twenty first century novel", None),
    ("Leave [$5](/faɪv/) alone", "Leave [$5](/faɪv/) alone", None),
    ("No change here: version 1.2.3 of iPhone", "No change here: version 1.2.3 of iPhone", None),
]


def normalize_cases(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.sql(f"SELECT id, text FROM {values([(i, c[0]) for i, c in enumerate(CASES)], 'id, text')}")
    return rows.select("id", normalize.normalised(F.col("text")).alias("us"), normalize.normalised(F.col("text"), "gb").alias("gb"))


def normalize_prices(spark: SparkSession, folder: str) -> DataFrame:
    """Order totals written as dollars in a sentence, and read."""
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    text = F.concat(F.lit("Paid $"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" at once"))
    return table(spark, folder, "orders").select("o_orderkey", normalize.normalised(text).alias("words"))


def normalize_documents(spark: SparkSession, folder: str) -> DataFrame:
    """All documents through the whole list of rules: how many changed, per language."""
    rows = table(spark, folder, "documents").select("lang", F.col("text"), normalize.normalised(F.col("text")).alias("read"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum((F.col("text") != F.col("read")).cast("long")).alias("changed"))


def rule_order(spark: SparkSession, folder: str) -> DataFrame:
    """The rules in their order, which is part of their meaning."""
    return spark.createDataFrame([(i, r.name) for i, r in enumerate(normalize.RULES)], "place int, rule string")


QUERIES = {f.__name__: f for f in (normalize_cases, normalize_prices, normalize_documents, rule_order)}

_ONES, _TENS = (["'" + "','".join(x) + "'" for x in (N.ONES, N.TENS)])


def _w(n: str) -> str:
    """Words of 0 to 999 without hyphens and "and"."""
    two = lambda x: f"CASE WHEN {x} < 20 THEN [{_ONES}][{x} + 1] ELSE [{_TENS}][{x} // 10 + 1] || CASE WHEN {x} % 10 > 0 THEN ' ' || [{_ONES}][{x} % 10 + 1] ELSE '' END END"
    return f"(CASE WHEN {n} < 100 THEN {two(f'({n} % 100)')} ELSE [{_ONES}][{n} // 100 + 1] || ' hundred' || CASE WHEN {n} % 100 > 0 THEN ' ' || {two(f'({n} % 100)')} ELSE '' END END)"


ORACLES = {
    "normalize_cases": f"SELECT id, us, gb FROM {values([(i, us, gb or us) for i, (_, us, gb) in enumerate(CASES)], 'id, us, gb')}",
    "normalize_prices": f"""WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders), p AS (SELECT o_orderkey, c // 100 AS u, c % 100 AS s FROM c),
w AS (SELECT o_orderkey, u, s, CASE WHEN u < 1000 THEN {_w("u")} ELSE {_w("(u // 1000)")} || ' thousand' || CASE WHEN u % 1000 > 0 THEN ' ' || {_w("(u % 1000)")} ELSE '' END END AS uw, {_w("s")} AS sw FROM p)
SELECT o_orderkey, 'Paid ' || CASE WHEN s = 0 THEN uw || CASE WHEN u = 1 THEN ' dollar' ELSE ' dollars' END WHEN u = 0 THEN sw || CASE WHEN s = 1 THEN ' cent' ELSE ' cents' END WHEN u >= 1000 OR u % 100 = 0 THEN uw || CASE WHEN u = 1 THEN ' dollar' ELSE ' dollars' END || ' and ' || sw || CASE WHEN s = 1 THEN ' cent' ELSE ' cents' END ELSE uw || ' ' || CASE WHEN s < 10 THEN 'oh ' ELSE '' END || sw END || ' at once' AS words FROM w""",
}
