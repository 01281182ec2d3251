"""Names analytics on the star schema: market segments and regions as sources, name parts as names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import names as O
from .tables import table


def _people(spark: SparkSession, folder: str) -> DataFrame:
    """source (market segment), form (a spelling made of the nation and key), n."""
    rows = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    form = F.concat_ws(" ", F.initcap(F.regexp_replace("n_name", "[^A-Za-z]", "")), F.element_at(F.array(*map(F.lit, ("Ann", "BEN", "ann", "O’Hara", "Ben"))), (F.col("c_custkey") % 5 + 1).cast("int")))
    return rows.select(F.col("c_mktsegment").alias("source"), form.alias("form"), (F.col("c_custkey") % 9 + 1).alias("n"), "n_name", "n_regionkey", "c_custkey")


def name_tally(spark: SparkSession, folder: str) -> DataFrame:
    return O.tally(_people(spark, folder))


def _counts(spark: SparkSession, folder: str) -> DataFrame:
    return O.tally(_people(spark, folder)).where("form is null").select("source", "key", "n")


def _populations(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy(F.col("c_mktsegment").alias("source")).agg((F.sum(F.ceil(F.abs("c_acctbal"))) * 100).alias("population")).withColumn("anglo", F.col("source") < "C")


def name_rank(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 keys with the highest population score."""
    scored = O.scores(_counts(spark, folder), _populations(spark, folder))
    share = F.round(F.col("anglo") / F.col("score"), 4)
    return O.ranked(scored, 50).select(F.col("rank").cast("long").alias("rank"), "key", F.round("score", 2).alias("score"), share.alias("anglo_share"), O.english_usage(share).alias("usage"), "n_sources")


def name_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Samples by nation; those below the least size are pooled. Cells below 2 go."""
    rows = _people(spark, folder).groupBy(F.col("n_name").alias("country"), O.key_of(F.substring_index("form", " ", -1)).alias("key")).agg(F.sum("n").alias("n"))
    return O.pool_small(rows, 300).where(F.col("n") >= O.MIN_CELL)


def name_display_form(spark: SparkSession, folder: str) -> DataFrame:
    tiers = _people(spark, folder).select("source", F.substring_index("form", " ", -1).alias("form"), "n").withColumn("key", O.key_of(F.col("form"))).withColumn("tier", F.when(F.col("source") < "C", 1).otherwise(2))
    return O.display_form(tiers.groupBy("key", "tier", "form").agg(F.sum("n").alias("n")))


def name_top_countries(spark: SparkSession, folder: str) -> DataFrame:
    rows = _people(spark, folder).groupBy(O.key_of(F.substring_index("form", " ", -1)).alias("key"), F.col("n_name").alias("country")).agg(F.sum("n").alias("n"))
    return O.top_per_key(rows, 3)


def _ledger(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    rank, freq = F.col("p_partkey"), F.col("p_size") / 10.0
    return part.select(rank.alias("rank"), F.col("p_name").alias("name"), O.bucket(rank, freq, F.col("p_name").contains(" ") & (F.col("p_size") > 45)).alias("bucket"), F.col("p_brand").alias("source"), (F.col("p_retailprice") > 1200).alias("settled"))


def triage_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return _ledger(spark, folder).groupBy("bucket").agg(F.count("*").alias("names"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"))


def coverage_cube(spark: SparkSession, folder: str) -> DataFrame:
    return O.coverage(_ledger(spark, folder)).withColumn("level", F.col("level").cast("long"))


def coverage_pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Settled and open names as columns, per bucket."""
    rows = _ledger(spark, folder).withColumn("state", F.when(F.col("settled"), "settled").otherwise("open"))
    return rows.groupBy("bucket").pivot("state", ["settled", "open"]).count().na.fill(0)


def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    return O.stratified_sample(table(spark, folder, "documents").select("doc_id", "lang"), "lang", "doc_id", 5, "seed").select("lang", "doc_id")


def batch_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a language in batches of 15 by length, and the first and last of each batch."""
    rows = O.batches(table(spark, folder, "documents").select("doc_id", "lang", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 15)
    return rows.groupBy("lang", "batch").agg(F.count("*").alias("size"), F.max("n_chars").alias("longest"), F.min("doc_id").alias("least_id"))


def queue_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    """Part types without those of several words that single names cover."""
    part = table(spark, folder, "part")
    singles = part.where(F.col("p_partkey") % 3 > 0).select(F.explode(F.split("p_type", " ")).alias("name"))
    return O.drop_covered(singles.union(part.select("p_type")).distinct())


def lexicon_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Equi-join of names with dictionary words by lower case, with a case predicate left over; in both lists or in one."""
    names = table(spark, folder, "supplier").select("s_suppkey", F.concat(F.lit("Supplier"), (F.col("s_suppkey") % 40).cast("string")).alias("name"))
    lexicon = table(spark, folder, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.lit("supplier")).otherwise(F.lit("Supplier")), F.col("n_nationkey").cast("string")).alias("word"), (F.col("n_nationkey") % 2 == 0).alias("any_case"), F.col("n_regionkey").alias("pack"))
    hits = names.join(lexicon, (F.lower("name") == F.lower("word")) & (F.col("any_case") | (F.col("name") == F.col("word"))))
    return hits.groupBy("s_suppkey").agg(F.array_join(F.array_sort(F.collect_set(F.col("pack").cast("string"))), ",").alias("packs"), F.count("*").alias("hits"))


def prior_dispositions(spark: SparkSession, folder: str) -> DataFrame:
    """Dispositions of an earlier ledger kept by name, "new" elsewhere; and names not yet researched (anti join)."""
    ledger = _ledger(spark, folder)
    prior = ledger.where(F.col("rank") % 7 == 0).select("rank", F.lit("kept").alias("disposition"))
    done = ledger.where("settled").select("rank")
    merged = ledger.join(prior, "rank", "left").select("rank", F.coalesce("disposition", F.lit("new")).alias("disposition"))
    return merged.join(done, "rank", "left_anti")


def supplier_affinity(spark: SparkSession, folder: str) -> DataFrame:
    """Affinity of part brands to one region of suppliers, per head of quantity."""
    rows = table(spark, folder, "lineitem").join(table(spark, folder, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, folder, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    inside = F.when(F.col("s_nationkey") < 5, F.col("l_quantity")).otherwise(0.0)
    brands = rows.groupBy("p_brand").agg(F.sum("l_quantity").alias("score"), F.sum(inside).alias("anglo"))
    whole = Window.partitionBy(F.lit(1))
    a, s = F.sum("anglo").over(whole), F.sum("score").over(whole)
    return brands.select("p_brand", F.round(O.affinity(F.col("anglo"), F.col("score"), a, s - a), 6).alias("affinity"))


QUERIES = {
    f.__name__: f
    for f in (
        name_tally, name_rank, name_pool, name_display_form, name_top_countries, triage_buckets, coverage_cube, coverage_pivot, stratified_sample, batch_queue, queue_uncovered, lexicon_hits, prior_dispositions, supplier_affinity,
    )
}

_PEOPLE = """p AS (SELECT c_mktsegment AS source, upper(regexp_replace(n_name, '[^A-Za-z]', '', 'g')[1]) || lower(regexp_replace(n_name, '[^A-Za-z]', '', 'g')[2:]) || ' ' || ['Ann','BEN','ann','O’Hara','Ben'][c_custkey % 5 + 1] AS form, c_custkey % 9 + 1 AS n, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
k AS (SELECT *, replace(form, '’', '''') AS f, lower(replace(form, '’', '''')) AS key, lower(replace(string_split(form, ' ')[-1], '’', '''')) AS last FROM p)"""
_LEDGER = """l AS (SELECT p_partkey AS rank, p_name AS name, CASE WHEN contains(p_name, ' ') AND p_size > 45 THEN 'multiword' WHEN p_size >= 40 THEN 'common word' WHEN p_size >= 30 THEN 'uncommon word' WHEN p_partkey <= 100 THEN 'top' ELSE 'rest' END AS bucket, p_brand AS source, p_retailprice > 1200 AS settled FROM part)"""

ORACLES = {
    "name_tally": f"WITH {_PEOPLE} SELECT source, key, f AS form, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY GROUPING SETS ((source, key, f), (source, key))",
    "name_rank": f"""WITH {_PEOPLE}, c AS (SELECT source, key, sum(n) AS n FROM k GROUP BY ALL), t AS (SELECT source, sum(n) AS total FROM c GROUP BY source), q AS (SELECT c_mktsegment AS source, sum(ceil(abs(c_acctbal))) * 100 AS population FROM customer GROUP BY 1),
s AS (SELECT key, sum(n * (population / total)) AS score, sum(CASE WHEN c.source < 'C' THEN n * (population / total) ELSE 0 END) AS anglo, count(*) AS n_sources FROM c JOIN t USING (source) JOIN q USING (source) GROUP BY key),
r AS (SELECT *, row_number() OVER (ORDER BY round(score, 4) DESC, key) AS rank FROM s)
SELECT rank, key, round(score, 2) AS score, round(anglo / round(score, 4), 4) AS anglo_share, CASE WHEN anglo / score >= 2/3 THEN 'english' WHEN anglo / score >= 0.4 THEN 'shared' ELSE 'other' END AS usage, n_sources FROM r WHERE rank <= 50""",
    "name_pool": f"WITH {_PEOPLE}, c AS (SELECT n_name AS country, last AS key, sum(n) AS n FROM k GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY country) AS size FROM c) SELECT CASE WHEN size >= 300 THEN country ELSE 'pool' END AS sample, key, CAST(sum(n) AS BIGINT) AS n FROM s GROUP BY ALL HAVING sum(n) >= 2",
    "name_display_form": f"""WITH {_PEOPLE}, c AS (SELECT last AS key, CASE WHEN source < 'C' THEN 1 ELSE 2 END AS tier, string_split(form, ' ')[-1] AS form, sum(n) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tier, n DESC, form DESC) AS r FROM c) SELECT key, form FROM r WHERE r = 1""",
    "name_top_countries": f"WITH {_PEOPLE}, c AS (SELECT last AS key, n_name AS country, sum(n) AS n FROM k GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, country) AS r FROM c) SELECT key, string_agg(country, ',' ORDER BY r) AS top FROM r WHERE r <= 3 GROUP BY key",
    "triage_buckets": f"WITH {_LEDGER} SELECT bucket, count(*) AS names, min(rank) AS first_rank, max(rank) AS last_rank FROM l GROUP BY bucket",
    "coverage_cube": f"WITH {_LEDGER} SELECT bucket, source, count(*) AS names, CAST(sum(CAST(settled AS INT)) AS BIGINT) AS settled, CAST(sum(CASE WHEN settled AND rank <= 1000 THEN 1 ELSE 0 END) AS BIGINT) AS settled_top, CAST(grouping(bucket) * 2 + grouping(source) AS BIGINT) AS level FROM l GROUP BY CUBE (bucket, source)",
    "coverage_pivot": f"WITH {_LEDGER} SELECT bucket, count(*) FILTER (WHERE settled) AS settled, count(*) FILTER (WHERE NOT settled) AS open FROM l GROUP BY bucket",
    "stratified_sample": "WITH r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('seed/' || lang || '/' || doc_id)) AS r FROM documents) SELECT lang, doc_id FROM r WHERE r <= 5",
    "batch_queue": "WITH r AS (SELECT *, CAST(ceil(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) / 15.0) AS BIGINT) AS batch FROM documents) SELECT lang, batch, count(*) AS size, max(n_chars) AS longest, min(doc_id) AS least_id FROM r GROUP BY ALL",
    "queue_uncovered": """WITH s AS (SELECT DISTINCT unnest(string_split(p_type, ' ')) AS name FROM part WHERE p_partkey % 3 > 0), n AS (SELECT name FROM s UNION SELECT p_type FROM part)
SELECT name FROM n WHERE NOT contains(name, ' ') OR EXISTS (SELECT 1 FROM (SELECT unnest(string_split(n.name, ' ')) AS part) x WHERE part NOT IN (SELECT name FROM n WHERE NOT contains(name, ' ')))""",
    "lexicon_hits": """WITH n AS (SELECT s_suppkey, 'Supplier' || s_suppkey % 40 AS name FROM supplier), w AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'supplier' ELSE 'Supplier' END || n_nationkey AS word, n_nationkey % 2 = 0 AS any_case, n_regionkey AS pack FROM nation)
SELECT s_suppkey, string_agg(DISTINCT CAST(pack AS VARCHAR), ',' ORDER BY CAST(pack AS VARCHAR)) AS packs, count(*) AS hits FROM n JOIN w ON lower(name) = lower(word) AND (any_case OR name = word) GROUP BY s_suppkey""",
    "prior_dispositions": f"WITH {_LEDGER} SELECT rank, CASE WHEN rank % 7 = 0 THEN 'kept' ELSE 'new' END AS disposition FROM l WHERE NOT settled",
    "supplier_affinity": """WITH b AS (SELECT p_brand, sum(l_quantity) AS s, sum(CASE WHEN s_nationkey < 5 THEN l_quantity ELSE 0 END) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey GROUP BY p_brand), t AS (SELECT sum(a) AS ta, sum(s) AS ts FROM b)
SELECT p_brand, round((a / ta) / (a / ta + (s - a) / (ts - ta)), 6) AS affinity FROM b, t""",
}
