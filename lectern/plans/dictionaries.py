"""Dictionary queries on literal lexicons and on the star schema, and pauses and audio stretches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..operators import narration as R
from .tables import table, values

#: ordinal, word, case_sensitive, us, dictation, spoken, evidence, unit, pack, pack_only
LEXICON = [
    (1, "Nginx", False, "A", "always", "engine x", None, None, "tech", False),
    (2, "nginx", False, "B", None, None, True, None, "tech", False),
    (3, "NGINX", True, "C", None, None, None, None, "tech", False),
    (4, "mg", True, "D", "context", "milligrams", None, True, "medicine", False),
    (5, "mg", True, "E", None, None, None, False, "medicine", False),
    (6, "bull", False, "F", "never", None, False, None, "finance", True),
    (7, "bull", False, "G", None, None, None, None, "general", False),
    (8, "Bull", False, "H", None, None, None, None, "user", False),
    (9, "put", False, "I", None, None, None, None, "finance", True),
    (10, "put", False, "J", None, None, None, None, "general", False),
    (11, "Siobhan", False, "K", "always", "shi von", None, None, "names", False),
    (12, "siobhan", False, "L", "context", "shivaun", True, None, "irish-names", False),
]
_COLUMNS = "ordinal, word, case_sensitive, us, dictation, spoken, evidence, unit, pack, pack_only"


def _lexicon(spark: SparkSession) -> DataFrame:
    rows = spark.sql(f"SELECT * FROM {values(LEXICON, _COLUMNS)}")
    return rows.withColumn("evidence", F.col("evidence").cast("boolean")).withColumn("unit", F.col("unit").cast("boolean"))


def lexicon_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lexicon(spark)
    return L.upsert(rows.withColumn("identity", L.identity(F.col("word"), F.col("case_sensitive"))), "ordinal")


def lexicon_resolve(spark: SparkSession, folder: str) -> DataFrame:
    return L.resolve(_lexicon(spark), ["finance"]).select("word", "us", "pack")


def lexicon_match_order(spark: SparkSession, folder: str) -> DataFrame:
    return L.match_order(_lexicon(spark)).select("ordinal", "bucket", F.col("place").cast("long").alias("place"))


def lexicon_shadowed(spark: SparkSession, folder: str) -> DataFrame:
    return L.shadowed(_lexicon(spark))


def lexicon_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Part names as words, types as readings, with what a check of the batch finds."""
    part = table(spark, folder, "part")
    dictation = F.when(F.col("p_size") % 4 == 0, F.lit("always")).when(F.col("p_size") % 4 == 1, F.lit("sometimes"))
    rows = part.select("p_partkey", F.when(F.col("p_size") > 48, F.lit(" ")).otherwise(F.col("p_name")).alias("word"), F.lower(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("us"), dictation.alias("dictation"))
    return L.batch_problems(rows).select("p_partkey", F.array_join("problems", ",").alias("problems"))


def ambiguous_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Second words of part names as spoken forms: how many parts own each."""
    part = table(spark, folder, "part")
    return L.ambiguous(part.select(F.concat_ws("-", F.upper(F.substring("p_name", 1, 6)), F.lit("x"), (F.col("p_size") % 50).cast("string")).alias("pattern"), F.col("p_brand").alias("word")))


def variant_collisions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    variants = part.select(F.col("p_name").alias("word"), F.concat(F.lit("v"), (F.col("p_partkey") % 1500).cast("string")).alias("variant"))
    terms = part.where("p_partkey % 11 = 0").select(F.concat(F.lit("V"), F.col("p_partkey").cast("string")).alias("word"))
    return L.resolve_collisions(variants.withColumn("word", F.concat("word", F.lit("#"), (F.col("variant")))), terms).select("word", "variant")


def merge_by_confidence(spark: SparkSession, folder: str) -> DataFrame:
    """Order priorities as confidence: per customer the best entry, and how many others it had."""
    orders = table(spark, folder, "orders")
    confidence = F.when(F.col("o_orderpriority").startswith("1"), "high").when(F.col("o_orderpriority") < "4", "medium").otherwise("low")
    return L.best_by_confidence(orders.select(F.col("o_custkey").alias("key"), confidence.alias("confidence"), F.year("o_orderdate").alias("batch"), F.col("o_orderkey").alias("pos"))).select("key", "confidence", "pos", "rivals")


def evidence_within_12(spark: SparkSession, folder: str) -> DataFrame:
    """Gated hits on words of documents that evidence of their field within 12 words releases."""
    words = table(spark, folder, "documents").where("lang = 'en'").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[ \n]+")).alias("i", "w"))
    field = F.when(F.length("w") % 2 == 0, "even").otherwise("odd")
    hits = words.where(F.col("w").rlike("^(thtion|erre|anth|ofthe|heth)")).select("doc_id", field.alias("field"), F.col("i").alias("first"), F.col("i").alias("last"), F.col("w").startswith("thtion").alias("gated"))
    return L.near_evidence(hits).groupBy("doc_id").agg(F.count("*").alias("hits"), F.sum((F.col("gated") & F.col("applied")).cast("long")).alias("released"), F.sum((~F.col("applied")).cast("long")).alias("held"))


def auto_verdict(spark: SparkSession, folder: str) -> DataFrame:
    """Readings that agree within one edit after normalising: edit distance of neighbouring customers' names and segments."""
    c = table(spark, folder, "customer")
    a, b = F.lower("c_mktsegment"), F.regexp_replace(F.lower(F.reverse(F.reverse("c_mktsegment"))), "e$", "a")
    d = F.levenshtein(a, b)
    return c.select("c_custkey", d.cast("long").alias("distance"), F.when(d == 0, "same").when(d <= 1, "close").otherwise("different").alias("verdict"), F.round(d / F.length(a), 6).alias("rate"))


def _blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lineitems of an order as a document's blocks."""
    kinds = F.array(*map(F.lit, ("heading", "paragraph", "item", "item", "row", "code", "rule")))
    pick = (F.col("l_partkey") % 7 + 1).cast("int")
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("pos")).agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("s")).select(
        "doc_id", "pos", F.element_at(kinds, pick).alias("kind"), (F.col("s") % 6 + 1).cast("int").alias("level"), (F.col("s") % 5 == 0).cast("int").alias("quote"), (F.col("s") % 4 == 0).alias("lead_in"), (F.col("l_partkey") % 7 != 6).alias("spoken")
    )


def pause_gap(spark: SparkSession, folder: str) -> DataFrame:
    return R.pauses(_blocks(spark, folder))


def quiet_frame(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select("vec_id", R.quietest_frame(F.col("embedding"), 8, 4).cast("long").alias("frame"))


def silence_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x"))
    return R.silence_runs(rows, 3, 0.04).select("vec_id", F.col("start").cast("long").alias("start"), "n")


def heteronym_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Confusion counts of two readings, and accuracy, from labels and a guess by the text's length."""
    rows = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    guess = (F.col("n_chars") > 1000).cast("int")
    return rows.groupBy("quality", guess.alias("guess")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("quality") == guess).cast("double")), 6).alias("right"))


QUERIES = {
    f.__name__: f
    for f in (
        lexicon_upsert, lexicon_resolve, lexicon_match_order, lexicon_shadowed, lexicon_problems, ambiguous_variants, variant_collisions, merge_by_confidence, evidence_within_12, auto_verdict, pause_gap, quiet_frame, silence_runs, heteronym_accuracy,
    )
}

_LEX = f"x AS (SELECT * FROM {values(LEXICON, _COLUMNS)})"

ORACLES = {
    "lexicon_upsert": f"""WITH {_LEX}, i AS (SELECT *, CASE WHEN case_sensitive THEN '=' || word ELSE '~' || lower(word) END AS identity FROM x)
SELECT identity, arg_max(us, ordinal) AS us, arg_max(dictation, ordinal) FILTER (WHERE dictation IS NOT NULL) AS dictation, (list(spoken ORDER BY ordinal DESC) FILTER (WHERE dictation IS NOT NULL))[1] AS spoken, arg_max(evidence, ordinal) FILTER (WHERE evidence IS NOT NULL) AS evidence, arg_max(unit, ordinal) FILTER (WHERE unit IS NOT NULL) AS unit FROM i GROUP BY identity""",
    "lexicon_resolve": f"WITH {_LEX}, r AS (SELECT *, row_number() OVER (PARTITION BY lower(word) ORDER BY CASE WHEN pack = 'user' THEN 2 WHEN pack_only THEN 1 ELSE 0 END DESC, ordinal DESC) AS r FROM x WHERE NOT pack_only OR pack IN ('finance', 'user')) SELECT word, us, pack FROM r WHERE r = 1",
    "lexicon_match_order": f"WITH {_LEX} SELECT ordinal, lower(word)[1:2] AS bucket, row_number() OVER (PARTITION BY lower(word)[1:2] ORDER BY length(word) DESC, ordinal DESC, case_sensitive DESC, word) AS place FROM x",
    "lexicon_shadowed": f"WITH {_LEX} SELECT lower(word) AS word, count(DISTINCT pack) AS packs, count(DISTINCT us) AS readings FROM x GROUP BY 1 HAVING count(DISTINCT pack) >= 2 AND count(DISTINCT us) >= 2",
    "lexicon_problems": """SELECT p_partkey, concat_ws(',', CASE WHEN p_size > 48 THEN 'no word' END, CASE WHEN regexp_replace(p_type, '[^A-Za-z]', '', 'g') = '' THEN 'no reading' END, CASE WHEN p_size % 4 = 1 THEN 'unknown dictation' END) AS problems FROM part""",
    "ambiguous_variants": """WITH v AS (SELECT trim(regexp_replace(lower(p_name[1:6]) || '-x-' || (p_size % 50), '[\\s-]+', ' ', 'g')) AS pattern, p_brand AS word FROM part) SELECT pattern, count(DISTINCT word) AS owners, min(word) AS first_word FROM v GROUP BY pattern""",
    "variant_collisions": """WITH v AS (SELECT p_name || '#v' || p_partkey % 1500 AS word, 'v' || p_partkey % 1500 AS variant FROM part), t AS (SELECT 'v' || p_partkey AS variant FROM part WHERE p_partkey % 11 = 0), k AS (SELECT * FROM v WHERE variant NOT IN (SELECT variant FROM t))
SELECT word, variant FROM k WHERE variant IN (SELECT variant FROM k GROUP BY variant HAVING count(DISTINCT word) = 1)""",
    "merge_by_confidence": """WITH c AS (SELECT o_custkey AS key, CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority < '4' THEN 1 ELSE 2 END AS k, year(o_orderdate) AS batch, o_orderkey AS pos FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k, batch, pos) AS r, count(*) OVER (PARTITION BY key) - 1 AS rivals FROM c)
SELECT key, ['high','medium','low'][k + 1] AS confidence, pos, rivals FROM r WHERE r = 1""",
    "evidence_within_12": """WITH s AS (SELECT doc_id, regexp_split_to_array(lower(text), '[ \\n]+') AS a FROM documents WHERE lang = 'en'), e AS (SELECT doc_id, unnest(a) AS w, unnest(range(len(a))) AS i FROM s),
h AS (SELECT doc_id, i, length(w) % 2 AS field, starts_with(w, 'thtion') AS gated FROM e WHERE regexp_matches(w, '^(thtion|erre|anth|ofthe|heth)')),
j AS (SELECT a.doc_id, a.i, a.gated, NOT a.gated OR EXISTS (SELECT 1 FROM h b WHERE b.doc_id = a.doc_id AND b.field = a.field AND b.i <> a.i AND abs(b.i - a.i) <= 12) AS applied FROM h a)
SELECT doc_id, count(*) AS hits, count(*) FILTER (WHERE gated AND applied) AS released, count(*) FILTER (WHERE NOT applied) AS held FROM j GROUP BY doc_id""",
    "auto_verdict": """WITH d AS (SELECT c_custkey, lower(c_mktsegment) AS a, levenshtein(lower(c_mktsegment), regexp_replace(lower(c_mktsegment), 'e$', 'a')) AS d FROM customer) SELECT c_custkey, d AS distance, CASE WHEN d = 0 THEN 'same' WHEN d <= 1 THEN 'close' ELSE 'different' END AS verdict, round(d / length(a), 6) AS rate FROM d""",
    "pause_gap": """WITH g AS (SELECT l_orderkey AS doc_id, CAST(l_linenumber AS BIGINT) AS pos, min(l_partkey) AS p, min(l_suppkey) AS s FROM lineitem GROUP BY ALL),
b AS (SELECT doc_id, pos, ['heading','paragraph','item','item','row','code','rule'][p % 7 + 1] AS k, s % 6 + 1 AS v, s % 5 = 0 AS q, s % 4 = 0 AS li, p % 7 <> 6 AS spoken FROM g),
n AS (SELECT *, lead(k) OVER w AS nk, lead(v) OVER w AS nv, lead(q) OVER w AS nq, sum(CAST(spoken AS INT)) OVER w AS island FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
e AS (SELECT *, CASE WHEN nk IS NULL THEN NULL WHEN k = 'heading' AND nk = 'heading' THEN 0.6 WHEN li AND nk = 'item' THEN 0.45 ELSE greatest(
 CASE WHEN k = 'heading' THEN [0.8, 0.7, 0.6, 0.5][least(v, 4)] WHEN k = 'rule' THEN 1.6 WHEN k = 'item' AND nk = 'item' THEN 0.4 WHEN k = 'row' AND nk = 'row' THEN 0.35 ELSE 0.75 END,
 CASE WHEN nk = 'heading' THEN [1.4, 1.2, 1.0, 0.9][least(nv, 4)] WHEN nk = 'rule' THEN 1.6 WHEN nk = 'code' THEN 0.75 WHEN nk = 'item' AND k <> 'item' THEN 0.6 ELSE 0.0 END, CASE WHEN q <> nq THEN 0.6 ELSE 0.0 END) END AS edge FROM n),
i AS (SELECT doc_id, island, max(pos) FILTER (WHERE spoken) AS pos, max(edge) AS pause FROM e WHERE island > 0 GROUP BY ALL)
SELECT doc_id, pos, CAST(CASE WHEN lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) IS NULL THEN 0.5 ELSE pause END AS DOUBLE) AS pause FROM i""",
    "quiet_frame": """WITH f AS (SELECT vec_id, unnest(range(0, greatest(len(embedding) - 8, 0) + 1, 4)) AS frame, embedding FROM embeddings), e AS (SELECT vec_id, frame, round(list_sum(list_transform(embedding[frame + 1:frame + 8], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 12) AS e FROM f), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY e, frame) AS r FROM e) SELECT vec_id, frame FROM r WHERE r = 1""",
    "silence_runs": """WITH e AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings), q AS (SELECT vec_id, pos, pos - row_number() OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM e WHERE abs(x) <= CAST(0.04 AS DOUBLE)) SELECT vec_id, min(pos) AS start, count(*) AS n FROM q GROUP BY vec_id, island HAVING count(*) >= 3""",
    "heteronym_accuracy": """SELECT quality, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS guess, count(*) AS n, round(avg(CASE WHEN quality = CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6) AS right FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2""",
}
