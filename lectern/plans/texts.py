"""Text queries over documents, conversations and pages: cleaning, sentences, tidying, planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import table


def flagship_sentences(spark: SparkSession, folder: str) -> DataFrame:
    """Per language and source: sentences, those that can be read, their mean words, and the longest sentence's length."""
    rows = table(spark, folder, "documents").select("lang", "source", F.explode(T.sentences(T.clean(F.col("text")))).alias("s"))
    rows = rows.where(T.has_words(F.col("s"))).select("lang", "source", T.can_read(F.col("s")).alias("fine"), F.size(F.split("s", " ")).alias("n"), F.length("s").alias("chars"))
    return rows.groupBy("lang", "source").agg(F.count("*").alias("sentences"), F.sum(F.col("fine").cast("int")).cast("long").alias("readable"), F.sum("n").cast("long").alias("words"), F.max("chars").cast("long").alias("longest"))


_CLEAN = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  translate(regexp_replace(text, '\r\n?', chr(10), 'g'), concat(chr(160), chr(173), chr(65279), chr(8203)), ' '),
  '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '([^\n])\n([a-z])', '\1 \2', 'g'), '([^\n])\n([a-z])', '\1 \2', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g'))"""
_SENTENCES = rf"""list_filter(list_transform(regexp_split_to_array(regexp_replace({_CLEAN}, '([.!?…]["''”’)\]]*)\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s)), lambda s: s <> '')"""


def clean_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each document's text cleaned: length, lines and a hash."""
    clean = T.clean(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", F.length(clean).cast("long").alias("n"), F.size(F.split(clean, "\n")).cast("long").alias("n_lines"), F.md5(clean.cast("binary")).alias("clean_md5"))


def readable_share_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    """Share of the documents that a voice for Latin script can read, and of letters that are Latin."""
    text = F.col("text")
    rows = table(spark, folder, "documents").select("lang", T.can_read(text).alias("fine"), F.regexp_count(text, F.lit(r"\p{L}")).alias("letters"), F.regexp_count(text, F.lit(r"\p{IsLatin}")).alias("latin"))
    return rows.groupBy("lang").agg(F.count("*").alias("docs"), F.sum(F.col("fine").cast("long")).alias("readable"), F.sum("letters").cast("long").alias("letters"), F.sum("latin").cast("long").alias("latin"))


def shouted_sentences(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences(T.clean(F.col("text")))).alias("pos", "sentence"))
    return rows.where(T.shouted(F.col("sentence"))).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").cast("long").alias("first_pos"), F.max(F.length("sentence")).cast("long").alias("longest"))


def tidy_words(spark: SparkSession, folder: str) -> DataFrame:
    """The words of each turn, as compared between what was said and what came back."""
    w = T.words(F.col("text"))
    return table(spark, folder, "conversations").select("conv_id", "turn", F.size(w).cast("long").alias("n_words"), F.array_join(w, " ").alias("words"))


def filler_drop(spark: SparkSession, folder: str) -> DataFrame:
    """Fillers put between the words of a turn, and dropped again."""
    said = F.concat(F.lit("Um, so "), F.regexp_replace("text", r"\n", " "), F.lit(" uh, hmm. Mm-hmm uh-huh and umbrella erm"))
    return table(spark, folder, "conversations").select("conv_id", "turn", T.drop_filler_sounds(said).alias("tidied"))


def speech_cleanup(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of a line with a link, an address, a citation mark and a tag around its words."""
    first = F.regexp_extract("text", r"^([\p{L}]+)", 1)
    line = F.concat(F.lit("> See [the "), first, F.lit(" page](docs/a.md) at https://x.org/a [12, 3] in <b>"), first, F.lit("</b> | now"))
    return table(spark, folder, "conversations").select("conv_id", "turn", T.speech_cleanup(line).alias("speech"))


def speech_cleanup_turns(spark: SparkSession, folder: str) -> DataFrame:
    """What is said of the whole text of every turn. No SQL: it has no look-ahead."""
    return table(spark, folder, "conversations").select("conv_id", "turn", T.speech_cleanup(F.col("text")).alias("speech"))


def format_detect(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown or plain, for documents as they are and with a mark added by the remainder of their id."""
    marks = F.element_at(F.array(F.lit(""), F.lit("# Title\n"), F.lit("> quoted\n"), F.lit("a **bold** b\n"), F.lit("# lower\n"), F.lit("```\ncode\n```\n")), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, folder, "documents").select("doc_id", T.markdown_like(F.concat(marks, F.regexp_replace("text", r"[*`>#|_\[\]-]", ""))).alias("markdown"))


def plain_heading_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that could be headings in plain text: short, without a final stop, followed by a longer line."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    near = lines.select("doc_id", "pos", "line", F.lead("line").over(w).alias("below"))
    fine = (F.length("line").between(1, 60)) & ~F.col("line").rlike(r"[.!?:;,]$") & (F.length("below") > F.length("line"))
    return near.where(fine).groupBy("doc_id").agg(F.count("*").alias("candidates"), F.min("pos").cast("long").alias("first_line"))


def plain_hard_wraps(spark: SparkSession, folder: str) -> DataFrame:
    """Lines joined to the one before where they start in lower case (gaps and islands over lines)."""
    lines = table(spark, folder, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = lines.withColumn("fresh", (~F.col("line").rlike("^[a-z]")).cast("long")).withColumn("block", F.sum("fresh").over(w))
    blocks = starts.groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("chars"))
    return blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.max("n_lines").alias("most_lines"), F.max("chars").cast("long").alias("longest"))


def lookahead_window(spark: SparkSession, folder: str) -> DataFrame:
    """For each document the sentences that must be ready: from the first until 25 seconds, and two at least."""
    rows = table(spark, folder, "documents").select("doc_id", F.posexplode(T.sentences(T.clean(F.col("text")))).alias("pos", "s"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum(F.length("s")).over(w), F.lit(0)))
    return rows.where((F.col("before") < 25 * 15) | (F.col("pos") < 2)).groupBy("doc_id").agg(F.count("*").alias("ahead"), F.sum(F.length("s")).cast("long").alias("chars"))


def open_tail(spark: SparkSession, folder: str) -> DataFrame:
    """Settled and open text of the growing transcript of a conversation: the last two sentences of at most 50 words stay
    open."""
    rows = table(spark, folder, "conversations").select("conv_id", "turn", T.sentences(T.clean(F.col("text"))).alias("s"))
    n = F.size("s")
    tail2 = F.array_join(F.slice("s", F.greatest(n - 1, F.lit(1)), F.lit(2)), " ")
    tail1 = F.array_join(F.slice("s", F.greatest(n, F.lit(1)), F.lit(1)), " ")
    opened = F.when(F.size(F.split(tail2, r"\s+")) <= 50, F.least(n, F.lit(2))).when(F.size(F.split(tail1, r"\s+")) <= 50, F.least(n, F.lit(1))).otherwise(F.lit(0))
    rows = rows.withColumn("n_open", opened).withColumn("n_settled", n - F.col("n_open"))
    return rows.select("conv_id", "turn", F.col("n_open").cast("long").alias("n_open"), F.col("n_settled").cast("long").alias("n_settled"))


def neighbour_context(spark: SparkSession, folder: str) -> DataFrame:
    """Context of each turn: itself and up to four neighbours each way."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(-4, 4)
    return table(spark, folder, "conversations").select("conv_id", "turn", F.sum(F.length("text")).over(w).cast("long").alias("context_chars"), F.count("*").over(w).alias("context_turns"))


QUERIES = {
    f.__name__: f
    for f in (flagship_sentences, clean_documents, readable_share_by_lang, shouted_sentences, tidy_words, filler_drop, speech_cleanup, speech_cleanup_turns, format_detect, plain_heading_candidates, plain_hard_wraps, lookahead_window, open_tail, neighbour_context)
}

ORACLES = {
    "flagship_sentences": rf"""WITH s AS (SELECT lang, source, unnest({_SENTENCES}) AS s FROM documents)
SELECT lang, source, count(*) AS sentences, CAST(sum(CASE WHEN len(regexp_extract_all(s, '\p{{L}}')) = 0 OR 2 * len(regexp_extract_all(s, '\p{{Latin}}')) >= len(regexp_extract_all(s, '\p{{L}}')) THEN 1 ELSE 0 END) AS BIGINT) AS readable,
CAST(sum(len(string_split(s, ' '))) AS BIGINT) AS words, CAST(max(length(s)) AS BIGINT) AS longest
FROM s WHERE regexp_matches(s, '[\p{{L}}\p{{M}}\p{{N}}]') GROUP BY lang, source""",
    "clean_documents": f"WITH c AS (SELECT doc_id, {_CLEAN} AS t FROM documents) SELECT doc_id, CAST(length(t) AS BIGINT) AS n, CAST(len(string_split(t, chr(10))) AS BIGINT) AS n_lines, md5(t) AS clean_md5 FROM c",
    "readable_share_by_lang": r"""WITH c AS (SELECT lang, len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '\p{Latin}')) AS latin FROM documents)
SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN letters = 0 OR 2 * latin >= letters THEN 1 ELSE 0 END) AS BIGINT) AS readable, CAST(sum(letters) AS BIGINT) AS letters, CAST(sum(latin) AS BIGINT) AS latin FROM c GROUP BY lang""",
    "shouted_sentences": rf"""WITH s AS (SELECT doc_id, {_SENTENCES} AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS pos FROM s)
SELECT doc_id, count(*) AS n, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(length(s)) AS BIGINT) AS longest FROM e WHERE len(regexp_extract_all(s, '\p{{Lu}}{{2,}}')) >= 2 AND NOT regexp_matches(s, '\p{{Ll}}') GROUP BY doc_id""",
    "tidy_words": r"""WITH w AS (SELECT conv_id, turn, list_filter(list_transform(regexp_split_to_array(replace(lower(text), '’', ''''), '[^\p{L}\p{M}\p{N}'']+'), lambda x: trim(x, '''')), lambda x: x <> '') AS w FROM conversations)
SELECT conv_id, turn, CAST(len(w) AS BIGINT) AS n_words, array_to_string(w, ' ') AS words FROM w""",
    "filler_drop": r"""SELECT conv_id, turn, trim('so ' || regexp_replace(text, '\n', ' ', 'g') || ' Mm-hmm uh-huh and umbrella ') AS tidied FROM conversations""",
    "speech_cleanup": r"""WITH f AS (SELECT conv_id, turn, regexp_extract(text, '^(\p{L}+)', 1) AS w FROM conversations)
SELECT conv_id, turn, trim(regexp_replace('See the ' || w || ' page at link in ' || w || ' now', '\s+', ' ', 'g')) AS speech FROM f""",
    "format_detect": "SELECT doc_id, doc_id % 6 IN (1, 2, 3, 5) AS markdown FROM documents",
    "plain_heading_candidates": r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM s),
n AS (SELECT doc_id, pos, line, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS below FROM e)
SELECT doc_id, count(*) AS candidates, CAST(min(pos) AS BIGINT) AS first_line FROM n WHERE length(line) BETWEEN 1 AND 60 AND NOT regexp_matches(line, '[.!?:;,]$') AND length(below) > length(line) GROUP BY doc_id""",
    "plain_hard_wraps": r"""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM s),
n AS (SELECT doc_id, line, sum(CASE WHEN regexp_matches(line, '^[a-z]') THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS block FROM e),
b AS (SELECT doc_id, block, count(*) AS n_lines, sum(length(line)) AS chars FROM n GROUP BY ALL)
SELECT doc_id, count(*) AS blocks, max(n_lines) AS most_lines, CAST(max(chars) AS BIGINT) AS longest FROM b GROUP BY doc_id""",
    "lookahead_window": rf"""WITH s AS (SELECT doc_id, {_SENTENCES} AS a FROM documents), e AS (SELECT doc_id, unnest(a) AS s, unnest(range(len(a))) AS pos FROM s),
n AS (SELECT doc_id, pos, length(s) AS n, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT doc_id, count(*) AS ahead, CAST(sum(n) AS BIGINT) AS chars FROM n WHERE before < 375 OR pos < 2 GROUP BY doc_id""",
    "open_tail": rf"""WITH s AS (SELECT conv_id, turn, {_SENTENCES} AS a FROM conversations),
t AS (SELECT conv_id, turn, len(a) AS n, len(regexp_split_to_array(array_to_string(a[greatest(len(a) - 1, 1):greatest(len(a), 1)], ' '), '\s+')) AS two, len(regexp_split_to_array(array_to_string(a[greatest(len(a), 1):greatest(len(a), 1)], ' '), '\s+')) AS one FROM s),
o AS (SELECT *, CASE WHEN two <= 50 THEN least(n, 2) WHEN one <= 50 THEN least(n, 1) ELSE 0 END AS k FROM t)
SELECT conv_id, turn, CAST(k AS BIGINT) AS n_open, CAST(n - k AS BIGINT) AS n_settled FROM o""",
    "neighbour_context": """SELECT conv_id, turn, CAST(sum(length(text)) OVER w AS BIGINT) AS context_chars, count(*) OVER w AS context_turns FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)""",
}
