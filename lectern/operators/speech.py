"""Pronunciation mechanics over supplied dictionaries, heteronyms, chunks for a voice, and checks of tidied text."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vowel symbols and those that end in a hiss. Fixed values.
VOWELS, HISS, VOICELESS = "aeiouæɑɔəɛɜɪʊʌᵻAIOWY", "szʃʒʧʤ", "ptkfθ"


def tokens(text: Column) -> Column:
    """Words (with inner apostrophes and hyphens), numbers and punctuation marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"\p{L}+(?:['’-]\p{L}+)*|\d+(?:[.,]\d+)*|[^\s\p{L}\d]"), F.lit(0))


def add_s(phonemes: Column) -> Column:
    last = F.substring(phonemes, -1, 1)
    return F.when(last.isin(*HISS), F.concat(phonemes, F.lit("ᵻz"))).when(last.isin(*VOICELESS), F.concat(phonemes, F.lit("s"))).otherwise(F.concat(phonemes, F.lit("z")))


def add_ed(phonemes: Column) -> Column:
    last = F.substring(phonemes, -1, 1)
    return F.when(last.isin("t", "d"), F.concat(phonemes, F.lit("ᵻd"))).when(last.isin(*VOICELESS, "s", "ʃ", "ʧ"), F.concat(phonemes, F.lit("t"))).otherwise(F.concat(phonemes, F.lit("d")))


def apply_stress(phonemes: Column, stress: Column) -> Column:
    """Below -1: no stress; -1, or 0 with a main stress: main becomes secondary; 0 to 1 without any: secondary before the
    first vowel; from 1 on secondary becomes main where there is no main; above 1 without any: main before the first
    vowel. A null stress, and a word without a vowel that would get one, stay."""
    first = rf"^([^{VOWELS}]*)([{VOWELS}])"
    main, any_mark = phonemes.contains("ˈ"), phonemes.rlike("[ˈˌ]")
    demoted = F.translate(F.translate(phonemes, "ˌ", ""), "ˈ", "ˌ")
    return (
        F.when(stress < -1, F.translate(phonemes, "ˈˌ", ""))
        .when((stress == -1) | (stress.isin(0, -0.5) & main), demoted)
        .when(stress.isin(0, 0.5, 1) & ~any_mark, F.regexp_replace(phonemes, first, "$1ˌ$2"))
        .when((stress >= 1) & ~main & any_mark, F.translate(phonemes, "ˌ", "ˈ"))
        .when((stress > 1) & ~any_mark, F.regexp_replace(phonemes, first, "$1ˈ$2"))
        .otherwise(phonemes)
    )


def pronounce(words: DataFrame, gold: DataFrame, fallback: DataFrame) -> DataFrame:
    """Distinct words (word) with phonemes and where they come from: gold dictionary (word, phonemes), its stems with -s,
    -ed and -ing, the fallback dictionary, or none. Every step is a join on the word, so no word is looked up twice."""
    w = words.select(F.lower("word").alias("word")).distinct()
    known = gold.select(F.lower("word").alias("k"), F.col("phonemes").alias("p"))
    stems = w.select("word", F.explode(F.array_compact(F.array(
        F.struct(F.lit(0).alias("r"), F.col("word").alias("stem"), F.lit("").alias("how")),
        F.when(F.col("word").rlike("[^s]s$"), F.struct(F.lit(1).alias("r"), F.regexp_replace("word", "s$", "").alias("stem"), F.lit("s").alias("how"))),
        F.when(F.col("word").rlike("es$"), F.struct(F.lit(2).alias("r"), F.regexp_replace("word", "es$", "").alias("stem"), F.lit("s").alias("how"))),
        F.when(F.col("word").rlike("..ed$"), F.struct(F.lit(3).alias("r"), F.regexp_replace("word", "ed$", "").alias("stem"), F.lit("ed").alias("how"))),
        F.when(F.col("word").rlike("..ing$"), F.struct(F.lit(4).alias("r"), F.regexp_replace("word", "ing$", "").alias("stem"), F.lit("ing").alias("how"))),
    ))).alias("s")).select("word", "s.*")
    said = F.when(F.col("how") == "s", add_s(F.col("p"))).when(F.col("how") == "ed", add_ed(F.col("p"))).when(F.col("how") == "ing", F.concat("p", F.lit("ɪŋ"))).otherwise(F.col("p"))
    best = stems.join(known, F.col("stem") == F.col("k")).groupBy("word").agg(F.min_by(F.struct(said.alias("phonemes"), F.when(F.col("how") == "", "gold").otherwise("stem").alias("source")), "r").alias("g"))
    other = fallback.select(F.lower("word").alias("word"), F.col("phonemes").alias("f"))
    joined = w.join(best, "word", "left").join(other, "word", "left")
    return joined.select("word", F.coalesce("g.phonemes", "f").alias("phonemes"), F.when(F.col("g").isNotNull(), F.col("g.source")).when(F.col("f").isNotNull(), "fallback").otherwise("none").alias("source"))


def us_to_gb(phonemes: Column) -> Column:
    """The rhotic vowels of a US reading as a British one has them."""
    out = phonemes
    for a, b in (("ɑɹ", "ɑː"), ("ɔɹ", "ɔː"), ("ɜɹ", "ɜː"), ("əɹ", "ə"), ("ɾ", "t"), ("O", "Q"), ("æ", "a")):
        out = F.regexp_replace(out, a, b)
    return out


def vowel_ahead(words: DataFrame) -> DataFrame:
    """Whether the next word that has letters begins with a vowel letter: true, false, or null at the end. As-of the
    nearest following row, by one window."""
    after = Window.partitionBy("doc_id").orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    begins = F.when(F.col("word").rlike(r"\p{L}"), F.lower(F.substring("word", 1, 1)).isin(*"aeiou"))
    return words.withColumn("vowel_ahead", F.first(begins, ignorenulls=True).over(after))


def pin(occurrences: DataFrame, picks: DataFrame) -> DataFrame:
    """The k-th occurrence of a word (doc_id, word, i) joined with the k-th pick (doc_id, word, k, reading, confidence);
    a pick counts from a confidence of 0.7 on."""
    k = F.row_number().over(Window.partitionBy("doc_id", "word").orderBy("i"))
    joined = occurrences.withColumn("k", k).join(picks, ["doc_id", "word", "k"], "left")
    return joined.withColumn("pinned", F.when(F.col("confidence") >= 0.7, F.col("reading")))


def lcs(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, one bit-parallel step for each word of b."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & places.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def faithful(said: Column, back: Column) -> Column:
    """Whether what came back only leaves words out: at most max(2, 5 %) added, and 60 % kept of eight words or more."""

    @F.arrow_udf("boolean")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True):
            a, b = a or [], b or []
            if not b:
                out.append(len(a) < 3)
                continue
            out.append(len(b) - lcs(a, b) <= max(2, len(b) // 20) and (len(a) < 8 or len(b) >= 0.6 * len(a)))
        return pa.array(out, pa.bool_())

    return run(said, back)


def long_split(sentence: str, most: int = 280) -> list[str]:
    """Pieces of at most `most` characters, cut in the second half of the window at the best mark, else at a space."""
    out, at = [], 0
    while len(sentence) - at > most:
        window = sentence[at + most // 2 : at + most]
        cut = next((at + most // 2 + window.rfind(m) + len(m) for m in ("; ", ": ", " — ", " – ", ", ", " ") if m in window), at + most)
        out.append(sentence[at:cut])
        at = cut
    return [p for p in (*map(str.strip, out), sentence[at:].strip()) if p]


#: Words that grammar never doubles, and those of them that may end one clause and begin the next. Fixed values.
STAMMERED, CLAUSE_EDGES = frozenset("the a an and but i to".split()), frozenset(("i", "to"))
_DOUBLE = re.compile(r"(?<![\w'’])(\w+(?:['’]\w+)?)((?:,? +(?i:\1)(?![\w'’]))+)")


def drop_stammers(text: str) -> str:
    """Runs of a word that is never doubled in grammar, or of a contraction, as one.

    A comma between "I" or "to" and its repeat parts two clauses, and a repeat with a capital of its own begins a name;
    both stay. A capital at the first of a run is that of a sentence."""

    def once(m: re.Match) -> str:
        word, repeats = m[1], re.findall(r"[^\s,]+", m[2])
        low = word.lower()
        if low not in STAMMERED and not ("'" in word or "’" in word):
            return m[0]
        if low in CLAUSE_EDGES and "," in m[2]:
            return m[0]
        if any(r not in (word, low) for r in repeats):
            return m[0]
        return word

    return _DOUBLE.sub(once, text)


def chunks(sentences: Column) -> Column:
    """Sentences cut into chunks for a voice (array of strings)."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([[p for s in (row or []) for p in long_split(s)] for row in column.to_pylist()], pa.list_(pa.string()))

    return run(sentences)


def tidied(text: Column) -> Column:
    """Text without stammers, by one Arrow UDF."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        return pa.array([t and drop_stammers(t) for t in column.to_pylist()], pa.string())

    return run(text)
