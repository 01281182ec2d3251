"""Cleaning, words and character tests as Spark column expressions. All of them stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are trimmed from both ends of a text. Fixed values.
_EDGES = r"[\s\x{85}\x{a0}\x{2028}\x{2029}\x{3000}]+"


def chain(text: Column, *steps: tuple[str, str]) -> Column:
    """Regular-expression replacements one after another."""
    for pattern, by in steps:
        text = F.regexp_replace(text, pattern, by)
    return text


def trim_all(text: Column) -> Column:
    return chain(text, (f"^{_EDGES}", ""), (f"{_EDGES}$", ""))


def normalize_characters(text: Column) -> Column:
    """One kind of line end, plain spaces, and no soft hyphens, byte-order marks or zero-width spaces."""
    return F.translate(chain(text, (r"\r\n?", "\n")), " ­﻿​", " ")


def line_separators(text: Column) -> Column:
    """normalize_characters, and Unicode's own line ends as line feeds too."""
    return chain(normalize_characters(text), (r"[\x{2028}\x{2029}\x{85}]", "\n"))


def clean(text: Column) -> Column:
    """Copied text with blanks collapsed, hard-wrapped lines joined and at most one empty line in a row.

    The lines are laid side by side with the ones before them, and each says what stands between the two: a blank where
    it goes on in lower case, nothing where both are empty, else a line end."""
    lines = F.transform(F.split(normalize_characters(text), "\n"), lambda line: F.trim(F.regexp_replace(line, r"[ \t]+", " ")))
    before = F.concat(F.array(F.lit(None).cast("string")), lines)

    def laid(line: Column, above: Column) -> Column:
        goes_on = (above != "") & line.substr(1, 1).between("a", "z")
        between = F.when(above.isNull() | ((above == "") & (line == "")), "").when(goes_on, " ").otherwise("\n")
        return F.concat(between, line)

    return trim_all(F.array_join(F.zip_with(lines, before, laid), ""))


def has_words(text: Column) -> Column:
    return text.rlike(r"[\p{L}\p{M}\p{N}]")


def can_read(text: Column) -> Column:
    """Whether at least half of the letters are Latin, or there is none."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (letters == 0) | (F.regexp_count(text, F.lit(r"\p{IsLatin}")) * 2 >= letters)


def sentences(text: Column) -> Column:
    """The sentences: cut after ., ! or ? (with closing quotes or brackets) before white space, and at line ends."""
    marked = chain(text, (r"([.!?…][\"'”’)\]]*)\s+", "$1\n"))
    return F.filter(F.transform(F.split(marked, r"\n+"), lambda s: F.trim(s)), lambda s: s != "")


#: Elements of formatting inside a line, which are silent. Fixed values.
INLINE_TAGS = ("b", "code", "del", "em", "i", "ins", "kbd", "mark", "s", "small", "span", "strike", "strong", "sub", "sup", "u")
#: Signs of lists and code, which are silent. Fixed values.
SILENT_SIGNS = "`|•▪●◦"
#: What a link's target looks like where it is a pronunciation: between slashes, with a sign that isn't ASCII.
_PRONUNCIATION = r"/[^/)]*[^\p{ASCII}][^/)]*/"


def speech_cleanup(text: Column) -> Column:
    """What is said of whole lines of text: labels of links, "link" for addresses, no citation marks, formatting
    tags, quote marks, bullets or code marks."""
    labels = F.regexp_replace(text, rf"!?\[([^\]]*)\]\((?!{_PRONUNCIATION}\))[^)]*\)", "$1")
    addresses = F.regexp_replace(labels, r"https?://\S+", "link")
    tags = rf"</?(?:{'|'.join(INLINE_TAGS)})\s*>|<br\s*/?>"
    silent = F.regexp_replace(addresses, rf"(?i){tags}|\[\d+(?:,\s*\d+)*\]", "")
    unquoted = F.regexp_replace(silent, r"(?m)^(?:\s*>)+", " ")
    return F.trim(F.regexp_replace(F.translate(unquoted, SILENT_SIGNS, " " * len(SILENT_SIGNS)), r"\s+", " "))


def words(text: Column) -> Column:
    """Lower-case words without punctuation; an apostrophe belongs to a word, but not at its edges."""
    parts = F.split(F.translate(F.lower(text), "’", "'"), r"[^\p{L}\p{M}\p{N}']+")
    return F.filter(F.transform(parts, lambda w: F.btrim(w, F.lit("'"))), lambda w: w != "")


#: Sounds of hesitation, a + after a letter that may be drawn out. Fixed values.
FILLER_SOUNDS = ("um+", "uh+", "erm", "hmm+")


def drop_filler_sounds(text: Column) -> Column:
    """Without um, uh, erm and hmm as words of their own (all lower case, or with a capital), and the comma or full stop
    after them; a hyphen makes them part of a longer word."""
    part = r"[\p{L}\p{M}\p{N}_]"
    sounds = "|".join(f"[{s[0].upper()}{s[0]}]{s[1:]}" for s in FILLER_SOUNDS)
    alone = rf"(?<!{part}|-)(?:{sounds})(?!-?{part})"
    return trim_all(F.regexp_replace(text, rf"{alone}[,.]?\s*", ""))


def currency_glue(text: Column) -> Column:
    """spend$100 as spend $100."""
    return chain(text, (r"(\p{L})([$£€]\d)", "$1 $2"))


def micro_sign(text: Column) -> Column:
    """A micro sign alone is read as micro; in a unit it becomes the Greek letter."""
    letter = r"[\p{L}\p{M}\p{N}]"
    return F.translate(chain(text, (rf"(?<!{letter})µ(?!{letter})", "micro")), "µ", "μ")


def quarter_split(text: Column) -> Column:
    return chain(text, (r"\b([QH][1-4])['’](\d\d)\b", "$1 '$2"))


def shouted(sentence: Column) -> Column:
    """At least two words of two or more capitals, and no lower-case letter."""
    return (F.regexp_count(sentence, F.lit(r"\p{Lu}{2,}")) >= 2) & ~sentence.rlike(r"\p{Ll}")


def markdown_like(text: Column) -> Column:
    """Whether a text looks like Markdown: a fence, a mark inside a line, a quote, a rule alone, a table or a heading."""
    signs = (
        r"(?m)^ {0,3}(```|~~~)",
        r"\*\*\S[^*\n]*\*\*|!?\[[^\]\n]+\]\([^)\n]+\)|`[^`\n]+`",
        r"(?m)^ {0,3}> ?\S",
        r"(?:^|\n\n) {0,3}(?:-{3,}|\*{3,}|_{3,}) *(?:\n\n|$)",
        r"\|[^\n]*\n *\|? *:?-{3,}:? *(\| *:?-{3,}:? *)+\|? *(\n|$)",
        r"(?m)^#{1,6} +[^a-z\s]",
    )
    found = text.rlike(signs[0])
    for s in signs[1:]:
        found = found | text.rlike(s)
    return found
