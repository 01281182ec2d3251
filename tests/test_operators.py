"""Operators on small cases of their own."""

import json
import re
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from lectern.functions import numbers as N
from lectern.functions import text as T
from lectern.operators import names, normalize, speech, structure
from lectern.plans import blocks, readings, rules, texts
from lectern.sources import lexicons, registers, workbooks
from lectern.streaming import sessions


def test_rule_order_is_kept():
    order = [r.name for r in normalize.RULES]
    assert order.index("money range") < order.index("money") < order.index("number range")
    assert order.index("time range") < order.index("clock") < order.index("ratio")
    assert order.index("label before a number") < order.index("number range")


@pytest.mark.parametrize("text", ["", "Plain words only.", "version 1.2.3", "a-b", "He said no. Then left.", "iPhone and eBay", "AT&T"])
def test_rules_leave_alone(text):
    assert normalize.normalise(text) == text


def test_null_text_stays_null(spark):
    assert spark.range(1).select(normalize.normalised(F.lit(None).cast("string")).alias("x")).first()["x"] is None


@pytest.mark.parametrize(("n", "words"), [(0, "zero"), (19, "nineteen"), (42, "forty two"), (105, "one hundred five"), (1_000_001, "one million one")])
def test_number_words(n, words):
    assert normalize.number_words(n) == words


@pytest.mark.parametrize(("text", "value"), [("IV", 4), ("MCMXCIX", 1999), ("IIII", None), ("VX", None), ("", None)])
def test_roman(text, value):
    assert normalize.roman_number(text) == value


def test_roman_columns_beyond_3999_have_no_numeral(spark):
    rows = spark.createDataFrame([(3995,), (3999,), (4000,), (0,), (-7,), (None,)], "n long")
    found = rows.select(N.roman(F.col("n")).alias("r"), N.roman_value(F.concat(N.roman(F.col("n")), F.lit("IIII"))).alias("misspelt")).collect()
    assert [tuple(r) for r in found] == [("MMMCMXCV", None), ("MMMCMXCIX", None), *[(None, None)] * 4]
    assert spark.range(1).select(N.roman_value(F.lit("MMMMMMMMMMMI")).alias("v")).first()["v"] is None


def test_html_blocks():
    source = "<h2>T</h2><p>a <b>b</b><br><br>c</p><ul><li>x<ol start=3><li>y</ol></ul><blockquote><p>q</blockquote><pre>l1\nl2</pre><table><tr><th>h</th><th>i</th></tr><tr><td>1<td>2</tr></table><hr><script>no</script><img alt='A cat'>"
    found = [(b.kind, b.text, b.level, b.number, b.depth, b.quote) for b in structure.html_blocks(source)]
    assert found == [
        ("heading", "T", 2, None, None, 0), ("paragraph", "a b", None, None, None, 0), ("paragraph", "c", None, None, None, 0), ("item", "x", None, None, 0, 0), ("item", "y", None, 3, 1, 0),
        ("paragraph", "q", None, None, None, 1), ("code", "l1\nl2", None, None, None, 0), ("row", "h | i", None, None, None, 0), ("row", "1 | 2", None, None, None, 0), ("rule", "", None, None, None, 0), ("paragraph", "A cat", None, None, None, 0),
    ]


def test_money_readings_round_as_their_sql(spark, tmp_path):
    prices = [10050.0, 12650.0, 84150.0, 904.0, 1000.0, 999.995, 100.01, 50.0, 149.99, 10000.0, 2_350_000.5, 0.005, 0.0, -525.25, None]
    cells = [(i, 1, p, d, t) for i, (p, (d, t)) in enumerate((p, s) for p in prices for s in ((0.1, 0.05), (0.0, 0.0), (1.0, 0.005), (0.29, 0.0), (0.01, None)))]
    spark.createDataFrame(cells, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    found = readings.QUERIES["money_readings"](spark, str(tmp_path)).orderBy("l_orderkey").collect()
    assert [tuple(r) for r in found] == duck.execute(f"SELECT * FROM ({readings.ORACLES['money_readings']}) ORDER BY l_orderkey").fetchall()


@pytest.mark.parametrize("title", ["A&amp;&amp; b&amp", "A&am", "a & b", "x&copy y", "&amp;amp", "say &quot;A&quot", "&amp;&"])
def test_html_headings_keep_references_without_semicolon(spark, tmp_path, title):
    page = f'<nav><a href="?a=1&copy=2">n</a></nav><h1>{title}</h1><p>x &amp y'
    spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert [tuple(r) for r in blocks.QUERIES["html_headings"](spark, str(tmp_path)).collect()] == duck.execute(blocks.ORACLES["html_headings"]).fetchall()


def test_markdown_blocks():
    source = "---\nt: 1\n---\n# A\n\ntext *it*\nmore\n\n- one\n  two\n1. n\n\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```\ncode\n```\nTitle\n===\n"
    assert [(b.kind, b.text) for b in structure.markdown_blocks(source)] == [
        ("heading", "A"), ("paragraph", "text it more"), ("item", "one two"), ("item", "n"), ("paragraph", "q"), ("row", "a | b"), ("row", "1 | 2"), ("code", "code"), ("heading", "Title"),
    ]


def test_plain_blocks():
    source = "Heading\nA longer line of text that\nwraps here.\n\n- one\n    - two\na\tb\nc\td"
    assert [(b.kind, b.depth) for b in structure.plain_blocks(source)] == [("heading", None), ("paragraph", None), ("item", 0), ("item", 1), ("row", None), ("row", None)]


def test_lcs():
    assert speech.lcs("a b c d".split(), "b x d".split()) == 2
    assert speech.lcs([], ["a"]) == 0


def test_long_split_loses_nothing():
    text = "word, " * 200
    parts = speech.long_split(text)
    assert max(map(len, parts)) <= 280
    assert "".join(parts).replace(" ", "") == text.replace(" ", "")


def test_clean(spark):
    row = spark.createDataFrame([("a b\r\nC  d\ne\n\n\n\nf​ ",)], "t string").select(T.clean(F.col("t")).alias("c")).first()
    assert row["c"] == "a b\nC d e\n\nf"


def test_valid_names(spark):
    rows = spark.createDataFrame([("Ann",), ("O'Hara",), ("-x",), ("a",), ("unknown",), ("A B C D",), ("Zoë",), ("R2",)], "n string")
    assert [r["n"] for r in rows.where(names.valid_name(F.col("n"))).collect()] == ["Ann", "O'Hara", "Zoë"]


def test_sessions_lose_no_sample():
    samples = [((i * 7) % 11) / 10 for i in range(500)]
    buffer, pieces = [], []
    for i, x in enumerate(samples):
        done, buffer = sessions.cut_session([*buffer, x], i == len(samples) - 1)
        pieces += done
    assert [x for p in pieces for x in p] == samples
    assert not buffer
    assert max(map(len, pieces)) <= sessions.MOST


def test_split_off():
    assert sessions.split_off("One. Two. Three.") == ("One.", "Two. Three.")
    assert sessions.split_off("w " * 60) == (("w " * 60), "")


def test_lexicon_folder(spark, tmp_path):
    (tmp_path / "tech-lexicon.json").write_text(json.dumps([{"word": "nginx", "us": "x", "spoken": ["engine x"]}, {"word": "", "us": "y", "dictation": "often"}]))
    (tmp_path / "names.json").write_text(json.dumps({"entries": [{"word": "Ann", "us": "z", "extra": 1}]}))
    (tmp_path / "heteronyms.json").write_text("{}")
    rows = {r["word"]: r for r in lexicons.read_lexicons(spark, str(tmp_path)).collect()}
    assert rows["nginx"]["pack"] == "tech" and rows["nginx"]["dictation"] == "context"
    assert rows[""]["problems"] == ["no word", "unknown dictation often"] and rows[""]["dictation"] == "never"
    assert rows["Ann"]["pack"] == "names"


def test_yearly_files(spark, tmp_path):
    (tmp_path / "yob1924.txt").write_text("Old,F,5\n")
    (tmp_path / "yob2000.txt").write_text("Ann,F,7\nBad,F,\n")
    assert [(r["form"], r["n"], r["year"]) for r in registers.read_yearly(spark, str(tmp_path)).collect()] == [("Ann", 7, 2000)]


def test_cube(spark, tmp_path):
    cube = {"id": ["name", "year"], "size": [2, 2], "value": [1, 2, None, 4], "labels": {"name": ["Ann", "Ben"], "year": ["2001", "2002"]}}
    (tmp_path / "c.json").write_text(json.dumps(cube))
    assert {(r["key"], r["value"]) for r in registers.read_cube(spark, str(tmp_path / "c.json")).collect()} == {("Ann|2001", 1.0), ("Ann|2002", 2.0), ("Ben|2002", 4.0)}
    assert {r["key"] for r in registers.read_cube(spark, str(tmp_path / "c.json"), "year").collect()} == {"Ann|2002", "Ben|2002"}


def test_word_frequencies(spark, tmp_path):
    packed = bytes([0x93, 0x81, 0xA1]) + b"f" + bytes([0xA1]) + b"c" + bytes([0x91, 0xA3]) + b"the" + bytes([0x92, 0xA3]) + b"the" + bytes([0xA1]) + b"a"
    (tmp_path / "w.bin").write_bytes(packed)
    assert {(r["word"], r["zipf"]) for r in registers.read_word_frequencies(spark, str(tmp_path / "w.bin")).collect()} == {("the", 9.0), ("a", 8.99)}


def test_ledger_round_trip(spark, tmp_path):
    registers.write_ledger(spark.createDataFrame([("x", "s", "s"), ("y", "s", "t")], "n string, us string, gb string"), str(tmp_path / "l"), ("us", "gb"))
    assert {(r["n"], r["gb"]) for r in registers.read_ledger(spark, str(tmp_path / "l")).collect()} == {("x", None), ("y", "t")}


def test_workbook(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}"><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>Name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2"><v>5</v></c></row></sheetData></worksheet>')
    assert [(r["sheet"], r["row"], r["cells"]) for r in workbooks.read_workbooks(spark, str(tmp_path)).collect()] == [("S", 2, ["Name", None, "5"])]


def test_workbook_follows_relationships(spark, tmp_path):
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = '<worksheet xmlns="{}"><sheetData><row r="1"><c r="AB1" t="inlineStr"><is><t>{}</t></is></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{r}"><sheets><sheet name="One" r:id="b"/><sheet name="Two" r:id="a"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", sheet.format(ns, "second"))
        z.writestr("xl/worksheets/sheet2.xml", sheet.format(ns, "first"))
    rows = workbooks.read_workbooks(spark, str(tmp_path)).collect()
    assert [(x["sheet"], len(x["cells"]), x["cells"][-1]) for x in rows] == [("One", 28, "first"), ("Two", 28, "second")]
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", "<?xml version='1.0'?>" + " " * 5000 + "<!DOCTYPE x [<!ENTITY e 'x'>]><workbook/>")
    with pytest.raises(ValueError, match="refused"):
        list(workbooks.workbook_rows((tmp_path / "c.xlsx").read_bytes()))


def test_text_after_a_skipped_element_stays():
    found = structure.html_blocks("<nav><ul><li>Home<li>About</ul></nav><h1>T</h1><p>All this text</p><select><option>a<option>b</select>more")
    assert [b.text for b in found] == ["T", "All this text", "more"]


@pytest.mark.parametrize("text", ["I want to, to be honest", "neither do I, I think", "listen to To Kill", "he had had it", "that that"])
def test_doubles_that_are_no_stammer(text):
    assert speech.drop_stammers(text) == text


@pytest.mark.parametrize(("text", "once"), [("it's it's fine", "it's fine"), ("The the end", "The end"), ("a, a and and, and b", "a and b"), ("I I go", "I go"), ("to to go", "to go")])
def test_stammers(text, once):
    assert speech.drop_stammers(text) == once


def test_digit_shortcut_changes_no_result():
    cases = [t for t, _, _ in rules.CASES] + ["He lives in Boston, MA with us", "Boston, MA 02134", "Austin, TX"]
    for text in {c for t in cases for c in (re.sub(r"\d", "", t), re.sub(r"\d+ ?", "", t), re.sub(r"\d", "x", t))}:
        whole = text
        for r in normalize.RULES:
            source = whole
            whole = r.pattern.sub(lambda m, r=r, source=source: m[0] if (out := r.read(m, source, "us")) is None else out, source)
        assert normalize._apply(text, "us") == whole
    assert normalize.normalise("He lives in Boston, MA with us") == "He lives in Boston, Massachusetts with us"


def test_rules_that_need_a_digit_have_one():
    assert normalize.NEED_DIGIT <= {r.name for r in normalize.RULES}
    assert not any(r.needs_digit for r in normalize.RULES if "\\d" not in r.pattern.pattern)


def test_whole_turns_are_tidied(spark, tmp_path):
    filler = "plain words " * 60
    turns = [
        (1, 0, f"{filler}and and the, the end had had it", f"{filler}and the end had had it"),
        (1, 1, f"First\nto to go {filler}I I", f"First\nto go {filler}I"),
        (2, 0, "", ""),
        (2, 1, None, None),
    ]
    spark.createDataFrame([t[:3] for t in turns], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r["conv_id"], r["turn"], r["tidied"]) for r in blocks.stammers_turns(spark, str(tmp_path)).collect()) == [(c, t, x) for c, t, _, x in turns]


def test_whole_turns_are_cleaned_for_speech(spark, tmp_path):
    filler = "plain words " * 60
    turns = [
        (1, 0, f"{filler}see [the\npage](docs/a.md) at https://x.org/a [1, 2] <b>now</b>", f"{filler}see the page at link now"),
        (1, 1, f"First\n> quoted\n > > twice a > b {filler}`code`", f"First quoted twice a > b {filler}code"),
        (2, 0, "", ""),
        (2, 1, None, None),
    ]
    spark.createDataFrame([t[:3] for t in turns], "conv_id long, turn long, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sorted((r["conv_id"], r["turn"], r["speech"]) for r in texts.speech_cleanup_turns(spark, str(tmp_path)).collect()) == [(c, t, x) for c, t, _, x in turns]
