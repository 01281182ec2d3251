"""The training-data operators against libraries, brute force and exact round trips, and on odd inputs."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.llm import arrow_files, joins, languages, licenses, neighbours, packing, pages, pieces, pseudonyms, shingles, tokens, transport
from lectern.llm.common import shared_folder
from lectern.llm.components import connected_components

LETTERS = " \n\t\r\x85\xa0 ab'sthe1é９٣*-\x1c　▁𝒳"
#: Null, empty, blank, ties, repeated rows, odd characters, and a very long text; null ids, and columns of clashing names.
ODD = [(1, None), (2, ""), (3, "  "), (4, "same words in both of these rows"), (4, "same words in both of these rows"), (5, "same words in both of these rows"), (6, "\x00 ▁ 𝒳\n\n<|endoftext|> <s>"), (7, "long words " * 20_000), (None, "no id here"), (8, "x" * 5_000)]


def texts(n, seed=0, letters=LETTERS, most=40):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd(spark):
    rows = spark.createDataFrame(ODD, "doc_id long, text string")
    return rows.select("*", F.lit("x").alias("ids"), F.lit(1).alias("node"), F.lit("en").alias("lang"), F.lit(2).alias("spans"), F.lit(0).alias("sequence_id"))


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary("byte_bpe_50k.json"))


def test_byte_bpe_is_the_library():
    t, own = library(), tokens.byte_bpe(tokens.default_vocabulary("byte_bpe_50k.json"))
    for text in [*texts(3000), *texts(500, 1, "ab \n's*1é", 400), "<|endoftext|> a", "a <|endoftext|><|endoftext|>b", "it's  don't"]:
        assert np.frombuffer(own.encode_one(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_byte_bpe_merges_new_words_together():
    t, own = library(), tokens.ByteBpe(tokens.default_vocabulary("byte_bpe_50k.json"))
    some = [*texts(2000, 11, "abenrst  é", 200), "Hend. hend&&& (b) a'c d12\nÊlevi, x\nend", "  a  b", "<|endoftext|> a b", None, "", "ß" * 32 + " " + "ñ" * 33 + " " + "xy" * 40]
    some += [" ".join(x.split()) for x in texts(2000, 12, "aeinort ,;$é'1\n", 300)]
    alone, piece = [], own._piece
    own._piece = lambda p: (alone.append(p), piece(p))[1]
    for text, ids in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text or "", add_special_tokens=False).ids
    words = [f"{a}{b}" for a in ("Hend", "lyß", "éren", "x") for b in texts(300, 14, "aeinrsté", 20)]
    assert own.encode_one("a " + " ".join(words)) == own.encode(["a " + " ".join(words)])[0]
    alone.clear()
    own.words.clear()
    own.words.old.clear()
    own.encode(["a " + ", ".join(words)])
    assert len(alone) <= 2  # not word by word


def test_byte_bpe_groups_with_full_caches(monkeypatch):
    some = [" ".join(x.split()) for x in texts(600, 13, "abé  ,.&'\n", 60)]
    t = library()
    for most, chars in ((3, 1 << 20), (40, 200), (400, 1000)):
        monkeypatch.setattr(tokens, "CACHE_WORDS", most)
        monkeypatch.setattr(tokens, "GROUP_CHARS", chars)
        own = tokens.ByteBpe(tokens.default_vocabulary("byte_bpe_50k.json"))
        for text, ids in zip([*some, *some], own.encode([*some, *some]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
        assert max(len(own.words), len(own.words.old)) <= most


def test_byte_bpe_takes_plain_words_from_its_table():
    own = tokens.ByteBpe(tokens.default_vocabulary("byte_bpe_50k.json"))
    some = [f"{a}, {b} ({c})\n12 {d}." for a, b, c, d in zip(*(iter(texts(400, 15, "aeinrstéß", 6)),) * 4, strict=True)]
    ids, merged, spans = own.encode(pa.array(some)), [], own.merges.spans
    own.merges.spans = lambda data, begins, sizes: (merged.append(len(begins)), spans(data, begins, sizes))[1]
    assert own.encode(some) == ids
    assert sum(merged) <= 4  # those that share a slot
    assert not own.words and not own.first  # no word goes through Python alone


def test_byte_bpe_cuts_odd_groups_as_the_library(monkeypatch):
    t = library()
    alphabets = ["ab  \n\n\t\r\x0b\x0c1.'", "é×÷ÿÀ \u0250\u024fab", "a\x00\x01\x1c\x1f\x7f \n'", "ab\xa0\x85\u1680\u2003\u200b\u2010\u2028\u3000 x", "日本語 abc。привет \u0301e", "µªº²¼½ a1'st've"]
    some = [x for i, a in enumerate(alphabets) for x in (*texts(300, 16 + i, a, 30), "")]
    some += ["<|endof", "text|> a", "a <|endoftext|> b", None, " " * 300 + "a", "é" * 200, "a" + "\n" * 140, " " + "b" * 15, "b" * 17]
    random.Random(16).shuffle(some)
    expected = [t.encode(x or "", add_special_tokens=False).ids for x in some]
    for slots, size in ((1 << 17, 1 << 20), (2, 300)):
        monkeypatch.setattr(tokens, "TABLE_SLOTS", slots)
        monkeypatch.setattr(tokens, "GROUP_CHARS", size)
        own = tokens.ByteBpe(tokens.default_vocabulary("byte_bpe_50k.json"))
        for given in (some, pa.array(["x", *some])[1:]):
            assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(given)] == expected


def test_merges_of_any_order_are_the_library():
    from tokenizers import models

    rng, letters = random.Random(5), tokens._byte_letters()
    for size in (0, 3, 60, 400):
        vocab, merges = {c: i for i, c in enumerate(letters.values())}, []
        known = [letters[b] for b in b" abc"]
        while len(merges) < size:
            a, b = rng.choice(known), rng.choice(known)
            if (a, b) not in merges and len(a + b) < 9:
                merges.append((a, b))
                vocab.setdefault(a + b, len(vocab))
                known.append(a + b)
        rng.shuffle(merges)  # so that a long piece may come before its parts
        model, own = models.BPE(vocab, merges), tokens.Merges(vocab, merges, letters)
        words = [w for w in set(texts(800, size, "abc", 30)) if w]
        for word, ids in zip(words, own.ids(words), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == [x.id for x in model.tokenize(letters[32] + word)]


def test_byte_bpe_with_marks_and_full_caches(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    monkeypatch.setattr(tokens, "CACHE_FIRST", 2)
    t, own = library(), tokens.ByteBpe(tokens.default_vocabulary("byte_bpe_50k.json"))
    some = ["hend, hend. hend; a, \n, b\nhend, c:", "été, naïve. ÿ; ɐbc, xɐ, 12. a.b, (a), it's, ... ,, é,", "a  b\n\n c , d .\x1c e\x85f", "x" * 70 + ", " + "é" * 70 + "; y"]
    for text in [*some, *texts(2000, 7, "ab,.;é'1 \n", 60), *some]:
        assert np.frombuffer(own.encode_one(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids
    assert max(len(own.words), len(own.words.old)) <= 3 and max(len(own.first), len(own.first.old)) <= 2


def test_pieces_are_the_library():
    import sentencepiece

    path = tokens.default_vocabulary("piece_bpe_32k.model")
    lib, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.piece_model(path)
    some = [*texts(2000, 2), *texts(300, 3, "the in aa \n", 300), "a" * 3000, "ab" * 900]
    for text, ids in zip(some, own.encode(some), strict=True):
        assert np.frombuffer(ids, "<i4").tolist() == lib.encode(text)
        assert own.decode([np.frombuffer(ids, "<i4")])[0] == lib.decode(np.frombuffer(ids, "<i4").tolist())


def test_pieces_odd_rows(odd, none):
    rows = pieces.encode_and_decode(odd).collect()
    assert len(rows) == len(ODD)
    assert {tuple(r["ids"]) for r in rows if r["doc_id"] in (1, 2)} == {(2,)}
    assert pieces.encode_and_decode(none).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = [random.Random(5).randint(1, 64) for _ in range(400)]
    spots = packing.best_fit_decreasing(lengths, 64)
    rooms = []  # brute force: of the open windows the one with least room, the latest of equals
    stack = defaultdict(list)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fit = min((r for r, w in stack.items() if w and r >= lengths[i]), default=None)
        window, room = (len(rooms), 64) if fit is None else (stack[fit].pop(), fit)
        rooms += [0] if fit is None else []
        assert spots[i] == (window, 64 - room)
        if room > lengths[i]:
            stack[room - lengths[i]].append(window)


def test_packing_keeps_every_id_once(odd, none):
    t = library()
    expected = Counter()
    for doc_id, text in ODD:
        expected[doc_id, zlib.crc32(np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4"))] += 1
    rows = packing.pack_documents(odd, capacity=64).collect()
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
        assert len(r["ids"]) == 4 * r["length"]
    for spots in by.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 64
    single = [r for r in rows if r["doc_tokens"] <= 64]
    assert {(r["doc_id"], zlib.crc32(bytes(r["ids"]))) for r in single} <= set(expected)
    assert packing.pack_documents(none).count() == 0


def test_arrow_files_round_trip(spark, odd, none):
    t, folder = library(), shared_folder(spark)
    manifest = arrow_files.write_token_files(odd, folder, length=16, shards=3)
    rows = sorted(arrow_files.read_token_files(manifest).collect(), key=lambda r: r["start"])
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    for r, (doc_id, text) in zip(rows, order, strict=True):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(ids), zlib.crc32(ids))
        at += len(ids)
    assert arrow_files.read_token_files(arrow_files.write_token_files(none, shared_folder(spark), shards=2)).count() == 0


def test_shards_of_many_batches(tmp_path):
    import pyarrow.fs

    fs, path = pyarrow.fs.LocalFileSystem(), str(tmp_path / "s.arrow")
    runs = [np.arange(n, dtype=np.uint32) % 50_000 for n in (1, 7, 60_000, 3, 25_000, 8_191)]
    writer = arrow_files.ShardWriter(fs, path, 16, 2)
    for ids in runs:
        writer.add(ids)
    assert writer.close() == sum(map(len, runs))
    reader, at = arrow_files.ShardReader(fs, path), 0
    for ids in runs:
        assert (reader.run(at, len(ids)) == ids).all()
        at += len(ids)
    ids, mask = reader.row((at - 1) // 16)
    assert mask.sum() == at % 16 or at % 16 == 0
    assert len(ids) == 16


@pytest.mark.parametrize("n", [0, 1, 100, 161, 162, 168, 169, 170, 184, 345, 354, 16_128, 16_129, 200_000])
def test_transport_round_trip(n):
    payload = random.Random(n).randbytes(n)
    media = transport.write_stream(payload)
    read = transport.parse_stream(media)
    assert len(media) % 188 == 0
    assert b"".join(s.payload for s in read.streams) == payload
    assert read.bad == 0 and not sum(read.errors.values())
    if n:
        stamps = [u[0] for u in read.streams[0].units]
        assert stamps == [k * transport.UNIT_TICKS for k in range(len(stamps))]
        assert [u[2] for u in read.streams[0].units] == [k % transport.ACCESS_EVERY == 0 for k in range(len(stamps))]


def test_transport_finds_damage():
    media = transport.write_stream(random.Random(0).randbytes(9_000))
    lost = media[: 188 * 6] + media[188 * 7 :]
    assert sum(transport.parse_stream(lost).errors.values()) == 1
    twice = media[: 188 * 7] + media[188 * 6 : 188 * 7] + media[188 * 7 :]
    assert transport.parse_stream(twice).streams[0].payload == transport.parse_stream(media).streams[0].payload
    broken = bytearray(media)
    broken[188 * 5] = 0
    assert transport.parse_stream(bytes(broken)).bad == 1


def test_transport_column(spark, odd):
    rows = transport.padded(odd)
    back = transport.from_media(transport.to_media(rows)).join(rows.select("doc_id", F.col("payload").alias("given")).distinct(), "doc_id")
    assert back.where("payload <> given").count() == 0
    assert rows.where("length(payload) % 192 <> 0 or length(payload) = 0").count() == 0


def brute_spans(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return len(words), sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split())


def test_license_phrases_against_brute_force():
    search, rng = licenses.NoticeSearch(), random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["MIT", "license", "CC", "BY", "apache", "gnu", "General", "public", "é", "1", "x"]) + rng.choice([" ", "-", "\n", ". ", ""]) for _ in range(rng.randint(0, 30)))
        line = search.words(text)
        found = search.spans(line)
        assert (max(0, line.count(b" ") - 1) if len(line) > 2 else 0, sorted((s.first, s.label) for s in found if s.base)) == brute_spans(text)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = _step(row, i, x, b)
    return row[-1]


def _step(before, i, x, b):
    row = [i]
    for j, y in enumerate(b, 1):
        row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row


def test_fuzzy_notices_are_found():
    search, rng = licenses.NoticeSearch(), random.Random(4)
    for text, label, most in licenses.NOTICES:
        for edits in range(most + 1):
            changed = list(text)
            for _ in range(edits):
                at = rng.randrange(1, len(changed) - 1)
                if changed[at] != " ":
                    changed[at] = rng.choice("qxzj")
            line = search.words("some words " + "".join(changed) + " and more")
            spans = [s for s in search.spans(line) if s.label == label and not s.base]
            assert spans, (text, "".join(changed))
            assert min(s.edits for s in spans) <= distance("".join(changed), text)


def test_worse_notices_beside_a_better_one_are_found():
    search, rng = licenses.NoticeSearch(), random.Random(5)
    found = [(s.first, s.edits) for s in search.spans(search.words("mit licence mit license")) if not s.base]
    assert sorted(found) == [(0, 1), (2, 0)]
    for text, label, most in licenses.NOTICES:
        for _ in range(5):
            words, planted = [], []
            for edits in rng.sample(range(most + 1), min(3, most + 1)):
                changed = list(text)
                for at in rng.sample([i for i, c in enumerate(text) if c != " "][1:-1], edits):
                    changed[at] = "q"
                planted.append((len(words), edits))
                words += "".join(changed).split() + ["x"] * rng.randint(0, 2)
            spans = [s for s in search.spans(search.words(" ".join(words))) if s.label == label and not s.base]
            for first, edits in planted:
                assert any(s.edits <= edits and s.first < first + len(text.split()) and first < s.first + s.words for s in spans), (words, first)


def test_license_odd_rows(odd, none):
    rows = licenses.find_notices(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["n_words"] == 0 for r in rows if r["doc_id"] in (1, 2, 3))
    assert licenses.find_notices(none).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_feistel_is_a_permutation(n):
    p = pseudonyms.Permutation(b"k")
    moved = [p.apply("x", n, i) for i in range(n)]
    assert sorted(moved) == list(range(n))
    assert [p.undo("x", n, m) for m in moved] == list(range(n))


def test_pseudonyms_keep_format_and_links():
    p = pseudonyms.Permutation(b"key")
    text = 'Mail ann.b@mail.example.com or +1 (415) 555-0132, card 4111 1111 1111 1111, IBAN DE89 3704 0044 0532 0130 00, 10.1.2.3, born 1980-02-29, token = "9a3f6b2c1d4e5f60718293a4b5c6d7e8f9012345"'
    out, spans = pseudonyms.pseudonymise(text, p)
    assert sorted(k for k, _, _ in spans) == ["account", "card", "date", "host", "mail", "phone", "token"]
    assert re.sub(r"[A-Za-z]", "a", re.sub(r"\d+", "1", out)).count("@") == 1
    for _, start, length in spans:
        assert text[start : start + length] not in out
    card = re.search(r"card ([\d ]+),", out)[1]
    assert pseudonyms.luhn(card.replace(" ", "")) and len(card) == 19
    again, _ = pseudonyms.pseudonymise("x 4111111111111111 y", p)
    assert card.replace(" ", "") in again
    assert pseudonyms._iban_rest(re.search(r"IBAN ([A-Z\d ]+),", out)[1].replace(" ", "")) == 1


@pytest.mark.parametrize("text", ["", "no data here", "version 4.0 of 2024", "4111 1111 1111 1112", "2023-02-30", "300.1.2.3", "a@b", "order 12345678", "1.2.3.4.5"])
def test_pseudonyms_leave_alone(text):
    assert pseudonyms.pseudonymise(text, pseudonyms.Permutation(b"k")) == (text, [])


@pytest.mark.parametrize("word", ["password", "Passwd", "API-key", "api key", "Secret", "token", "CREDENTIAL"])
def test_secrets_of_letters_need_no_digit(word):
    p, secret = pseudonyms.Permutation(b"k"), "correcthorsebatterystaple"
    out, spans = pseudonyms.pseudonymise(f"{word}: {secret}", p)
    assert spans == [("token", len(word) + 2, len(secret))] and secret not in out
    assert out + " 7" == pseudonyms.pseudonymise(f"{word}: {secret} 7", p)[0]


def test_pseudonym_rows(odd, none):
    rows = pseudonyms.with_pseudonyms(odd).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in rows) == sorted((i or 0, t or "") for i, t in ODD)
    assert pseudonyms.with_pseudonyms(none).count() == 0


def language_rows(spark):
    rng, words = random.Random(6), {"en": "the of and thing with that was for".split(), "de": "der die und nicht ein zu auf schön".split(), "fr": "le la et les des que être une".split()}
    return spark.createDataFrame([(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(3, 30))), lang) for i in range(300) for lang in [("en", "de", "fr")[i % 3]]], "doc_id long, text string, lang string")


def test_languages_held_out(spark, odd, none):
    docs = language_rows(spark)
    model = languages.fit_languages(docs, ~languages.held_out())
    found = languages.predict_languages(docs, model).join(docs, "doc_id").where(languages.held_out())
    assert found.where("lang = lang_pred").count() >= 0.95 * found.count()
    rows = languages.predict_languages(odd, model).collect()
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert all(0 <= r["score"] <= 1 for r in rows)
    empty = languages.fit_languages(none, F.lit(True))
    assert {r["lang_pred"] for r in languages.predict_languages(docs, empty).collect()} == {"und"}
    assert languages.keep_predicted(odd, model).columns == odd.columns


def test_forward_sums_all_segmentations():
    vocabulary = languages.Vocabulary(["▁", "▁a", "a", "b", "ab", "▁ab", "ba"])
    p = np.random.default_rng(0).random((8, 2))
    index = {x: i for i, x in enumerate(vocabulary.pieces)}

    def brute(rest):
        if not rest:
            return np.ones(2)
        return sum((p[index[rest[:k]]] * brute(rest[k:]) for k in range(1, len(rest) + 1) if rest[:k] in index), np.zeros(2))

    for word in ("▁ab", "▁abab", "▁baab", "▁bbaa"):
        points = np.frombuffer(word.encode("utf-32-le"), "<u4")[None]
        assert np.allclose(languages.forward(languages._grid(vocabulary, points, 8), p)[-1][0], brute(word))


HTML = "<html><head><title>t</title></head><body><nav><ul><li><a href=x>Home</a></ul></nav><div class='ad-1'>Buy this now</div><article class='post-{0}'><h1>Title</h1><p>Some <b>bold</b> text &amp; more of it {0}.<p>Second\n paragraph &eacute;.<div class=comments>First!</div></article><footer>&copy; me</footer><script>var x='<p>no</p>'</script></body>"


def test_main_text_by_host(spark):
    rows = [(i, f"https://A.example.org:80/{i}", HTML.format(i)) for i in range(6)] + [(10, None, None), (11, "", ""), (12, "x", "plain words only"), (13, "https://a.example.org/z", "<div><p>other layout with words</p></div>")]
    found = {r["page_id"]: r for r in pages.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit(1)).withColumn("host", F.lit(2))).collect()}
    assert found[3]["text"] == "Title Some bold text & more of it 3. Second paragraph é."
    assert found[3]["path"] == "/html/body/article.post-#"
    assert found[10]["text"] == found[11]["text"] == ""
    assert found[12]["text"] == "plain words only"
    assert found[13]["text"] == "other layout with words"


@pytest.mark.parametrize(("given", "kept"), [
    ("<div class=comment-body>Reader says</div>", ""), ("<div class='sidebar-content'>no</div>", ""), ("<p class=has-sidebar>yes</p>", "yes"),
    ("<figure><figcaption>a caption</figcaption></figure>", "a caption"), ("<math><mi>x</mi></math>", "x"), ("<div class='content sidebar-left'>yes</div>", "yes"),
    ("<div class='body comment'>no</div>", ""), ("<script>if (a < b) '<p>'</script>", ""), ("<!-- <p>no</p> -->", ""), ("<img alt='a > b'>yes", "yes"),
])
def test_what_an_article_keeps(given, kept):
    around = "<article class=post><p>First of all the words that stand here.</p>{}</article>"
    assert pages.main_text(around.format(given), None) == f"First of all the words that stand here. {kept}".strip()


@pytest.mark.parametrize("page", ["<a " * 300_000, "<div>" * 60_000, "<div>" * 30_000 + "</p>" * 30_000, "<b>" * 30_000 + "<p>x" * 30_000, '<a "x" ' * 50_000 + '">'])
def test_hostile_pages_take_linear_time(page):
    began = time.process_time()
    pages.main_text(page, None)
    assert time.process_time() - began < 10


@pytest.mark.parametrize("text", ["a" * 500_000 + " x@y.com", "a@" * 100_000, "_._" * 200_000, "token = " + "a1" * 100_000])
def test_hostile_texts_take_linear_time(text):
    began = time.process_time()
    pseudonyms.pseudonymise(text, pseudonyms.Permutation(b"k"))
    assert time.process_time() - began < 10


def test_identity_numbers_stay_valid_and_addresses_linked():
    p, rng = pseudonyms.Permutation(b"k"), random.Random(8)
    for _ in range(500):
        given = f"{rng.choice([*range(1, 666), *range(667, 900)]):03d}{rng.randint(1, 99):02d}{rng.randint(1, 9999):04d}"
        out = pseudonyms.pseudonymise(f"id {given[:3]}-{given[3:5]}-{given[5:]}", p)[0][3:].replace("-", "")
        assert pseudonyms._is_identity(out)
    one, two = pseudonyms.pseudonymise("Ann@X.com ann@x.com", p)[0].split()
    assert one.lower() == two and one != two


def test_letters_and_long_words(spark):
    vocabulary = languages.load_vocabulary(tokens.default_vocabulary("piece_bpe_32k.model"))
    p = np.random.default_rng(0).random((len(vocabulary.pieces) + 1, 3)) * 1e-3
    for word in ("abc", "straße" * 5, "ééa" * 20):
        points = np.frombuffer(("▁" + word).encode("utf-32-le"), "<u4")[None]
        whole = np.log(languages.forward(languages._grid(vocabulary, points, vocabulary.longest), p)[-1][0])
        assert np.allclose(whole, languages.long_word_log(vocabulary, word, p))
    index = {x: i for i, x in enumerate(vocabulary.pieces)}
    assert all(vocabulary.find(vocabulary.hashes[[i]])[0] == i for i in index.values())
    model = languages.fit_languages(language_rows(spark), F.lit(True))
    rows = languages.predict_languages(spark.createDataFrame([(1, "½ ² Ⅷ ①"), (2, "the " + "q" * 5000)], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in sorted(rows)] == ["und", "en"]


def brute_classes(rows, n, num):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset([tuple(words)] if 0 < len(words) < n else [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= num * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 60)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least[find(i)], doc_id)
    return {doc_id: (len(sets[i]), least[find(i)] if sets[i] else doc_id) for i, (doc_id, _) in enumerate(rows)}


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 60)])
def test_jaccard_classes_against_brute_force(spark, n, num):
    rng = random.Random(n)
    rows, bases = [], [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([4, 12, 25, 60, 150, 400]))] for _ in range(14)]
    for i in range(330):
        words = list(rng.choice(bases))
        for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
            words[rng.randrange(len(words))] = f"e{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "A b"), (1004, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit(1)).withColumn("component", F.lit(1))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joins.jaccard_classes(docs, n=n, num=num).collect()}
    assert found == brute_classes(rows, n, num)


def test_tiles_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 8)
    rng, base = random.Random(9), [f"w{i}" for i in range(80)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(80), 3):
            words[k] = f"e{rng.randrange(25)}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joins.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=2, num=90).collect()}
    assert found == brute_classes(rows, 2, 90)


def test_short_texts_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randint(3, 12)))) for i in range(2000)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joins.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=2, num=60).collect()}
    assert found == brute_classes(rows, 2, 60)


def test_family_far_from_its_least_member(spark, monkeypatch):
    monkeypatch.setattr(joins, "TILE", 16)
    rng, base, rows = random.Random(12), [f"w{i}" for i in range(160)], []
    for i in range(500):
        words = list(base)
        for k in rng.sample(range(160), 7 if i == 0 else rng.choice((1, 2, 3, 3, 4, 5))):  # five-word shingles: five a change
            words[k] = f"e{rng.randrange(10_000)}"
        rows.append((i, " ".join(words)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in joins.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=5, num=80).collect()}
    assert found == brute_classes(rows, 5, 80)
    assert len({c for _, c in found.values()}) > 1


def test_wide_sketches_bound_the_difference():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64)) for n in (3, 900, 1025, 1500, 5000)]
    sets += [np.unique(np.append(s[: len(s) * 9 // 10], rng.integers(0, 1 << 62, 7, dtype=np.uint64))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    import pyarrow as pa

    sketches = joins.Sketches(pa.array(joins._sketches(np.concatenate(sets), sizes), pa.binary()))
    x, y = (a.ravel() for a in np.indices((len(sets), len(sets))))
    for i, j, apart in zip(x, y, sketches.apart(x, y), strict=True):
        assert apart <= len(np.setxor1d(sets[i], sets[j]))
        assert i != j or apart == 0


def test_near_copies_without_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join(words)), (3, " ".join([*words[:-1], "x"])), (None, " ".join(["y", *words[1:]])), (1, "other words"), (None, None)]
    found = joins.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=2, num=90).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in found) == [(0, 0), (0, 3), (0, 3), (1, 1), (3, 3)]


def test_jaccard_candidates_of_many_signatures_are_compared_once(spark, monkeypatch):
    """Nodes that meet under 40 signatures are candidates once: a pair as one row, a dense block as its rows."""
    common = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join([*common, *(f"own{i}x{k}" for k in range(4))])) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    threshold = shingles.Threshold(80, 100)
    written, keep = {}, joins.Scratch.write

    def write(self, df, name):
        written[name] = keep(self, df, name)
        return written[name]

    monkeypatch.setattr(joins.Scratch, "write", write)
    join = joins.JaccardJoin(joins.Scratch(spark), docs, 5, threshold)
    join.nodes = joins.describe(docs, 5, threshold).where("doc_id is not null").select("doc_id", "node", "size", "sketch").localCheckpoint()
    nodes = join.nodes.selectExpr("node", "size", "doc_id", "node as component", "false as main", "false as away", "true as is_left", "true as is_right")
    blocks = nodes.join(spark.range(40).withColumnRenamed("id", "k"), (F.col("k") < 20) | (F.col("doc_id") < 2))
    blocks = blocks.selectExpr("k as key", "0 as tile", "0 as other", "node", "size", "component", "main", "away", "is_left", "is_right")
    links = join.links(blocks)
    assert written["candidates"].count() == 12 + 1
    found = {r["node"]: r["component"] for r in connected_components(links).collect()}
    assert len(found) == 12 and len(set(found.values())) == 1


@pytest.mark.parametrize("held", [3, 4_096])
def test_jaccard_shared_signatures(spark, monkeypatch, held):
    """Single, repeated, away and very frequent ones, in Arrow batches of few rows."""
    rng = random.Random(5)
    rows = [(s, n, abs(n) % 7, a) for s, n, a in ((rng.randint(-40, 40), rng.randint(-30, 30), rng.random() < 0.6) for _ in range(900))]
    rows += [(77, 5, 5, False), (77, 5, 5, True), (77, 5, 5, False), (78, 1, 1, True), (78, 2, 2, True), *((99, n, abs(n) % 7, n % 3 > 0) for n in range(-150, 150)), *[(98, 4, 4, False)] * 60]
    groups = defaultdict(set)
    for s, n, z, a in rows:
        groups[s].add((n, z, a))
    expected = []
    for s, members in groups.items():
        home = sorted((n, z) for n, z, a in members if not a)
        if home and len({n for n, _, _ in members}) > 1:
            expected += [(s, n, z, a, *home[0]) for n, z, a in members]
    monkeypatch.setattr(joins, "HELD_ROWS", held)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = joins._shared(spark.createDataFrame(rows, "signature long, node long, size long, away boolean").repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, found)) == sorted(expected)


def test_jaccard_empty_and_odd(spark, odd, none):
    assert joins.jaccard_classes(none).count() == 0
    rows = joins.jaccard_classes(odd).collect()
    assert len(rows) == len(ODD)
    assert {r["component_id"] for r in rows if r["doc_id"] in (4, 5)} == {4}
    kept = joins.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == sorted(i or 0 for i, _ in ODD if i != 5)


def test_linked_sets_share_a_signature():
    rng, threshold = np.random.default_rng(1), shingles.Threshold(80, 100)
    for _ in range(300):
        size = int(rng.integers(1, 200))
        a = rng.integers(0, (1 << 64) - 1, size, dtype=np.uint64, endpoint=True)
        b = a.copy()
        for k in range(int(rng.integers(0, 1 + size // 9))):
            b = np.delete(b, rng.integers(len(b))) if k % 2 else np.append(b, rng.integers(0, (1 << 64) - 1, dtype=np.uint64, endpoint=True))
        a, b = np.unique(a), np.unique(b)
        if len(b) == 0 or not threshold.linked(len(np.intersect1d(a, b)), len(a), len(b)) or len(a) == len(b) == len(np.intersect1d(a, b)):
            continue
        hot = (np.empty(0, np.uint64), np.empty(0, np.int64))
        rows, sig, deleted = shingles.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), threshold, hot)
        one, two = ({(int(s), bool(d)) for s, d in zip(sig[rows == r], deleted[rows == r], strict=True)} for r in (0, 1))
        assert any((s, not d) in two or (s, False) in two for s, d in one if (s, False) in two or not d and (s, True) in two), (len(a), len(b))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {x: x for link in links for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    linked = {x for a, b in links if a != b for x in (a, b)}
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {x: find(x) for x in linked}


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(1500, 24))
    vectors[700:760] = vectors[0]
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0] * 7), (5200, [1.0, None] + [0.0] * 22), (None, [1.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("vector", F.lit(1))
    found = neighbours.nearest_neighbours(table, F.col("vec_id") % 50 == 0).collect()
    unit = vectors / np.sqrt((vectors**2).sum(1, keepdims=True))
    hits = total = 0
    for q in range(0, 1500, 50):
        near = unit @ unit[q]
        near[q] = -9
        best = np.lexsort((np.arange(1500), -np.round(near, 12)))[:5]
        own = sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == q)
        assert [k for k, _ in own] == [1, 2, 3, 4, 5]
        hits, total = hits + len(set(best) & {v for _, v in own}), total + 5
    assert hits >= 0.9 * total
    assert [v for _, v in sorted((r["rank"], r["vec_id"]) for r in found if r["query_id"] == 0)] == [700, 701, 702, 703, 704]
    assert not {5000, 5050, 5100, 5200} & {r["query_id"] for r in found} and 5150 not in {r["query_id"] for r in found}
    assert neighbours.nearest_neighbours(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_digests(spark):
    docs = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    row = transport.padded(docs).first()
    assert row["payload"] == bytearray(b"abc".ljust(192)) and row["n_bytes"] == 3
    assert hashlib.sha256(row["payload"]).hexdigest()
