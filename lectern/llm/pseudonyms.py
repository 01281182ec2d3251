"""Format-preserving pseudonyms for personal data.

Validated values (mail addresses, phone numbers, payment cards, bank accounts, addresses of hosts, dates, identity
numbers, tokens) are replaced by values of the same format with a keyed Feistel permutation of the format's own domain.
Equal values so stay equal in every document, nothing has to be stored or shuffled, and who has the key can undo it.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, slices, small_batches

#: Where the session names the key of the pseudonyms. Without it, a key is drawn that nobody keeps: values stay linked
#: within a session, and nothing can be undone.
KEY_SETTING = "spark.lectern.pseudonyms.key"
ROUNDS = 10
#: Characters that are permuted together at most.
PART = 256
#: Alphabets that a character is permuted within. Fixed values.
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ")
_ALPHABET = {c: a for a in _ALPHABETS for c in a}
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


class Permutation:
    """A keyed permutation of 0..n-1 for any n: a balanced Feistel network on the next even number of bits, walked until
    the value falls below n again. `kind` separates the permutations of different formats."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, n: int, i: int, half: int) -> int:
        data = f"{kind}/{n}/{i}/{half}".encode()
        return int.from_bytes(blake2b(data, key=self.key[:64], digest_size=32).digest(), "big")

    def _once(self, kind: str, n: int, value: int, bits: int, order: range) -> int:
        mask = (1 << bits) - 1
        left, right = value >> bits, value & mask
        if order.step > 0:
            for i in order:
                left, right = right, left ^ self._round(kind, n, i, right) & mask
        else:
            for i in order:
                left, right = right ^ self._round(kind, n, i, left) & mask, left
        return left << bits | right

    def _walk(self, kind: str, n: int, value: int, order: range) -> int:
        if n < 2:
            return value
        bits = ((n - 1).bit_length() + 1) // 2
        while True:
            value = self._once(kind, n, value, bits, order)
            if value < n:
                return value

    def apply(self, kind: str, n: int, value: int) -> int:
        return self._walk(kind, n, value, range(ROUNDS))

    def undo(self, kind: str, n: int, value: int) -> int:
        return self._walk(kind, n, value, range(ROUNDS - 1, -1, -1))


def permute_text(move: Callable[[str, int, int], int], kind: str, text: str, keep: int = 0, alphabet: str = "") -> str:
    """text with its letters and digits (after the first `keep` characters) permuted together, each within its alphabet
    or all within the given one; other characters stay. Long texts are permuted part by part."""
    if len(text) > PART:
        return "".join(permute_text(move, f"{kind}/{i}", text[i : i + PART], max(0, keep - i), alphabet) for i in range(0, len(text), PART))
    alphabets = [(alphabet or _ALPHABET.get(c)) if i >= keep else None for i, c in enumerate(text)]
    number, size = 0, 1
    for c, a in zip(text, alphabets, strict=True):
        if a:
            number, size = number * len(a) + a.index(c), size * len(a)
    number = move(kind, size, number)
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if a := alphabets[i]:
            number, r = divmod(number, len(a))
            out[i] = a[r]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def _refill(digits: str, shape: str) -> str:
    """digits in the places of the shape's digits."""
    take = iter(digits)
    return "".join(next(take) if c.isdecimal() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdecimal())


# Each reader gets the match's text and a permutation; None: not valid, so it stays as it is.
def _mail(text, move):
    local, _, host = text.rpartition("@")
    name, _, top = host.rpartition(".")
    given = f"{local}@{name}"
    # addresses that differ in case only are one address, and stay so
    moved = permute_text(move, "mail", "".join(c.lower() if len(c.lower()) == 1 else c for c in given))
    return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for c, m in zip(given, moved, strict=True)) + f".{top}"


def _host(text, move):
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    n = move("host", 1 << 32, int.from_bytes(bytes(map(int, parts)), "big"))
    return ".".join(map(str, n.to_bytes(4, "big")))


def _card(text, move):
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = permute_text(move, "card", digits[:-1])
    return _refill(body + next(c for c in "0123456789" if luhn(body + c)), text)


def _phone(text, move):
    digits = _digits(text)
    if not 8 <= len(digits) <= 15:
        return None
    code = len(re.match(r"\+\d{1,3}(?=\D)|\+\d|", text)[0].lstrip("+"))  # the country's code stays
    return _refill(permute_text(move, "phone", digits, code), text)


def _is_identity(number: str) -> bool:
    return not (number[:3] in ("000", "666") or number[:3] >= "900" or number[3:5] == "00" or number[5:] == "0000")


def _identity(text, move):
    number = _digits(text)
    if not _is_identity(number):
        return None
    number = permute_text(move, "identity", number)
    while not _is_identity(number):  # the permutation of all numbers, walked inside the valid ones
        number = permute_text(move, "identity", number)
    return _refill(number, text)


def _account(text, move):
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = permute_text(move, "account", plain[4:])
    check = 98 - _iban_rest(f"{plain[:2]}00{body}")
    take = iter(f"{plain[:2]}{check:02d}{body}")
    return "".join(c if c == " " else next(take) for c in text)


def _day(year: str, month: str, day: str) -> int | None:
    try:
        n = date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return n if 0 <= n < _DAYS else None


def _iso_date(text, move):
    n = _day(text[:4], text[5:7], text[8:])
    return None if n is None else date.fromordinal(_FIRST_DAY + move("date", _DAYS, n)).strftime(f"%Y{text[4]}%m{text[7]}%d")


def _slash_date(text, move):
    a, b, year = re.split(r"[./]", text)
    for order, (day, month) in (("%d{0}%m{0}%Y", (a, b)), ("%m{0}%d{0}%Y", (b, a))):
        if (n := _day(year, month, day)) is not None:
            return date.fromordinal(_FIRST_DAY + move("date", _DAYS, n)).strftime(order.format(text[len(a)]))
    return None


def _token(text, move):
    for alphabet in ("0123456789abcdef", "0123456789ABCDEF"):
        if set(text) <= set(alphabet):
            return permute_text(move, "token", text, alphabet=alphabet)
    return permute_text(move, "token", text)


_B, _E = r"(?<![\w@])", r"(?![\w@])"
#: The words before a token, whose value may be letters only.
_TOKEN_WORDS = r"(?i:token|secret|passw(?:or)?d|credential|api[_ -]?key)"
#: The kinds, in the order in which a place is tried: name, pattern (its group 1 is the value), reader, a character it needs.
KINDS = (
    ("mail", re.compile(r"(?<![\w.+%-])[_.+%-]*([^\W_][\w.+%-]*@[^\W_][\w-]*(?:\.[\w-]+)*\.[A-Za-z]{2,24})(?![\w@])"), _mail, "@"),
    ("token", re.compile(_TOKEN_WORDS + r"[^\w\n]{0,12}[=:][^\w\n]{0,12}([0-9A-Za-z][0-9A-Za-z+/_-]{14,})"), _token, ""),
    ("host", re.compile(_B + r"(?<!\d\.)(\d{1,3}(?:\.\d{1,3}){3})(?!\.\d)" + _E), _host, "."),
    ("date", re.compile(_B + r"(\d{4}([-/])\d{2}\2\d{2})" + _E), _iso_date, ""),
    ("date", re.compile(_B + r"(\d{1,2}([./])\d{1,2}\2\d{4})" + _E), _slash_date, ""),
    ("account", re.compile(_B + r"([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)" + _E), _account, ""),
    ("identity", re.compile(_B + r"(\d{3}-\d{2}-\d{4})" + _E), _identity, "-"),
    ("card", re.compile(_B + r"(\d(?:[ -]?\d){12,18})" + _E), _card, ""),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}(?:[^\w\n@+]{0,6}\d{1,5}){2,6})" + _E), _phone, "+"),
    ("phone", re.compile(_B + r"(\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})" + _E), _phone, ""),
)
_DIGIT, _TOKEN_WORD = re.compile(r"\d"), re.compile(_TOKEN_WORDS)


def pseudonymise(text: str | None, permutation: Permutation) -> tuple[str | None, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, length) of each value in the given text, in order of place."""
    if not text or "@" not in text and not _DIGIT.search(text) and not _TOKEN_WORD.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    used = bytearray(len(text))
    for kind, pattern, reader, need in KINDS:
        if need and need not in text:
            continue
        for m in pattern.finditer(text):
            b, e = m.span(1)
            if used.find(1, b, e) < 0 and (new := reader(m[1], permutation.apply)) is not None:
                used[b:e] = b"\1" * (e - b)
                taken.append((b, e, kind, new))
    taken.sort()
    out, at = [], 0
    for b, e, _, new in taken:
        out += [text[at:b], new]
        at = e
    return "".join([*out, text[at:]]), [(kind, b, e - b) for b, e, kind, _ in taken]


_drawn: list[bytes] = []


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's settings name, or one drawn at random for this driver."""
    if named := spark.conf.get(KEY_SETTING, ""):
        return named.encode()
    if not _drawn:
        _drawn.append(secrets.token_bytes(32))
    return _drawn[0]


def with_pseudonyms(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """doc_id, text with pseudonyms, and spans (array of kind, start, length in the given text).

    A null text stays null and an empty one empty, without spans. Each row is handled by itself: repeated rows get equal
    results and null ids pass through; where two kinds of values overlap the first of KINDS is taken; texts of any length
    go in whole; other columns are left out; an empty table gives an empty result. For the key see session_key.
    """
    key = key or session_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(key)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
        for part in slices(batches):
            done = [pseudonymise(t, permutation) for t in part.column("text").to_pylist()]
            spans = pa.array([[dict(zip(("kind", "start", "length"), s, strict=True)) for s in spans] for _, spans in done], kind)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([t for t, _ in done], pa.string()), spans], names=["doc_id", "text", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string, spans array<struct<kind: string, start: long, length: long>>")


def replace_texts(docs: DataFrame, *, text_col: str = "text", key: bytes | None = None) -> DataFrame:
    """The rows, with all their columns, and pseudonyms in the text. Null and empty texts, repeated rows and null ids stay
    as they are; texts of any length go in whole; an empty table gives an empty result. For the key see session_key."""
    key = key or session_key(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = Permutation(key)
        for part in slices(batches, text_col):
            texts = pa.array([pseudonymise(t, permutation)[0] for t in part.column(text_col).to_pylist()], pa.string())
            yield part.set_column(part.schema.get_field_index(text_col), text_col, texts)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with pseudonyms, how many values were replaced and of what kinds; odd rows as for with_pseudonyms."""
    rows = with_pseudonyms(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("spans", lambda s: s.kind))), ",")
    return rows.select("doc_id", "text", F.size("spans").cast("long").alias("n_values"), kinds.alias("kinds"))


QUERIES = {"op6_pseudonyms": op6_pseudonyms}
