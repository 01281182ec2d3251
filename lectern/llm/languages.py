"""Language of whole texts by unigram models of pieces, with the segmentation summed out.

Every language has a probability for each piece of a fixed public vocabulary. The probability of a word is the sum over
all its segmentations into pieces, by a forward algorithm over all words of a slice at once; a text's is the product over
its words. The models are fitted by expectation-maximisation, on the words of a bounded sample of labelled texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, kept, slices, small_batches
from .tokens import default_vocabulary

#: Texts of each language that the fit takes at most, on average (all, where there are fewer), and rounds of the fit.
SAMPLE_TEXTS, FIT_ROUNDS = 300, 3
#: Longer words are scored one by one, all their parts at once, with rescaled sums.
LONG_WORD = 48
#: Words whose scores a worker keeps before it starts afresh.
CACHE_WORDS = 300_000
_UNKNOWN, _SMOOTHING = 1e-7, 0.1
_LETTERS = regex.compile(r"\p{L}+")
_START = "▁"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(29)
    return x * np.uint64(0xBF58476D1CE4E5B9)


class Vocabulary:
    """The pieces in use, found by the hash of their letters in tables, as many as it takes to place them all."""

    BITS = 20

    def __init__(self, pieces: Sequence[str]):
        self.pieces = list(pieces)
        lengths = np.array([len(p) for p in self.pieces])
        self.longest = int(lengths.max(initial=1))
        self.hashes = np.zeros(len(self.pieces), np.uint64)
        for n in np.unique(lengths):
            rows = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(self.pieces[i] for i in rows).encode("utf-32-le"), "<u4").reshape(-1, n)
            h = np.zeros(len(rows), np.uint64)
            for k in range(n):
                h = self.step(h, points[:, k])
            self.hashes[rows] = h
        if len(np.unique(self.hashes)) < len(self.pieces):
            raise ValueError("two pieces have one hash")
        self.tables: list[np.ndarray] = []
        left = np.arange(len(self.pieces))
        while len(left):
            places = self._places(self.hashes[left], len(self.tables))
            _, first = np.unique(places, return_index=True)
            self.tables.append(np.full(1 << self.BITS, -1, np.int32))
            self.tables[-1][places[first]] = left[first]
            left = np.delete(left, first)
        self.hashes = np.append(self.hashes, np.uint64(0))  # what -1 points to

    @staticmethod
    def step(h: np.ndarray, points: np.ndarray) -> np.ndarray:
        """The hash of a text one letter longer."""
        return _mix((h + points.astype(np.uint64) + np.uint64(1)) * _FACTOR)

    def _places(self, h: np.ndarray, table: int) -> np.ndarray:
        return (h >> np.uint64(64 - self.BITS) if table == 0 else _mix(h + np.uint64(table)) >> np.uint64(44 - self.BITS) & np.uint64((1 << self.BITS) - 1)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1."""
        found = self.tables[0][self._places(h, 0)] if self.tables else np.full(h.shape, -1, np.int32)
        found = np.where(self.hashes[found] == h, found, -1)
        for k, table in enumerate(self.tables[1:], 1):
            other = table[self._places(h, k)]
            found = np.where((found < 0) & (self.hashes[other] == h), other, found)
        return found


def load_vocabulary(path: str) -> Vocabulary:
    """The lower-case pieces of letters in a SentencePiece model file, with or without a word's start, of any length."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return Vocabulary(sorted({p for p in pieces if p == p.lower() and (p.removeprefix(_START).isalpha() or p == _START)}))


def _grid(vocabulary: Vocabulary, points: np.ndarray, most: int) -> list[list[np.ndarray]]:
    """For each end 1..n the pieces of each length that end there, of words of equal length: grid[end - 1][length - 1]."""
    n = points.shape[1]
    grid: list[list[np.ndarray]] = [[] for _ in range(n)]
    for begin in range(n):
        h = np.zeros(len(points), np.uint64)
        for end in range(begin + 1, min(n, begin + most) + 1):
            h = vocabulary.step(h, points[:, end - 1])
            grid[end - 1].append(vocabulary.find(h))
    return [row[::-1] for row in grid]


def forward(grid: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
    """The probability of the first k letters, summed over segmentations, by language. The last row of p is for letters
    that no piece has."""
    words = len(grid[0][0])
    alpha = [np.ones((words, p.shape[1]))]
    for end, row in enumerate(grid, 1):
        total = np.zeros((words, p.shape[1]))
        for length, piece in enumerate(row, 1):
            gain = p[piece] if length == 1 else np.where(piece[:, None] >= 0, p[piece], 0.0)
            total += alpha[end - length] * gain
        alpha.append(total)
    return alpha


def backward(grid: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
    n, words = len(grid), len(grid[0][0])
    beta = [np.zeros((words, p.shape[1])) for _ in range(n)] + [np.ones((words, p.shape[1]))]
    for end in range(n, 0, -1):
        for length, piece in enumerate(grid[end - 1], 1):
            gain = p[piece] if length == 1 else np.where(piece[:, None] >= 0, p[piece], 0.0)
            beta[end - length] += beta[end] * gain
    return beta


def long_word_log(vocabulary: Vocabulary, word: str, p: np.ndarray) -> np.ndarray:
    """The logarithm of a word's probability by language, by the same sum as `forward`, for words of any length.

    The word is cut into some sqrt(n) stretches that run side by side: each carries forward what it would give for every
    state it can begin with (the sums of the last few letters), rescaled as it goes; then the states are chained.
    """
    most, languages = vocabulary.longest, p.shape[1]
    points = np.frombuffer((_START + word).encode("utf-32-le"), "<u4")
    n = len(points)
    pieces = np.full((most, n), -1, np.int64)  # by length - 1 and the letter that a piece ends at
    h = np.zeros(n, np.uint64)
    for length in range(1, min(most, n) + 1):
        h = vocabulary.step(h[: n - length + 1], points[length - 1 :])
        pieces[length - 1, length - 1 :] = vocabulary.find(h)
    stretch = max(most, int(np.ceil(np.sqrt(n))))
    count = -(-n // stretch)
    state = np.zeros((count, most, most, languages))  # stretch, letters back, state it began with, language
    state[:, np.arange(most), np.arange(most)] = 1.0
    logs = np.zeros((count, languages))
    begins = np.arange(count) * stretch
    for k in range(stretch):
        at = begins + k
        inside = at < n
        piece = pieces[:, np.minimum(at, n - 1)]
        gain = np.where(piece[..., None] >= 0, p[piece], 0.0)
        gain[0] = p[piece[0]]  # the last row of p is for letters that no piece has
        fresh = np.einsum("lcg,clsg->csg", gain, state)
        moved = np.concatenate([fresh[:, None], state[:, :-1]], 1)
        state = np.where(inside[:, None, None, None], moved, state)
        if k % 8 == 7:
            scale = np.maximum(state.max((1, 2)), 1e-300)
            state /= scale[:, None, None]
            logs += np.log(scale)
    now, total = np.zeros((most, languages)), logs.sum(0)
    now[0] = 1.0
    for c in range(count):
        now = np.einsum("lsg,sg->lg", state[c], now)
        scale = np.maximum(now.max(0), 1e-300)
        now, total = now / scale, total + np.log(scale)
    return total + np.log(np.maximum(now[0], 1e-300))


def split_words(text: str) -> list[str]:
    """The runs of letters in lower case."""
    return _LETTERS.findall(text.lower())


def _by_length(words: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and code points (with the start mark) of the words of each length."""
    lengths = np.array([len(w) for w in words])
    for n in np.unique(lengths):
        for rows in np.array_split(np.flatnonzero(lengths == n), 1 + (lengths == n).sum() // 20_000):
            yield rows, np.frombuffer("".join(_START + words[i] for i in rows).encode("utf-32-le"), "<u4").reshape(len(rows), -1)


class LanguageModel:
    """languages and, for each piece and language, a probability; the last row is for letters that no piece has."""

    def __init__(self, languages: list[str], vocabulary_path: str, p: np.ndarray):
        self.languages, self.vocabulary_path, self.p = languages, vocabulary_path, p
        self.key = hashlib.sha256(p.tobytes() + repr((languages, vocabulary_path)).encode()).hexdigest()

    @classmethod
    def fit(cls, languages: list[str], words: Sequence[str], counts: np.ndarray, vocabulary_path: str, rounds: int = FIT_ROUNDS) -> LanguageModel:
        """From the words of a sample and how often each language has them (words x languages)."""
        vocabulary = load_vocabulary(vocabulary_path)
        v, k = len(vocabulary.pieces), len(languages)
        p = np.full((v + 1, k), 1.0 / (v + 1))
        grids = [(rows, _grid(vocabulary, points, vocabulary.longest)) for rows, points in _by_length(words)]
        for _ in range(rounds):
            expected = np.zeros((v + 1, k))
            for rows, grid in grids:
                alpha, beta, weight = forward(grid, p), backward(grid, p), counts[rows]
                scale = weight / np.maximum(alpha[-1], 1e-300)
                for end, row in enumerate(grid, 1):
                    for length, piece in enumerate(row, 1):
                        share = alpha[end - length] * p[piece] * beta[end] * scale
                        used = piece >= 0
                        for lang in range(k):
                            expected[:, lang] += np.bincount(piece[used], share[used, lang], v + 1)
            p = (expected + _SMOOTHING) / (expected.sum(0) + _SMOOTHING * (v + 1))
            p[-1] = _UNKNOWN
        return cls(languages, vocabulary_path, p)


class Scorer:
    """Scores texts in a worker, each word once."""

    def __init__(self, model: LanguageModel):
        self.model, self.vocabulary = model, load_vocabulary(model.vocabulary_path)
        self.forget()

    def forget(self) -> None:
        self.row: dict[str, int] = {}
        self.logs = np.zeros((0, len(self.model.languages)))

    def word_logs(self, words: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(words), len(self.model.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= LONG_WORD]
        for rows, points in _by_length([words[i] for i in short]) if short else ():
            out[np.array(short)[rows]] = np.log(np.maximum(forward(_grid(self.vocabulary, points, self.vocabulary.longest), self.model.p)[-1], 1e-300))
        for i in sorted(set(range(len(words))).difference(short)):
            out[i] = long_word_log(self.vocabulary, words[i], self.model.p)
        return out

    def predict(self, texts: Sequence[str | None]) -> list[tuple[str, float]]:
        """(language, its probability among the languages); (und, 0) without a letter."""
        if not self.model.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.row) > CACHE_WORDS:
            self.forget()
        lists = [t.split() if t else [] for t in texts]
        fresh = list(set().union(*lists).difference(self.row))
        if fresh:
            pieces = [split_words(w) for w in fresh]
            own = sorted(set().union(*pieces))
            at = {w: i for i, w in enumerate(own)}
            logs = self.word_logs(own)
            owner = np.repeat(np.arange(len(fresh)), [len(p) for p in pieces])
            flat = np.array([at[w] for p in pieces for w in p], np.int64)
            rows = np.stack([np.bincount(owner, logs[flat, k], len(fresh)) for k in range(logs.shape[1])], 1)
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh)), strict=True))
            self.logs = np.concatenate([self.logs, rows])
        out = []
        for text, words in zip(texts, lists, strict=True):
            if not text or not _LETTERS.search(text):
                out.append(("und", 0.0))
                continue
            total = self.logs[np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))].sum(0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def fit_languages(docs: DataFrame, learn: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, sample_texts: int = SAMPLE_TEXTS) -> LanguageModel:
    """Fits the models on texts where `learn` holds and the language is not null: a sample by a hash of the id, of
    sample_texts texts of each language on average, or all that there are. The sample's words are counted in Spark; what
    comes to the driver is bounded by the sample. Words of more than LONG_WORD letters are scored, but not learned from;
    repeated rows count each; an empty table gives a model that knows no language."""
    path = vocabulary or default_vocabulary("piece_bpe_32k.model")
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)).alias("draw"), F.col(text_col).alias("text"))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], path, np.zeros((1, 0)))
    share = F.coalesce(*(F.when(F.col("lang") == lang, F.lit(min(1 << 30, (1 << 30) * sample_texts // n))) for lang, n in sizes.items()))
    tokens = rows.where(F.col("draw") < share).select("lang", F.explode(F.split("text", r"\s+")).alias("token"))
    table = tokens.groupBy("lang", "token").agg(F.count("*").alias("n")).toArrow()
    at, lang_at = {}, {lang: i for i, lang in enumerate(languages)}
    cells: list[tuple[int, int, int]] = []
    for lang, token, n in zip(*(table.column(c).to_pylist() for c in ("lang", "token", "n")), strict=True):
        for word in split_words(token):
            if len(word) > LONG_WORD:
                continue
            cells.append((at.setdefault(word, len(at)), lang_at[lang], n))
    counts = np.zeros((len(at), len(languages)))
    w, k, n = (np.array(c, np.int64) for c in zip(*cells, strict=True)) if cells else (np.zeros(0, np.int64),) * 3
    np.add.at(counts, (w, k), n)
    order = sorted(range(len(at)), key=list(at).__getitem__)  # the same sums whatever order the rows came in
    words = list(at)
    return LanguageModel.fit(languages, [words[i] for i in order], counts[order], path)


def predict_languages(docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for each row, from the text alone.

    A null text and one without a letter give und with score 0, as all do if nothing was learned. Null ids and repeated
    rows pass through; of languages with the same probability the first in order is taken; texts and words of any length
    are scored whole; other columns are left out; an empty table gives an empty result. The model that goes to the workers
    has a number for each of some 20,000 pieces and each language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("languages", model.key), lambda: Scorer(model))
        for part in slices(batches):
            found = scorer.predict(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_predicted(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text has a language of at least this score; the rest is rejected, as are
    null texts and those without a letter. Repeated rows and null ids pass like others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = kept(("languages", model.key), lambda: Scorer(model))
        for part in slices(batches, text_col):
            found = scorer.predict(part.column(text_col).to_pylist())
            yield part.filter(pa.array([lang != "und" and score >= least_score for lang, score in found], pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from the fit."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by models that saw only those not held out; nulls, ties and repeats as for
    predict_languages. A null id is not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_languages(docs, ~held_out())
    return predict_languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_languages": op3_languages}
