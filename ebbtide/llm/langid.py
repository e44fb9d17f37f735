"""Language identification by segmentation-marginalised unigrams (operator 3).

A language is a probability for each piece of a fixed public vocabulary. The probability of a word is the sum
over all ways of cutting it into pieces, by the forward algorithm; a text's is the product over its words
(runs of letters in lower case, each with a word-begin mark). The piece probabilities are estimated by
expectation-maximisation (forward-backward over the distinct words of each language, as Spark jobs) from a
bounded sample of the labelled documents. Scoring works on the distinct words of a slice of texts with numpy:
all words advance through one trie of the pieces together, and each text's sum is gathered from its words.

Of the vocabulary's pieces those of lower-case letters with at most ``MAX_PIECE`` characters are used; a letter that
is no piece has the probability ``UNKNOWN``, so longer pieces are spelt out by shorter ones.

Defined results: a text that is null or has no letter (Unicode category L) is ``und`` with score 0; a null ``doc_id`` is kept and
counts as not held out; repeated rows give repeated rows; ties go to the first language in order; an empty
table gives no rows; without any labelled document every prediction is ``und``; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import tokens
from ebbtide.llm.store import stored

VOCAB_FILE = "piece_bpe_32k.model"
BEGIN = "▁"
MAX_PIECE = 8  # longest piece taken from the vocabulary, mark included
FIT_DOCS_PER_LANG = 2000  # labelled documents per language that the model is fitted on (expected number)
EM_ROUNDS = 3
SMOOTHING = 0.1  # added to every piece's expected count
DENSE_LETTERS = 96  # letters with a column in the trie's dense table
UNKNOWN = 1e-7  # probability of a letter that is no piece
UNDECIDED = "und"
SLICE_BYTES = 8 << 20  # text whose words are scored together
WORD_BLOCK = 1 << 14  # words whose forward values are held at once
LONG_WORD = 512  # letters from which a word is scored on its own, one letter after the other
_WORD = re.compile(r"[^\W\d_]+")


def letter_runs(word: str) -> list[str]:
    """Runs of letters (Unicode category L; number characters such as a half or a circled one are none)."""
    return [r for run in _WORD.findall(word) for r in ([run] if run.isalpha() else "".join(c if c.isalpha() else " " for c in run).split())]


class Pieces:
    """A trie over the vocabulary's lower-case letter pieces, as arrays."""

    def __init__(self, path: str, max_piece: int = MAX_PIECE):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        names = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        letters = (n for n in names if n.removeprefix(BEGIN).isalpha() or n == BEGIN)
        self.names = sorted(n for n in letters if n == n.lower() and len(n) <= max_piece)
        self.longest = max(map(len, self.names))
        used = Counter(c for n in self.names for c in n)
        self.code = {c: i + 1 for i, c in enumerate(sorted(used, key=lambda c: (-used[c], c)))}  # 0: no such letter
        child: list[dict[int, int]] = [{}]
        piece = [-1]
        for i, n in enumerate(self.names):
            at = 0
            for c in n:
                if self.code[c] not in child[at]:
                    child[at][self.code[c]] = len(child)
                    child.append({})
                    piece.append(-1)
                at = child[at][self.code[c]]
            piece[at] = i
        # frequent letters have a column in a dense table, edges of the others are kept as sorted keys
        self._dense = np.full((len(child), DENSE_LETTERS + 2), -1, dtype=np.int32)
        edges = sorted((at * (len(self.code) + 1) + c, to) for at, below in enumerate(child) for c, to in below.items() if c > DENSE_LETTERS)
        self._keys, self._to = np.array([k for k, _ in edges] + [-1], np.int64), np.array([t for _, t in edges] + [-1], np.int32)
        self._keys[-1] = np.iinfo(np.int64).max
        for at, below in enumerate(child):
            for c, to in below.items():
                if c <= DENSE_LETTERS:
                    self._dense[at, c] = to
        self.piece = np.array(piece, dtype=np.int32)

    @cached_property
    def _below(self) -> list[dict[int, int]]:
        """The trie's edges by node and letter, for words that are scored one by one; most tasks have none."""
        below: list[dict[int, int]] = [{} for _ in range(len(self.piece))]
        for at, c in np.argwhere(self._dense >= 0).tolist():
            below[at][c] = int(self._dense[at, c])
        for key, to in zip(self._keys[:-1].tolist(), self._to.tolist()):
            below[key // (len(self.code) + 1)][key % (len(self.code) + 1)] = to
        return below

    def from_letter(self, codes: list[int], i: int) -> Iterator[tuple[int, int]]:
        """(length, piece) of all pieces that begin at letter ``i``."""
        at = 0
        for length in range(1, min(self.longest, len(codes) - i) + 1):
            at = self._below[at].get(codes[i + length - 1])
            if at is None:
                return
            if self.piece[at] >= 0:
                yield length, int(self.piece[at])

    def child(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The node below along a letter, -1 where there is none."""
        to = self._dense[node, np.minimum(code, DENSE_LETTERS + 1)]
        rare = np.flatnonzero(code > DENSE_LETTERS)
        if len(rare):
            key = node[rare].astype(np.int64) * (len(self.code) + 1) + code[rare]
            at = np.searchsorted(self._keys, key)
            to[rare] = np.where(self._keys[at] == key, self._to[at], -1)
        return to

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Letter codes of the marked words in one array, and the bounds of each word."""
        text = "".join(BEGIN + w for w in words)
        code = self.code
        codes = np.fromiter((code.get(c, 0) for c in text), np.int32, len(text))
        bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
        return codes, bounds


def _steps(p: Pieces, codes: np.ndarray, begin: np.ndarray, size: np.ndarray, i: int):
    """All pieces that begin at position ``i`` of the words (sorted by falling length): (length, word rows, piece)."""
    n = int(np.searchsorted(-size, -i, "left"))  # words longer than i
    rows = np.arange(n)
    node = np.zeros(n, dtype=np.int32)
    for length in range(1, p.longest + 1):
        fits = size[rows] >= i + length
        rows, node = rows[fits], node[fits]
        node = p.child(node, codes[begin[rows] + i + length - 1])
        alive = node >= 0
        if length == 1 and not alive.all():
            yield 1, rows[~alive], None
        rows, node = rows[alive], node[alive]
        if not len(rows):
            return
        piece = p.piece[node]
        ends = piece >= 0
        if length == 1 and not ends.all():
            yield 1, rows[~ends], None
        if ends.any():
            yield length, rows[ends], piece[ends]


def log_likelihoods(p: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """log P(word | language) for every word and language: the forward algorithm over all segmentations.

    ``probs`` has a row per piece and a column per language. Words go through in blocks, the longest of them one by
    one, so memory and time follow the letters, not the longest word.
    """
    out = np.empty((len(words), probs.shape[1]))
    usual = np.array([i for i, w in enumerate(words) if len(w) < LONG_WORD], np.int64)
    usual = usual[np.argsort([len(words[i]) for i in usual.tolist()], kind="stable")] if len(usual) else usual
    for a in range(0, len(usual), WORD_BLOCK):
        rows = usual[a:a + WORD_BLOCK]
        out[rows] = _together(p, probs, [words[i] for i in rows.tolist()])
    for i, w in enumerate(words):
        if len(w) >= LONG_WORD:
            out[i] = _alone(p, probs, w)
    return out


def _alone(p: Pieces, probs: np.ndarray, word: str) -> np.ndarray:
    """The forward algorithm over one long word; values in reach of a letter shrink together, in units of the one there."""
    codes = p.encoded([word])[0].tolist()
    langs, unknown = range(probs.shape[1]), [UNKNOWN] * probs.shape[1]
    known: dict[int, list[float]] = {}
    ahead = [[0.0] * len(langs) for _ in range(p.longest + 1)]  # of the letter at hand and those in reach
    ahead[0] = [1.0] * len(langs)
    scale = [0.0] * len(langs)
    for i in range(len(codes)):
        here = ahead[0]
        if min(here) < 1e-100:
            for k in langs:  # every language in units of its own
                unit = here[k]
                scale[k] += math.log(unit)
                for values in ahead:
                    values[k] /= unit
        one = False
        for length, piece in p.from_letter(codes, i):
            prob = known.get(piece)
            if prob is None:
                prob = known[piece] = probs[piece].tolist()
            one |= length == 1
            to = ahead[length]
            for k in langs:
                to[k] += here[k] * prob[k]
        if not one:
            to = ahead[1]
            for k in langs:
                to[k] += here[k] * unknown[k]
        ahead.append([0.0] * len(langs))
        del ahead[0]
    return np.log(ahead[0]) + scale


def _together(p: Pieces, probs: np.ndarray, words: list[str]) -> np.ndarray:
    """The forward algorithm over many words at once. The forward values in reach are rescaled per word as they
    shrink, so words of any length stay within range."""
    codes, bounds = p.encoded(words)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size = bounds[:-1][order], size[order]
    ring = p.longest + 1
    ahead = np.zeros((ring, len(words), probs.shape[1]))
    ahead[0] = 1.0
    scale, final = np.zeros(len(words)), np.zeros((len(words), probs.shape[1]))
    for i in range(int(size[0]) if len(size) else 0):
        here = ahead[i % ring]
        for length, rows, piece in _steps(p, codes, begin, size, i):
            ahead[(i + length) % ring, rows] += here[rows] * (UNKNOWN if piece is None else probs[piece])
        here[:] = 0
        done = slice(int(np.searchsorted(-size, -(i + 1), "left")), int(np.searchsorted(-size, -i, "left")))
        final[done] = np.log(np.maximum(ahead[(i + 1) % ring, done], 1e-300)) + scale[done, None]
        if i % 4 == 3:
            live = done.start
            top = ahead[:, :live].max(axis=(0, 2))
            ahead[:, :live] /= top[:, None]
            scale[:live] += np.log(top)
    out = np.empty_like(final)
    out[order] = final
    return out


def expected_counts(p: Pieces, probs: np.ndarray, words: list[str], lang: np.ndarray, weight: np.ndarray,
                    longest_word: int = 64) -> np.ndarray:
    """Expected use of each piece in each language (forward-backward). Words beyond ``longest_word`` letters
    are counted in parts of that length. Forward values in reach of a position are in units of the one there,
    backward values follow by the same factors, so parts of any probability stay within range."""
    parts = [(w[a:a + longest_word], k, n) for w, k, n in zip(words, lang, weight) for a in range(0, len(w), longest_word)]
    words, lang, weight = [x[0] for x in parts], np.array([x[1] for x in parts], np.int64), np.array([x[2] for x in parts], float)
    codes, bounds = p.encoded(words)
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    begin, size, lang, weight = bounds[:-1][order], size[order], lang[order], weight[order]
    width = int(size[0]) if len(size) else 0
    ahead, back = np.zeros((width + 1, len(size))), np.zeros((width + 1, len(size)))
    ahead[0] = 1.0
    back[size, np.arange(len(size))] = 1.0

    def prob(rows, piece):
        return UNKNOWN if piece is None else probs[piece, lang[rows]]

    scale = np.ones((width, len(size)))  # forward values at the positions, each in units of the one before
    live = np.searchsorted(-size, -np.arange(width), "left")  # words longer than i
    for i in range(width):
        here = slice(0, int(live[i]))
        scale[i, here] = ahead[i, here]
        ahead[i:i + p.longest, here] /= scale[i, here]
        for length, rows, piece in _steps(p, codes, begin, size, i):
            ahead[i + length, rows] += ahead[i, rows] * prob(rows, piece)
    total = ahead[size, np.arange(len(size))]
    counts = np.zeros(probs.size)
    for i in reversed(range(width)):
        for length, rows, piece in _steps(p, codes, begin, size, i):
            through = prob(rows, piece) * back[i + length, rows]
            back[i, rows] += through
            if piece is not None:
                share = weight[rows] * ahead[i, rows] * through / total[rows]
                counts += np.bincount(piece * probs.shape[1] + lang[rows], share, probs.size)
        here = slice(0, int(live[i]))
        back[i:i + p.longest, here] /= scale[i, here]
    return counts.reshape(probs.shape)


def _word_table(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct white-space separated words of the texts, the word of each place, and the bounds of each text."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = split.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(split), dtype=np.int64))])
    return flat.dictionary.to_pylist(), flat.indices.to_numpy(zero_copy_only=False), bounds


@dataclass(frozen=True)
class Model:
    langs: list[str]
    probs: np.ndarray  # piece x language
    vocab: str
    max_piece: int

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Predicts arrays of texts; one per task."""

    def __init__(self, model: Model):
        self._model = model
        self._pieces = Pieces(tokens.vocab_path(model.vocab), model.max_piece)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        words, word, bounds = _word_table(texts)
        runs = [letter_runs(w.lower()) for w in words]
        number: dict[str, int] = {}
        flat = [number.setdefault(r, len(number)) for rs in runs for r in rs]
        each = np.fromiter(map(len, runs), np.int64, len(runs))
        n_lang = len(self._model.langs)
        score = log_likelihoods(self._pieces, self._model.probs, list(number)) if number and n_lang else np.zeros((0, n_lang))
        owner = np.repeat(np.arange(len(runs)), each)
        of_word = np.stack([np.bincount(owner, score[flat, k], len(runs)) for k in range(n_lang)], axis=1) if len(score) else np.zeros((len(runs), n_lang))
        n_texts = len(bounds) - 1
        text = np.repeat(np.arange(n_texts), np.diff(bounds))
        lettered = np.bincount(text, each[word] if len(word) else None, n_texts) > 0
        if not n_lang:
            return [UNDECIDED] * n_texts, np.zeros(n_texts)
        total = np.stack([np.bincount(text, of_word[word, k], n_texts) for k in range(n_lang)], axis=1)
        best = total.argmax(axis=1)
        share = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [self._model.langs[b] if ok else UNDECIDED for b, ok in zip(best, lettered)], np.where(lettered, share, 0.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = FIT_DOCS_PER_LANG,
        rounds: int = EM_ROUNDS, vocab: str = VOCAB_FILE, max_piece: int = MAX_PIECE) -> Model:
    """Piece probabilities of every language among the labelled rows.

    Rows are sampled by a hash of the text at a rate that leaves ``docs_per_lang`` of each language in
    expectation (the documented bound of the fit; all rows of rarer languages). What reaches the driver is
    one number per piece and language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    found = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}  # one row per language
    langs = sorted(found)
    pieces = Pieces(tokens.vocab_path(vocab), max_piece)
    probs = np.full((len(pieces.names), len(langs)), 1.0 / len(pieces.names))
    if not langs:
        return Model([], probs, vocab, max_piece)
    places = 1 << 20
    rate = F.create_map(*[x for k, n in found.items() for x in (F.lit(k), F.lit(int(places * min(1.0, docs_per_lang / n))))])
    sample = rows.where(F.pmod(F.xxhash64(F.col(text_col), F.lit("fit")), F.lit(places)) < rate[F.col(lang_col)])

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in enumerate(langs)}
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                words, word, bounds = _word_table(part.column("text"))
                lang = np.repeat([place[k] for k in part.column("lang").to_pylist()], np.diff(bounds))
                counts = np.bincount(word * len(langs) + lang, minlength=len(words) * len(langs)).reshape(-1, len(langs))
                out = [(r, k, int(n)) for w, row in zip(words, counts) for r in letter_runs(w.lower()) for k, n in enumerate(row) if n]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["word", "lang", "n"])

    used = sample.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counted = stored(used.mapInArrow(count_words, "word string, lang long, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "lang-words")

    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], probs=probs) -> Iterator[pa.RecordBatch]:
            p, total = Pieces(tokens.vocab_path(vocab), max_piece), np.zeros_like(probs)
            for batch in batches:
                total += expected_counts(p, probs, batch.column("word").to_pylist(), batch.column("lang").to_numpy(), batch.column("n").to_numpy())
            at, lang = np.nonzero(total)
            yield pa.RecordBatch.from_pydict({"piece": pa.array(at, pa.int64()), "lang": pa.array(lang, pa.int64()), "n": total[at, lang]})

        sums = counted.mapInArrow(expect, "piece long, lang long, n double").groupBy("piece", "lang").agg(F.sum("n")).collect()
        counts = np.full_like(probs, SMOOTHING)
        for piece, lang, n in sums:  # at most pieces x languages rows
            counts[piece, lang] += n
        probs = counts / counts.sum(axis=0)
    return Model(langs, probs, vocab, max_piece)


def predicted(text: Column, model: Model) -> Column:
    """Struct (lang, score) of a text column."""
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("struct<lang: string, score: double>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = model.scorer()
        for part in parts:
            batch = pa.RecordBatch.from_arrays([part], ["text"])
            lang, score = [], []
            for s in tokens.slices(batch, "text", SLICE_BYTES):
                a, b = scorer.predict(s.column("text"))
                lang += a
                score.append(b)
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], ["lang", "score"])
        del scorer
        tokens.release_memory()

    return run(text)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """Query form: learns from the rows that are not held out, predicts every row."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), predicted(F.col("text"), model).alias("p"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def accepted(docs: DataFrame, model: Model, min_score: float = 0.5) -> DataFrame:
    """The rows (all columns) whose language is decided with at least ``min_score``."""
    p = predicted(F.col("text"), model)
    return docs.where((p["lang"] != UNDECIDED) & (p["score"] >= min_score))
