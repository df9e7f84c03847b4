"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. A word may be cut into
pieces in many ways; a forward pass sums the probability of all of them, so no tokeniser's choice of
one segmentation decides. The probabilities are fitted by expectation maximisation over the same
lattice. A text's log-likelihood is the sum over its words; the posterior under equal priors picks the
language.

A word is a letter with the letters and combining marks that follow it (Unicode classes L and M), in lower
case; numbers such as ``½`` or ``Ⅳ`` are no letters. Fitting takes a bounded sample of labelled rows
(``per_lang`` documents of each language on average, the ``words_per_lang`` most frequent words of each
language); scoring takes every letter of every text and all letter pieces of the vocabulary, however long
the word. Words over ``SPAN`` letters, as in scripts without blanks, are scored by a running forward pass
that keeps only the last ends and their scale; for fitting they are cut into spans, of which the first alone
has the word mark. A null text, or one without letters, is ``und`` with score 0, as is every text if nothing
could be learned. Equal likelihoods go to the language that comes first by name. Repeated rows get equal
results, empty tables give empty tables, and columns named like the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from wellspan.llm.common import LATIN_LETTERS, fold, free_name, is_latin, map_batches, spread_key, table, texts

SPAN = 24  # longer words get the running pass
MARK = "▁"
SHORT = 6  # pieces up to this length are looked up at every place
FLOOR = 1e-8  # probability of a letter that no piece covers
LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
LATIN = re.compile(f"[{LATIN_LETTERS}]+")
PIECE = regex.compile(rf"{MARK}?+[\p{{L}}\p{{M}}]*+")
UND = "und"


def words_of(text: str) -> list[str]:
    low = text.lower()
    return LATIN.findall(low) if is_latin(low) else LETTERS.findall(low)


def spans_of(word: str) -> list[str]:
    """The word with its mark, in spans of at most ``SPAN`` letters, of which the first alone has the mark."""
    return [MARK + word[:SPAN], *(word[i:i + SPAN] for i in range(SPAN, len(word), SPAN))]


def read_pieces(path: str) -> list[str]:
    """All pieces of letters and combining marks, with or without the word mark, in lower case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p and PIECE.fullmatch(p))


class Lattice:
    """Piece numbers of all substrings of words, and sums over all segmentations.

    Words are given as spans of characters that start with the word mark, or without it where a longer word goes on.
    """

    def __init__(self, pieces: list[str]):
        self.number = {p: i + 1 for i, p in enumerate(pieces)}  # 0: no piece, size - 1: an uncovered letter
        self.size = len(pieces) + 2
        self.longest = max(map(len, pieces), default=1)
        self.tails = {p[-SHORT:] for p in pieces if len(p) > SHORT}  # few places end like a long piece

    def ending(self, places: list[tuple[str, int]]) -> np.ndarray:
        """[place, length - 1]: the piece that ends before each (span, place)."""
        get, tails, other = self.number.get, self.tails, self.size - 1
        out = np.zeros((len(places), max(SHORT, self.longest)), np.int32)
        out[:, :SHORT] = [[get(w[j - k:j], 0) if k <= j else 0 for k in range(1, SHORT + 1)] for w, j in places]
        out[:, 0] = np.where(out[:, 0] == 0, other, out[:, 0])
        for i, (w, j) in enumerate(places):
            if j > SHORT and w[j - SHORT:j] in tails:
                for k in range(SHORT + 1, min(j, self.longest) + 1):
                    out[i, k - 1] = get(w[j - k:j], 0)
        return out

    def edges(self, spans: list[str]) -> np.ndarray:
        """[span, end, length - 1]: the piece that ends there; spans have equal lengths."""
        n = len(spans[0])
        return self.ending([(w, j) for w in spans for j in range(1, n + 1)]).reshape(len(spans), n, -1)

    def lengths(self, edges: np.ndarray) -> list[list[int]]:
        """For every end the lengths of which at least one span has a piece."""
        return [(np.flatnonzero(used) + 1).tolist() for used in edges.any(axis=0)]

    def forward(self, edges: np.ndarray, p: np.ndarray) -> np.ndarray:
        """[end, span, language]: probability of all ways to reach an end. ``p``: [piece, language]."""
        spans, n, _ = edges.shape
        alpha = np.zeros((n + 1, spans, p.shape[1]))
        alpha[0] = 1.0
        for j, lengths in enumerate(self.lengths(edges), 1):
            for k in lengths:
                alpha[j] += alpha[j - k] * p[edges[:, j - 1, k - 1]]
        return alpha

    def running(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language]: logarithms for words of any lengths; memory grows with the words, not their letters."""
        order = sorted(range(len(words)), key=lambda i: -len(words[i]))
        spans = [MARK + words[i] for i in order]
        last = np.zeros((self.longest, len(spans), p.shape[1]))  # at k - 1: the end k places back
        last[0] = 1.0
        scale, out = np.zeros((len(spans), p.shape[1])), np.empty((len(spans), p.shape[1]))
        going = len(spans)
        for j in range(1, len(spans[0]) + 1):
            e = self.ending([(w, j) for w in spans[:going]])
            new = np.zeros((going, p.shape[1]))
            for k in (np.flatnonzero(e.any(axis=0)) + 1).tolist():
                new += last[k - 1, :going] * p[e[:, k - 1]]
            # ends are kept relative to the newest one, whose own size goes to the scale
            scale[:going] += np.log(new)
            last[1:, :going] = last[:-1, :going] / new
            last[0, :going] = 1.0
            while going and len(spans[going - 1]) == j:
                going -= 1
                out[order[going]] = scale[going]
        return out

    def log_likelihood(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """[word, language], for words of any lengths."""
        out = np.empty((len(words), p.shape[1]))
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_length.setdefault(min(len(w), SPAN + 1), []).append(i)
        for length, own in by_length.items():
            for at in range(0, len(own), 4096):
                part = own[at:at + 4096]
                if length > SPAN:
                    out[part] = self.running([words[i] for i in part], p)
                else:
                    out[part] = np.log(self.forward(self.edges([MARK + words[i] for i in part]), p)[-1])
        return out

    def expected_counts(self, edges: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in one language's spans, summed over all segmentations."""
        counts = np.zeros(self.size)
        spans, n, _ = edges.shape
        lengths = self.lengths(edges)
        alpha = self.forward(edges, p[:, None])[:, :, 0]
        beta = np.zeros((n + 1, spans))
        beta[n] = 1.0
        for j in range(n, 0, -1):
            for k in lengths[j - 1]:
                beta[j - k] += p[edges[:, j - 1, k - 1]] * beta[j]
        share = weight / alpha[n]
        for j in range(1, n + 1):
            for k in lengths[j - 1]:
                e = edges[:, j - 1, k - 1]
                counts += np.bincount(e, alpha[j - k] * p[e] * beta[j] * share, self.size)
        counts[0] = 0
        return counts


@dataclass
class LanguageModel:
    pieces: list[str]
    langs: list[str]
    p: np.ndarray  # [piece, language]

    @staticmethod
    def fit(pieces: list[str], counts: dict[str, dict[str, int]], rounds: int = 3) -> "LanguageModel":
        """``counts``: words and how often, by language."""
        lattice = Lattice(pieces)
        langs = sorted(lang for lang, words in counts.items() if words)
        p = np.full((lattice.size, max(1, len(langs))), FLOOR)
        for i, lang in enumerate(langs):
            spans: dict[int, Counter] = {}
            for w, n in counts[lang].items():
                for part in spans_of(w):
                    spans.setdefault(len(part), Counter())[part] += n
            cut = [(lattice.edges(list(c)), np.array(list(c.values()), float)) for c in spans.values()]
            own = np.full(lattice.size, 1.0 / lattice.size)
            own[0], own[-1] = 0.0, FLOOR
            for _ in range(rounds):
                c = sum(lattice.expected_counts(edges, weight, own) for edges, weight in cut) + 0.01
                c[0] = 0.0
                own = c / c.sum()
                own[0], own[-1] = 0.0, FLOOR
            p[:, i] = own
        p[0] = 0.0
        return LanguageModel(pieces, langs, p)


class Scorer:
    def __init__(self, model: LanguageModel, remember: int = 300_000):
        self.model, self.lattice, self.remember = model, Lattice(model.pieces), remember
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.known = np.empty((0, len(self.model.langs)))

    def predict(self, batch: list[str]) -> tuple[list[str], list[float]]:
        langs = self.model.langs
        if not langs:
            return [UND] * len(batch), [0.0] * len(batch)
        if len(self.at) > self.remember:
            self.forget()
        found = [words_of(t) for t in batch]
        new = [w for w in set().union(*found) if w not in self.at]
        long = [w for w in new if len(w) > SPAN]  # remembered for this batch only
        if long:
            new = [w for w in new if len(w) <= SPAN] + long
        if new:
            self.known = np.concatenate([self.known, self.lattice.log_likelihood(new, self.model.p)])
            start = len(self.at)
            self.at.update(zip(new, range(start, start + len(new))))
        names, scores = [], []
        for words in found:
            if not words:
                names.append(UND)
                scores.append(0.0)
                continue
            ll = self.known[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
            best = int(ll.argmax())
            names.append(langs[best])
            scores.append(float(1.0 / np.exp(ll - ll[best]).sum()))
        if long:
            for w in long:
                del self.at[w]
            self.known = self.known[:len(self.at)]
        return names, scores


def fit(labelled: DataFrame, path: str, text: str = "text", lang: str = "lang", key: str = "doc_id",
        per_lang: int = 400, words_per_lang: int = 60_000) -> LanguageModel:
    """Learn all languages of the rows with a language and a text; the sample depends on ``key`` and ``text`` only.

    The driver gets one row a language and at most ``words_per_lang`` words of each.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = rows.groupBy(lang).count().orderBy(lang).collect()
    pieces = read_pieces(path)
    if not sizes:
        return LanguageModel.fit(pieces, {})
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r[lang], min(1 << 20, int(per_lang / r["count"] * (1 << 20)) + 1))])
    sample = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"),
                         spread_key(key, text).alias("_at")).where(F.col("_at") < share[F.col("lang")])

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts: Counter = Counter()
            for t, name in zip(texts(batch, "text"), batch.column("lang").to_pylist()):
                counts.update((name, w) for w in words_of(t))
            names, words = zip(*counts) if counts else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()), pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())],
                ["lang", "word", "n"])

        return step

    counted = map_batches(sample, make, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found: dict[str, dict[str, int]] = {}
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "word")  # ranked in part before the shuffle
    ranked = counted.withColumn("at", F.row_number().over(order)).where(F.col("at") <= words_per_lang).toArrow()
    for name, word, n in zip(*(ranked.column(c).to_pylist() for c in ("lang", "word", "n"))):
        found.setdefault(name, {})[word] = n
    return LanguageModel.fit(pieces, found)


def predict(df: DataFrame, model: LanguageModel, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``df`` plus the language and its posterior (0 to 1); columns of those names are replaced."""
    kept = [c for c in df.columns if c not in (lang_pred, score)]
    source = df.select(*kept)
    schema = StructType(source.schema.fields + [StructField(lang_pred, StringType()), StructField(score, DoubleType())])
    sent = df.sparkSession.sparkContext.broadcast(model)  # size: pieces times languages

    def make():
        if sent.value is not _KEPT.get("model"):
            _KEPT.update(model=sent.value, scorer=Scorer(sent.value))
        scorer = _KEPT["scorer"]

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, scores = scorer.predict(texts(batch, text))
            return pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                [*kept, lang_pred, score])

        return step

    return map_batches(source, make, schema)


_KEPT: dict = {}


def keep(df: DataFrame, model: LanguageModel, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows whose language is known with a posterior of at least ``least``; columns as before."""
    lang_pred, score = free_name(df, "lang_pred"), free_name(df, "score")
    return predict(df, model, text, lang_pred, score).where((F.col(lang_pred) != UND) & (F.col(score) >= least)).select(*df.columns)


def op1_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = fold("doc_id", 3)
    model = fit(docs.where(part != 1), public_tokenizers.path("piece_bpe_32k.model"))
    return predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(part == 1, F.lit(True)).alias("held_out"), "lang_pred", "score")
