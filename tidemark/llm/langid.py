"""Language ID by segmentation-marginalised unigrams.

Pieces come from a fixed public vocabulary (the path of a sentencepiece model is a parameter). Each language has a
probability for every piece; a word's likelihood is the sum over all ways to cut it into pieces, computed by the
forward algorithm for all languages and a whole batch of words at once. The probabilities are fitted by expectation
maximisation (forward and backward sums give the expected piece counts) on a bounded sample: the `fit_rows` different
learning rows (id, language, text) of least hash. Expected counts are summed on the executors; the driver holds pieces
x languages numbers.

A word is a letter followed by letters and marks, lower-cased and NFC; a text's log likelihood is the sum over all
its words, the prior is even, and the score is the posterior of the predicted language.

Cases: a null text or one without a letter is `und` with score 0. With no learning rows every text is `und`. Ties go
to the language that comes first by name. Letters outside the vocabulary have one small fixed probability. Words of
any length work, in learning as in scoring: sums are rescaled as they go. Repeated rows are each predicted; in learning,
repeats of a row count once. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, materialize, tidy, worker_cache

_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MARK = "▁"
#: Probability of a letter that no piece holds.
RARE = 1e-7


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters, with or without the mark of a word's start, lower case only."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return sorted({p for p in found if _WORD.fullmatch(p.lstrip(MARK) or "1") and p == p.lower()})


class Pieces:
    """The vocabulary by length, as sorted 64-bit hashes: a whole batch of substrings is looked up at once."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, vocab: list[str]):
        self.n = len(vocab)  # number n stands for a letter that no piece holds, n + 1 for no piece
        by: dict[int, list[tuple[int, int]]] = {}
        for i, p in enumerate(vocab):
            h = 0
            for c in p:
                h = (h * self.BASE + ord(c) + 1) & (1 << 64) - 1
            by.setdefault(len(p), []).append((h, i))
        self.longest = max(by, default=1)
        self.tables = {k: (np.array([h for h, _ in sorted(v)], np.uint64), np.array([i for _, i in sorted(v)], np.int64)) for k, v in by.items()}

    def edges(self, words: list[str]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """For words of one length: (stop, length) -> (words, pieces) of the pieces that fit there."""
        size = len(words[0]) + 1
        code = np.empty((len(words), size), np.uint64)
        code[:, 0] = ord(MARK) + 1
        code[:, 1:] = np.array(words, f"U{size - 1}").view(np.uint32).reshape(len(words), size - 1)
        code[:, 1:] += np.uint64(1)
        base = np.uint64(self.BASE)
        pre, power = [np.zeros(len(words), np.uint64)], [np.uint64(1)]
        with np.errstate(over="ignore"):
            for j in range(size):
                pre.append(pre[-1] * base + code[:, j])
                power.append(power[-1] * base)
            out = {}
            for k, (hashes, ids) in self.tables.items():
                for j in range(k, size + 1):
                    h = pre[j] - pre[j - k] * power[k]
                    at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
                    hit = np.flatnonzero(hashes[at] == h)
                    if len(hit):
                        out[j, k] = (hit, ids[at[hit]])
        everyone = np.arange(len(words))
        for j in range(1, size + 1):
            hit, ids = out.get((j, 1), (everyone[:0], everyone[:0]))
            rest = np.setdiff1d(everyone, hit, assume_unique=True)
            if len(rest):
                out[j, 1] = (np.concatenate([hit, rest]), np.concatenate([ids, np.full(len(rest), self.n)]))
        return out


_PIECES: dict[str, Pieces] = worker_cache()


def pieces(path: str) -> Pieces:
    """The vocabulary's tables, once a worker process."""
    if path not in _PIECES:
        _PIECES[path] = Pieces(load_pieces(path))
    return _PIECES[path]


class Lattice:
    """All cuts of a batch of words of one length into pieces.

    Position j's sum is kept relative to a running scale, so that neither long words nor rare letters underflow.
    """

    def __init__(self, words: list[str], pieces: Pieces):
        self.size, self.k = len(words[0]) + 1, len(words)
        self.long, self.longest = self.size >= 32, pieces.longest
        edges = pieces.edges(words)
        self.into = [[(k, *edges[j, k]) for k in range(1, min(j, pieces.longest) + 1) if (j, k) in edges] for j in range(self.size + 1)]

    def forward(self, prob: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """(sums by position, each times exp(-scale of the position); log likelihoods [word, language])."""
        shape = (self.k, prob.shape[1])
        alpha, scale, self.scales = [np.ones(shape)], np.zeros(shape), [np.zeros(shape)]
        for j in range(1, self.size + 1):
            now = np.zeros(shape)
            for k, w, p in self.into[j]:
                got = alpha[j - k][w] * prob[p]
                if j - k:
                    got *= np.exp(self.scales[j - k][w] - scale[w]) if j > 32 else 1
                now[w] += got
            if j >= 32:
                # Long words: keep each position near one and remember by how much.
                m = np.maximum(now, 1e-300)
                scale = scale + np.log(m)
                now = now / m
                self.scales.append(scale)
            else:
                self.scales.append(scale)
            alpha.append(now)
        return alpha, np.log(np.maximum(alpha[-1], 1e-300)) + self.scales[-1]

    def backward(self, prob: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(sums by position, each times exp(-scale of the position); the scales)."""
        shape = (self.k, prob.shape[1])
        out: list[list] = [[] for _ in range(self.size + 1)]
        for j, into in enumerate(self.into):
            for k, w, p in into:
                out[j - k].append((k, w, p))
        beta, scales = [np.ones(shape)] * (self.size + 1), [np.zeros(shape)] * (self.size + 1)
        for i in range(self.size - 1, -1, -1):
            now, scale = np.zeros(shape), scales[i + 1]
            for k, w, p in out[i]:
                got = prob[p] * beta[i + k][w]
                if self.long and k > 1:
                    got *= np.exp(scales[i + k][w] - scale[w])
                now[w] += got
            if self.long:
                m = np.maximum(now, 1e-300)
                scale, now = scale + np.log(m), now / m
            beta[i], scales[i] = now, scale
        return beta, scales

    def expected(self, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts [piece, language], words weighted by weight[word, language]."""
        alpha, total = self.forward(prob)
        beta, scales = self.backward(prob)
        out = np.zeros_like(prob)
        unit = weight / np.maximum(alpha[-1], 1e-300)
        for j in range(self.size, 0, -1):
            if self.long:
                unit = [weight * np.exp(np.minimum(self.scales[j - k] + scales[j] - total, 700)) for k in range(1, min(j, self.longest) + 1)]
            for k, w, p in self.into[j]:
                share = alpha[j - k][w] * prob[p] * beta[j][w] * (unit[k - 1] if self.long else unit)[w]
                for x in range(prob.shape[1]):
                    out[:, x] += np.bincount(p, share[:, x], minlength=len(out))
        return out


def by_size(words: list[str], most: int = 400_000) -> Iterator[list[str]]:
    """Batches of words of one length whose tables stay small; one very long word makes a batch by itself."""
    run: list[str] = []
    for w in sorted(words, key=len):
        if run and (len(run[0]) != len(w) or len(run) * (len(w) + 2) > most):
            yield run
            run = []
        run.append(w)
    if run:
        yield run


class Scorer:
    """Log likelihoods by white-space chunk and by word, kept in caches of bounded size."""

    def __init__(self, pieces: Pieces, prob: np.ndarray, cache: int = 300_000):
        self.pieces, self.prob, self.cache = pieces, prob, cache
        self.chunks: dict[str, int] = {}
        self.words: dict[str, int] = {}
        self.chunk_rows = np.zeros((0, prob.shape[1] + 1))
        self.word_rows = np.zeros((0, prob.shape[1]))

    def _words(self, words: list[str]) -> None:
        """Score words not seen before."""
        add = []
        for some in by_size(words):
            add.append(Lattice(some, self.pieces).forward(self.prob)[1])
            self.words.update(zip(some, range(len(self.words), len(self.words) + len(some)), strict=True))
        self.word_rows = np.concatenate([self.word_rows, *add])

    def _chunks(self, chunks: list[str]) -> None:
        found = [_WORD.findall(unicodedata.normalize("NFC", c).lower()) for c in chunks]
        if len(self.words) > self.cache:
            self.words, self.word_rows = {}, self.word_rows[:0]
        self._words(list({w for ws in found for w in ws if w not in self.words}))
        size = np.fromiter(map(len, found), np.int64, len(found))
        at = np.fromiter((self.words[w] for ws in found for w in ws), np.int64, int(size.sum()))
        add = np.zeros((len(chunks), self.prob.shape[1] + 1))
        add[:, -1] = size
        owner = np.repeat(np.arange(len(chunks)), size)
        for x in range(self.prob.shape[1]):
            add[:, x] = np.bincount(owner, self.word_rows[at, x], len(chunks))
        n = len(self.chunks)
        self.chunks.update(zip(chunks, range(n, n + len(chunks)), strict=True))
        self.chunk_rows = np.concatenate([self.chunk_rows, add])

    def texts(self, texts: list[str]) -> np.ndarray:
        """[text, language] log likelihoods, with the number of words as the last column."""
        cut = [t.split() for t in texts]
        if len(self.chunks) > self.cache:
            self.chunks, self.chunk_rows = {}, self.chunk_rows[:0]
        todo = list({c for doc in cut for c in doc if c not in self.chunks})
        if todo:
            self._chunks(todo)
        size = np.fromiter(map(len, cut), np.int64, len(cut))
        at = np.fromiter((k for c in cut for k in map(self.chunks.__getitem__, c)), np.int64, int(size.sum()))
        owner = np.repeat(np.arange(len(cut)), size)
        return np.stack([np.bincount(owner, self.chunk_rows[at, x], len(cut)) for x in range(self.prob.shape[1] + 1)], 1)


def runs(texts: list[str], most: int = 400_000) -> Iterator[list[str]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def fit(rows: DataFrame, path: str, fit_rows: int = 4_000, rounds: int = 3, id_col: str = "doc_id") -> tuple[list[str], np.ndarray]:
    """(languages, prob[piece, language]) from rows (id, text, lang), by EM on the fit_rows of least hash."""
    vocab_size = pieces(path).n
    able = rows.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col(id_col).alias("id"), "lang", "text")
    sample = bounded_sample(able, 11, ["id", "lang", "text"], fit_rows)
    sample = materialize(sample.select("lang", "text").repartition(max(2, fit_rows // 500)), "langfit")
    langs = sorted(r[0] for r in sample.select("lang").distinct().collect())
    if not langs:
        return [], np.zeros((vocab_size + 1, 0))
    place = {x: i for i, x in enumerate(langs)}
    prob = np.full((vocab_size + 1, len(langs)), 1.0 / vocab_size)
    prob[-1] = RARE
    for _ in range(rounds):

        def expect(batches: Iterator[pd.DataFrame], prob: np.ndarray = prob) -> Iterator[pd.DataFrame]:
            out = np.zeros_like(prob)
            for b in batches:
                counts: dict[str, Counter] = {}
                for x, t in zip(b["lang"], b["text"], strict=True):
                    counts.setdefault(x, Counter()).update(_WORD.findall(unicodedata.normalize("NFC", t).lower()))
                for some in by_size(list({w for c in counts.values() for w in c})):
                    weight = np.zeros((len(some), prob.shape[1]))
                    for x, c in counts.items():
                        weight[:, place[x]] = [c[w] for w in some]
                    out += Lattice(some, pieces(path)).expected(prob, weight)
            p, k = np.nonzero(out)
            yield pd.DataFrame({"p": p, "k": k, "n": out[p, k]})

        got = sample.mapInPandas(tidy("langid", expect), "p long, k long, n double").groupBy("p", "k").agg(F.sum("n").alias("n")).toPandas()
        count = np.zeros_like(prob)
        count[got["p"], got["k"]] = got["n"]
        count[-1] = 0
        prob = (count + 0.01) / (count + 0.01).sum(0)
        prob[-1] = RARE
    return langs, prob


def predict(docs: DataFrame, langs: list[str], prob: np.ndarray, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row of docs."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(pieces(path), prob)
        for b in batches:
            texts = [t if isinstance(t, str) else "" for t in b["_text"]]
            pred, score = [], []
            for some in runs(texts):
                got = scorer.texts(some)
                for row in got:
                    if not row[-1] or not langs:
                        pred.append("und")
                        score.append(0.0)
                        continue
                    k = int(np.argmax(row[:-1]))
                    pred.append(langs[k])
                    score.append(float(1 / np.exp(row[:-1] - row[k]).sum()))
            yield pd.DataFrame({id_col: b[id_col].array, "lang_pred": pred, "score": score})

    return docs.select(id_col, F.col(text_col).alias("_text")).mapInPandas(tidy("langid", run), f"`{id_col}` {kind}, lang_pred string, score double")


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; learns from those whose crc32(doc_id) mod 3 is not 1."""
    import public_tokenizers

    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    langs, prob = fit(docs.where(~held), path)
    return predict(docs, langs, prob, path).select("doc_id", held.alias("held_out"), "lang_pred", "score")
