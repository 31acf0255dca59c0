"""Toxicity by noisy-channel deobfuscation.

1. A character trigram model is counted on all learning texts' plain words.
2. Suspicious spans (letters mixed with look-alike digits or signs, letters set apart by separators, letters repeated
   three times or more) become lattices: each written character may stand for itself, for a letter it looks like, for
   nothing (a separator), or repeat the letter before. Viterbi decoding over the last two letters finds the likeliest
   word. A span without such a character has one path, itself.
3. Features of the restored words (the word and its beginnings of 4 to 8 letters, seen once, twice or four times) that go with the label on the
   learning texts get weights by logistic regression; a text's score is the sigmoid of its features' sum.

Decoding keeps every state, that is every pair of last two letters that a path can have; none is pruned. A word's
features are itself, whole, and its beginnings.

All different labelled learning rows (id, label, text) count, in tasks that hand on sums. The driver holds the model: the
trigrams that occur and the features whose evidence is beyond chance, each with its weight; nothing of it is cut.

Cases: null and empty texts have no feature and get the model's base score. With no toxic learning row every score
is 0; with only toxic ones, the base score. Conflicting labels of one document all count; repeats of a row are each
scored but count once in learning. Texts of any length are scored whole. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, key128, materialize, tidy

#: Letters that a sign is written for (fixed values).
LOOKS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c"}
SEPARATORS = " .-_*~'`·,/\\"
_SIGNS = re.escape("".join(LOOKS))
_SEPS = re.escape(SEPARATORS)
_LETTER = r"[^\W\d_]"
#: One character apart from the next by one separator, four times or more.
_SPACED = re.compile(rf"(?<![^\s{_SEPS}])(?:{_LETTER}|[{_SIGNS}])(?:[{_SEPS}](?:{_LETTER}|[{_SIGNS}])){{3,}}(?![^\s{_SEPS}!?:;)])")
#: What every such span holds; a search for it starts at a separator, so that most texts are passed over quickly.
_APART = re.compile(rf"[{_SEPS}][\w{_SIGNS}][{_SEPS}][\w{_SIGNS}][{_SEPS}]")
#: A sign between or before letters, an inner separator, or a letter three times.
_MIXED = re.compile(rf"{_LETTER}[{_SIGNS}]+{_LETTER}|(?:^|[^\w])[{_SIGNS}]{{1,2}}{_LETTER}|({_LETTER})\1\1|{_LETTER}[*._~-]{_LETTER}")
_WORD = re.compile(rf"{_LETTER}+")
#: All that makes a plain word suspicious.
_TRIPLE = re.compile(r"(.)\1\1")
_ENDS = frozenset(".,;:!?)\"'")
_EDGE = "^"
LEAST, LONGEST = 4, 8
#: What a path pays, as a natural logarithm, to repeat a letter, read a sign as a letter, skip a separator, skip another sign.
REPEAT, LOOK, GAP, SIGN = 1.2, 0.7, 0.3, 3.0
#: A feature may also stand for so many occurrences at least: one slip is weaker evidence than a run of them.
LEVELS = (1, 2, 4)
#: Features that a task holds before it sends their counts on.
HELD = 200_000
#: Words whose features are counted at once.
CHUNK = 200_000
#: Buckets of features' hashes: what the driver gathers of features before they are counted.
BUCKETS = 1 << 21
#: Labelled rows that are broadcast; more of them meet the texts by key.
LABELS = 2_000_000


class Channel:
    """The trigram model and the lattice decoder."""

    def __init__(self, grams: dict[str, int]):
        self.grams = grams
        self.context: Counter = Counter()
        for g, n in grams.items():
            self.context[g[:2]] += n
        self.seen: dict[str, str] = {}

    def cost(self, context: str, c: str) -> float:
        return math.log((self.grams.get(context + c, 0) + 0.05) / (self.context.get(context, 0) + 3.0))

    def decode(self, span: str) -> str:
        """The likeliest word of a span; equal paths go to the one found first (the written character)."""
        # A path is (the path before, its last letter), so that a step costs the same in spans of any length.
        states: dict[str, tuple[float, tuple | None]] = {_EDGE * 2: (0.0, None)}
        for k, c in enumerate(span):
            nxt: dict[str, tuple[float, tuple | None]] = {}

            def put(state: str, score: float, out: tuple | None, nxt: dict = nxt) -> None:
                if state not in nxt or score > nxt[state][0]:
                    nxt[state] = (score, out)

            letter = c.isalpha()
            for state, (score, out) in states.items():
                if letter:
                    put(state[1] + c, score + self.cost(state, c), (out, c))
                    if k and state[1] == c:
                        put(state, score - REPEAT, out)
                for x in LOOKS.get(c, ""):
                    put(state[1] + x, score + self.cost(state, x) - LOOK, (out, x))
                    if state[1] == x:
                        put(state, score - LOOK - REPEAT, out)
                if not letter:
                    put(state, score - (GAP if c in SEPARATORS else SIGN), out)
            states = nxt
        if not states:
            return ""
        out = max(((s + self.cost(state, _EDGE), path) for state, (s, path) in states.items()), key=lambda x: x[0])[1]
        word = []
        while out is not None:
            out, c = out
            word.append(c)
        return "".join(reversed(word))

    def restore(self, span: str) -> str:
        out = self.seen.get(span)
        if out is None:
            out = self.decode(span)
            if len(self.seen) > 50_000:
                self.seen.clear()
            self.seen[span] = out
        return out


def fold(text: str) -> str:
    return text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).lower()


def chunk_words(chunk: str, channel: Channel | None) -> list[str]:
    """A white-space chunk's words, folded: those written and, where it is suspicious, the one restored."""
    c = fold(chunk)
    # Most chunks are a word, or a word and a mark, which can't make it suspicious.
    word = c[:-1] if c[-1] in _ENDS else c
    if word.isalpha():
        return [word] if channel is None or not _TRIPLE.search(word) else [word, channel.restore(c.strip("\"'()[]{}<>?:;,."))]
    words = _WORD.findall(c)
    if channel is not None and _MIXED.search(c):
        words.append(channel.restore(c.strip("\"'()[]{}<>?:;,.")))
    return words


def spaced_words(text: str, channel: Channel | None) -> list[str]:
    """The restored words of letters set apart."""
    if channel is None or not _APART.search(text):
        return []
    return [channel.restore(fold(m.group())) for m in _SPACED.finditer(text)]


def features(word: str) -> list[str]:
    return ["=" + word] + [word[:n] for n in range(LEAST, min(LONGEST, len(word)) + 1)]


class Reader:
    """A text's features among those of a model; what chunks have is kept, up to `cache` chunks."""

    def __init__(self, channel: Channel | None, names: list[tuple[str, int]], cache: int = 200_000):
        self.channel, self.cache = channel, cache
        self.index: dict[str, list[tuple[int, int]]] = {}
        for i, (f, k) in enumerate(names):
            self.index.setdefault(f, []).append((k, i))
        self.starts = {f[:LEAST] for f in self.index if f[0] != "="}
        self.whole = {f[1:] for f in self.index if f[0] == "="}
        self.seen: set[str] = set()
        self.found: dict[str, tuple[str, ...]] = {}

    def of_words(self, words: list[str]) -> tuple[str, ...]:
        # No beginning of a word is known whose first letters begin none.
        return tuple([f for w in words for f in (features(w) if w[:LEAST] in self.starts else ("=" + w,)) if f in self.index])

    def __call__(self, text: str) -> list[int]:
        """The numbers of the features that the text has, in order."""
        counts: Counter = Counter()
        chunks = text.split()
        each = set(chunks)
        new = each - self.seen
        if len(self.seen) + len(new) > self.cache:
            self.seen.clear(), self.found.clear()
            new = each
        starts, whole = self.starts, self.whole
        for c in new:
            # Most new chunks are one word that isn't suspicious and has no feature.
            word = fold(c)
            if word[-1] in _ENDS:
                word = word[:-1]
            if word.isalpha() and word[:LEAST] not in starts and word not in whole and not _TRIPLE.search(word):
                continue
            got = self.of_words(chunk_words(c, self.channel))
            if got:
                self.found[c] = got
        self.seen |= new
        # Few chunks have a feature, so that only those are counted.
        hits = self.found.keys() & each
        times = Counter(chunks) if len(hits) > 4 else {c: chunks.count(c) for c in hits}
        for c in hits:
            for f in self.found[c]:
                counts[f] += times[c]
        for f in self.of_words(spaced_words(text, self.channel)):
            counts[f] += 1
        return sorted(i for f, n in counts.items() for k, i in self.index[f] if n >= k)


class Codes(dict):
    """Numbers of keys in the order they come."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Counted:
    """Texts of each label that have a feature so often as a level says, of features whose bucket passes."""

    def __init__(self, channel: Channel, passes: np.ndarray):
        self.channel, self.passes = channel, passes.tobytes()
        self.clear()

    def clear(self) -> None:
        self.chunks, self.names = Codes(), Codes()
        #: The features of all chunks, one after the other, and where each chunk's end.
        self.flat: list[int] = []
        self.ends = [0]
        self.n = np.zeros((2, len(LEVELS), 0), np.int64)
        self.texts: list[tuple[int, np.ndarray, list[int]]] = []
        self.held = 0

    def of_words(self, words: list[str]) -> list[int]:
        return [self.names[f] for w in words for f in features(w) if self.passes[zlib.crc32(f.encode()) % BUCKETS]]

    def add(self, y: int, text: str) -> None:
        chunks = text.split()
        at = np.fromiter(map(self.chunks.__getitem__, chunks), np.int64, len(chunks))
        self.texts.append((y, at, self.of_words(spaced_words(text, self.channel))))
        self.held += len(at)
        if self.held > CHUNK:
            self.count()

    def count(self) -> None:
        """Bring the counts up to date."""
        if not self.texts:
            return
        for c in list(self.chunks)[len(self.ends) - 1 :]:
            self.flat += self.of_words(chunk_words(c, self.channel))
            self.ends.append(len(self.flat))
        flat, ends = np.array(self.flat, np.int64), np.array(self.ends, np.int64)
        at, size = np.concatenate([x for _, x, _ in self.texts]), len(self.names)
        more = ends[at + 1] - ends[at]
        # Each word's features: its place in the flat list, and from there on as many as it has.
        place = np.arange(more.sum()) + np.repeat(ends[at] - np.cumsum(more) + more, more)
        text = np.repeat(np.repeat(np.arange(len(self.texts)), [len(x) for _, x, _ in self.texts]), more)
        extra = [(i, f) for i, (_, _, apart) in enumerate(self.texts) for f in apart]
        keys = np.concatenate([text * size + flat[place], np.array([i * size + f for i, f in extra], np.int64)])
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        times, keys = np.diff(first, append=len(keys)), keys[first]
        toxic = np.array([y for y, _, _ in self.texts])[keys // max(size, 1)]
        self.n = np.pad(self.n, ((0, 0), (0, 0), (0, size - self.n.shape[2])))
        for y in (0, 1):
            for j, k in enumerate(LEVELS):
                self.n[y, j] += np.bincount(keys[(toxic == y) & (times >= k)] % max(size, 1), minlength=size)
        self.texts, self.held = [], 0

    def frames(self) -> Iterator[pd.DataFrame]:
        """(f, k, t, c): toxic and other texts with a feature at a level."""
        self.count()
        names = np.array(list(self.names), object)
        for j, k in enumerate(LEVELS):
            some = np.flatnonzero(self.n[:, j].sum(0))
            if len(some):  # Arrow takes no frame of strings without a row
                yield pd.DataFrame({"f": names[some], "k": k, "t": self.n[1, j, some], "c": self.n[0, j, some]}).astype({"k": "int64"})


class Model:
    def __init__(self, grams: dict[str, int], names: list[tuple[str, int]], weights: np.ndarray, base: float):
        self.grams, self.names, self.weights, self.base = grams, names, weights, base

    def score(self, found: list[int]) -> float:
        if self.base == -math.inf:
            return 0.0
        z = self.base + float(self.weights[found].sum()) if found else self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def regress(rows: DataFrame, n: int, decay: float = 0.02, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression over rows (y, f: numbers of features under n, times), of both classes; nothing of them reaches the driver."""
    names = CountVectorizerModel.from_vocabulary([str(i) for i in range(n)], "f", "x")
    data = names.setBinary(True).transform(rows.select("y", F.col("f").cast("array<string>").alias("f"), F.col("times").cast("double").alias("times"))).drop("f")
    # Spark's loss is a mean over rows, so that the penalty of the sum is divided by them.
    many = rows.agg(F.sum("times")).first()[0]
    fitted = LogisticRegression(featuresCol="x", labelCol="y", weightCol="times", regParam=decay / many, standardization=False, maxIter=rounds).fit(data)
    return fitted.coefficients.toArray(), float(fitted.intercept)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Learn from all different labelled rows (labels: id, toxic); docs and labels hold learning rows only."""
    able = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), (F.col("toxic") != 0).cast("int").alias("y")).distinct()
    if able.count() <= LABELS:
        able = F.broadcast(able)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(able, "id")
    rows = rows.select("*", *key128(F.col("text"))).dropDuplicates(["id", "y", "h1", "h2"])
    sample = materialize(rows.select("y", "text"), "toxfit")
    n, toxic = sample.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic:
        return Model({}, [], np.zeros(0), -math.inf)

    def count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter = Counter()
        for b in batches:
            words: Counter = Counter()
            for t in b["text"]:
                words.update(_WORD.findall(t.lower()))
            for w, k in words.items():
                s = _EDGE * 2 + w + _EDGE
                for i in range(len(w) + 1):
                    c[s[i : i + 3]] += k
                if len(c) > HELD:
                    yield pd.DataFrame({"g": list(c), "n": list(c.values())}).astype({"n": "int64"})
                    c.clear()
        if c:
            yield pd.DataFrame({"g": list(c), "n": list(c.values())}).astype({"n": "int64"})

    grams = sample.mapInPandas(tidy("toxicity", count_grams), "g string, n long").groupBy("g").agg(F.sum("n").alias("n"))
    grams = dict(grams.toPandas().itertuples(index=False, name=None))

    def read_counts(batches: Iterator[pd.DataFrame], passes: np.ndarray) -> Iterator[pd.DataFrame]:
        found = Counted(Channel(grams), passes)
        for b in batches:
            for y, t in zip(b["y"], b["text"], strict=True):
                found.add(y, t)
                if len(found.names) > HELD or len(found.chunks) > HELD:
                    yield from found.frames()
                    found.clear()
        yield from found.frames()

    def counted_by(rows: DataFrame, passes: np.ndarray) -> DataFrame:
        found = rows.mapInPandas(tidy("toxicity", lambda batches: read_counts(batches, passes)), "f string, k long, t long, c long")
        return found.groupBy("f", "k").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))

    # Features of two toxic texts or more can be chosen, so that those of other buckets than theirs need no count. A bucket
    # only says what can't be chosen: features that share one are all counted by themselves.
    twice = counted_by(sample.where("y = 1"), np.ones(BUCKETS, bool)).where("k = 1 AND t >= 2")
    passes = np.zeros(BUCKETS, bool)
    passes[twice.select((F.crc32(F.col("f").cast("binary")) % BUCKETS).alias("at")).distinct().toPandas()["at"].to_numpy("int64")] = True
    counted = counted_by(sample, passes)
    # Evidence: the log likelihood ratio of a feature's own share of toxic texts against the sample's. Chance alone
    # brings some of the tested features up to about the logarithm of their number.
    share = min(toxic / n, 1 - 1 / (n + 1))
    t, c = F.col("t"), F.col("c")
    part = lambda k, p: F.when(k > 0, k * F.log(k / ((t + c) * F.lit(p)))).otherwise(0.0)
    counted = materialize(counted.where("t >= 2").withColumn("evidence", part(t, share) + part(c, 1 - share)), "toxfeatures")
    tested = max(1, counted.count())
    chosen = counted.where((t / (t + c) > share) & (F.col("evidence") > math.log(tested) + 1))
    names = [(r["f"], r["k"]) for r in chosen.orderBy(F.desc("evidence"), "f", "k").collect()]  # the model itself: features beyond chance

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Channel(grams), names)
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "f": [reader(t) for t in b["text"]]})

    if not names or toxic == n:
        return Model(grams, names, np.zeros(len(names)), math.log((toxic + 0.5) / (n - toxic + 0.5)))
    rows = sample.mapInPandas(tidy("toxicity", read), "y int, f array<int>").groupBy("y", "f").agg(F.count("*").alias("times"))
    weights, base = regress(materialize(rows, "toxrows"), len(names))
    return Model(grams, names, weights, base)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carried columns, score) for every row; a carried column of any name but the others' works."""
    kept = (id_col, *carry)
    if len({c.lower() for c in (*kept, "score")}) <= len(kept):
        raise ValueError("carried columns must differ from each other, the id and score")
    names = [f"c{k}" for k in range(len(kept))]
    fields = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for n, c in zip(names, kept, strict=True))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(Channel(model.grams), model.names)
        for b in batches:
            yield b[names].assign(score=[model.score(reader(t) if isinstance(t, str) else []) for t in b["text"]])

    rows = docs.select(*[F.col(c).alias(n) for n, c in zip(names, kept, strict=True)], F.col(text_col).alias("text"))
    return rows.mapInPandas(tidy("toxicity", run), f"{fields}, score double").toDF(*kept, "score")


def score_column(model: Model):
    """The score of a text column, as an Arrow-batched function to filter by."""

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = Reader(Channel(model.grams), model.names)
        for texts in batches:
            yield pd.Series([model.score(reader(t) if isinstance(t, str) else []) for t in texts], dtype="float64")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from tidy("toxicity", score)(batches)

    return F.pandas_udf(run, "double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; learns from those whose crc32(doc_id) mod 4 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    held = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held), labels.where(~held))
    return score_texts(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
