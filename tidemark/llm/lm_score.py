"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

Tokens are the words [^\\x20\\x09-\\x0D]+ of a text after A-Z are lower-cased, then one end. With c, N, V the token's
count, all tokens and the distinct tokens of the learning texts, the base model is log10((c + 0.1) / (N + 0.1 (V + 1))).

The model is P(word | history) = P(class | history) * P(symbol | class, history) * P(word | symbol):
- A symbol is one of the TOP commonest words, or stands for all other words of a class.
- P(class | history) is a softmax over classes. Its features are hashed n-grams and skip-grams of the two tokens before,
  as symbols (so the common words by themselves) and as classes: the last, the last two, the last but one, and mixtures.
- P(symbol | class, history) is a softmax over the class's symbols with hashed features of the same history: the last,
  the last but one, and the classes of both.
- P(word | symbol) = (c + 0.1) / (N_rest + 0.1 (V_rest + 1)) among the other words of a class, with one slot a class for
  words never seen; a common word is all of its symbol.
So probabilities over all words and unknown slots sum to one after any history. Both softmaxes are trained by gradient
updates over all histories of the learning texts: each round, tasks take the observed minus the expected count of every
feature row over their share of the histories, and the driver sums these tables of fixed size and makes the step.

Classes come from word endings (hashed into KEYS keys) that are clustered by what stands beside them. Those neighbour
counts, at most KEYS * KEYS cells a task and in all, cover all learning texts, as do the counts of tokens and of symbols
after each pair of symbols.

A text's sum of log10(c + 0.1) takes the counts of the `frequent` commonest tokens (a table of bounded size) from a
broadcast, those of all others from a join; nothing of the vocabulary's size is ever held in one place.

Cases: null and empty texts are one end token. With no learning row, c, N and V are 0 and both scores follow the same
formulas. Rows of a null id are learning rows. Repeated rows count, and are scored, each by itself. Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tidy

#: Hashed endings, the last of them for the end; classes, the last of them for the end; words that are symbols of their own.
KEYS, CLASSES, TOP = 1024, 32, 128
#: Symbols: a class's other words have the class's number, common words those after; START stands before a text.
SYMBOLS = CLASSES + TOP
START, WIDE = SYMBOLS, SYMBOLS + 1
#: Rows of the weight tables over classes and over the symbols of a class.
ROWS, INNER = 1 << 13, 1 << 10
END = b"\n"
ALPHA = 0.1
#: Tokens that are counted at once, and scored at once.
CHUNK, AT_ONCE = 1_000_000, 200_000


def key_of(word: bytes) -> int:
    return KEYS - 1 if word == END else zlib.crc32(word.rstrip(b".,;:!?)\"'")[-3:]) % (KEYS - 1)


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


class Codes(dict):
    """Words to numbers; a new word's hash and ending key are noted."""

    def __init__(self) -> None:
        self.hash: list[int] = []
        self.key: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.hash.append(_hash(word))
        self.key.append(key_of(word))
        return n


class Tokens:
    """Token to place in growing arrays of hash and ending key; full() says when to start afresh."""

    def __init__(self, most: int = 300_000):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.codes = Codes()
        self.hash, self.key = np.empty(0, np.int64), np.empty(0, np.int64)

    def full(self) -> bool:
        return len(self.codes) > self.most

    def __call__(self, text: object) -> np.ndarray:
        words = text.encode().lower().split() if isinstance(text, str) else []
        words.append(END)
        return np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))

    def arrays(self) -> int:
        """Bring the arrays up to date; returns how many tokens are new in them."""
        n = len(self.hash)
        self.hash = np.concatenate([self.hash, np.array(self.codes.hash[n:], np.int64)])
        self.key = np.concatenate([self.key, np.array(self.codes.key[n:], np.int64)])
        return len(self.hash) - n


def _texts(batches: Iterator[pd.DataFrame], column: str) -> Iterator[object]:
    for b in batches:
        yield from b[column]


def survey(train: DataFrame) -> DataFrame:
    """All learning texts' counts: kind 0 is a token (id hash, key), kind 1 two keys side by side (id)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, some, held = Tokens(), [], 0
        words, pairs = np.zeros(0, np.int64), np.zeros(KEYS * KEYS, np.int64)

        def add() -> None:
            nonlocal words, some, held
            tokens.arrays()
            at = np.concatenate(some)
            more = np.bincount(at, minlength=len(tokens.hash))
            more[: len(words)] += words
            words = more
            k = tokens.key[at].astype(np.int64)
            # Texts end with the end's key, after which no pair begins.
            both = (k[:-1] * KEYS + k[1:])[k[:-1] != KEYS - 1]
            np.add(pairs, np.bincount(both, minlength=KEYS * KEYS), out=pairs)
            some, held = [], 0

        for t in _texts(batches, "text"):
            some.append(tokens(t))
            held += len(some[-1])
            if held > CHUNK or tokens.full():
                add()
            if tokens.full():
                yield pd.DataFrame({"kind": 0, "id": tokens.hash, "key": tokens.key, "n": words})
                tokens.clear()
                words = words[:0]
        if some:
            add()
        yield pd.DataFrame({"kind": 0, "id": tokens.hash, "key": tokens.key, "n": words})
        p = np.flatnonzero(pairs)
        yield pd.DataFrame({"kind": 1, "id": p, "key": 0, "n": pairs[p]})

    rows = train.mapInPandas(tidy("lm", count), "kind int, id long, key int, n long")
    return materialize(rows.groupBy("kind", "id").agg(F.min("key").alias("key"), F.sum("n").alias("n")), "lmcounts")


def classes_of_keys(counts: DataFrame) -> np.ndarray:
    """key -> class from the survey: weighted clusters of the neighbours' distributions."""
    got = counts.where("kind = 1").select("id", "n").toPandas()  # at most KEYS * KEYS rows
    m = np.zeros(KEYS * KEYS)
    m[got["id"]] = got["n"]
    m = m.reshape(KEYS, KEYS)
    weight = m.sum(1) + m.sum(0)
    rows = np.concatenate([m / np.maximum(m.sum(1, keepdims=True), 1), m.T / np.maximum(m.sum(0)[:, None], 1)], 1) ** 0.5
    out = np.arange(KEYS) % (CLASSES - 1)
    used = np.flatnonzero(weight[: KEYS - 1] > 0)
    if len(used) > CLASSES - 1:
        x, w = rows[used], weight[used]
        c = x[np.argsort(-w, kind="stable")[: CLASSES - 1]]
        for _ in range(25):
            own = ((c**2).sum(1) - 2 * x @ c.T).argmin(1)
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = np.average(x[own == k], axis=0, weights=w[own == k])
        out[used] = own
    out[KEYS - 1] = CLASSES - 1
    return out


class Symbols:
    """The common words (hash, key, count) and the classes: token to symbol, symbol to class."""

    def __init__(self, classes: np.ndarray, top: list[tuple[int, int, int]]):
        top = sorted(top)
        self.classes = classes
        self.hash = np.array([h for h, _, _ in top], np.int64)
        self.count = np.array([n for _, _, n in top], np.float64)
        self.of = np.concatenate([np.arange(CLASSES), classes[[k for _, k, _ in top]] if top else np.zeros(0, np.int64), np.zeros(TOP - len(top), np.int64), [CLASSES]]).astype(np.int64)
        self.used = np.arange(SYMBOLS) < CLASSES + len(top)

    def __call__(self, hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
        out = self.classes[keys]
        if len(self.hash):
            at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
            out = np.where(self.hash[at] == hashes, CLASSES + at, out)
        return out


def common_words(counts: DataFrame, classes: np.ndarray) -> Symbols:
    top = counts.where((F.col("kind") == 0) & (F.col("id") != _hash(END))).orderBy(F.desc("n"), "id").limit(TOP)
    return Symbols(classes, [(r["id"], r["key"], r["n"]) for r in top.select("id", "key", "n").collect()])


def histories(k: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The number of the history (last but one, last symbol before) at each place of texts that stand one after the other; they
    begin at `starts` and have `size` places, one at least."""
    last, before = np.empty_like(k), np.empty_like(k)
    last[1:], before[2:] = k[:-1], k[:-2]
    last[starts] = before[starts] = START
    before[starts[size > 1] + 1] = START
    return before * WIDE + last


def _rows(parts: list[np.ndarray], size: int) -> np.ndarray:
    """Hashed rows of the features, [history, feature]."""
    raw = np.stack([p + (f << 20) for f, p in enumerate(parts)], 1).astype(np.uint64)
    raw = (raw + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((raw ^ (raw >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(np.int64) % size


def _parts(history: np.ndarray, of: np.ndarray | None) -> tuple[np.ndarray, ...]:
    of = np.minimum(np.arange(WIDE), CLASSES) if of is None else of
    s1, s2 = history % WIDE, history // WIDE
    return np.zeros_like(s1), s1, s2, of[s1], of[s2]


def feature_rows(history: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """[history, feature] hashed rows of the classes' weights; of: symbol to class."""
    one, s1, s2, c1, c2 = _parts(history, of)
    return _rows([one, c1, c1 * WIDE + c2, c2, s1, s1 * WIDE + s2, s2, s1 * WIDE + c2, c1 * WIDE + s2], ROWS)


def inner_rows(history: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """[history, feature] hashed rows of the symbols' weights."""
    one, s1, s2, c1, c2 = _parts(history, of)
    return _rows([one, s1, s2, c1 * WIDE + c2], INNER)


def class_logs(w: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """[history, class] natural logs of P(class | history)."""
    z = w[rows].sum(1)
    z -= z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


def symbol_logs(v: np.ndarray, rows: np.ndarray, symbols: Symbols) -> np.ndarray:
    """[history, symbol] natural logs of P(symbol | its class, history); -inf for symbols not in use."""
    z = np.where(symbols.used, v[rows].sum(1), -np.inf)
    order = np.argsort(symbols.of[:SYMBOLS], kind="stable")
    starts = np.searchsorted(symbols.of[:SYMBOLS][order], np.arange(CLASSES))
    by = symbols.of[:SYMBOLS]
    z -= np.maximum.reduceat(z[:, order], starts, axis=1)[:, by]
    return z - np.log(np.add.reduceat(np.exp(z[:, order]), starts, axis=1))[:, by]


def gather(train: DataFrame, symbols: Symbols) -> DataFrame:
    """(history, s, n): how often each symbol follows each history in all learning texts."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, some, held = Tokens(), [], 0
        grams, sym = np.zeros(WIDE * WIDE * SYMBOLS, np.int32), np.zeros(0, np.int64)

        def add() -> None:
            nonlocal sym, some, held
            if tokens.arrays():
                sym = np.concatenate([sym, symbols(tokens.hash[len(sym) :], tokens.key[len(sym) :])])
            k = sym[np.concatenate(some)]
            # Two starts before every text, which nothing counts as a symbol that follows.
            p = np.insert(k, np.repeat(np.r_[0, np.cumsum([len(x) for x in some])[:-1]], 2), START)
            at = ((p[:-2] * WIDE + p[1:-1]) * SYMBOLS + p[2:])[p[2:] != START]
            each = np.bincount(at) if len(at) > len(grams) // 16 else None
            if each is not None:
                grams[: len(each)] += each.astype(np.int32)
            else:
                np.add.at(grams, at, 1)
            some, held = [], 0

        for t in _texts(batches, "text"):
            some.append(tokens(t))
            held += len(some[-1])
            if held > CHUNK or tokens.full():
                add()
            if tokens.full():
                tokens.clear()
                sym = sym[:0]
        if some:
            add()
        some = np.flatnonzero(grams)
        yield pd.DataFrame({"id": some, "n": grams[some].astype(np.int64)})

    rows = train.mapInPandas(tidy("lm", count), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return rows.select((F.col("id") / SYMBOLS).cast("int").alias("history"), (F.col("id") % SYMBOLS).cast("int").alias("s"), "n")


def train_weights(grams: DataFrame, symbols: Symbols, rounds: int = 10, shares: int = 4, rate: float = 0.2, decay: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """The weight tables [row, class] and [row, symbol], by gradient updates over all histories."""
    grams = materialize(grams.repartition(shares, "history"), "lmgrams")
    w, v = np.zeros((ROWS, CLASSES), np.float32), np.zeros((INNER, SYMBOLS), np.float32)

    def spread(rows: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
        """Sums of values[history] by row, over all features."""
        out = np.zeros((size, values.shape[1]))
        for f in range(rows.shape[1]):
            order = np.argsort(rows[:, f], kind="stable")
            each, first = np.unique(rows[order, f], return_index=True)
            out[each] += np.add.reduceat(values[order], first, axis=0)
        return out

    def counted(b: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(histories, [history, symbol], [history, class]) of a task's rows, some histories at once."""
        each, at = np.unique(b["history"].to_numpy("int64"), return_inverse=True)
        for k in range(0, len(each), 4096):
            some, own = each[k : k + 4096], (at >= k) & (at < k + 4096)
            n = np.zeros((len(some), SYMBOLS))
            n[at[own] - k, b["s"].to_numpy("int64")[own]] = b["n"].to_numpy()[own]
            yield some, n, np.stack([n[:, symbols.of[:SYMBOLS] == c].sum(1) for c in range(CLASSES)], 1)

    def summed(model: tuple[np.ndarray, np.ndarray] | None) -> list[np.ndarray]:
        """Counts by feature row, over all tasks: those seen (no model), or those that a model expects."""

        def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            b = pd.concat([x for x in batches if len(x)] or [pd.DataFrame({"history": [], "s": [], "n": []}, dtype="int64")])
            outer, deep = np.zeros((ROWS, CLASSES)), np.zeros((INNER, SYMBOLS))
            for some, n, inner in counted(b):
                rows, within = feature_rows(some, symbols.of), inner_rows(some, symbols.of)
                if model is not None:
                    n = np.exp(symbol_logs(model[1].astype(np.float64), within, symbols)) * inner[:, symbols.of[:SYMBOLS]]
                    inner = np.exp(class_logs(model[0].astype(np.float64), rows)) * inner.sum(1, keepdims=True)
                outer += spread(rows, inner, ROWS)
                deep += spread(within, n, INNER)
            yield pd.DataFrame({"outer": [outer.astype(np.float32).tobytes()], "deep": [deep.astype(np.float32).tobytes()]})

        parts = grams.mapInPandas(tidy("lm", step), "outer binary, deep binary").collect()  # `shares` tables of fixed size
        return [sum(np.frombuffer(p[x], np.float32).reshape(shape).astype(float) for p in parts) for x, shape in (("outer", w.shape), ("deep", v.shape))]

    seen = summed(None)
    for _ in range(rounds):
        # Nine features share a class's error: steps much over a ninth of it each would overshoot.
        steps = [rate * (have - want - decay * old) / (np.maximum(have, want) + 2.0) for have, want, old in zip(seen, summed((w, v)), (w, v), strict=True)]
        w, v = ((old + step).astype(np.float32) for old, step in zip((w, v), steps, strict=True))
    return w, v


def log_table(w: np.ndarray, v: np.ndarray, symbols: Symbols, totals: np.ndarray) -> np.ndarray:
    """[history, symbol] log10 of what to multiply (c + 0.1) of a word by; totals: [tokens and distinct tokens, class]."""
    rest = totals.astype(float)
    np.subtract.at(rest[0], symbols.of[CLASSES : CLASSES + len(symbols.hash)], symbols.count)
    np.subtract.at(rest[1], symbols.of[CLASSES : CLASSES + len(symbols.hash)], 1)
    each = np.concatenate([rest[0] + ALPHA * (rest[1] + 1), symbols.count + ALPHA, np.ones(TOP - len(symbols.hash))])
    out = np.empty((WIDE * WIDE, SYMBOLS), np.float32)
    for k in range(0, len(out), 4096):
        h = np.arange(k, min(k + 4096, len(out)))
        logs = class_logs(w.astype(np.float64), feature_rows(h, symbols.of))[:, symbols.of[:SYMBOLS]] + symbol_logs(v.astype(np.float64), inner_rows(h, symbols.of), symbols)
        out[h] = logs / np.log(10) - np.log10(each)
    return out


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", learn: str = "true", frequent: int = 200_000) -> DataFrame:
    """(id, learned, n_tokens, n_known, train_tokens, base_score, score) for each row; learn: SQL that marks learning rows."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("learned", F.coalesce(F.expr(learn), F.lit(True)))
    train = docs.where("learned").select("text")
    counts = survey(train)
    classes = classes_of_keys(counts)
    symbols = common_words(counts, classes)
    w, v = train_weights(gather(train, symbols), symbols)
    words = counts.where("kind = 0")
    totals = np.zeros((2, CLASSES))
    for key, n, many in words.groupBy("key").agg(F.sum("n"), F.count("*")).collect():  # at most KEYS rows
        totals[:, classes[key]] += (n, many)
    size, distinct = int(totals[0].sum()), int(totals[1].sum())
    # The commonest tokens: a histogram of counts by sixteenths of a power of two tells from which count on they are
    # `frequent` at most, so that tasks send no more rows than that in all.
    scale = F.floor(F.log2("n") * 16)
    cut, total = None, 0
    for level, many in sorted(words.groupBy(scale.alias("level")).count().collect(), reverse=True):  # at most 1024 rows
        total += many
        if total > frequent:
            break
        cut = level
    top = words.where(scale >= cut if cut is not None else F.lit(False)).select("id", "n").toPandas().sort_values("id")  # bounded by `frequent`
    top_ids, top_logs = top["id"].to_numpy("int64"), np.log10(top["n"].to_numpy("float64") + ALPHA)
    shared = docs.sparkSession.sparkContext.broadcast((symbols, top_ids, top_logs, log_table(w, v, symbols, totals)))
    kind = docs.schema["id"].dataType.simpleString()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbols, top_ids, top_logs, table = shared.value
        tokens, logs, sym, row = Tokens(), np.empty(0), np.empty(0, np.int64), TaskContext.get().partitionId() << 40

        def summed(some: list[np.ndarray]) -> pd.DataFrame:
            """The sums of some texts' tokens, all texts at once."""
            nonlocal logs, sym, row
            if tokens.arrays():
                new = tokens.hash[len(logs) :]
                place = np.minimum(np.searchsorted(top_ids, new), max(0, len(top_ids) - 1))
                hit = top_ids[place] == new if len(top_ids) else np.zeros(len(new), bool)
                sym = np.concatenate([sym, symbols(new, tokens.key[len(sym) :])])
                logs = np.concatenate([logs, np.where(hit, top_logs[place] if len(top_ids) else 0.0, np.nan)])
            size = np.array([len(x) for x in some])
            at, starts = np.concatenate(some), np.cumsum(size) - size
            own = logs[at]
            rare = np.isnan(own)
            own[rare] = 0.0
            k = sym[at]
            model = table[histories(k, starts, size), k].astype(np.float64)
            # A text's rare tokens with their numbers, text by text.
            each, n = np.unique(np.repeat(np.arange(len(some)), size)[rare] * len(logs) + at[rare], return_counts=True)
            cuts, ids = np.searchsorted(each, np.arange(1, len(some)) * len(logs)), tokens.hash[each % len(logs)]
            add = np.add.reduceat
            out = {"row": row + np.arange(len(some)), "n_tokens": size, "known": add((~rare).astype(np.int64), starts), "logs": add(own, starts), "model": add(model, starts)}
            row += len(some)
            return pd.DataFrame(out | {"ids": np.split(ids, cuts), "ns": np.split(n, cuts)})

        for b in batches:
            done, some, held = [], [], 0
            for t in b["text"]:
                some.append(tokens(t))
                held += len(some[-1])
                if held > AT_ONCE or tokens.full():
                    done.append(summed(some))
                    some, held = [], 0
                if tokens.full():
                    tokens.clear()
                    logs, sym = np.empty(0), sym[:0]
            if some:
                done.append(summed(some))
            if done:
                out = pd.concat(done, ignore_index=True)
                out.insert(0, "learned", b["learned"].to_numpy())
                out.insert(0, "id", b["id"].array)
                yield out

    scored = docs.mapInPandas(tidy("lm", score), f"id {kind}, learned boolean, row long, n_tokens long, known long, logs double, model double, ids array<long>, ns array<long>")
    scored = materialize(scored, "lmscored")
    # The rest of the tokens, joined with their counts; a count of 0 where there is none.
    rest = scored.select("row", F.explode(F.arrays_zip("ids", "ns")).alias("x")).select("row", F.col("x.ids").alias("id"), F.col("x.ns").alias("times"))
    rest = rest.join(words.select("id", "n"), "id", "left")
    rest = rest.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("more"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    out = scored.drop("ids", "ns").join(rest, "row", "left")
    logs = F.col("logs") + F.coalesce("more", F.lit(0.0))
    base = logs - F.col("n_tokens") * float(np.log10(size + ALPHA * (distinct + 1)))
    return out.select("id", "learned", "n_tokens", (F.col("known") + F.coalesce("also", F.lit(0))).cast("long").alias("n_known"), F.lit(size).cast("long").alias("train_tokens"), base.alias("base_score"), (logs + F.col("model")).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learns from documents whose crc32(doc_id) mod 10 is not 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score_texts(docs, learn="crc32(cast(cast(id as string) as binary)) % 10 <> 0")
    return out.select(F.col("id").alias("doc_id"), (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
