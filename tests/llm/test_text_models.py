"""BPE, language ID, toxicity and LM scoring."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.conftest import TESTDATA
from tidemark.llm import bpe, langid, lm_score, registry, toxicity
from tidemark.llm.common import bounded_sample

BPE = str(public_tokenizers.path("word_bpe_49k.json"))
PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BPE)


def test_bpe_equals_the_library_on_random_texts(library):
    rng, ours = random.Random(1), bpe.SpeculativeBpe(BPE, cache=500)
    pool = "aaaabcdetiono' \t\n\x1c\x85  éÉßΣσςİıǅﬁ中文한글😀👍🏽ȩ́,.!<|endoftext|>'s'll123٣½²‍﻿\x00"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + ["<|endoftext|> hi <|startoftext|>x", "a" * 3000, "hello world's it'll", ""]
    for at in range(0, len(texts), 50):
        for t, (ids, decoded) in zip(texts[at : at + 50], ours.encode(texts[at : at + 50])):
            want = library.encode(t, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_query(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect()}
    got = registry.queries()["op3_bpe"](spark, TESTDATA).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "hi", 3)], "doc_id long, text string, ids int")
    got = sorted((str(r.doc_id), r.n_tokens, r.ids) for r in bpe.encode_texts(df, BPE, with_ids=True).collect())
    assert got[0] == ("1", 0, []) and got[1][1] == 1 and got[2] == ("None", 0, [])
    assert bpe.encode_texts(df.limit(0), BPE).count() == 0


def test_segmentations_are_summed():
    vocab = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba", "aab"]
    prob = np.random.default_rng(0).random((9, 2))
    prob[-1] = langid.RARE

    def brute(s, k):
        if not s:
            return 1.0
        total = sum(prob[vocab.index(s[:j]), k] * brute(s[j:], k) for j in range(1, len(s) + 1) if s[:j] in vocab)
        return total + (langid.RARE * brute(s[1:], k) if s[0] not in vocab else 0)

    pieces = langid.Pieces(vocab)
    for words in (["ab", "bx"], ["aabba"], ["abababab"]):
        lattice = langid.Lattice(words, pieces)
        _, logs = lattice.forward(prob)
        assert np.allclose(np.exp(logs), [[brute("▁" + w, k) for k in range(2)] for w in words])
        expected = lattice.expected(prob, np.ones((len(words), 2)))
        for p in range(8):  # the expected count is the likelihood's elasticity
            more = prob.copy()
            more[p] *= 1 + 1e-6
            assert np.allclose((langid.Lattice(words, pieces).forward(more)[1] - logs).sum(0) / 1e-6, expected[p], atol=1e-3)


def test_long_words_do_not_underflow():
    pieces, prob = langid.Pieces(["▁", "a", "aa"]), np.array([[0.2], [0.3], [0.1], [langid.RARE]])
    ways = [1.0, 0.3]  # sums for a^n after the mark, with rescaling
    logs, scale = [], 0.0
    for n in range(2, 5001):
        x = 0.3 * ways[-1] + 0.1 * ways[-2]
        scale += math.log(x)
        ways = [ways[-1] / x, 1.0]
        logs.append(scale)
    got = langid.Lattice(["a" * 5000], pieces).forward(prob)[1][0, 0]
    assert abs(got - (logs[-1] + math.log(0.2))) < 1e-6 * abs(got)


def test_language_accuracy_and_odd_rows(spark):
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text", "lang")
    got = registry.queries()["op9_langid"](spark, TESTDATA).join(docs, "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95 and all(0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    rows = spark.createDataFrame([(None, "the house", "en"), (1, None, "en"), (1, "", None), (2, "12 !?", "en"), (3, "x" * 100_000, None), (4, "la maison", "fr")], "doc_id long, text string, lang string")
    langs, prob = langid.fit(rows, PIECES)
    out = {(r.doc_id, r.lang_pred) for r in langid.predict(rows, langs, prob, PIECES).collect()}
    assert langs == ["en", "fr"] and {(1, "und"), (2, "und"), (None, "en"), (4, "fr")} <= out
    langs, prob = langid.fit(rows.limit(0), PIECES)
    assert langs == [] and {r.lang_pred for r in langid.predict(rows, langs, prob, PIECES).collect()} == {"und"}


def toxic_rows(n=400):
    rng = random.Random(2)
    plain = "the house stands near a river and people walk there every morning with bread tea milk".split()
    out = []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(30)]
        if i % 4 == 0:
            words[3] = words[17] = rng.choice(["idiot", "pathetic", "moron"])
        out.append((i, " ".join(words), int(i % 4 == 0)))
    return out


def test_toxicity_restores_disguised_words(spark):
    rows = toxic_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    read = toxicity.Reader(toxicity.Channel(model.grams), model.names)
    bad = ["what an 1d10t and a m0r0n", "so p a t h e t i c, you i d i o t", "an idiooooot, pathhhhetic", "p@thetic m0ron"]
    assert all(model.score(read(t)) >= 0.3 for t in bad)
    assert all(model.score(read(t)) < 0.3 for t in ("the river and the house", "tea 2 milk 3 bread", "", "a b c d e f", "bread " * 20_000))
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "x"), (2, "idiot moron")], "doc_id long, text string")
    got = {(str(r.doc_id), r.score >= 0.3) for r in toxicity.score_texts(odd, model).collect()}
    assert got == {("None", False), ("1", False), ("2", True)}
    none = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic").limit(0))
    assert toxicity.score_texts(odd, none).where("score > 0").count() == 0 and toxicity.score_texts(odd.limit(0), none).count() == 0


def test_toxicity_learns_from_all_rows(spark):
    rows = spark.range(12_000).selectExpr("id AS doc_id", "concat(if(id % 10 = 0, 'you moron ', 'fine day '), translate(cast(id AS string), '0123456789', 'abcdefghij')) AS text", "cast(id % 10 = 0 AS int) AS toxic")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"))
    assert model.grams["^^f"] >= 10_800 and model.grams["^^y"] >= 1_200 and model.grams["mor"] == 1_200
    assert ("=moron", 1) in model.names
    read = toxicity.Reader(toxicity.Channel(model.grams), model.names)
    assert model.score(read("a m0ron abc")) >= 0.3 > model.score(read("fine day abc"))


def test_toxicity_query(spark):
    got = registry.queries()["op4_toxicity"](spark, TESTDATA).collect()
    assert len(got) == spark.read.parquet(f"{TESTDATA}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_lm_base_scores_and_gain(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{TESTDATA}/documents.parquet").collect())
    got = {r.doc_id: r for r in registry.queries()["op7_lm_score"](spark, TESTDATA).collect()}
    tokens = {i: [*t.encode().lower().split(), b"\n"] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n) and abs(r.base_score - base) < 1e-6
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_lm_is_a_distribution_and_takes_odd_rows(spark):
    w = np.random.default_rng(0).normal(size=(lm_score.ROWS, lm_score.CLASSES))
    logs = lm_score.class_logs(w, lm_score.feature_rows(np.arange(500)))
    assert np.allclose(np.exp(logs).sum(1), 1)
    rows = spark.createDataFrame([(None, None), (1, ""), (1, "A a"), (2, "b " * 50_000)], "id long, text string")
    # A tiny table of frequent tokens sends the others through the join.
    a, b = (sorted((str(r.id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 5)) for r in lm_score.score_texts(rows, "id", learn="id IS NULL OR id < 2", frequent=f).collect()) for f in (1, 1000))
    assert a == b and ("None", 1, 1) in {x[:3] for x in a} and ("2", 50_001, 1) in {x[:3] for x in a}
    assert lm_score.score_texts(rows.limit(0), "id").count() == 0
    assert {r.train_tokens for r in lm_score.score_texts(rows, "id", learn="false").collect()} == {0}


def test_lm_counts_come_from_all_learning_texts(spark):
    rows = spark.range(4_000).selectExpr("concat('aa b', id % 7, ' c', id % 11) AS text").repartition(5)
    counts = lm_score.survey(rows)
    sums = {r.kind: r.n for r in counts.groupBy("kind").sum("n").toDF("kind", "n").collect()}
    assert sums == {0: 4_000 * 4, 1: 4_000 * 3}  # tokens with ends, and pairs
    classes = lm_score.classes_of_keys(counts)
    symbols = lm_score.common_words(counts, classes)
    grams = lm_score.gather(rows, symbols).toPandas()
    assert grams["n"].sum() == 4_000 * 4
    # Every text begins with the same word after two starts.
    first = grams[grams["history"] == lm_score.START * lm_score.WIDE + lm_score.START]
    assert first["n"].tolist() == [4_000] and first["s"].iat[0] >= lm_score.CLASSES


def test_lm_words_and_unknown_slots_sum_to_one(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "of", f"w{rng.randrange(400)}", f"x{rng.randrange(30)}ing"]) for _ in range(40)) for _ in range(60)]
    counts = lm_score.survey(spark.createDataFrame([(t,) for t in texts], "text string"))
    classes = lm_score.classes_of_keys(counts)
    symbols = lm_score.common_words(counts, classes)
    noise = np.random.default_rng(1)
    w, v = noise.normal(size=(lm_score.ROWS, lm_score.CLASSES)), noise.normal(size=(lm_score.INNER, lm_score.SYMBOLS))
    words = counts.where("kind = 0").toPandas()
    totals = np.zeros((2, lm_score.CLASSES))
    np.add.at(totals[0], classes[words["key"]], words["n"])
    np.add.at(totals[1], classes[words["key"]], 1)
    table = lm_score.log_table(w, v, symbols, totals).astype(float)
    sym = symbols(words["id"].to_numpy(), words["key"].to_numpy())
    assert set(sym) >= set(range(lm_score.CLASSES, lm_score.SYMBOLS))
    for history in (0, 5 * lm_score.WIDE + 40, lm_score.START * lm_score.WIDE + lm_score.START, 150 * lm_score.WIDE + 3):
        known = (10 ** table[history][sym] * (words["n"].to_numpy() + lm_score.ALPHA)).sum()
        unknown = (10 ** table[history][: lm_score.CLASSES] * lm_score.ALPHA).sum()
        assert abs(known + unknown - 1) < 1e-3


def test_lm_score_equals_a_plain_walk(spark):
    rows = [(i, f"the cat w{i % 5} sat on the mat x{i % 3}ing {'the dog ' * (i % 4)}") for i in range(80)]
    df = spark.createDataFrame(rows, "id long, text string")
    train = df.where("id % 10 <> 0").select("text")
    counts = lm_score.survey(train)
    classes = lm_score.classes_of_keys(counts)
    symbols = lm_score.common_words(counts, classes)
    w, v = lm_score.train_weights(lm_score.gather(train, symbols), symbols)
    c = {r.id: r.n for r in counts.where("kind = 0").collect()}
    top = {h: lm_score.CLASSES + k for k, h in enumerate(symbols.hash.tolist())}
    rest_n, rest_v = [0] * lm_score.CLASSES, [0] * lm_score.CLASSES
    for r in counts.where("kind = 0").collect():
        if r.id not in top:
            rest_n[classes[r.key]] += r.n
            rest_v[classes[r.key]] += 1
    for r in lm_score.score_texts(df, "id", learn="id % 10 <> 0", frequent=3).collect():
        s2 = s1 = lm_score.START
        want = 0.0
        for word in [*dict(rows)[r.id].encode().lower().split(), lm_score.END]:
            h = lm_score._hash(word)
            k = classes[lm_score.key_of(word)]
            s = top.get(h, k)
            history = np.array([s2 * lm_score.WIDE + s1])
            want += lm_score.class_logs(w.astype(float), lm_score.feature_rows(history, symbols.of))[0, k] / math.log(10)
            want += lm_score.symbol_logs(v.astype(float), lm_score.inner_rows(history, symbols.of), symbols)[0, s] / math.log(10)
            if s < lm_score.CLASSES:
                want += math.log10((c.get(h, 0) + 0.1) / (rest_n[k] + 0.1 * (rest_v[k] + 1)))
            s2, s1 = s1, s
        assert abs(r.score - want) < 1e-3


def test_toxicity_decoder_equals_enumeration():
    grams = Counter()
    for word in ("idiot", "moron", "pathetic", "river", "toil", "allow"):
        s = "^^" + word + "^"
        grams.update(s[i : i + 3] for i in range(len(word) + 1))
    channel = toxicity.Channel(dict(grams))

    def paths(span, k=0, last="^", out=""):
        """Every reading of the span: (its letters, what its steps cost beside the letters)."""
        if k == len(span):
            yield out, 0.0
            return
        c = span[k]
        steps = []
        if c.isalpha():
            steps.append((c, 0.0))
            if k and last == c:
                steps.append(("", toxicity.REPEAT))
        for x in toxicity.LOOKS.get(c, ""):
            steps.append((x, toxicity.LOOK))
            if last == x:
                steps.append(("", toxicity.LOOK + toxicity.REPEAT))
        if not c.isalpha():
            steps.append(("", toxicity.GAP if c in toxicity.SEPARATORS else toxicity.SIGN))
        for letter, cost in steps:
            for o, more in paths(span, k + 1, letter or last, out + letter):
                yield o, cost + more

    def score(word):
        s = "^^" + word + "^"
        return sum(channel.cost(s[i : i + 2], s[i + 2]) for i in range(len(word) + 1))

    rng = random.Random(5)
    for span in ["1d10t", "m0r0n", "i d i o t", "p@th3t1c", "aaa11", *("".join(rng.choice("ail01!| t3$") for _ in range(rng.randint(1, 8))) for _ in range(300))]:
        got = channel.decode(span)
        best = max(score(o) - cost for o, cost in paths(span))
        own = max(score(o) - cost for o, cost in paths(span) if o == got)
        assert abs(own - best) < 1e-9, span


def test_repeated_rows_do_not_empty_or_swell_a_sample(spark):
    rows = spark.range(200_000).selectExpr("id % 3 AS k", "concat('text ', id % 3) AS text")
    assert sorted(r.k for r in bounded_sample(rows, 1, ["k", "text"], 4_000).collect()) == [0, 1, 2]
    assert bounded_sample(rows, 1, ["k", "text"], 2).count() == 2
    many = spark.range(50_000).selectExpr("id AS k", "cast(NULL AS string) AS text")
    first = {r.k for r in bounded_sample(many, 1, ["k", "text"], 300).collect()}
    assert len(first) == 300 and first == {r.k for r in bounded_sample(many.repartition(7), 1, ["k", "text"], 300).collect()}
    assert bounded_sample(many.limit(0), 1, ["k", "text"], 300).count() == 0


def test_models_of_repeated_rows_equal_those_of_the_different_ones(spark):
    texts = {0: ("der Mann und die Frau gehen nach Hause", "de", 0), 1: ("the man and the woman are going home", "en", 0), 2: ("what an idiot, you idiot, idiot", "en", 1)}
    once = spark.createDataFrame([(i, *t) for i, t in texts.items()], "doc_id long, text string, lang string, toxic int")
    often = spark.range(60_000).selectExpr("id % 3 AS doc_id").join(once, "doc_id")
    a, b = (langid.fit(x, PIECES) for x in (once, often))
    assert a[0] == b[0] == ["de", "en"] and np.allclose(a[1], b[1])
    a, b = (toxicity.fit(x.select("doc_id", "text"), x.select("doc_id", "toxic").distinct()) for x in (once, often))
    assert a.names == b.names and a.grams == b.grams and np.allclose(a.weights, b.weights) and a.base == b.base


def test_long_words_are_learned_from():
    table = langid.pieces(PIECES)
    prob = np.random.default_rng(2).random((table.n + 1, 2)) / table.n
    prob[-1] = langid.RARE
    for size in (20, 31, 40, 200):
        lattice = langid.Lattice([("theandofing" * 20)[:size]], table)
        got = lattice.expected(prob, np.ones((1, 2)))
        # Each cut covers every letter once: expected pieces weighted by length add up to the word's length with its mark.
        length = np.zeros(table.n + 1)
        for k, (_, ids) in table.tables.items():
            length[ids] = k
        length[-1] = 1
        assert np.allclose((got * length[:, None]).sum(0), size + 1)


def test_lm_histories_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, lm_score.SYMBOLS, n) for n in (1, 2, 3, 1, 50)]
    size = np.array([len(x) for x in texts])
    got = lm_score.histories(np.concatenate(texts), np.cumsum(size) - size, size)
    want = []
    for x in texts:
        p = [lm_score.START, lm_score.START, *x]
        want += [p[i] * lm_score.WIDE + p[i + 1] for i in range(len(x))]
    assert got.tolist() == want


def test_toxicity_counts_of_many_texts_equal_plain_counting(monkeypatch):
    monkeypatch.setattr(toxicity, "CHUNK", 40)
    rng = random.Random(8)
    texts = [(rng.randint(0, 1), " ".join(rng.choice(["idiot,", "1d10t", "goood", "Café", "p a t h", "house!", "2²x", "it's", "(no)"]) for _ in range(rng.randint(0, 25)))) for _ in range(60)]
    passes = np.ones(toxicity.BUCKETS, bool)
    passes[zlib.crc32(b"=house") % toxicity.BUCKETS] = False
    channel, want = toxicity.Channel({"^^i": 3, "idi": 2}), Counter()
    found = toxicity.Counted(channel, passes)
    for y, t in texts:
        found.add(y, t)
        words = [w for c in t.split() for w in toxicity.chunk_words(c, channel)] + toxicity.spaced_words(t, channel)
        for f, n in Counter(f for w in words for f in toxicity.features(w) if f != "=house").items():
            want.update((f, k, y) for k in toxicity.LEVELS if n >= k)
    got = Counter()
    for frame in found.frames():
        for f, k, t, c in frame.itertuples(index=False):
            got.update({(f, k, 1): t, (f, k, 0): c})
    assert +got == want
