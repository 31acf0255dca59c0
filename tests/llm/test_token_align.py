"""Token alignment against whole-text encoding and a plain two-pointer walk, with counts over the corpus."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import token_align
from tidemark.llm.bpe import byte_chars

A, B = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()


class Plain:
    """Whole texts, by the libraries; ends compared by a walk of two pointers."""

    def __init__(self):
        self.a, self.b = tokenizers.Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        self.a.encode_special_tokens = True
        byte = {c: b for b, c in enumerate(byte_chars())}
        self.of_a = {i: bytes(byte[c] for c in t) for t, i in json.load(open(A))["model"]["vocab"].items() if all(c in byte for c in t)}

    def of_b(self, i):
        return bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()

    def align(self, text):
        want = (" " + text).encode()
        a, b = (self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)) if text else ([], [])
        if not text or b"".join(map(self.of_a.get, a)) != want or b"".join(map(self.of_b, b)) != want:
            return [], [], [], []
        ends_a, ends_b = np.cumsum([len(self.of_a[i]) for i in a]), np.cumsum([len(self.of_b(i)) for i in b])
        links, groups, i, j, i0, j0 = [], [], 0, 0, 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            x, y = ends_a[i], ends_b[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append((a[i0:i], b[j0:j]))
                i0, j0 = i, j
        return a, b, groups, links


def brute(texts):
    plain = Plain()
    found = [plain.align(t or "") for t in texts]
    counts = Counter(link for f in found for link in f[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for a, b, groups, links in found:
        form = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(counts[k] == best[k[1]] for k in links), sum(counts[k] for k in links), hashlib.sha256(form.encode()).hexdigest() if groups else ""))
    return out


def texts(n, seed=4):
    rng = random.Random(seed)
    bits = ["the", "naïve", "don't", " ", "  ", "\n", "\t", "　", "漢字", "🙂", "é", "ﬁ", "<s>", "<0x41>", "<|endoftext|>", "42", "...", "\x1c", " ", "a b", "ß", "Кот", "x" * 70, "\x00", "ᏸ", "'ll", "/" * 9, "\U0001e030", "internationalization"]
    return ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 25))) for _ in range(n)]


def run(spark, rows, schema="doc_id long, text string", **how):
    df = spark.createDataFrame(rows, schema)
    width, bits = token_align.packing(A, B)
    aligned = token_align.align_texts(df, A, B, with_groups=True)
    return token_align.with_counts(aligned, token_align.pair_counts(aligned, width, bits), bits, **how)


@pytest.mark.parametrize("hot", [500_000, 20])
def test_against_brute_force(spark, hot):
    some = [*texts(150), None, "", " ", "▁x", "a ▁b", "the " * 3000, "one two", "one two", " lead", "trail ", "y" * 30_000]
    got = {r.id: tuple(r[c] for c in COLUMNS) for r in run(spark, list(enumerate(some)), hot=hot).collect()}
    want = dict(enumerate(brute(some)))
    assert {i: (some[i], got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert got[some.index("a ▁b")] == (0, 0, 0, 0, 0, 0, "")


def test_pieces_align_as_whole_texts_do():
    aligner, plain = token_align.Aligner(A, B, 50), Plain()  # a cache that overflows
    assert aligner.cut and aligner.fast
    some = texts(600, 9)
    for text, found in zip(some, aligner.align(some), strict=True):
        a, b, groups, links = plain.align(text)
        form, pairs, n_a, n_groups = found or ("", np.empty(0, np.int64), 0, 0)
        assert (n_a, n_groups) == (len(a), len(groups)) and form == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups), repr(text)
        assert [divmod(int(p), aligner.width) for p in pairs] == links


def test_given_texts(spark):
    df = token_align.op11_token_alignment(spark, TESTDATA)
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet").select("doc_id", "text").collect()
    want = dict(zip([d.doc_id for d in docs], brute([d.text for d in docs]), strict=True))
    assert {r.doc_id: tuple(r[c] for c in COLUMNS) for r in df.collect()} == want


def test_counts_of_pairs(spark):
    df = spark.createDataFrame([(1, "one two one"), (2, "one three")], "doc_id long, text string")
    width, bits = token_align.packing(A, B)
    got = {(r.a, r.b): (r.n, r.texts, r.best_a, r.best_b) for r in token_align.pair_counts(token_align.align_texts(df, A, B), width, bits).collect()}
    links = [Plain().align(t)[3] for t in ("one two one", "one three")]
    counts = Counter(x for f in links for x in f)
    best = lambda side, k: max(n for p, n in counts.items() if p[side] == k)
    assert got == {p: (n, sum(p in f for f in links), best(0, p[0]), best(1, p[1])) for p, n in counts.items()}


def test_numbers_too_large_for_an_entry():
    packed = token_align._entries(np.array([5] * 700 + [2]), 8)
    assert sorted((int(x) >> 8, int(x) & 255) for x in packed) == [(2, 1), (5, 190), (5, 255), (5, 255)]


def test_odd_tables(spark):
    rows = [(None, "null id", 1, 2), (7, "same", 1, 2), (7, "same", 1, 2), (7, None, 1, 2)]
    schema = "doc_id long, text string, row int, links int"  # clashing names
    got = run(spark, rows, schema).collect()
    assert sorted((str(r.id), r.n_links > 0) for r in got) == [("7", False), ("7", True), ("7", True), ("None", True)]
    assert run(spark, rows[:0], schema).count() == 0
    assert next(r for r in got if r.id == 7 and r.n_a).groups.count("|") == next(r for r in got if r.id == 7 and r.n_a).n_groups
