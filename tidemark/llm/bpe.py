"""BPE encoding and decoding by speculation and verification.

Words are cut by greedy longest match, a whole batch in one run of an automaton of the vocabulary. A word's cut is the BPE encoding if, and only if, each token merges to itself and
each pair of neighbours, merged alone, stays that pair; so all neighbour pairs of a batch of words are looked up in
a sorted array of checked pairs (numpy), pairs not met before are merged exactly once, and only words with a failing
pair go through exact merging. Results per white-space chunk are kept in caches of bounded size.

Semantics are those of the tokenizers library for the given file (BPE with an end-of-word suffix over byte-level
characters, NFC, lower case): special tokens that stand in the text become their ids; decoding joins the tokens'
strings by a space, as the library does for a file without a decoder.

Cases: null and empty texts encode to nothing (the digest of no bytes). Chunks of any length work, since merging
uses a heap. Repeated rows each get a result; extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import tidy, worker_cache

#: Words and white-space chunks that a worker keeps, each.
CACHE = 300_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


class SpeculativeBpe:
    """Encodes words of the vocabulary in `path` (a tokenizers JSON file)."""

    def __init__(self, path: str, cache: int = CACHE):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.text_of = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.bytes = byte_chars()
        self.plain = str.maketrans(dict(enumerate(self.bytes)))
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # The pre-tokenizer's pattern (fixed value, as in the vocabulary's file).
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}"))
        self.odd_space = regex.compile(r"[\x1c-\x1f]")
        self.space = regex.compile(r"\p{White_Space}+")
        self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)
        self.whole: dict[int, bool] = {}
        self.cache = cache
        self.chunks: dict[str, tuple[bytes, str]] = {}
        self.coded: dict[str, bytes] = {}
        # A word's last character, with its end mark, is one character of a range that no token uses otherwise.
        self.last = {c: chr(0xE000 + i) for i, c in enumerate(self.bytes)}
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ids.items():
            stem = t[: -len(self.end)]
            ends = t.endswith(self.end) and stem
            self.automaton.add_word(stem[:-1] + self.last[stem[-1]] if ends else t, i)
        self.automaton.make_automaton()

    # -- exact merging

    def symbols(self, word: str) -> list[int]:
        chars = [self.bytes[b] for b in word.encode()]
        return [self.ids[c] for c in chars[:-1]] + [self.ids[chars[-1] + self.end]]

    def symbols_of(self, token: int) -> list[int]:
        t = self.text_of[token]
        last = t.endswith(self.end) and len(t) > len(self.end)
        chars = list(t[: -len(self.end)] if last else t)
        return [self.ids[c] for c in chars[:-1]] + [self.ids[chars[-1] + (self.end if last else "")]]

    def merge(self, s: list[int]) -> list[int]:
        """Lowest rank first, leftmost first, until no pair merges; short words without a heap."""
        n, get = len(s), self.merges.get
        if n <= 20:
            found = [get(p) for p in zip(s, s[1:], strict=False)]
            s = list(s)
            while True:
                best = None
                for i, m in enumerate(found):
                    if m is not None and (best is None or m[0] < best[0]):
                        best, at = m, i
                if best is None:
                    return s
                s[at : at + 2] = (best[1],)
                del found[at]
                if at < len(found):
                    found[at] = get((s[at], s[at + 1]))
                if at:
                    found[at - 1] = get((s[at - 1], s[at]))
        s, nxt, prv = list(s), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m[0], i, s[i], s[i + 1], m[1]) for i in range(n - 1) if (m := get((s[i], s[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = nxt[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = to, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((to, s[k])):
                    heapq.heappush(heap, (m[0], i, to, s[k], m[1]))
            if (p := prv[i]) >= 0 and (m := get((s[p], to))):
                heapq.heappush(heap, (m[0], p, s[p], to, m[1]))
        return [x for x in s if x >= 0]

    # -- speculation and verification

    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, word of each): greedy longest matches over the words' byte characters, the last with its end mark."""
        last, plain = self.last, self.plain
        raw = []
        for w in words:
            r = w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(plain)
            raw.append(r[:-1] + last[r[-1]])
        found = list(self.automaton.iter_long("\n".join(raw)))  # the line feed's byte character is another
        tokens = np.array([t for _, t in found], np.int64)
        stops = np.array([e for e, _ in found], np.int64)
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1) - 2  # each word's last character
        return tokens, np.searchsorted(ends, stops)

    def _pair_ok(self, pair: int) -> bool:
        a, b = pair >> 32, pair & 0xFFFFFFFF
        return self.merge(self.symbols_of(a) + self.symbols_of(b)) == [a, b]

    def verify(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair (a << 32 | b) stays as it is."""
        each, at = np.unique(pairs, return_inverse=True)
        place = np.searchsorted(self.known, each)
        seen = np.zeros(len(each), bool)
        if len(self.known):
            seen = self.known[np.minimum(place, len(self.known) - 1)] == each
        ok = np.zeros(len(each), bool)
        ok[seen] = self.good[place[seen]]
        if (~seen).any():
            ok[~seen] = [self._pair_ok(int(p)) for p in each[~seen]]
            if len(self.known) > 1_000_000:
                self.known, self.good = np.empty(0, np.int64), np.empty(0, bool)
            known, good = np.concatenate([self.known, each[~seen]]), np.concatenate([self.good, ok[~seen]])
            order = np.argsort(known, kind="stable")
            self.known, self.good = known[order], good[order]
            self.known, first = np.unique(self.known, return_index=True)
            self.good = self.good[first]
        return ok[at]

    def words(self, words: list[str]) -> list[bytes]:
        """The encodings of words that the pre-tokenizer has cut, as little-endian 32-bit integers."""
        if not words:
            return []
        flat, owner = self.propose(words)
        beside = owner[1:] == owner[:-1]
        bad = set(owner[1:][beside][~self.verify((flat[:-1][beside] << 32) | flat[1:][beside])].tolist())
        cuts = np.searchsorted(owner, np.arange(len(words) + 1))
        for i in np.flatnonzero(np.diff(cuts) == 1).tolist():
            t = int(flat[cuts[i]])
            ok = self.whole.get(t)
            if ok is None:
                ok = self.whole[t] = self.merge(self.symbols_of(t)) == [t]
            if not ok:
                bad.add(i)
        raw, at = flat.astype("<u4").tobytes(), (cuts * 4).tolist()
        return [self.pack(self.merge(self.symbols(words[i]))) if i in bad else raw[at[i] : at[i + 1]] for i in range(len(words))]

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    # -- texts

    def _learn(self, chunks: list[str]) -> None:
        find, code = self.pattern.findall, self.coded
        parts = [find(c.lower() if c.isascii() else unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()) for c in chunks]
        each = list({w for p in parts for w in p}.difference(code))
        if len(code) + len(each) > self.cache:
            code = self.coded = {}
            each = list({w for p in parts for w in p})
        code.update(zip(each, self.words(each), strict=True))
        ids = [code[p[0]] if len(p) == 1 else b"".join([code[w] for w in p]) for p in parts]
        # All tokens' texts at once, cut again at each chunk's end.
        texts = [self.text_of[t] for t in np.frombuffer(b"".join(ids), "<u4").tolist()]
        at = 0
        for c, i in zip(chunks, ids, strict=True):
            n = len(i) >> 2
            self.chunks[c] = (i, " ".join(texts[at : at + n]))
            at += n

    def _split(self, text: str) -> list[str]:
        return [x for x in self.space.split(text) if x] if self.odd_space.search(text) else text.split()

    def encode(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text, its ids as little-endian 32-bit integers and its decoded text."""
        out = []
        cut = []
        for text in texts:
            pieces = self.split_special.split(text) if self.split_special and "<" in text else [text]
            cut.append([(k % 2 == 1, p) if k % 2 else (False, self._split(p)) for k, p in enumerate(pieces)])
        if len(self.chunks) > self.cache:
            self.chunks = {}
        new = self.chunks
        todo = set().union(*[p for doc in cut for special, p in doc if not special]).difference(new)
        if todo:
            self._learn(list(todo))
        for doc in cut:
            if len(doc) == 1:
                got = [new[c] for c in doc[0][1]]
            else:
                got = []
                for special, p in doc:
                    if special:
                        got.append((struct.pack("<I", self.special[p]), p))
                    else:
                        got += [new[c] for c in p]
            out.append((b"".join([g[0] for g in got]), " ".join([g[1] for g in got if g[1]])))
        return out


_CODERS: dict[str, SpeculativeBpe] = worker_cache()


def coder(path: str, cache: int = CACHE) -> SpeculativeBpe:
    """One encoder a worker process."""
    key = f"{cache} {path}"
    if key not in _CODERS:
        _CODERS[key] = SpeculativeBpe(path, cache)
    return _CODERS[key]


def _some(texts: list[str], most: int = 1_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `most` characters, so that what is held at once is bounded by that or one text."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


def encode_texts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """Every row's id, n_tokens, ids_sha256, decoded_sha256 and, on wish, its ids (array<int>); cache: entries a worker keeps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = coder(path, cache)
        names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in batches:
            at = 0
            for some in _some([t if isinstance(t, str) else "" for t in batch["_text"]]):
                rows = []
                for ids, decoded in bpe.encode(some):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), *([np.frombuffer(ids, "<u4").astype(np.int32)] if with_ids else [])))
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, id_col, batch[id_col].iloc[at : at + len(some)].array)
                at += len(some)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(id_col, F.col(text_col).alias("_text")).mapInPandas(tidy("bpe", run), schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_texts(docs, str(public_tokenizers.path("word_bpe_49k.json")))
