"""Alignment of two tokenizers over the same texts, with corpus-wide counts of the token pairs that meet.

A is a byte-level BPE (a tokenizers JSON file), B a SentencePiece BPE model. Each text, with a space in front, is cut by
both; byte offsets where tokens of both end cut it into groups, and an A and a B token whose bytes overlap are linked.

How it works
- `align_texts` (mapInPandas) encodes and merges: the cumulative token ends of A and B are two sorted lists, and one merge
  of the two gives everything. Each distinct end closes one stretch of bytes that lies in one A and one B token: a link. An
  end that both lists hold closes a group. A text's links leave the task as distinct id pairs with their number.
- `pair_counts` adds up the pairs with a groupBy, and joins the highest count of each A id and of each B id to them.
- `with_counts` joins the counts to the texts' pairs and adds up by text. Pairs in more than 1 / HOT of all entries, of which
  there are HOT at most, are broadcast; the others meet their counts by key, and none of those is frequent.

Encoding is by the libraries, with special tokens as plain text. A space between a character that is no space and one
that is no white space starts a token of either: A's pre-tokenizer cuts there, and no piece of B goes on over such a
space (checked when the model is loaded; else whole texts are encoded). So texts are cut there, and the alignments of the
pieces are kept in a cache of bounded size. A's words of letters up to U+024F are encoded by tiktoken with ranks from the
same file (if its ids are in the order of its merges), which does the same and is faster; others by tokenizers.

Cases: null and empty texts, and those whose joined token bytes of A or B differ from the text's (such as texts that hold
U+2581, B's mark for a space), have no tokens: zeros, no links, groups ''. Texts of any length work. Repeated rows each get
a result, whatever their ids; a null id is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import _some, byte_chars
from .common import materialize, tidy, worker_cache

#: Pieces of text whose alignment a worker keeps.
CACHE = 200_000
HOT = 500_000
#: A byte-level BPE's way of cutting a text into words (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PLAIN = re.compile("[\x00-ɏ]*").fullmatch
#: Where plain splitting at spaces would cut wrongly, and where to cut then.
_ODD = re.compile(r"\A\s| (?=\s|\Z)").search
_CUT = re.compile(r"(?<=[^ ])(?= \S)").split


class Aligner:
    """Groups and links of pieces of texts; for one pair of vocabularies."""

    def __init__(self, a_path: str, b_path: str, cache: int = CACHE):
        import sentencepiece
        import tiktoken
        import tokenizers

        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if all(c in byte for c in t)}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(byte[c] for c in t)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_lens, self.b_lens = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.width = len(self.b_bytes)
        pre = spec.get("pre_tokenizer") or {}
        usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
        self.cut = bool(usual) and not any(re.search("[^▁]▁", p) for p in pieces)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = [vocab[x + y] for x, y in pairs]
        ranked = usual and made == sorted(made) and all(i < made[0] for t, i in vocab.items() if len(t) == 1)
        self.fast = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks={self.a_bytes[i]: i for i in vocab.values()}, special_tokens={}).encode_ordinary if ranked else None
        self.cache = cache
        self.known: dict[str, tuple[str, bytes, int] | None] = {}

    def pieces(self, text: str) -> list[str]:
        """The text cut where both tokenizers do, each piece without the space in front of it."""
        if not self.cut:
            return [text]
        if _ODD(text):
            return [p[1:] for p in _CUT(" " + text)]
        return text.split(" ")

    def _encode(self, pieces: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        fast, slow = self.fast, self.a.encode
        a = [fast(" " + p) if fast and _PLAIN(p) else slow(" " + p, add_special_tokens=False).ids for p in pieces]
        return a, self.b.encode(pieces, num_threads=1)

    def learn(self, pieces: list[str]) -> None:
        """Put the alignment of new pieces into `known`: groups as text, links as id pairs, A tokens and groups; None without tokens."""
        a, b = self._encode(pieces)
        raw = [(" " + p).encode() for p in pieces]
        a_of, b_of = self.a_bytes.__getitem__, self.b_bytes.__getitem__
        if any(b"".join(map(of, chain.from_iterable(side))) != b"".join(raw) for of, side in ((a_of, a), (b_of, b))):
            good = [b"".join(map(a_of, x)) == r == b"".join(map(b_of, y)) for x, y, r in zip(a, b, raw, strict=True)]
            self.known.update((p, None) for p, ok in zip(pieces, good, strict=True) if not ok)
            pieces, raw, a, b = ([x for x, ok in zip(side, good, strict=True) if ok] for side in (pieces, raw, a, b))
        if not pieces:
            return
        ids_a, ids_b = (np.fromiter(chain.from_iterable(side), np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_lens[ids_a]), np.cumsum(self.b_lens[ids_b])
        # The merge of both lists of ends: at each, the tokens of A and B that hold the bytes before it.
        ends = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
        shared = (ends_a[at_a] == ends) & (ends_b[at_b] == ends)
        packed = (ids_a[at_a] * self.width + ids_b[at_b]).tobytes()
        # Group by group, then piece by piece: where each stops in the lists of tokens, links and groups.
        text_a, text_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip((at_a[shared] + 1).tolist(), (at_b[shared] + 1).tolist(), strict=True):
            groups.append(f"{text_a[i]}|{text_b[j]}" if x - i == y - j == 1 else f"{','.join(text_a[i:x])}|{','.join(text_b[j:y])}")
            i, j = x, y
        stops = np.cumsum([len(r) for r in raw])
        link_stops = ((np.searchsorted(ends, stops) + 1) * 8).tolist()
        group_stops = (np.searchsorted(ends[shared], stops) + 1).tolist()
        i = j = 0
        for p, tokens, x, y in zip(pieces, a, link_stops, group_stops, strict=True):
            self.known[p] = ";".join(groups[j:y]), packed[i:x], len(tokens) | (y - j) << 32
            i, j = x, y

    def align(self, texts: list[str]) -> list[tuple[str, np.ndarray, int, int] | None]:
        """For each text: groups as text, links as packed id pairs, A tokens, groups; None for texts without tokens."""
        cut = [self.pieces(t) if t else [] for t in texts]
        if len(self.known) > self.cache:
            self.known = {}
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        for at in range(0, len(new), 20_000):
            self.learn(new[at : at + 20_000])
        get, out = self.known.__getitem__, []
        for pieces in cut:
            got = list(map(get, pieces))
            if not got or None in got:
                out.append(None)
                continue
            n = sum([g[2] for g in got])
            out.append((";".join([g[0] for g in got]), np.frombuffer(b"".join([g[1] for g in got]), np.int64), n & 0xFFFFFFFF, n >> 32))
        return out


_ALIGNERS: dict[str, Aligner] = worker_cache()


def _aligner(a_path: str, b_path: str, cache: int) -> Aligner:
    key = f"{cache} {a_path} {b_path}"
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(a_path, b_path, cache)
    return _ALIGNERS[key]


def packing(a_path: str, b_path: str) -> tuple[int, int]:
    """(width, bits): a pair is a * width + b, and an entry of a text's links is pair << bits | number."""
    aligner = Aligner(a_path, b_path, 0)
    return aligner.width, 63 - (len(aligner.a_bytes) * aligner.width - 1).bit_length()


def _entries(pairs: np.ndarray, bits: int) -> np.ndarray:
    """Distinct pairs with their numbers, packed; a number that has no room is dealt over several entries."""
    pairs, times = np.unique(pairs, return_counts=True)
    most = (1 << bits) - 1
    if len(times) and times.max() > most:
        many = -(-times // most)
        pairs = np.repeat(pairs, many)
        times = np.concatenate([np.r_[np.full(m - 1, most), t - (m - 1) * most] for m, t in zip(many, times, strict=True)])
    return pairs << bits | times


def align_texts(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False, cache: int = CACHE) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, links) for every row; `row` numbers the rows, links are entries of
    `packing`. with_groups adds the groups as text, `a1,a2|b1;a3|b2,b3`."""
    bits = packing(a_path, b_path)[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        aligner, row = _aligner(a_path, b_path, cache), TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for some in _some([t if isinstance(t, str) else "" for t in batch["_text"]]):
                rows = []
                for found in aligner.align(some):
                    groups, pairs, n_a, n_groups = found or ("", np.empty(0, np.int64), 0, 0)
                    # Every end closes a link, and those of groups are ends of both.
                    n_b = len(pairs) - n_a + n_groups
                    rows.append((n_a, n_b, n_groups, len(pairs), hashlib.sha256(groups.encode()).hexdigest() if found else "", _entries(pairs, bits), *([groups] if with_groups else [])))
                out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"] + ["groups"] * with_groups)
                out.insert(0, "id", batch["_id"].iloc[at : at + len(some)].array)
                out.insert(0, "row", np.arange(row, row + len(some)))
                at, row = at + len(some), row + len(some)
                yield out

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>" + ", groups string" * with_groups
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInPandas(tidy("align", run), schema)


def _exploded(aligned: DataFrame, bits: int) -> DataFrame:
    x = F.col("x")
    return aligned.select("row", F.explode("links").alias("x")).select("row", F.shiftright(x, bits).alias("pair"), x.bitwiseAND(F.lit((1 << bits) - 1)).alias("times"))


def pair_counts(aligned: DataFrame, width: int, bits: int) -> DataFrame:
    """(pair, a, b, n, texts, best_a, best_b): how many links hold the pair, in how many texts, and the highest n of its A id and B id."""
    counts = _exploded(aligned, bits).groupBy("pair").agg(F.sum("times").alias("n"), F.count("*").alias("texts"))
    counts = materialize(counts.withColumns({"a": F.expr(f"pair div {width}"), "b": F.col("pair") % width}), "pairs")
    for side in "ab":
        counts = counts.join(counts.groupBy(side).agg(F.max("n").alias(f"best_{side}")), side)
    return materialize(counts.select("pair", "a", "b", "n", "texts", "best_a", "best_b"), "pair-counts")


def with_counts(aligned: DataFrame, counts: DataFrame, bits: int, hot: int = HOT) -> DataFrame:
    """aligned (without links) with n_best_a, n_best, count_sum: links whose pair has its A id's and its B id's highest count, and the sum of counts."""
    pairs, entries = counts.agg(F.count("*"), F.coalesce(F.sum("texts"), F.lit(0))).first()
    facts = counts.select("pair", "n", (F.col("n") == F.col("best_a")).cast("long").alias("top_a"), (F.col("n") == F.col("best_b")).cast("long").alias("top_b"), "texts")
    common = F.lit(True) if pairs <= hot else F.col("texts") > entries / hot
    each, near = _exploded(aligned, bits), F.broadcast(facts.where(common).drop("texts"))
    met = each.join(near, "pair")
    if pairs > hot:
        met = met.unionByName(each.join(near.select("pair"), "pair", "left_anti").join(facts.where(~common).drop("texts"), "pair"))
    by = lambda c: F.sum(F.col("times") * F.col(c))
    sums = met.groupBy("row").agg(by("top_a").alias("n_best_a"), by("top_b").alias("n_best"), by("n").alias("count_sum"))
    new = ["n_best_a", "n_best", "count_sum"]
    return aligned.drop("links").join(sums, "row", "left").fillna(0, new)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for every document (and n_best_a)."""
    import public_tokenizers

    a, b = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    width, bits = packing(a, b)
    aligned = materialize(align_texts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), a, b), "aligned", "zstd")
    found = with_counts(aligned, pair_counts(aligned, width, bits), bits)
    return found.select(F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "n_best_a", "count_sum", "groups_sha256")
