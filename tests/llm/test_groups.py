"""HTML extraction, WARC, embeddings, near duplicates and the pipeline."""

import base64
import gzip
import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import TESTDATA
from tidemark.llm import embed_dedup, html_extract, near_dup, registry, warc
from tidemark.llm.common import components, scratch_path


def groups(ids, pairs):
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(7, 7), (7, None)]
    got = {r.id: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    real = [p for p in pairs if p[1] is not None and p[0] != p[1]]
    assert got == groups({i for p in real for i in p}, real)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def words(t):
    return t.encode().lower().split()


def shingles(t, k):
    w = words(t or "")
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_groups(docs, k):
    sets = {i: shingles(t, k) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, groups(ids, links)


def near_docs(seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 25, len(base) // 12])):
                copy[rng.randrange(len(copy))] = word()
            docs.append(" ".join(copy) if rng.random() < 0.8 else " ".join(copy).upper())
    return list(enumerate([*docs, None, "", " \n", "one", "one", "ONE two"]))


@pytest.mark.parametrize("hot", [64, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(near_dup, "HOT", hot)
    docs = near_docs()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, id string")
    sizes, want = brute_groups(docs, 2)
    got = near_dup.near_duplicates(df, k=2).collect()
    assert {r.id: r.n_shingles for r in got} == sizes and {r.id: r.component_id for r in got} == want and all(r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_of_odd_tables(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    df = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (5, "a b c"), (5, "x y z"), (7, "x y z"), (8, long), (9, long + " z")], "doc_id long, text string")
    got = {(r.id, r.component_id, r.kept) for r in near_dup.near_duplicates(df, k=2).collect()}
    assert got == {(None, None, True), (1, 1, True), (5, 1, False), (7, 1, False), (8, 8, True), (9, 8, False)}
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_of_ids_with_several_texts_in_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 2)
    rng = random.Random(9)
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    docs = []
    for i in range(40):
        copy = list(base)
        for _ in range(rng.randrange(14)):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(900)}"
        docs.append((i // 2, " ".join(copy)))
    docs += [(i, f"other text number {i} of its own") for i in range(20)]
    got = {(r.id, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=2).collect()}
    parts = [shingles(t, 2) for _, t in docs]
    links = [(docs[a][0], docs[b][0]) for a in range(len(docs)) for b in range(a + 1, len(docs)) if 100 * len(parts[a] & parts[b]) >= 80 * len(parts[a] | parts[b])]
    assert dict(got) == groups(sorted({i for i, _ in docs}), links)


def test_odd_sketch_tells_similarity():
    rng = np.random.default_rng(0)
    for share in (1.0, 0.9, 0.8):
        a = rng.integers(0, 2**63, 2000).astype(np.uint64)
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**63, 2000 - n).astype(np.uint64)])
        _, s = near_dup.fold(np.array([near_dup.samples(np.unique(x)) for x in (a, b)]))
        assert np.bitwise_count((s[0] ^ s[1]).view(np.uint64)).sum() <= near_dup.most_bits(80)


def vectors(seed=0, dim=9):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 9)):
            rows.append(((base + rng.normal(size=dim) * rng.choice([0.0, 0.03, 0.1])) * rng.choice([0.5, 1, 7])).tolist())
    return rows


@pytest.mark.parametrize("cell_rows", [512, 6])
def test_embeddings_equal_brute_force(spark, cell_rows):
    rows = vectors()
    data = [(i, v, i % 2) for i, v in enumerate(rows)] + [(1000, None, 1), (1001, [0.0] * 9, 1), (1002, [float("nan")] * 9, 1), (1003, rows[0], None), (1004, [1.0, 2.0], 0), (1005, [None] + rows[0][1:], 0), (1006, [], 0), (1007, [float("inf")] + rows[0][1:], 0)]
    df = spark.createDataFrame([(*r, "x") for r in data], "vec_id long, embedding array<double>, label int, m string")
    unit = {i: (np.array(v) / np.linalg.norm(v), y) for i, v, y in data if i < 1000}
    ids = sorted(unit)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if unit[a][1] == unit[b][1] and unit[a][0] @ unit[b][0] >= 0.98]
    want = groups([r[0] for r in data], links)
    got = {r.id: r for r in embed_dedup.near_vectors(df, cell_rows=cell_rows).collect()}
    assert {i: r.component_id for i, r in got.items()} == want and all(r.kept == (r.id == r.component_id) for r in got.values())
    assert {i: r.n_links for i, r in got.items()} == {i: sum(i in p for p in links) for i in want}


def test_embeddings_reach_the_target_recall(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 16))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1)[:, None] * base
    side /= np.linalg.norm(side, axis=1)[:, None]
    cos = rng.uniform(0.9801, 0.985, size=(1500, 1))  # planted partners right above the threshold
    x = np.concatenate([base, cos * base + np.sqrt(1 - cos * cos) * side])
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.id: r.n_links for r in embed_dedup.near_vectors(df, cell_rows=64).collect()}
    want = ((x @ x.T) >= 0.98).sum(1) - 1
    assert sum(got.values()) >= 0.99 * want.sum() and all(got[i] <= want[i] for i in got)
    sure = {r.id: r.n_links for r in embed_dedup.near_vectors(df, cell_rows=64, recall=1.0).collect()}
    assert all(sure[i] == want[i] for i in sure)


def test_embeddings_of_odd_tables(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (None, [1.0, 0.01], 1), (4, [0.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted((str(r.id), r.n_links, str(r.component_id), r.kept) for r in embed_dedup.near_vectors(df).collect())
    assert got == [("3", 2, "3", True), ("3", 2, "3", True), ("4", 0, "4", True), ("None", 2, "None", True)]
    assert embed_dedup.near_vectors(df.limit(0)).count() == 0


def test_multi_sequence_order():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    got = list(embed_dedup.multi_sequence(a, b, 0.9))
    sums = [a[i] ** 2 + b[j] ** 2 for i, j in got]
    assert sums == sorted(sums) and set(got) == {(i, j) for i in range(7) for j in range(5) if a[i] ** 2 + b[j] ** 2 <= 0.81}


def test_warc_round_trip(spark):
    pages = [(1, "http://a", "é<p>"), (2, None, "é<p>"), (3, "http://b\nc", None), (-4, "http://d", ""), (None, "http://e", "x"), (9, "u", "x" * 300_000), (9, "u", "x" * 300_000)]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, size int")
    manifest = warc.write_archives(df.repartition(3), scratch_path(spark, "warc"))
    for split in (1 << 20, 97):
        got = warc.read_archives(manifest, split).collect()
        want = []
        for p, _, h in pages:
            raw = (h or "").encode()
            top = max(q for q, _, g in pages if (g or "").encode() == raw and q is not None) if any(q is not None and (g or "").encode() == raw for q, _, g in pages) else None
            again = top is not None and p != top
            want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", top if again else None))
        assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    empty = warc.write_archives(df.limit(0), scratch_path(spark, "warc"))
    assert warc.read_archives(empty).count() == 0


def test_warc_reader_skips_what_only_looks_like_a_member():
    good = warc.record(5, "u", hashlib.sha1(b"p").digest(), 1, None, b"p", False)
    data = b"\x1f\x8b\x08junk" + good + b"\x1f\x8b\x08" + good
    read = lambda at, n: data[at : at + n]
    assert len(list(warc.members(read, 0, len(data), len(data)))) == 2
    for cut in range(0, len(data), 7):  # each record is owned once, wherever the ranges meet
        assert len(list(warc.members(read, 0, cut, len(data)))) + len(list(warc.members(read, cut, len(data), len(data)))) == 2


def test_warc_reader_reads_each_byte_about_once(spark):
    rng = random.Random(2)
    data = b"".join(warc.record(i, f"http://h/{i}", hashlib.sha1(b"x").digest(), 400, None, bytes(rng.randrange(256) for _ in range(400)), False) for i in range(4_000))
    count = [0, 0]

    def read(at, n):
        count[0] += n
        count[1] += 1
        return data[at : at + n]

    got = []
    for start in range(0, len(data), 1 << 18):
        got += list(warc.members(read, start, min(len(data), start + (1 << 18)), len(data)))
    assert len(got) == 4_000 and all(whole for _, whole in got)
    assert count[0] <= 1.1 * len(data) and count[1] < 40


def test_warc_archives_from_elsewhere(spark):
    def member(head, block=b"x", cut=None):
        raw = "\r\n".join(["WARC/1.0", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
        data = gzip.compress(raw)
        return data[:cut] if cut else data

    ours = warc.record(5, "u", hashlib.sha1(b"p").digest(), 1, None, b"p", False)
    page = b"HTTP/1.1 200 OK\r\n\r\nbody"
    noise = random.Random(1).randbytes(3000)
    data = (
        member(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>"]) + member(["WARC-Type: response", "WARC-Record-ID: <http://x/1>"], page)
        + member(["WARC-Type: response", "WARC-Record-ID: <urn:uuid:0f5b9b8e-1c5f-4a86-9a1e-2d6b7c8d9e0f>"], page) + member(["WARC-Type: response"], page)
        + member(["WARC-Type: response", "WARC-Record-ID: <x>"], noise, -900) + ours
    )
    path = scratch_path(spark, "foreign").removeprefix("file://")
    os.makedirs(path)
    with open(f"{path}/a.warc.gz", "wb") as f:
        f.write(data)
    manifest = spark.createDataFrame([(f"file://{path}/a.warc.gz", len(data), 6)], "file string, size long, records long")
    got = sorted((r.record_type, str(r.page_id), r.payload_bytes) for r in warc.read_archives(manifest).collect())
    assert got == [("damaged", "None", 0), ("response", "5", 1), ("response", "None", 4), ("response", "None", 4), ("response", "None", 4)]


def test_warc_shared_payloads_by_join(spark):
    rows = [(i % 40 if i % 7 else None, f"http://h/{i}", "same" if i % 3 else f"own {i}") for i in range(120)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = [sorted(map(str, warc.read_archives(warc.write_archives(df, scratch_path(spark, "warc"), broadcast_rows=n)).collect())) for n in (1000, -1)]
    assert got[0] == got[1] and len(got[0]) == 120


def test_warc_query(spark):
    got = registry.queries()["op8_warc"](spark, TESTDATA)
    pages = spark.read.parquet(f"{TESTDATA}/pages.parquet")
    assert got.count() == pages.count() and got.join(pages, "page_id").where("payload_bytes <> octet_length(html)").count() == 0


PAGE = "<html><head><title>T</title></head><body><header><a>Logo</a></header><nav>Menu</nav><div class='{main}'><h1>A &amp; B</h1><p>One <b>two</b>{n}<p>three&nbsp;{n}</div><div class='cookie-notice'>We use</div><aside>Side</aside><div id=comments><p>Nice!</p></div><form>Mail</form><p>All rights</p><footer>F</footer></body></html>"


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a b"), ("<article>x<script>var t='</p>';</script> y", "x y"),
        ("<body><main><p>m</p></main><p>o</p></body>", "m"), ("<div><article><header><h1>T</h1></header><p>x</p><section id='comments'>c</section></article>tail</div>", "T x"),
        ("<article><p>cut &am", "cut &am"), ("<article>a<!-- x", "a"), ("<div class='content with-sidebar'><div class='article-header'><h1>T</h1></div>x<div class='ad-slot'>no</div></div><p>o", "T x"), ("<article>x<article class='comment'>no</article></article>", "x"), ("<article><p>1 < 2 and <b", "1 < 2 and"), ("<article><ul><li>a<li>b</ul>a<br>b <i>c</i>d</article>", "a b a b cd"),
    ],
)
def test_html_cases(source, text):
    assert html_extract.main_text(html_extract.Page(source or "")) == text


def test_html_template_and_odd_rows(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(main="wrap", n=f" n{i}"), "x") for i in range(12)] + [(12, None, None, "x"), (None, "bad url", "<p>solo</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.id: r.text for r in html_extract.extract(df).collect()}
    # Without any mark of an article, what all pages of the host share is template.
    assert got[3] == "One two n3 three n3" and got[12] == "" and got[None] == "solo"
    same = html_extract.extract(df, broadcast_tokens=-1)
    assert {r.id: r.text for r in same.collect()} == got
    assert html_extract.extract(df.limit(0)).count() == 0


def test_html_template_inside_articles(spark):
    page = "<nav>Menu</nav><article><h1>Title {n}</h1><p>Body {n}</p><div>Share this</div><section>Subscribe now</section></article><p>End</p>"
    rows = [(i, f"https://h.example/{i}", page.format(n=i)) for i in range(10)]
    # On one page the template's tokens stand in another order: its class isn't valid there, so its text stays.
    rows.append((10, "https://h.example/10", "<article><section>Subscribe now</section><div>Share this</div><h1>Title 10</h1><p>Body 10</p></article><nav>Menu</nav><p>End</p>"))
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title 3 Body 3" and got[10] == "Subscribe now Share this Title 10 Body 10"


def test_html_classes_nest():
    # Tokens 1 to 3 are one class; 5 and 6 occur twice, each time in one slot of it or, in the second list, across two.
    template = {1: (7, 0), 5: (8, 1), 6: (8, 2), 2: (7, 3), 3: (7, 4)}
    assert html_extract.valid_classes([1, 5, 6, 2, 5, 6, 3], template) == {7, 8}
    assert html_extract.valid_classes([1, 5, 2, 6, 5, 6, 3], template) == {7}


def test_html_template_decides_without_marks(spark):
    # On hosts of four pages or more, neither the article's tags nor class names are needed.
    pages = spark.read.parquet(f"{TESTDATA.replace('sf0.001', 'sf0.01')}/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace(F.regexp_replace("html", "</?(article|main)[^>]*>", ""), ' class="[^"]*"', ""))
    with_, without = ({r.id: r.text for r in html_extract.extract(x).collect()} for x in (pages, bare))
    hosts = {}
    for r in pages.collect():
        hosts.setdefault(html_extract.host_of(r.url), {})[r.page_id] = r.html
    large = [i for found in hosts.values() if len(set(found.values())) >= 4 for i in found]
    assert len(large) > 150 and all(with_[i] == without[i] for i in large)
    assert sum(with_[i] != without[i] for i in with_) > 10  # small hosts have no template


def test_html_main_slot_against_marks(spark):
    # The class names lie: what fills the leading slot is the article; a menu of links and comments are not.
    page = "<body><div class='content'>Hello reader</div><h1>Title {n}</h1><div class='widget'><p>{t}</p><p>{t}</p></div><div class='links'><a>{t} {t} {t} {t} link</a></div><section>c{n}</section></body>"
    rows = [(i, f"https://h.example/{i}", page.format(n=i, t=f"words of page {i} that go on and on")) for i in range(8)]
    got = {r.id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Title {i} " + " ".join([f"words of page {i} that go on and on"] * 2) for i in range(8))


def test_html_classes_equal_brute_force(spark):
    pages = spark.read.parquet(f"{TESTDATA.replace('sf0.001', 'sf0.01')}/pages.parquet").select(F.col("page_id").alias("id"), "url", "html")
    got = {r.host: r for r in html_extract.deduce(html_extract.tokenise(pages.unionByName(pages.where("id % 3 = 0")))).collect()}
    hosts = {}
    for r in pages.collect():
        hosts.setdefault(html_extract.host_of(r.url), {})[r.html] = html_extract.Page(r.html)
    checked = 0
    for host, found in hosts.items():
        vectors, order = {}, list(found.values())
        for k, page in enumerate(order):
            for t in page.tokens:
                vectors.setdefault(t, [0] * len(order))[k] += 1
        kinds = {t: k for page in order for t, k in zip(page.tokens, page.kinds, strict=True)}
        classes = {}
        for t, vector in vectors.items():
            seen = sum(n > 0 for n in vector)
            if seen >= 4 and seen >= 0.5 * len(order):
                classes.setdefault(tuple(vector), set()).add(t)
        want = {frozenset(c) for c in classes.values() if len(c) > 1 and any(kinds[t] != html_extract.TEXT for t in c)}
        mine = {}
        for t in got[host].rows if host in got else []:
            mine.setdefault(t.cls, set()).add(t.token)
        assert {frozenset(c) for c in mine.values()} == want
        if not want:
            continue
        template = html_extract.Template(got[host].rows)
        for page in order:
            valid = html_extract.valid_classes(page.tokens, template.place)
            spans = {}
            for c in valid:
                at = [i for i, t in enumerate(page.tokens) if template.place.get(t, (None,))[0] == c]
                m = len({page.tokens[i] for i in at})
                spans[c] = (at, [(at[i], at[i + m - 1]) for i in range(0, len(at), m)])
            for a in valid:
                for b in valid - {a}:
                    # Nesting: each occurrence of one class has no token of the other inside, or the other way round.
                    inside = [any(lo < x < hi for lo, hi in spans[p][1] for x in spans[q][0]) for p, q in ((a, b), (b, a))]
                    assert not all(inside)
                    checked += 1
    assert checked > 50


def test_html_long_page():
    assert len(html_extract.main_text(html_extract.Page("<article>" + "<p>word</p>" * 50_000))) == 50_000 * 5 - 1


def test_html_query(spark):
    got = registry.queries()["op1_html_extraction"](spark, TESTDATA).collect()
    pages = {r.page_id: r for r in spark.read.parquet(f"{TESTDATA}/pages.parquet").collect()}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) and r.url == pages[r.page_id].url for r in got)
