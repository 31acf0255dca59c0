"""Main text of web pages by equivalence-class template deduction.

1. Each page becomes tokens: tags with the path of tags and classes above them, and text blocks with their path. Pages
   are parsed once; tokens and blocks are stored, and all that follows works on them.
2. Per host, tokens that occur equally often in each of the host's different pages have the same occurrence vector
   and form an equivalence class. Vectors are compared by a sum of page hashes times counts, so they are built by a
   plain aggregation; exact copies of a page count once.
3. Large and frequent classes (at least `min_pages` pages and `share` of the host's, two tokens or more, one of them a
   tag) make the host's template; a class's tokens are in the order that most pages have. On a page, a class is valid if its tokens stand in the
   template's order, as often as the class occurs, and each occurrence lies in one slot of every larger valid class, or
   the other way round: valid classes nest. Text of a valid class is template wherever it stands, inside an article too.
4. Block tags of valid classes that occur once a page cut it into slots; classes nested in a slot belong to it. What is
   left in a slot is the page's own. The slot with most text outside of links over all pages of the host, at least
   `lead` times that of the next, is the host's main slot, and its blocks are the page's text, with a slot of headings
   right before it and what stands in the same article.
5. Elements that HTML names as menus, headers, footers, asides, forms, scripts, styles or the head never count. Marks
   (class, id and role words of adverts, notices, comments and the like; the article, else a main element, else a
   content container) choose among the blocks of the main slot, unless they would take most of it. Alone they decide only where
   no template does: hosts of few pages, pages that don't follow their host's template, and slots too even to tell.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined
in page order by one space. Nothing else is dropped or cut.

Cases: null and empty html give the empty text; unclosed, crossed and truncated tags are closed as browsers do for
the common cases; a null or odd url belongs to the host ''. Repeated rows each get a result; null page ids are kept.
Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import html as _html
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, tidy

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|$)|<[a-zA-Z/][^<>]*$", re.S)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")
#: Fixed lists of HTML: elements without content, raw text, and inline elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
#: Elements that a new one of the same group ends.
GROUPS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("article aside blockquote body div dl fieldset footer form header html main nav ol section table td th ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CHROME_TAGS = frozenset("head nav footer aside form button select menu dialog".split()) | RAW
#: Words in class, id or role that mark what isn't the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs "
    "sidebar aside rail widget widgets footer header masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert popup modal overlay paywall "
    "comment comments commentlist disqus replies reply respond discussion feedback share sharing social related recommended recommendations trending popular newsletter subscribe subscription signup login search searchbox "
    "pagination pager skip hidden complementary contentinfo tags legal copyright".split()
)
#: First parts of a mark that make its other parts describe the content or its layout.
OF_CONTENT = frozenset("has with without no article post entry story".split())
CONTENT_WORDS = frozenset("article articlebody content maincontent post entry story main body-text articletext".split())


def _h(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x00".join(map(str, parts))) - (1 << 63)


def host_of(url: object) -> str:
    m = _HOST.match(url) if isinstance(url, str) else None
    return m.group(1).lower() if m else ""


class Frame:
    """An open element: its path's hash and what it makes of the text inside.

    hard: by its tags the text isn't the article's; chrome: by its tags or marks.
    """

    __slots__ = ("name", "path", "chrome", "hard", "root", "link")

    def __init__(self, name: str, path: int, chrome: bool, hard: bool, root: int, link: bool):
        self.name, self.path, self.chrome, self.hard, self.root, self.link = name, path, chrome, hard, root, link


_TOP = Frame("", 0, False, False, 0, False)
ARTICLE, MAIN, CONTENT = 3, 2, 1


@functools.lru_cache(maxsize=10_000)
def _is_chrome(mark: str) -> bool:
    """Whether a class, id or role is, begins or ends with a word of chrome; not "with-sidebar", not "article-header"."""
    parts = re.split(r"[-_:]+", mark)
    return mark in CHROME_WORDS or (parts[0] not in OF_CONTENT and (parts[0] in CHROME_WORDS or parts[-1] in CHROME_WORDS))


def _open(name: str, attrs: str, up: Frame) -> Frame:
    marks: list[str] = []
    hidden = False
    if attrs:
        for key, value in _ATTR.findall(attrs):
            key, value = key.lower(), value.strip("\"'").lower()
            if key in ("class", "id", "role", "itemprop"):
                marks += value.split()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                hidden = True
    words = {w for m in marks for w in (m, *re.split(r"[-_:]+", m))}
    root = up.root
    hard = up.hard or hidden or name in CHROME_TAGS or (name == "header" and up.root < ARTICLE)
    chrome = up.chrome or hard
    if not chrome and marks and name not in ("html", "body", "main"):
        chrome = any(map(_is_chrome, marks)) and not (name == "article" and not words & {"comment", "comments", "reply"})
    if not chrome:
        if name == "article":
            root = ARTICLE
        elif name == "main" or "main" in words:
            root = max(root, MAIN)
        elif words & CONTENT_WORDS:
            root = max(root, CONTENT)
    return Frame(name, _h(up.path, name, *sorted(marks)), chrome, hard, root, up.link or name == "a")


#: Kinds of tokens: block tags, inline tags, text.
TAG, INNER, TEXT = 0, 1, 2
#: What a block's flags hold beside its root (two lowest bits).
CHROME, HARD, HEADING = 4, 8, 16


class Page:
    """A page's tokens (of tags and text blocks, in order), their kinds, and its text blocks.

    Of each block: text, its token's place in the page, flags, and how much of it is not a link's.
    """

    def __init__(self, source: str):
        self.tokens: list[int] = []
        self.kinds: list[int] = []
        self.texts: list[str] = []
        self.at: list[int] = []
        self.flags: list[int] = []
        self.free: list[int] = []
        self._stack = [_TOP]
        # Text under chrome is held apart, so that it doesn't split the text around it.
        self._parts: tuple[list[str], list[str]] = ([], [])
        self._from: list[Frame] = [_TOP, _TOP]
        self._linked = [0, 0]
        self._read(source)
        self._flush()

    def _flush(self) -> None:
        for side in (1, 0):
            if parts := self._parts[side]:
                self._block("".join(parts), self._from[side], self._linked[side])
                parts.clear()
                self._linked[side] = 0

    def _block(self, raw: str, at: Frame, linked: int) -> None:
        text = " ".join(raw.split())
        if text:
            self.at.append(len(self.tokens))
            self.texts.append(text)
            self.flags.append(at.root + CHROME * at.chrome + HARD * at.hard + HEADING * (at.name in HEADINGS))
            self.free.append(max(0, len(text) - linked))
            self.tokens.append(_h(at.path, "=", text))
            self.kinds.append(TEXT)

    def _tag(self, f: Frame) -> None:
        self.tokens.append(f.path)
        self.kinds.append(INNER if f.name in INLINE else TAG)

    def _text(self, raw: str) -> None:
        top = self._stack[-1]
        if not raw:
            return
        side, text = int(top.chrome), _html.unescape(raw) if "&" in raw else raw
        parts, at = self._parts[side], self._from[side]
        if parts and (top.hard != at.hard if side else top.root != at.root):
            # A block belongs to one root; where it changes (unclosed tags), a new block begins.
            self._flush()
        if not parts:
            self._from[side] = next((f for f in reversed(self._stack) if f.name not in INLINE), top)
        parts.append(text)
        self._linked[side] += len(text) * top.link

    def _pop_to(self, k: int) -> None:
        while len(self._stack) > k:
            f = self._stack.pop()
            if f.name not in INLINE:
                self._flush()

    def _read(self, s: str) -> None:
        at, n, stack = 0, len(s), self._stack
        find = _TOKEN.search
        while at < n:
            m = find(s, at)
            if m is None:
                self._text(s[at:])
                return
            if m.start() > at:
                self._text(s[at : m.start()])
            at = m.end()
            name = m.group(2)
            if not name:
                continue
            name = name.lower()
            if m.group(1):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        self._pop_to(k)
                        break
                    # An inline end tag doesn't reach past a block's container.
                    if name in INLINE and stack[k].name in SCOPES:
                        break
                if name not in INLINE:
                    self._flush()
                continue
            if name == "br" or name == "hr":
                if name == "hr":
                    self._flush()
                elif self._parts[0]:
                    self._parts[0].append(" ")
                continue
            group = GROUPS.get(name, {"p"} if name in ENDS_P else None)
            if group:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in group:
                        self._pop_to(k)
                        break
                    if stack[k].name in SCOPES and stack[k].name not in group:
                        break
            if name not in INLINE:
                self._flush()
            f = _open(name, m.group(3), stack[-1])
            self._tag(f)
            if name in RAW and not m.group(3).endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(s, at)
                at = end.end() if end else n
                continue
            if name not in VOID and not m.group(3).endswith("/"):
                stack.append(f)


def orders(tokens: list[int], cls: dict[int, int]) -> dict[int, list[int]]:
    """Class to its tokens in the order of their first places on this page."""
    out: dict[int, list[int]] = {}
    for t in dict.fromkeys(tokens):
        if (c := cls.get(t)) is not None:
            out.setdefault(c, []).append(t)
    return out


def _nests(inner: tuple[list[int], int], outer: tuple[list[int], int]) -> bool:
    """Whether each occurrence of one class lies in one slot of the other; a class is its places and how many make an occurrence."""
    (at, m), (others, _) = inner, outer
    return all(bisect(others, at[i]) == bisect(others, at[i + m - 1]) for i in range(0, len(at), m))


def valid_classes(tokens: list[int], template: dict[int, tuple[int, int]]) -> set[int]:
    """The classes whose tokens stand in the template's order on this page and nest with the larger valid classes."""
    found: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(tokens):
        if c := template.get(t):
            found.setdefault(c[0], []).append((i, c[1]))
    members = Counter(c for c, _ in template.values())
    valid: dict[int, tuple[list[int], int]] = {}
    for c in sorted(found, key=lambda c: (-members[c], c)):
        order = sorted({place for _, place in found[c]})
        if len(order) == members[c] and [place for _, place in found[c]] == order * (len(found[c]) // len(order)):
            own = ([i for i, _ in found[c]], len(order))
            if all(_nests(own, other) or _nests(other, own) for other in valid.values()):
                valid[c] = own
    return set(valid)


class Template:
    """A host's template: token -> (class, place), the text tokens, the block tags, and the main slot, if one leads."""

    def __init__(self, rows: list | None = None, main: int | None = None):
        rows = rows if rows is not None else []
        self.place = {t["token"]: (t["cls"], t["at"]) for t in rows}
        self.texts = {t["token"] for t in rows if t["kind"] == TEXT}
        self.tags = {t["token"] for t in rows if t["kind"] == TAG}
        self.main = None if main is None or main != main else int(main)

    def cut(self, tokens: list[int], at: list[int]) -> tuple[set[int], list[int | None]]:
        """(template texts that count on this page, each block's slot); a slot is named by the tag that opens it."""
        if not self.place:
            return set(), [None] * len(at)
        valid = valid_classes(tokens, self.place)
        texts = {t for t in self.texts if self.place[t][0] in valid}
        often = Counter(t for t in tokens if t in self.tags)
        places = [(i, t) for i, t in enumerate(tokens) if often.get(t) == 1 and self.place[t][0] in valid]
        found = [bisect(places, (k,)) - 1 for k in at]
        return texts, [places[k][1] if k >= 0 else None for k in found]


EMPTY = Template()


def chosen(tokens: list[int], at: list[int], flags: list[int], free: list[int], template: Template = EMPTY) -> list[int]:
    """The numbers of the blocks that are the page's text, in page order."""
    texts, slots = template.cut(tokens, at)
    own = [k for k in range(len(at)) if not flags[k] & HARD and tokens[at[k]] not in texts]
    plain = [k for k in own if not flags[k] & CHROME]
    main = [k for k in own if slots[k] == template.main] if template.main is not None else []
    if main:
        unmarked = [k for k in main if not flags[k] & CHROME]
        # Marks that would take most of the main slot are wrong here.
        main = unmarked if 2 * sum(free[k] for k in unmarked) >= sum(free[k] for k in main) else main
        first, root = main[0], max(flags[k] & 3 for k in main)
        before = slots[next((k for k in range(first - 1, -1, -1) if slots[k] != template.main), first)]
        titles = [k for k in plain if k < first and slots[k] == before and before != template.main]
        titles = titles if all(flags[k] & HEADING for k in titles) else []
        plain = sorted({*main, *titles, *(k for k in plain if root and flags[k] & 3 == root)})
    root = max((flags[k] & 3 for k in plain), default=0)
    return [k for k in plain if root == 0 or flags[k] & 3 == root or (root < ARTICLE and flags[k] & 3 >= root)]


def main_text(page: Page, template: Template = EMPTY) -> str:
    return " ".join([page.texts[k] for k in chosen(page.tokens, page.at, page.flags, page.free, template)])


def tokenise(pages: DataFrame) -> DataFrame:
    """The rows of pages (id, url, html) as (id, url, host, page, tokens, kinds, nth, texts, at, flags, free).

    page: hash of the html; nth: how manieth occurrence of its token on the page each is; the rest as in Page.
    """
    kind = pages.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, size = [], 0
            for i, url, source in zip(b["id"], b["url"], b["html"], strict=True):
                s = source if isinstance(source, str) else ""
                p = Page(s)
                rows.append((i, url, host_of(url), _h(s), np.array(p.tokens, np.int64), np.array(p.kinds, np.int8), _nth(p.tokens), p.texts, np.array(p.at, np.int32), np.array(p.flags, np.int8), np.array(p.free, np.int32)))
                size += len(s)
                if size > 4_000_000:
                    yield _frame(rows)
                    rows, size = [], 0
            if rows:
                yield _frame(rows)

    # Ids travel as strings: pandas would turn a column with nulls into floats.
    rows = pages.withColumn("id", F.col("id").cast("string"))
    out = rows.mapInPandas(tidy("html", run), "id string, url string, host string, page long, tokens array<long>, kinds array<byte>, nth array<int>, texts array<string>, at array<int>, flags array<byte>, free array<int>")
    return out.withColumn("id", F.col("id").cast(kind))


def _nth(tokens: list[int]) -> np.ndarray:
    count: Counter = Counter()
    out = np.empty(len(tokens), np.int32)
    for i, t in enumerate(tokens):
        count[t] += 1
        out[i] = count[t]
    return out


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["id", "url", "host", "page", "tokens", "kinds", "nth", "texts", "at", "flags", "free"])


def deduce(parsed: DataFrame, share: float = 0.5, min_pages: int = 4, lead: float = 2.0, broadcast_tokens: int = 200_000) -> DataFrame:
    """(host, rows, main): each host's template, rows (cls, at, token, kind) by class and order, and its main slot."""
    # How often a token occurs on a page is the number of its last occurrence there, so copies of a page count once; then
    # one number stands for a token's occurrence vector over the host's pages. Token 0 is the page itself.
    every = F.arrays_zip(F.col("tokens").alias("token"), F.col("kinds").alias("kind"), F.col("nth").alias("n"))
    page = F.array(F.struct(F.lit(0).cast("long").alias("token"), F.lit(0).cast("byte").alias("kind"), F.lit(1).alias("n")))
    seen = parsed.select("host", "page", F.inline(F.concat(page, every))).groupBy("host", "token", "page").agg(F.first("kind").cast("int").alias("kind"), F.max("n").alias("n"))
    vector = F.sum(F.xxhash64("page", "n").bitwiseAND(F.lit((1 << 40) - 1)))
    tokens = seen.groupBy("host", "token").agg(F.first("kind").alias("kind"), F.count("*").alias("pages"), vector.alias("vector"))
    tokens = materialize(tokens.where(F.col("pages") >= min_pages), "tokens")
    whole = tokens.where("token = 0").select("host", F.col("pages").alias("host_pages"))
    frequent = tokens.where("token <> 0").join(whole, "host").where(F.col("pages") >= share * F.col("host_pages"))
    cls = F.xxhash64("pages", "vector")
    # A class needs two tokens: a text that shares its vector with no tag is repeated content, not template.
    sizes = frequent.groupBy("host", cls.alias("cls")).agg(F.count("*").alias("size"), F.max((F.col("kind") != TEXT).cast("int")).alias("has_tag")).where("size > 1 AND has_tag = 1")
    frequent = frequent.withColumn("cls", cls).join(sizes, ["host", "cls"])
    members = materialize(frequent.groupBy("host").agg(F.collect_list(F.struct("token", "cls", "kind")).alias("rows")), "members")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            votes: Counter = Counter()
            cls: dict[str, dict[int, int]] = {}
            for host, tokens, rows in zip(b["host"], b["tokens"], b["rows"], strict=True):
                if host not in cls:
                    cls[host] = {t["token"]: t["cls"] for t in rows}
                votes.update((host, c, tuple(o)) for c, o in orders(tokens.tolist(), cls[host]).items())
            yield pd.DataFrame([(h, c, list(o), n) for (h, c, o), n in votes.items()], columns=["host", "cls", "tokens", "n"])

    # The order of most pages is the class's; pages vote by the whole order.
    votes = _with_host(parsed.select("host", "tokens"), members, broadcast_tokens, "inner").mapInPandas(tidy("html", vote), "host string, cls long, tokens array<long>, n long")
    votes = votes.groupBy("host", "cls", "tokens").agg(F.sum("n").alias("n"))
    best = votes.groupBy("host", "cls").agg(F.max_by("tokens", F.struct(F.col("n"), F.col("tokens"))).alias("tokens"))
    placed = best.select("host", "cls", F.posexplode("tokens").alias("at", "token"))
    placed = placed.join(members.select("host", F.inline("rows")), ["host", "token", "cls"])
    template = materialize(placed.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("cls", "at", "token", "kind"))).alias("rows")), "placed")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sums: Counter = Counter()
            known: dict[str, Template] = {}
            for host, tokens, at, flags, free, rows in zip(b["host"], b["tokens"], b["at"], b["flags"], b["free"], b["rows"], strict=True):
                if host not in known:
                    known[host] = Template(rows)
                tokens, at = tokens.tolist(), at.tolist()
                texts, slots = known[host].cut(tokens, at)
                for k, f, n, slot in zip(at, flags.tolist(), free.tolist(), slots, strict=True):
                    if slot is not None and not f & HARD and tokens[k] not in texts:
                        sums[host, slot] += n
            yield pd.DataFrame([(h, x, n) for (h, x), n in sums.items()], columns=["host", "slot", "n"])

    slots = _with_host(parsed.select("host", "tokens", "at", "flags", "free"), template, broadcast_tokens, "inner").mapInPandas(tidy("html", weigh), "host string, slot long, n long")
    slots = slots.groupBy("host", "slot").agg(F.sum("n").alias("n")).groupBy("host").agg(F.sort_array(F.collect_list(F.struct("n", "slot")), False).alias("s"))
    first, next_ = F.get("s", 0), F.coalesce(F.get("s", 1)["n"], F.lit(0))
    slots = slots.select("host", F.when((first["n"] > 0) & (first["n"] >= lead * next_), first["slot"]).alias("main"))
    return template.join(slots, "host", "left").select("host", "rows", "main")


def _with_host(rows: DataFrame, template: DataFrame, broadcast_tokens: int, how: str) -> DataFrame:
    """rows with the columns of their host in template; small templates (checked) go to the rows, otherwise Spark joins by host and splits a host with many pages."""
    tokens = template.agg(F.coalesce(F.sum(F.size("rows")), F.lit(0))).first()[0]
    return rows.join(F.broadcast(template) if tokens <= broadcast_tokens else template, "host", how)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_tokens: int = 200_000, **rule) -> DataFrame:
    """(id, url, text) of every row."""
    kind = pages.schema[id_col].dataType.simpleString()
    parsed = materialize(tokenise(pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "parsed", "zstd")
    template = materialize(deduce(parsed, broadcast_tokens=broadcast_tokens, **rule), "template")
    joined = _with_host(parsed.drop("page", "kinds", "nth"), template, broadcast_tokens, "left").withColumns({"id": F.col("id").cast("string"), "main": F.col("main").cast("string")})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            known: dict[str, Template] = {}
            out = []
            for host, tokens, texts, at, flags, free, rows, main in zip(b["host"], b["tokens"], b["texts"], b["at"], b["flags"], b["free"], b["rows"], b["main"], strict=True):
                if host not in known:
                    known[host] = Template(rows, None if main is None else int(main))
                out.append(" ".join([texts[k] for k in chosen(tokens.tolist(), at.tolist(), flags.tolist(), free.tolist(), known[host])]))
            yield pd.DataFrame({"id": b["id"].array, "url": b["url"].array, "text": out})

    return joined.mapInPandas(tidy("html", run), "id string, url string, text string").withColumn("id", F.col("id").cast(kind))


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
