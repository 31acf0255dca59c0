"""Dictionary entity recognition as joins: n-gram chunks against a table of terms.

The dictionary is a table (brand, industry, kind, term): kinds are name, alias, product and keyword. It goes to the
chunks by broadcast if it has at most `broadcast_terms` rows (checked), else by a join on the term or its length.

Similarity is the Levenshtein ratio of module fuzzy, both sides in lower case; its index finds every pair that is alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import ngrams, strings
from tidemark.operators.fuzzy import fitting_lengths, partial_ratio, ratio, similar_pairs, token_sort_ratio
from tidemark.sources.shared import stored

# -- fixed values that results depend on: phrases that make two brands in one text a comparison, endings that a product's
# name may take, the weights of the composite score, and the least ratios of each fuzzy test
COMPARISONS = ["better than", "worse than", "vs", "versus", "compared to", "comparison", "prefer", "instead of", "switched from", "upgraded from", "downgraded from", "beats", "outperforms"]
DESCRIPTORS = ["pro", "plus", "max", "mini", "ultra", "lite"]
WEIGHTS = {"ratio": 0.4, "partial": 0.2, "token_sort": 0.25, "token_set": 0.15}
KEYWORD_RATIO, PHRASE_RATIO, PRODUCT_RATIO, INDUSTRY_RATIO = 80.0, 80.0, 70.0, 85.0

DICTIONARY = T.StructType([T.StructField(n, T.StringType()) for n in ("brand", "industry", "kind", "term")])


def load_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(brand, industry, kind, term) from JSON {"industries": {industry: {"brands": {brand: {...}}}}}, names, aliases, products and keywords."""
    item = "struct<name:string,aliases:array<string>,products:array<string>,keywords:array<string>,competitors:array<string>>"
    raw = spark.read.option("multiLine", True).option("wholetext", True).text(path)
    tree = raw.select(F.from_json("value", f"struct<industries:map<string,struct<brands:map<string,{item}>>>>").alias("j"))
    brands = tree.select(F.explode("j.industries").alias("industry", "v")).select("industry", F.explode("v.brands").alias("key", "b"))
    return terms_of(brands.select(F.coalesce("b.name", "key").alias("brand"), "industry", "b.aliases", "b.products", "b.keywords"))


def load_competitors(spark: SparkSession, path: str) -> DataFrame:
    """(brand, competitor) as stated in the JSON, in lower case; see competitor_map for the closure."""
    item = "struct<name:string,competitors:array<string>>"
    raw = spark.read.option("wholetext", True).text(path)
    tree = raw.select(F.from_json("value", f"struct<industries:map<string,struct<brands:map<string,{item}>>>>").alias("j"))
    brands = tree.select(F.explode("j.industries").alias("industry", "v")).select(F.explode("v.brands").alias("key", "b"))
    return brands.select(F.lower(F.coalesce("b.name", "key")).alias("brand"), F.explode("b.competitors").alias("c")).select("brand", F.lower("c").alias("competitor"))


def terms_of(brands: DataFrame) -> DataFrame:
    """One row a term from (brand, industry, aliases, products, keywords); keywords of three letters or fewer are no terms."""
    lists = [("name", F.array("brand")), ("alias", F.col("aliases")), ("product", F.col("products")), ("keyword", F.filter("keywords", lambda k: F.char_length(k) > 3))]
    rows = [brands.select("brand", "industry", F.lit(k).alias("kind"), F.explode(c).alias("t")) for k, c in lists]
    out = reduce(DataFrame.unionByName, rows).select("brand", "industry", "kind", F.lower("t").alias("term"))
    # A term of several brands belongs to the last by name, whatever its kind.
    order = Window.partitionBy("term").orderBy(F.desc("brand"), F.array_position(F.array(*[F.lit(k) for k, _ in lists]), F.col("kind")))
    return out.where("term <> ''").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def competitor_map(pairs: DataFrame) -> DataFrame:
    """The symmetric closure of (brand, competitor), in lower case."""
    low = pairs.select(F.lower("brand").alias("brand"), F.lower("competitor").alias("competitor"))
    back = low.select(F.col("competitor").alias("brand"), F.col("brand").alias("competitor"))
    return low.unionByName(back).where("brand <> competitor").distinct()


def brand_info(terms: DataFrame, brand: str) -> DataFrame:
    """(brand, industry, kind, terms) of one brand, whatever the case of its name."""
    return terms.where(F.lower("brand") == brand.lower()).groupBy("brand", "industry", "kind").agg(F.array_sort(F.collect_set("term")).alias("terms"))


# -- similarity


def similarity(a: Column, b: Column, weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted plain, partial (best alignment), sorted-word and word-set ratios; equal ones get a tenth more, up to 100."""
    plain, partial = ratio(a, b), partial_ratio(a, b)
    common = F.size(F.array_intersect(F.split(a, " "), F.split(b, " ")))
    sets = F.when(common == F.least(F.size(F.array_distinct(F.split(a, " "))), F.size(F.array_distinct(F.split(b, " ")))), 100.0).otherwise(token_sort_ratio(a, b))
    total = plain * weights["ratio"] + partial * weights["partial"] + token_sort_ratio(a, b) * weights["token_sort"] + sets * weights["token_set"]
    return F.when(a == b, F.least(total * 1.1, F.lit(100.0))).otherwise(total)


# -- recognition


def chunks(texts: DataFrame, id_col: str, text_col: str, longest: int = 4, shortest: int = 1, within: tuple[int, int] = (3, 1 << 30)) -> DataFrame:
    """(id, position, n, chunk): every run of `shortest` to `longest` words whose letters are `within` bounds, in lower case.

    All lengths come from one generator, so that a text is read and split once.
    """
    return runs_of(texts.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")), longest, shortest, within)


def words_of(text: Column) -> Column:
    """The words of a text in order, in lower case: runs of letters, digits and apostrophes."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}']+"), "")


def runs_of(rows: DataFrame, longest: int, shortest: int = 1, within: tuple[int, int] = (3, 1 << 30)) -> DataFrame:
    """chunks() of (id, w) with the words w of each text."""
    if longest == shortest == 1:
        return rows.select("id", F.posexplode("w").alias("position", "chunk")).select("id", "position", F.lit(1).alias("n"), "chunk").where(F.char_length("chunk").between(*within))
    beside = F.arrays_zip(*[F.slice("w", k + 1, F.greatest(F.size("w"), F.lit(0))).alias(f"w{k}") for k in range(longest)])
    rows = rows.select("id", F.posexplode(beside).alias("position", "z"))

    def run(n: int) -> Column:
        return F.struct(F.lit(n).alias("n"), F.when(F.col(f"z.w{n - 1}").isNotNull(), F.concat_ws(" ", *[F.col(f"z.w{k}") for k in range(n)])).alias("chunk"))

    return rows.select("id", "position", F.inline(F.array(*map(run, range(shortest, longest + 1))))).where(F.char_length("chunk").between(*within))


def _size(terms: DataFrame) -> int:
    """The longest term's words, 4 at most."""
    return min(4, terms.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1)


def _side(terms: DataFrame, most: int) -> DataFrame:
    return F.broadcast(terms) if terms.limit(most + 1).count() <= most else terms


def _split(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, w): the words of each text, stored, since splitting takes longer than what is done with the words."""
    return stored(texts.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")), "split")


def _alike_words(words: DataFrame, terms: DataFrame, least: float, words_sorted: bool = False) -> DataFrame:
    """The distinct single words with every term that is alike by `least`, and the ratio; words repeat much."""
    return similar_pairs(runs_of(words, 1).select("chunk").distinct(), terms, least, words_sorted=words_sorted)


def _alike_runs(words: DataFrame, terms: DataFrame, least: float, longest: int, words_sorted: bool = False) -> DataFrame:
    """(id, position, n, chunk, ...): runs of two words or more where they stand, since those hardly repeat, with such terms."""
    low, high = fitting_lengths(terms, least)
    return similar_pairs(runs_of(words, longest, 2, (max(3, low), high)), terms, least, words_sorted=words_sorted, by_letters=False)


def alike_chunks(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, least: float, longest: int, words_sorted: bool = False) -> DataFrame:
    """The different runs of one to `longest` words with every term that is alike by `least`, and the ratio, once each.

    Only words are made distinct before they meet the terms; of the runs, those that are alike, which are few.
    """
    split = _split(texts, id_col, text_col)
    runs = _alike_runs(split, terms, least, longest, words_sorted).drop("id", "position", "n").dropDuplicates()
    return _alike_words(split, terms, least, words_sorted).unionByName(runs)


_HIT = ["id", "position", "n", "chunk", "brand", "industry", "kind", "term", "score"]


def _hits(texts: DataFrame, terms: DataFrame, id_col: str, text_col: str, fuzzy: float | None, broadcast_terms: int = 20_000) -> DataFrame:
    """_HIT for every chunk that is a term or, unless fuzzy is None, alike one; keywords are alike from KEYWORD_RATIO on, and only
    to single words. The texts are split once, for the distinct words, for the longer runs, and for the places of the words."""
    known, keys = terms.where("kind <> 'keyword'"), terms.where("kind = 'keyword'")
    exact = terms.withColumns({"chunk": F.col("term"), "score": F.lit(100.0)})
    if fuzzy is None:
        return chunks(texts, id_col, text_col, _size(terms)).join(_side(exact, broadcast_terms), "chunk").select(_HIT)
    brand = F.col("kind") != "keyword"

    def best(pairs: DataFrame, place: list[str]) -> DataFrame:
        near = pairs.where(F.col("chunk") != F.col("term")).withColumn("score", similarity(F.col("chunk"), F.col("term"))).where(F.col("score") >= fuzzy)
        return near.withColumn("_r", F.row_number().over(Window.partitionBy(*place, "chunk").orderBy(F.desc("score"), "term"))).where("_r <= 5").drop("_r", "ratio")

    split = _split(texts, id_col, text_col)
    words = stored(_alike_words(split, terms, min(fuzzy, KEYWORD_RATIO)), "words")
    near = best(words.where(brand & (F.col("ratio") >= fuzzy)), []).unionByName(words.where(~brand & (F.col("ratio") >= KEYWORD_RATIO) & (F.col("chunk") != F.col("term"))).withColumnRenamed("ratio", "score"))
    near = exact.where(~F.contains("chunk", F.lit(" "))).unionByName(near)
    # Counted, they go to the texts, whose words then needn't be shuffled.
    out = runs_of(split, 1).join(_side(stored(near, "alike"), 10 * broadcast_terms), "chunk").select(_HIT)
    longest, several = _size(known), _size(keys)
    if longest > 1:
        runs = stored(_alike_runs(split, known, fuzzy, longest), "runs")
        same = runs.where(F.col("chunk") == F.col("term")).withColumn("score", F.lit(100.0))
        out = out.unionByName(same.select(_HIT)).unionByName(best(runs, ["id", "position", "n"]).select(_HIT))
    if several > 1:
        out = out.unionByName(runs_of(split, several, 2).join(_side(exact.where(~brand), broadcast_terms), "chunk").select(_HIT))
    return out


def matches(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", fuzzy: float | None = 70.0, broadcast_terms: int = 20_000) -> DataFrame:
    """(id, position, n, chunk, brand, industry, kind, term, score) for exact and, unless fuzzy is None, similar chunks.

    Chunks meet every term that is alike by `fuzzy` (see fuzzy.candidate_pairs), of which the five best stay; keywords
    are left out. A single word's composite score isn't under its ratio, so words that no run claims have been tried, too.
    """
    return _hits(texts, terms.where("kind <> 'keyword'"), id_col, text_col, fuzzy, broadcast_terms)


def without_overlaps(cands: Column) -> Column:
    """Greedy over array<struct(n, position, ...)>: longer runs first, then better, then earlier; a word is claimed once."""
    free = lambda acc, x: ~F.exists(acc, lambda y: (y["position"] < x["position"] + x["n"]) & (x["position"] < y["position"] + y["n"]))
    return F.aggregate(cands, F.slice(cands, 1, 0), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))


def recognise(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", fuzzy: float | None = 70.0, context: bool = True) -> DataFrame:
    """(id, brands): array<struct(brand, confidence, match_type, position)>, best match a brand, surest first; texts without one have no row.

    With fewer than three brands found, a brand with two or more of its keywords in the text is added by context at
    confidence min(50 + 10 k, 85) / 100 and position -1. A keyword is in the text if a run of words equals it or, unless
    fuzzy is None, a word is alike by KEYWORD_RATIO.
    """
    hits = stored(_hits(texts, terms if context else terms.where("kind <> 'keyword'"), id_col, text_col, fuzzy), "hits")
    got = hits.where("kind <> 'keyword'")
    packed = F.struct((-F.col("n")).alias("o"), (-F.col("score")).alias("s"), "position", "n", "brand", "industry", "kind", "term")
    per = got.groupBy("id").agg(without_overlaps(F.array_sort(F.collect_set(packed))).alias("m"))
    flat = per.select("id", F.explode("m").alias("x")).select("id", F.col("x.brand").alias("brand"), (-F.col("x.s") / 100).alias("confidence"), F.when(F.col("x.s") == -100, "exact").otherwise("fuzzy").alias("match_type"), F.col("x.position").alias("position"))
    if context:
        hits = hits.where("kind = 'keyword'").groupBy("id", "brand").agg(F.countDistinct("term").alias("k")).where("k >= 2")
        few = flat.groupBy("id").agg(F.countDistinct("brand").alias("b"))
        hits = hits.join(few, "id", "left").where("coalesce(b, 0) < 3")
        flat = flat.unionByName(hits.select("id", "brand", (F.least(50 + 10 * F.col("k"), F.lit(85)) / 100).alias("confidence"), F.lit("context").alias("match_type"), F.lit(-1).alias("position")))
    kind = F.array_position(F.array(F.lit("exact"), F.lit("fuzzy"), F.lit("context")), F.col("match_type"))
    best = flat.withColumn("_r", F.row_number().over(Window.partitionBy("id", "brand").orderBy(kind, F.desc("confidence"), "position"))).where("_r = 1")
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("o"), "position", "brand", "confidence", "match_type")))
    return best.groupBy("id").agg(F.transform(ordered, lambda x: F.struct(x["brand"].alias("brand"), x["confidence"].alias("confidence"), x["match_type"].alias("match_type"), x["position"].alias("position"))).alias("brands"))


def detect_brands(df: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", **how) -> DataFrame:
    """df with detected_brands as array<struct>; an empty list where there is none."""
    got = recognise(df, terms, id_col, text_col, **how).withColumnRenamed("brands", "detected_brands")
    return df.join(got, df[id_col] == got["id"], "left").drop("id").withColumn("detected_brands", F.coalesce("detected_brands", F.array().cast("array<struct<brand:string,confidence:double,match_type:string,position:int>>")))


def encode_pairs(brands: Column) -> Column:
    """The compact form "Brand:0.95"."""
    return F.transform(brands, lambda b: F.format_string("%s:%.2f", b["brand"], b["confidence"]))


def product_terms(terms: DataFrame) -> DataFrame:
    """Products alone, with each descriptor and with the numbers 1 to 20."""
    ends = F.array(F.lit(""), *[F.lit(f" {d}") for d in (*DESCRIPTORS, *range(1, 21))])
    return terms.where("kind = 'product'").select("brand", F.col("term").alias("product"), F.explode(ends).alias("e")).select("brand", "product", F.concat("product", "e").alias("term"))


def extract_products(texts: DataFrame, terms: DataFrame, id_col: str = "id", text_col: str = "text", fuzzy: float | None = PRODUCT_RATIO, brands: DataFrame | None = None) -> DataFrame:
    """(id, product, brand, confidence in 0 to 1): the most alike phrases first, of those the longest; a word is claimed
    once, and the best of a product and brand stays.

    A phrase of one to three words takes its best term by the token-sort ratio, if that is `fuzzy` or more (None: equal
    phrases only); phrases and terms are compared where the index lets them meet. brands: (id, brand) seen
    in the texts; a product of such a brand gets a tenth more confidence, up to 1.
    """
    known = product_terms(terms)
    cols = ["id", "position", "n", "brand", "product", "term", "ratio"]
    if fuzzy is None:
        exact = known.withColumn("chunk", F.col("term")).withColumn("ratio", F.lit(100.0))
        got = chunks(texts, id_col, text_col, 3).join(_side(exact, 20_000), "chunk").select(cols)
    else:
        best = lambda pairs, place: pairs.groupBy(*place, "chunk").agg(F.min(F.struct((-F.col("ratio")).alias("o"), "term", "brand", "product", "ratio")).alias("x")).select(*place, "chunk", "x.brand", "x.product", "x.term", "x.ratio")
        split = _split(texts, id_col, text_col)
        words = _alike_words(split, known, fuzzy, words_sorted=True)
        runs = _alike_runs(split, known, fuzzy, 3, words_sorted=True)
        got = runs_of(split, 1).join(_side(stored(best(words, []), "products"), 200_000), "chunk").select(cols)
        got = got.unionByName(best(runs, ["id", "position", "n"]).select(cols))
    packed = F.struct((-F.col("ratio")).alias("s"), (-F.col("n")).alias("o"), "position", "n", "product", "brand", "term")
    per = got.groupBy("id").agg(without_overlaps(F.array_sort(F.collect_set(packed))).alias("m"))
    out = per.select("id", F.explode("m").alias("x")).groupBy("id", F.col("x.product").alias("product"), F.col("x.brand").alias("brand")).agg((-F.min("x.s") / 100).alias("confidence"))
    if brands is not None:
        seen = brands.select("id", "brand").distinct().withColumn("_seen", F.lit(1.1))
        out = out.join(seen, ["id", "brand"], "left").withColumn("confidence", F.least(F.col("confidence") * F.coalesce("_seen", F.lit(1.0)), F.lit(1.0))).drop("_seen")
    return out.select("id", "product", "brand", "confidence")


def detect_products(df: DataFrame, terms: DataFrame, id_col: str, text_col: str = "text", brands: str | None = "detected_brands", **how) -> DataFrame:
    """df with detected_products as array<struct(product, brand, confidence)>; the column `brands`, if df has it, is the context."""
    seen = df.select(F.col(id_col).alias("id"), F.explode(brands).alias("b")).select("id", "b.brand") if brands in df.columns else None
    got = extract_products(df, terms, id_col, text_col, brands=seen, **how)
    got = got.groupBy(F.col("id").alias("_id")).agg(F.array_sort(F.collect_list(F.struct("product", "brand", "confidence"))).alias("detected_products"))
    return df.join(got, df[id_col] == got["_id"], "left").drop("_id").withColumn("detected_products", F.coalesce("detected_products", F.array().cast("array<struct<product:string,brand:string,confidence:double>>")))


def encode_products(products: Column) -> Column:
    """The compact form "iphone|Apple:97.00", with the confidence in percent."""
    return F.transform(products, lambda p: F.format_string("%s|%s:%.2f", p["product"], p["brand"], p["confidence"] * 100))


def says(text: Column, phrases: list[str], least: float | None) -> Column:
    """Whether a run of as many words as a phrase has is alike by `least` or more; None: whether the text holds a phrase."""
    if least is None:
        return F.exists(strings(phrases), lambda p: F.contains(text, p))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    close = lambda run, p: F.when(F.least(F.char_length(run), F.char_length(p)) * 100.0 >= F.greatest(F.char_length(run), F.char_length(p)) * least, ratio(run, p) >= least).otherwise(F.lit(False))

    def any_run(n: int) -> Column:
        some = strings([p for p in phrases if len(p.split()) == n])
        return F.exists(F.array_distinct(ngrams(words, n)), lambda run: F.exists(some, lambda p: close(run, p)))

    alike = [any_run(n) for n in sorted({len(p.split()) for p in phrases})]
    return reduce(lambda a, b: a | b, alike)


def competitive_context(df: DataFrame, rivals: DataFrame, industries: DataFrame, brands: str = "brands", text: str = "text", id_col: str = "id", phrases: float | None = PHRASE_RATIO) -> DataFrame:
    """(id, brand_a, brand_b, context): pairs of a row's brands that are rivals or share an industry; comparison if a phrase says so.

    phrases: the least ratio of a run of words to a phrase; None: the text holds the phrase.

    rivals: (brand, competitor), symmetric; industries: (brand, industry). A row's list of brands bounds its pairs.
    """
    names = F.array_sort(F.array_distinct(F.transform(F.col(brands), lambda b: F.lower(b))))
    # Only texts of two brands or more are looked at, each once.
    rows = df.select(F.col(id_col).alias("id"), F.lower(text).alias("t"), names.alias("b")).where("size(b) > 1")
    rows = rows.select("id", "b", F.explode(F.array(says(F.col("t"), COMPARISONS, phrases))).alias("says"))
    pairs = rows.select("id", "says", "b", F.posexplode("b").alias("i", "brand_a")).select("id", "says", "brand_a", F.explode(F.slice("b", F.col("i") + 2, F.greatest(F.size("b") - F.col("i") - 1, F.lit(0)))).alias("brand_b"))
    side = industries.select(F.lower("brand").alias("brand"), "industry").distinct()
    pairs = pairs.join(side.select(F.col("brand").alias("brand_a"), F.col("industry").alias("ia")), "brand_a", "left").join(side.select(F.col("brand").alias("brand_b"), F.col("industry").alias("ib")), "brand_b", "left")
    known = rivals.select(F.col("brand").alias("brand_a"), F.col("competitor").alias("brand_b"), F.lit(True).alias("known"))
    pairs = pairs.join(known, ["brand_a", "brand_b"], "left").where("known OR ia = ib")
    return pairs.select("id", "brand_a", "brand_b", F.when(F.col("says"), "comparison").otherwise("co-mention").alias("context")).distinct()


def disambiguate(df: DataFrame, industry_words: DataFrame, id_col: str = "id", text: str = "text", least: float = INDUSTRY_RATIO) -> DataFrame:
    """Of overlapping detections the surer stays; confidence gains min(0.05 k, 0.15) for k industry words in the text, that
    is industry words to which a word of the text is alike by `least` or more.

    df: (id, text, brand, industry, confidence, position, n); industry_words: (industry, word).
    """
    packed = F.struct((-F.col("confidence")).alias("o"), "position", "n", "brand", "industry", "confidence")
    per = df.groupBy(F.col(id_col).alias("id"), F.lower(text).alias("t")).agg(without_overlaps(F.array_sort(F.collect_set(packed))).alias("m"))
    kept = per.select("id", "t", F.explode("m").alias("x")).select("id", "t", "x.brand", "x.industry", "x.confidence", "x.position")
    words = industry_words.groupBy("industry").agg(F.collect_set(F.lower("word")).alias("ws"))
    out = kept.join(words, "industry", "left")
    mine = F.array_distinct(F.split(F.col("t"), r"[^\p{L}\p{N}_]+"))
    k = F.size(F.filter(F.coalesce("ws", F.array().cast("array<string>")), lambda w: F.exists(mine, lambda m: ratio(m, w) >= least)))
    return out.select("id", "brand", "industry", "position", F.least(F.col("confidence") + F.least(0.05 * k, F.lit(0.15)), F.lit(1.0)).alias("confidence")).orderBy("id", "position")
