"""Directed glossaries from terminologies, terms in texts, and the domain of a text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.functions.text import contains_term, strip
from bitloom.runtime import join_nulls_equal, spread

# Fragments that speak for the shop domain, in order; the first count two, the others one.
STRONG_KEYWORDS = (
    "amazon", "temu", "shopee", "lazada", "aliexpress", "shopify", "etsy", "ebay", "listing", "sku", "fba", "fbm",
    "dropshipping", "cross-border e-commerce", "跨境电商", "商品标题", "卖点", "店铺", "物流单号", "退货政策", "清关",
)
WEAK_KEYWORDS = (
    "product title", "bullet points", "product description", "variant", "inventory", "restock", "minimum order quantity",
    "lead time", "fulfillment", "overseas warehouse", "shipping fee", "delivery time", "tracking number", "hs code",
    "incoterms", "refund", "exchange", "after-sales service", "warranty", "brand registry", "storefront",
    "conversion rate", "click-through rate", "gmv", "aov", "coupon", "limited-time offer", "畅销款", "变体", "库存", "补货",
    "履约", "海外仓", "运费", "配送时效", "知识产权", "品牌备案", "转化率", "点击率", "客单价", "成交总额", "优惠券", "限时优惠",
)
DOMAIN_SCORE = 3
MATCHES_KEPT = 20
EXAMPLES_KEPT = 10
#: A glossary up to so many rows is broadcast, after its rows were counted.
BROADCAST_TERMS = 20_000


def directed(terms: DataFrame, reverse: Column, order: str, group: list[str]) -> DataFrame:
    """(group, order, term, translation) with trimmed fields, swapped where ``reverse``; blank ones are left out."""
    s, t = strip(F.coalesce("source", F.lit(""))), strip(F.coalesce("target", F.lit("")))
    return terms.select(
        *group, order, F.when(reverse, t).otherwise(s).alias("term"), F.when(reverse, s).otherwise(t).alias("translation")
    ).where((F.col("term") != "") & (F.col("translation") != ""))


def build(entries: DataFrame, order: str, group: list[str]) -> DataFrame:
    """(group, term, translation): the first translation of each term."""
    return entries.groupBy(*group, "term").agg(F.min_by("translation", order).alias("translation"))


def collisions(entries: DataFrame, order: str, group: list[str]) -> DataFrame:
    """(group, order, term, kept, dropped): later rows of a term with another translation than its first."""
    kept = build(entries, order, group).withColumnRenamed("translation", "kept")
    # null groups (an unset domain) are equal to each other
    return join_nulls_equal(entries, kept, [*group, "term"]).where(F.col("translation") != F.col("kept")).select(
        *group, order, "term", "kept", F.col("translation").alias("dropped")
    )


def summary(terms: DataFrame, reverse: Column, order: str, group: list[str]) -> DataFrame:
    """A row for each group: terms kept, rows skipped, collisions, and the first ten of them.

    Collisions are counted by (term, translation) before anything is gathered, so a hot term is a few rows here.
    """
    entries = directed(terms, reverse, order, group)
    known = entries.groupBy(*group, "term", "translation").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    per_term = known.groupBy(*group, "term").agg(
        F.min_by("translation", "first").alias("kept"), F.min_by("n", "first").alias("n_kept"), F.sum("n").alias("n_all")
    )
    counted = per_term.groupBy(*group).agg(
        F.count(F.lit(1)).alias("term_count"), F.sum(F.col("n_all") - F.col("n_kept")).alias("collision_count")
    )
    all_rows = terms.groupBy(*group).agg(F.count(F.lit(1)).alias("_rows"))
    valid = entries.groupBy(*group).agg(F.count(F.lit(1)).alias("_valid"))
    out = join_nulls_equal(join_nulls_equal(all_rows, valid, group, "left"), counted, group, "left")
    return out.select(
        *group, F.coalesce("term_count", F.lit(0)).alias("term_count"),
        (F.col("_rows") - F.coalesce("_valid", F.lit(0))).alias("skipped_count"),
        F.coalesce("collision_count", F.lit(0)).alias("collision_count"),
    )


def examples(entries: DataFrame, order: str, group: list[str], kept: int = EXAMPLES_KEPT) -> DataFrame:
    """The first collisions of each group, at most ``kept``; a report, not a selection of rows."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(*group).orderBy(order))
    return collisions(entries, order, group).withColumn("example_no", n).where(F.col("example_no") <= kept)


_LATIN = r"[A-Za-z0-9_]+"


def term_key(term: Column) -> Column:
    """What a text must hold to hold the term: its first word, or for others its first two characters."""
    return F.when(
        term.rlike("[A-Za-z0-9]"), F.lower(F.regexp_extract(term, r"[A-Za-z0-9_]*[A-Za-z0-9][A-Za-z0-9_]*", 0))
    ).otherwise(F.substring(term, 1, 2))


def with_text_keys(texts: DataFrame, text: str, keys: str) -> DataFrame:
    """The keys of all terms that a text can hold: its words, and beyond ASCII its characters, single and in twos.

    Characters and keys are projections of their own, so that each is computed once for a text.
    """
    c = F.col
    wide = c(text).rlike(r"[^\x00-\x7f]")
    parts = texts.withColumns({
        "_signs": F.when(wide, F.split(text, "")).otherwise(F.array().cast("array<string>")),
        "_words": F.regexp_extract_all(F.lower(text), F.lit(_LATIN), F.lit(0)),
    })
    # the last character has no second one; its pair is null and no key
    pairs = F.zip_with("_signs", F.slice("_signs", F.lit(2), F.greatest(F.size("_signs"), F.lit(1))), lambda x, y: F.concat(x, y))
    return parts.withColumn(keys, F.array_distinct(F.concat("_words", "_signs", pairs))).drop("_signs", "_words")


#: A glossary counts as small up to so many characters and rows, counted first; it is then handed to every task.
BROADCAST_CHARS = 5_000_000
#: Up to so many terms under one key each text looks for them one by one, which is cheaper than taking its words apart.
FEW_TERMS = 500


def term_hits(texts: DataFrame, glossary: DataFrame, text: str, on: list[str]) -> DataFrame:
    """Rows of ``texts`` joined with the glossary entries whose term they contain; ``on`` names columns that both share.

    The counted size of the glossary decides how, for the same rows. A few terms under each key are one array that a text filters.
    Else the term's first word (or first two characters) is an equi-join key as well, and only candidates
    are tested in full, so that the work grows with hits, not with rows times terms; a small glossary is
    broadcast, and for others both sides are shuffled by the keys.
    """
    columns = [c for c in glossary.columns if c not in on]
    per_key = glossary.groupBy(*[F.col(c) for c in on]).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("term") + F.length("translation")).alias("chars")
    )
    rows, chars, most = per_key.agg(F.sum("n"), F.sum("chars"), F.max("n")).first()
    small = (rows or 0) <= BROADCAST_TERMS and (chars or 0) <= BROADCAST_CHARS
    if small and (most or 0) <= FEW_TERMS:
        key = [*on, "_key"]
        arrays = glossary.withColumns({"_key": F.lit(0), "_low": F.lower("term")}).groupBy(*key).agg(
            F.collect_list(F.struct(*columns, "_low")).alias("_terms")
        )
        low = texts.withColumns({"_key": F.lit(0), "_text_low": F.lower(F.col(text))})
        near = low.join(F.broadcast(arrays), key).withColumn(
            "_term_hit", F.explode(F.filter("_terms", lambda t: F.contains(F.col("_text_low"), t["_low"])))
        )
        hits = near.where(contains_term(F.col(text), F.col("_term_hit.term"), F.col("_text_low")))
        return hits.select(*[F.col(c) for c in texts.columns], *[F.col(f"_term_hit.{c}").alias(c) for c in columns])
    terms = glossary.withColumn("_term_key", term_key(F.col("term")))
    if small:
        terms = F.broadcast(terms)
    keyed = with_text_keys(texts, text, "_keys").withColumn("_text_low", F.lower(F.col(text)))
    hits = keyed.withColumn("_term_key", F.explode("_keys")).drop("_keys").join(terms, [*on, "_term_key"])
    return hits.where(contains_term(F.col(text), F.col("term"), F.col("_text_low"))).drop("_term_key", "_text_low")


def domain_matches(text: Column, strong: tuple[str, ...] = STRONG_KEYWORDS, weak: tuple[str, ...] = WEAK_KEYWORDS) -> Column:
    """array<struct<keyword, weight>>: the keywords that occur in a text in lower case, in the order of the lists."""
    known = F.array(*[
        F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for ks, w in ((strong, 2), (weak, 1)) for k in ks
    ])
    return F.filter(known, lambda k: F.contains(text, k["keyword"]))


def domains(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, domain, matches): matches are the first twenty keywords, joined by commas."""
    low = spread(documents.select(key, text)).select(key, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))
    found = low.select(key, domain_matches(F.col("_low")).alias("_m"))
    return found.select(
        key, F.aggregate("_m", F.lit(0), lambda a, m: a + m["weight"]).alias("score"),
        F.array_join(F.slice(F.transform("_m", lambda m: m["keyword"]), 1, MATCHES_KEPT), ",").alias("matches"),
    ).withColumn("domain", F.when(F.col("score") >= DOMAIN_SCORE, "ecommerce").otherwise("default"))
