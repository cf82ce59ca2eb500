"""Benchmark decontamination on a distributed positional inverted index, in DataFrame functions.

1. The corpus is cut into terms once, as a stored table. Counts of the test windows' terms over all
   of it say how rare each is.
2. Each window looks up its ``LISTS`` rarest terms. The index holds their postings: term, document
   and position, and for a window's rarest term the terms around it that a window can reach.
3. Posting lists are intersected from the rarest, offsets adjusted: a posting of the rarest term
   tells where the window would start; the second list must have its term at that start's place for
   it, by an equality join on term, document and position, then the third. What is left is
   compared as a whole phrase, so a match is exact.
4. Where the second rarest term stands near the rarest but the phrase differs, the match is one of
   proximity.

The terms looked up are broadcast only below a checked size; above it the windows are taken in
blocks, one pass over the stored terms for each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.llm import common

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_BYTES = 8 << 20  # of looked-up terms at once
LISTS = 3  # posting lists that are intersected before the phrase is compared


def terms(text: Column) -> Column:
    """Array of the terms of a text, null for a null text."""
    lowered = common.lower_ascii(text.cast("string"))
    return F.filter(F.split(lowered, SEPARATORS), lambda x: x != "")


def test_windows(tests: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``item_id, at, words``: each ``size`` consecutive terms of an item, or all if it has fewer."""
    items = tests.select(F.col(id_col).cast("string").alias("item_id"), terms(F.col(text_col)).alias("all"))
    items = items.where(F.col("item_id").isNotNull() & (F.size("all") > 0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - size + 1, F.lit(1)))
    return items.select("item_id", F.posexplode(F.transform(starts, lambda i: F.slice("all", i, size))).alias("at", "words"))


def lookups(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """For each distinct phrase: its words, how many, and its rarest terms with their offsets.

    A term that the corpus lacks is the rarest: its phrase finds nothing. A phrase of fewer
    different terms has no second or third one.
    """
    phrases = windows.select("words").distinct()
    each = phrases.select("words", F.posexplode("words").alias("offset", "term"))
    known = each.join(counts, "term", "left").select(
        "words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "offset").alias("by_rarity")
    )
    ranked = known.groupBy("words").agg(F.sort_array(F.collect_list("by_rarity")).alias("ranked"))  # at most ``size`` terms
    # Of a term that occurs several times in a phrase, the first place.
    new = lambda x, i: (i == 0) | (F.get("ranked", i - 1)["term"] != x["term"])
    ranked = ranked.withColumn("ranked", F.filter("ranked", new))
    rank = lambda k: F.get("ranked", F.lit(k))
    more = [rank(k)[c].alias(f"{c}{k}") for k in range(1, LISTS) for c in ("term", "offset")]
    return ranked.where(rank(0)["n"] > 0).select("words", F.size("words").alias("n_terms"), rank(0)["term"].alias("term"), rank(0)["offset"].alias("offset"), *more)


def postings(corpus: DataFrame, looked_up: DataFrame, size: int) -> DataFrame:
    """The index: a row for each occurrence of a looked-up term. For a term that is some window's
    rarest, ``near`` has the terms from ``size - 1`` before the posting to as many after it, of
    which ``before`` come before."""
    rows = corpus.select("doc_id", "all", F.posexplode("all").alias("at", "term"))
    before = F.least("at", F.lit(size - 1))
    near = F.when(F.col("rarest"), F.slice("all", F.col("at") - before + 1, before + size))
    return rows.join(F.broadcast(looked_up), "term").select("term", "doc_id", "at", before.alias("before"), near.alias("near"))


def blocks_of(looked_up: DataFrame) -> list[DataFrame]:
    """``looked_up`` terms in parts that are small enough to broadcast."""
    size = looked_up.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    n = size // BROADCAST_BYTES + 1
    if n == 1:
        return [looked_up]
    return [looked_up.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) for k in range(n)]


def matches(
    docs: DataFrame,
    tests: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    test_id_col: str = "item_id",
    test_text_col: str = "text",
    size: int = 13,
    proximity: bool = True,
) -> DataFrame:
    """``doc_id, item_id, test_at, start, n_terms, kind``: where a test window occurs.

    For kind ``exact``, ``start`` is the position of the phrase's first term in the document;
    for ``proximity``, that of the rarest term, whose second rarest one stands at another place
    within reach; left out if not asked for. Each occurrence is told once.
    """
    corpus = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text_col)).alias("all"))
    return located(common.stored(corpus), tests, test_id_col, test_text_col, size, proximity)


def located(corpus: DataFrame, tests: DataFrame, test_id_col: str, test_text_col: str, size: int, proximity: bool) -> DataFrame:
    """``matches`` in a stored table of ``doc_id, all``: the terms of each document."""
    windows = common.stored(test_windows(tests, test_id_col, test_text_col, size))
    vocabulary = windows.select(F.explode("words").alias("term")).distinct()
    counts = corpus.select(F.explode("all").alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    wanted = common.stored(lookups(windows, common.stored(counts)))
    looked_up = wanted.select("term", F.lit(True).alias("rarest"))
    for k in range(1, LISTS):
        looked_up = looked_up.unionByName(wanted.select(F.col(f"term{k}").alias("term"), F.lit(False).alias("rarest")))
    looked_up = looked_up.where("term IS NOT NULL").groupBy("term").agg(F.max("rarest").alias("rarest"))
    parts = [postings(corpus, part, size) for part in blocks_of(common.stored(looked_up))]
    index = common.stored(reduce(DataFrame.unionByName, parts))
    found = index.where("near IS NOT NULL").join(wanted, "term").withColumn("start", F.col("at") - F.col("offset"))
    for k in range(1, LISTS):
        # A phrase without such a term passes; where proximity is asked for, all stay and are told apart.
        listed = index.select(F.col("term").alias(f"term{k}"), "doc_id", F.col("at").alias(f"at{k}"), F.lit(True).alias(f"in{k}")).distinct()
        found = found.withColumn(f"at{k}", F.col("start") + F.col(f"offset{k}")).join(listed, [f"term{k}", "doc_id", f"at{k}"], "left")
        found = found.withColumn(f"in{k}", F.col(f"term{k}").isNull() | F.col(f"in{k}").isNotNull())
        if not proximity:
            found = found.where(f"in{k}")
    begin = F.col("before") - F.col("offset")
    whole = (begin >= 0) & F.coalesce(F.slice("near", F.greatest(begin, F.lit(0)) + 1, F.col("n_terms")) == F.col("words"), F.lit(False))
    found = found.withColumn("exact", whole & reduce(Column.__and__, (F.col(f"in{k}") for k in range(1, LISTS))))
    kept = F.col("exact") | F.array_contains("near", F.col("term1")) if proximity else F.col("exact")
    found = found.where(kept).select(
        "doc_id",
        "words",
        F.when(F.col("exact"), F.col("start")).otherwise(F.col("at")).alias("start"),
        "n_terms",
        F.when(F.col("exact"), "exact").otherwise("proximity").alias("kind"),
    )
    named = windows.select("item_id", F.col("at").alias("test_at"), "words")
    return found.join(named, "words").select("doc_id", "item_id", "test_at", "start", "n_terms", "kind")


def covered(found: DataFrame) -> DataFrame:
    """``doc_id, n_hit``: how many positions the exact matches of each document cover."""
    spans = found.select("doc_id", "start", (F.col("start") + F.col("n_terms")).alias("end")).distinct()
    of_doc = Window.partitionBy("doc_id").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("end").over(of_doc), F.lit(0))
    fresh = F.greatest(F.col("end") - F.greatest("start", reached), F.lit(0))
    return spans.select("doc_id", fresh.alias("fresh")).groupBy("doc_id").agg(F.sum("fresh").cast("long").alias("n_hit"))


def contamination(
    docs: DataFrame,
    tests: DataFrame,
    share: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    test_id_col: str = "item_id",
    test_text_col: str = "text",
    size: int = 13,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_hit, items`` (sorted ids of the items with
    occurring windows) ``, contaminated``: hit words times ``share`` reach the words.

    A null or blank text has no words and no hits. Rows without an id are told without hits, as
    are all rows if ``tests`` is empty. Rows of one id share their hits: an exact repeat gives
    the same row again; the words of an id's other texts count together. Other columns are not
    looked at; an empty table gives an empty result.
    """
    every = common.stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), terms(F.col(text_col)).alias("all")))
    found = located(every.where("doc_id IS NOT NULL"), tests, test_id_col, test_text_col, size, proximity=False)
    found = common.stored(found.select("doc_id", "item_id", "start", "n_terms").distinct())
    items = found.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    hits = covered(found).join(items, "doc_id")
    rows = every.select("doc_id", F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_words"))
    rows = rows.withColumn("n_words", F.greatest("n_words", F.lit(0)))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.join(hits, "doc_id", "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminated(docs: DataFrame, tests: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` without the documents that ``contamination`` finds contaminated."""
    bad = contamination(docs, tests, id_col=id_col, **how).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, docs[id_col].cast("long") == bad.doc_id, "left_anti")
