"""Line dedup by winnowing over line hashes.

1. Lines that are not blank are hashed. In every window of ``run`` consecutive lines of a document
   the least hash (the last of equals) is selected: two windows of equal lines select the same one,
   so a run of ``run`` lines that occurs twice has a selected fingerprint in both places. Shorter
   windows count as well if they hold over ``words`` words, so that a long paragraph is found on
   whatever number of lines it stands.
2. Fingerprints are reduced to their first and last places; those with one place are dropped.
3. Positions of the others are joined: each window that selected one with the earliest place of
   the same lines, in order of document and line. Pairs that go on along one diagonal are a match,
   extended both ways as far as both documents agree.
4. The later side of every match is a repeated run; runs that overlap or touch are deleted as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.llm import common

SPACE = r"[\t\x0B\f\r ]"


def numbered_lines(text: Column) -> Column:
    """Array of (line number, two hashes, words) of the lines that are not blank."""
    lines = F.transform(F.split(text, "\n", -1), lambda x, i: F.struct(i.alias("no"), F.rtrim(x).alias("line")))
    full = F.filter(lines, lambda x: F.length(F.trim(F.translate(x["line"], "\t\x0b\f\r", "    "))) > 0)
    n_words = lambda x: F.regexp_count(x["line"], F.lit(r"[^\t\x0B\f\r ]+"))
    return F.transform(full, lambda x: F.struct(x["no"].alias("no"), F.xxhash64(x["line"]).alias("hash"), F.hash(x["line"]).alias("hash2"), n_words(x).alias("n_words")))


def windows(docs: DataFrame, id_col: str, text_col: str, run: int, words: int) -> DataFrame:
    """A row for each window: its document, place among the full lines, number of lines, first and
    last line number, content keys, selected fingerprint and the fingerprint's place."""
    text = F.col(text_col).cast("string")
    rows = docs.where(F.col(id_col).isNotNull() & text.isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), numbered_lines(text).alias("lines")
    )

    def one(i: Column, n: int) -> Column:
        part = F.slice("lines", i, n)
        least = F.array_min(F.transform(part, lambda x, k: F.struct(x["hash"].alias("hash"), (-k).alias("back"))))
        return F.struct(
            (i - 1).alias("at"),
            F.lit(n).alias("n_lines"),
            F.element_at(part, 1)["no"].alias("first"),
            F.element_at(part, n)["no"].alias("last"),
            F.xxhash64(F.transform(part, lambda x: x["hash"])).alias("key"),
            F.hash(F.transform(part, lambda x: x["hash2"])).alias("key2"),
            least["hash"].alias("print"),
            (i - 1 - least["back"]).alias("print_at"),
        )

    def of_length(n: int) -> Column:
        starts = F.when(F.size("lines") >= n, F.sequence(F.lit(1), F.size("lines") - n + 1)).otherwise(F.array().cast("array<int>"))
        if n < run:
            in_all = lambda i: F.aggregate(F.slice("lines", i, n), F.lit(0), lambda s, x: s + x["n_words"])
            starts = F.filter(starts, lambda i: in_all(i) > words)
        return F.transform(starts, lambda i: one(i, n))

    return rows.select("doc_id", "text_hash", F.inline(F.concat(*(of_length(n) for n in range(1, run + 1)))))


def matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, words: int = 50) -> DataFrame:
    """Windows with an equal one before them, and where that is: ``doc_id, text_hash, at, n_lines,
    first, last, src_id, src_hash, src_at``. Repeated rows are told once."""
    found = common.stored(windows(docs, id_col, text_col, run, words))
    place = F.xxhash64("doc_id", "print_at", "text_hash")
    prints = found.groupBy("print").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    # Prints and places grow with the texts, so they meet windows by a shuffle at every size.
    near = found.join(common.stored(prints.where("least <> most").select("print")).hint("merge"), "print", "left_semi")
    place = F.struct("doc_id", "at", "text_hash")
    key = ["key", "key2", "n_lines"]
    first = near.groupBy(*key).agg(F.min(place).alias("src"), F.max(place).alias("most")).where("src <> most")
    joined = near.join(common.stored(first.select(*key, "src")).hint("merge"), key)
    earlier = (F.col("src.doc_id") < F.col("doc_id")) | (F.col("src.doc_id") == F.col("doc_id")) & (F.col("src.at") < F.col("at"))
    return joined.where(earlier).select(
        "doc_id", "text_hash", "at", "n_lines", "first", "last", F.col("src.doc_id").alias("src_id"), F.col("src.text_hash").alias("src_hash"), F.col("src.at").alias("src_at")
    ).distinct()


def islands(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """``rows`` with a number ``island``, one for rows of a key that overlap or touch."""
    before = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.coalesce(F.col(start) > F.max(end).over(before), F.lit(True))
    return rows.withColumn("fresh", fresh.cast("int")).withColumn("island", F.sum("fresh").over(Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, 0)))


def repeated_runs(found: DataFrame) -> DataFrame:
    """``matches`` extended to maximal runs: ``doc_id, text_hash, first_line, last_line`` by line
    numbers from 0, and where the run is in its source, by full lines: ``src_id, src_hash, src_at``."""
    pair = ["doc_id", "text_hash", "src_id", "src_hash", "diagonal"]
    rows = found.withColumn("diagonal", F.col("at") - F.col("src_at")).withColumn("until", F.col("at") + F.col("n_lines"))
    runs = islands(rows, pair, "at", "until").groupBy(*pair, "island")
    return runs.agg(F.min("at").alias("at"), F.max("until").alias("until"), F.min("first").alias("first_line"), F.max("last").alias("last_line"), F.min("src_at").alias("src_at")).drop("diagonal", "island")


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = 3, words: int = 50) -> DataFrame:
    """``docs`` with the lines of ``repeated_runs`` deleted from their texts; all rows stay.

    Lines are equal if they are up to spaces at their ends; blank lines take no part, those
    inside of a deleted run go with it. Within a document, too, a later run goes. A null text
    stays null, an empty one empty. A row without an id is neither a source nor changed.
    Repeated rows, the same id with the same text, are one document and are changed alike; an
    id's rows with other texts are compared by line number. A text of which all lines go is
    empty. An empty table gives an empty result; other columns stay as they are, whatever their
    names. Ids must be numbers.
    """
    runs = repeated_runs(matches(docs, id_col, text_col, run, words))
    spans = islands(runs, ["doc_id", "text_hash"], "at", "until").groupBy("doc_id", "text_hash", "island")
    spans = spans.agg(F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"))
    deleted = spans.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("first_line", "last_line"))).alias("runs"))
    # The text travels once, beside the other columns.
    row, cut = F.struct(*(docs[c] for c in docs.columns if c != text_col)).alias("row"), F.struct("runs").alias("cut")
    text = docs[text_col].cast("string")
    left = docs.select(row, docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    # Runs grow with the texts, so they meet by a shuffle at every size.
    joined = left.join(deleted.select("doc_id", "text_hash", cut).hint("merge"), ["doc_id", "text_hash"], "left")
    lines, gone = F.split("text", "\n", -1), F.col("cut.runs")
    # What lies before each run, from the end of the one before it, and what lies after the last.
    edges = F.concat(gone, F.array(F.struct(F.size(lines).alias("first_line"), F.lit(0).alias("last_line"))))
    begin = lambda i: F.when(i == 0, F.lit(1)).otherwise(F.get(edges, i - 1)["last_line"] + 2)
    parts = F.transform(edges, lambda r, i: F.slice(lines, begin(i), F.greatest(r["first_line"] - begin(i) + 1, F.lit(0))))
    new = F.when(F.col("cut").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(parts), "\n"))
    return joined.select(*(new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
