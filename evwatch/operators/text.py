"""Text posts: ticker mentions, keyword classes, gap clusters, labels by articles and moves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.operators.joins import within


#: The end of a word, whose characters are ASCII letters, digits and the underscore whatever the engine takes ``\b`` for.
WORD_END = "(?![0-9A-Za-z_])"


def mentions(posts: DataFrame, universe: DataFrame, id_col: str, text: str, blacklist: tuple[str, ...] = (), most: int = 5) -> DataFrame:
    """``id, tickers``: sorted distinct tickers of each post with any: cashtags, bare upper-case
    words of the universe, and names as whole words, the longest first; less the blacklist, and
    none at all for a post with more than ``most``. ``universe``: ticker, name.

    Candidate words are joined to the universe, and names are met by their first word, so neither
    is tried against every post.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = posts.select(F.col(id_col).alias("id"), body.alias("text"))
    cash = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit(r"\$([A-Z]{1,5})" + WORD_END), 1)).alias("ticker"))
    bare = rows.select("id", F.explode(F.regexp_extract_all("text", F.lit("(?<![0-9A-Za-z_])([A-Z]{2,5})" + WORD_END), 1)).alias("ticker"))
    bare = bare.distinct().join(universe.select("ticker").distinct(), "ticker", "left_semi")
    names = universe.where("name IS NOT NULL AND trim(name) <> ''").select("ticker", F.lower(F.trim("name")).alias("name"))
    names = names.withColumn("first", F.regexp_extract("name", r"^\w+", 0)).where("first <> ''")
    words = rows.select("id", F.concat(F.lit(" "), F.regexp_replace(F.lower("text"), r"[^\w]+", " "), F.lit(" ")).alias("plain"))
    first = words.select("id", "plain", F.explode(F.array_distinct(F.split("plain", " "))).alias("first")).where("first <> ''")
    plain_name = F.concat(F.lit(" "), F.regexp_replace("name", r"[^\w]+", " "), F.lit(" "))
    named = first.join(names, "first").where(F.contains(F.col("plain"), plain_name)).select("id", "ticker")
    found = cash.unionByName(bare.select("id", "ticker")).unionByName(named).distinct()
    found = found.where(~F.col("ticker").isin(*blacklist)) if blacklist else found
    out = found.groupBy("id").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    return out.where(F.size("tickers") <= most)


def clusters(posts: DataFrame, gap_s: int, least_posts: int, least_solo: float) -> DataFrame:
    """Clusters of a ticker's posts, a new one where the gap is over ``gap_s``; kept with enough
    posts or a first post of enough score. ``posts``: ticker, ts, id, title, score, kind."""
    of = Window.partitionBy("ticker").orderBy("ts", "id")
    fresh = F.lag("ts").over(of).isNull() | (F.col("ts") - F.lag("ts").over(of) > gap_s)
    numbered = posts.withColumn("fresh", fresh.cast("int")).withColumn("no", F.sum("fresh").over(of))
    key = F.struct("ts", "id")
    out = numbered.groupBy("ticker", "no").agg(
        F.min("ts").alias("t0"), F.count("*").alias("n"), F.min_by("score", key).alias("first_score"), F.substring(F.min_by("title", key), 1, 280).alias("summary"),
        F.min_by("kind", key).alias("kind"), F.array_join(F.transform(F.sort_array(F.collect_list(key)), lambda x: x["id"].cast("string")), ",").alias("ids"),
    )
    return out.where((F.col("n") >= least_posts) | (F.col("first_score") >= least_solo)).drop("no")


def confirmed(events: DataFrame, articles: DataFrame, horizon_s: int, abnormal: DataFrame) -> DataFrame:
    """1 at the first whitelisted article of [t0, t0 + h]; else 0 at t0 + h where the move isn't
    abnormal; else null with a reason. ``abnormal``: id, abnormal."""
    pairs = within(events.select("id", "ticker", "t0"), articles, "ticker", "t0", "at", horizon_s, closed=True)
    first = pairs.groupBy("id").agg(F.min("r_at").alias("at"))
    out = events.join(first, "id", "left").join(abnormal, "id", "left")
    label = F.when(F.col("at").isNotNull(), 1).when(~F.col("abnormal"), 0)
    reason = F.when(F.col("at").isNotNull() | ~F.col("abnormal"), F.lit(None)).when(F.col("abnormal"), "abnormal move, no article").otherwise("no price data")
    return out.withColumn("label", label).withColumn("label_ts", F.when(label == 1, F.col("at")).when(label == 0, F.col("t0") + horizon_s)).withColumn("reason", reason).drop("at", "abnormal")


def abnormal_moves(events: DataFrame, bars: DataFrame, horizon_s: int, base_bars: int = 720, least_base: int = 120, least_move: float = 0.04, least_z: float = 2.0) -> DataFrame:
    """``id, ret, z, abnormal`` against the ``base_bars`` bars before t0; null with a short base."""
    from evwatch.operators.joins import bars_before

    anchors = events.select("id", "ticker", F.col("t0").alias("anchor_utc"))
    base = bars_before(bars.select("ticker", "ts_utc", "close", "volume"), anchors, base_bars).groupBy("id").agg(
        F.count("*").alias("n"), F.avg("volume").alias("mean"), F.stddev_pop("volume").alias("sd"), F.max_by("close", "ts_utc").alias("before")
    )
    after = within(events.select("id", "ticker", "t0"), bars.select("ticker", "ts_utc", "close", "volume"), "ticker", "t0", "ts_utc", horizon_s, closed=True)
    after = after.groupBy("id").agg(F.max_by("r_close", "r_ts_utc").alias("last"), F.avg("r_volume").alias("volume"))
    rows = events.select("id").join(base, "id", "left").join(after, "id", "left")
    sd = F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd"))
    enough = (F.col("n") >= least_base) & F.col("last").isNotNull() & (F.col("before") > 0)
    ret, z = F.when(enough, F.col("last") / F.when(F.col("before") > 0, F.col("before")) - 1), F.when(enough, (F.col("volume") - F.col("mean")) / sd)
    return rows.select("id", ret.alias("ret"), z.alias("z"), ((F.abs(ret) >= least_move) | (z >= least_z)).alias("abnormal"))


def decide(steps: DataFrame, least_wait: int, timeout: int, up: float, down: float, least_z: float) -> DataFrame:
    """Hour by hour: WAIT before ``least_wait`` or without a signal; TRUE once the return passes the
    threshold of the claim's direction or z is high; FALSE at the timeout. The first decision of
    each event wins. ``steps``: id, claim (``up``/``down``), hour, ret, z."""
    moved = F.when(F.col("claim") == "down", F.col("ret") <= -down).otherwise(F.col("ret") >= up)
    told = F.when(F.col("hour") < least_wait, "WAIT").when(F.coalesce(moved, F.lit(False)) | F.coalesce(F.col("z") >= least_z, F.lit(False)), "TRUE").when(F.col("hour") >= timeout, "FALSE").otherwise("WAIT")
    decided = steps.withColumn("decision", told).where("decision <> 'WAIT'")
    return decided.groupBy("id").agg(F.min("hour").alias("hour"), F.min_by("decision", "hour").alias("decision"))


def fetch_spans(events: DataFrame, horizon_s: int) -> DataFrame:
    return events.groupBy("ticker").agg((F.min("t0") - 86400).alias("low"), (F.max("t0") + horizon_s).alias("high"))


def links(tagged: DataFrame) -> DataFrame:
    return tagged.select("id", F.explode("tickers").alias("ticker"))


def engagement(posts: DataFrame, snapshots: DataFrame, hours: int) -> DataFrame:
    """``score_<h>h``: the score of the first snapshot at or after ``hours``; 0 without one."""
    late = posts.select("id", "created_utc").join(snapshots, "id").where(F.col("seen_utc") >= F.col("created_utc") + hours * 3600)
    first = late.groupBy("id").agg(F.min_by("seen_score", "seen_utc").alias("__score"))
    return posts.join(first, "id", "left").withColumn(f"score_{hours}h", F.coalesce("__score", F.lit(0))).drop("__score")
