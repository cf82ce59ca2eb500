"""The registered queries over ``documents`` and the other text tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evwatch.llm import attribution, chat, decontaminate, lines, merkle, packing, passages, quality, resampling, secrets, simhash, substrings, toxicity
from evwatch.llm.common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op2_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id"])


def op3_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.classed(passages.fuzzy_passages(table(spark, sf_dir, "documents")))


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").alias("n_before"))
    rest = lines.drop_repeated_lines(docs)
    return rest.select("doc_id", "n_before", F.length("text").alias("n_after"), F.sha2("text", 256).alias("text_sha256"))


def op5_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = F.array_join(F.transform("masks", lambda x: F.concat_ws(":", x["start"], x["end"])), ",")
    return chat.perspectives(table(spark, sf_dir, "conversations")).withColumn("masks", masks)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))

    def told(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda x: x["kind"] != "entropy")
    counts = [count(kind) for kind in secrets.KINDS]
    return found.select("doc_id", *counts[:3], F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), counts[3])


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long").alias("n_items")
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", n_items, digest, "contaminated")


def op8_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(table(spark, sf_dir, "documents"))


def op9_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = substrings.drop_repeats(table(spark, sf_dir, "documents"))
    n_spans = F.size("spans").cast("long").alias("n_spans")
    return rest.select(F.col("doc").alias("doc_id"), "n_bytes", "n_removed", n_spans, F.sha2("kept", 256).alias("kept_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = merkle.manifest(merkle.leaves(table(spark, sf_dir, "documents"), tampered=changed))
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", "verified")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_fertility": op2_fertility,
    "op3_chaining": op3_chaining,
    "op4_lines": op4_lines,
    "op5_rotation": op5_rotation,
    "op6_secrets": op6_secrets,
    "op7_decontaminate": op7_decontaminate,
    "op8_attribution": op8_attribution,
    "op9_suffixes": op9_suffixes,
    "op10_packing": op10_packing,
    "op11_manifest": op11_manifest,
    "op12_toxicity": op12_toxicity,
    "op13_resampling": op13_resampling,
}

#: The CRC-32 of a text's UTF-8 bytes.
CRC32 = """xor(list_reduce(list_transform(range(0, octet_length(encode({0}))), lambda k: ('0x' || substr(hex(encode({0})), 2 * k + 1, 2))::BIGINT),
    lambda crc, byte: list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, byte)), 4294967295::BIGINT), 4294967295::BIGINT)"""


def levels_sql(name: str, by: str, n_levels: int) -> str:
    """``{name}0`` (by, i, n, h) up to its last level, ``{name}_walk0`` (row, by, i, given, proof) along it."""
    out = []
    for k in range(n_levels):
        out.append(f"""{name}_run{k} AS (SELECT {by}, i // 8 AS i, n, list(h ORDER BY i) AS hs FROM {name}{k} GROUP BY {by}, i // 8, n)""")
        out.append(f"""{name}{k + 1} AS (SELECT {by}, i, (n + 7) // 8 AS n, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {name}_run{k})""")
        out.append(f"""{name}_walk{k + 1} AS (
  SELECT no, w.{by}, w.i // 8 AS i, CASE WHEN n > 1 THEN sha256(array_to_string(hs[: w.i % 8], '') || given || array_to_string(hs[w.i % 8 + 2 :], '')) ELSE given END AS given,
    CASE WHEN n > 1 THEN proof || array_to_string(hs[: w.i % 8], '') || array_to_string(hs[w.i % 8 + 2 :], '') ELSE proof END AS proof
  FROM {name}_walk{k} w JOIN {name}_run{k} r ON w.{by} IS NOT DISTINCT FROM r.{by} AND w.i // 8 = r.i)""")
    return ",\n".join(out)


def field_sql(c: str) -> str:
    return f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"


def leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(map(field_sql, ("doc_id", "source", "lang", "n_chars", text))) + ")"


LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op11_manifest": f"""
WITH leaf AS (
  SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id NULLS FIRST, leaf) AS no, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT doc_id, lang, {leaf_sql("text")} AS leaf, CASE WHEN {CRC32.format("doc_id::VARCHAR")} % 3 = 0 THEN {leaf_sql(f"({LOWER_SQL})")} ELSE {leaf_sql("text")} END AS given FROM documents)
), part0 AS (SELECT lang, i, n, leaf AS h FROM leaf), part_walk0 AS (SELECT no, lang, i, given, '' AS proof FROM leaf),
{levels_sql("part", "lang", 8)},
top0 AS (SELECT 0 AS whole, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, h FROM part8),
top_walk0 AS (SELECT no, 0 AS whole, t.i, given, proof FROM part_walk8 w JOIN top0 t ON w.lang IS NOT DISTINCT FROM t.lang),
{levels_sql("top", "whole", 3)}
SELECT doc_id, leaf, p.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, w.given AS folded_root, w.given = t.h AS verified
FROM leaf l JOIN top_walk3 w ON l.no = w.no JOIN part8 p ON l.lang IS NOT DISTINCT FROM p.lang, top3 t
""",
    "op13_resampling": rf"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS no, list_filter(string_split_regex({LOWER_SQL.replace("text", "coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT list_filter(string_split_regex({LOWER_SQL.replace("text", "coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), raw AS (SELECT no, unnest(w) AS word FROM doc), wanted AS (SELECT unnest(w) AS word FROM item),
word AS (SELECT word, {CRC32.format("word")} % 10000 AS bucket FROM (SELECT word FROM raw UNION SELECT word FROM wanted)),
s AS (SELECT bucket, count(*) AS s FROM raw JOIN word USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM wanted JOIN word USING (word) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT sum(s) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT sum(t) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
), weight AS (
  SELECT no, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM raw JOIN word USING (word) JOIN gain USING (bucket) GROUP BY no
), scored AS (
  SELECT doc_id, no, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM doc LEFT JOIN weight USING (no)
), ranked AS (
  SELECT no, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20 AND doc_id IS NOT NULL
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (no)
""",
    "op4_lines": r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no
  FROM documents
), full_line AS (
  SELECT doc_id, no, rtrim(line, ' ') AS line, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS words, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS pos
  FROM line WHERE regexp_matches(line, '[^ \t\x0B\f\r]')
), next AS (
  SELECT doc_id, pos, no, lead(no, 1) OVER d AS no1, lead(no, 2) OVER d AS no2, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c, words, words + lead(words, 1) OVER d AS words1
  FROM full_line WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
), win AS (
  SELECT doc_id, pos, 3 AS n, no AS first, no2 AS last, a, b, c FROM next WHERE no2 IS NOT NULL
  UNION ALL SELECT doc_id, pos, 2, no, no1, a, b, NULL FROM next WHERE no1 IS NOT NULL AND words1 > 50
  UNION ALL SELECT doc_id, pos, 1, no, no, a, NULL, NULL FROM next WHERE words > 50
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n, a, b, c ORDER BY doc_id, pos) AS k FROM win
), again AS (
  SELECT doc_id, pos, n, first, last, CASE WHEN pos <= max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh
  FROM ranked WHERE k > 1
), island AS (
  SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos, n ROWS UNBOUNDED PRECEDING) AS island FROM again
), run AS (
  SELECT doc_id, island, min(first) AS first, max(last) AS last FROM island GROUP BY ALL
), rest AS (
  SELECT line.doc_id, string_agg(line, chr(10) ORDER BY no) AS text
  FROM line LEFT JOIN run ON line.doc_id = run.doc_id AND no BETWEEN first AND last
  WHERE run.doc_id IS NULL GROUP BY line.doc_id
)
SELECT d.doc_id, length(d.text)::INT AS n_before, length(coalesce(r.text, ''))::INT AS n_after, sha256(coalesce(r.text, '')) AS text_sha256
FROM documents d LEFT JOIN rest r USING (doc_id)
""",
    "op5_rotation": r"""
WITH said AS (
  SELECT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS who, replace(coalesce(text, ''), '<|', '< |') AS said, turn // 1024 AS part FROM conversations
), cut AS (
  SELECT *, (row_number() OVER (PARTITION BY conv_id, part ORDER BY turn, who, said) - 1) // 1024 AS piece FROM said
), speaker AS (
  SELECT DISTINCT conv_id, who AS speaker FROM said WHERE who <> 'system'
), each AS (
  SELECT s.conv_id, speaker, part, piece, turn, who, said, who = speaker AS own,
    '<|im_start|>' || CASE WHEN who = speaker THEN 'assistant' WHEN who = 'system' THEN 'system' ELSE 'user name=' || who END || chr(10) AS head,
    said || '<|im_end|>' AS body
  FROM cut s JOIN speaker p ON s.conv_id = p.conv_id
), placed AS (
  SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, speaker, part, piece ORDER BY turn, who, said ROWS UNBOUNDED PRECEDING) AS stop FROM each
), parts AS (
  SELECT conv_id, speaker, part, piece, count(*) AS n_turns, max(stop) AS n_chars,
    string_agg(head || body || chr(10), '' ORDER BY turn, who, said) AS text,
    coalesce(string_agg(CASE WHEN own THEN (stop - length(body) - 1)::BIGINT || ':' || (stop - 1)::BIGINT END, ',' ORDER BY turn, who, said), '') AS masks
  FROM placed GROUP BY ALL
)
SELECT conv_id, speaker, part, piece, n_turns::INT AS n_turns,
  coalesce(sum(n_chars) OVER (PARTITION BY conv_id, speaker ORDER BY part, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_offset,
  text, masks
FROM parts
""",
    "op7_decontaminate": r"""
WITH doc AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), item AS (
  SELECT item_id::VARCHAR AS item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), win AS (
  SELECT item_id, least(len(w), 13) AS n, list_aggregate(w[i : i + 12], 'string_agg', ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item WHERE len(w) > 0)
), size AS (SELECT DISTINCT n FROM win), place AS (
  SELECT doc_id, n, i, list_aggregate(w[i : i + n - 1], 'string_agg', ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, size)
), hit AS (
  SELECT DISTINCT doc_id, item_id, place.n, i FROM place JOIN win USING (phrase, n)
), word AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc d LEFT JOIN word USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
