"""A manifest of a dataset as a tree of hashes, with a proof for every row.

Rows are leaves; within each part (a language, a source) leaves lie in order and every ``FANOUT``
consecutive nodes hash to one, until one is left; the parts' last nodes are joined likewise to one
root. Conditional aggregates spread each parent's children over ``FANOUT`` columns, by their slot:
the columns in order, concatenated, hash to the parent, and without the own slot's column they are a
child's siblings. So a level is one grouping by eights, and proofs come down the levels by joining
each node to its parent's row, where the slots already lie.

Digests are lower-case hex SHA-256, and are concatenated as that text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.llm.common import lower_ascii
from evwatch.operators.ranks import numbered
from evwatch.tables import stored

FANOUT = 8
SLOTS = [f"c{s}" for s in range(FANOUT)]
NO_PROOF = "array<struct<left: string, right: string>>"


def field(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def leaves(docs: DataFrame, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """``(doc_id, part, leaf, given)``: the hash of each row, and that of the row as somebody gives
    it: with ``text_col`` lower-cased (A-Z) where ``tampered`` holds, else the same."""
    changed = row_hash(*(lower_ascii(F.col(c)) if c == text_col else F.col(c) for c in columns))
    leaf = row_hash(*(F.col(c) for c in columns))
    given = leaf if tampered is None else F.when(F.coalesce(tampered, F.lit(False)), changed).otherwise(leaf)
    return docs.select(F.col(id_col).alias("doc_id"), F.col(part_col).cast("string").alias("part"), leaf.alias("leaf"), given.alias("given"))


@dataclass
class Tree:
    """Levels above the nodes, as tables ``part, i, n, h, c0..c7``: node ``i`` of the ``n`` that the part
    has there, its hash and its children; the last node of each part, ``part, h``; and at which levels
    parts end, 0 being that of the nodes."""

    nodes: DataFrame
    levels: list[DataFrame]
    tops: DataFrame
    ends: set[int]


def same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def tree(nodes: DataFrame) -> Tree:
    """``nodes``: part, i (from 0 in each part), n (of the part). The driver gets the numbers of levels
    that parts have, of which there are a dozen at most."""
    height = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(21)), F.lit(0))
    ends = set(nodes.agg(F.collect_set(height)).first()[0])
    level, levels, tops = nodes.select("part", "i", "n", "h"), [], nodes.select("part", "h").limit(0)
    for k in range(max(ends, default=0) + 1):
        if k:
            slot = F.col("i") % FANOUT
            children = [F.max(F.when(slot == s, F.col("h"))).alias(c) for s, c in enumerate(SLOTS)]
            up = level.where("n > 1").groupBy("part", F.floor(F.col("i") / FANOUT).cast("long").alias("i"), F.floor((F.col("n") + FANOUT - 1) / FANOUT).cast("long").alias("n")).agg(*children)
            level = stored(up.select("part", "i", "n", F.sha2(F.concat_ws("", *SLOTS), 256).alias("h"), *SLOTS))
            levels.append(level)
        if k in ends:
            tops = tops.unionByName(level.where("n = 1").select("part", "h"))
    return Tree(nodes, levels, stored(tops), ends)


def siblings(slot: Column) -> Column:
    """What lies left and right of a slot among its parent's columns."""
    left = F.concat_ws("", *(F.when(slot > s, F.col(c)) for s, c in enumerate(SLOTS)))
    right = F.concat_ws("", *(F.when(slot < s, F.col(c)) for s, c in enumerate(SLOTS)))
    return F.struct(left.alias("left"), right.alias("right"))


def proofs(found: Tree, above: DataFrame) -> DataFrame:
    """The tree's nodes with ``top``, the last node of their part, and ``proof``: the siblings left and right
    at each level from theirs up. ``above``: part, top and the proof of the part's last node."""
    above = above.select(F.col("part").alias("__part"), "top", "proof")

    def of(k: int) -> DataFrame:
        level = found.levels[k - 1] if k else found.nodes
        alone = level.where("n = 1").join(above, same("part", "__part")).drop("__part")
        if k == len(found.levels):
            return alone
        up = of(k + 1).select(F.col("part").alias("__part"), F.col("i").alias("__i"), *SLOTS, "top", F.col("proof").alias("__proof"))
        kept = [F.col(f"__child.{c}").alias(c) for c in level.columns]
        here = level.where("n > 1").select(F.struct(*level.columns).alias("__child"))
        met = here.join(up, F.col("__child.part").eqNullSafe(F.col("__part")) & (F.floor(F.col("__child.i") / FANOUT).cast("long") == F.col("__i")))
        whole = F.concat(F.array(siblings(F.col("__child.i") % FANOUT)), F.col("__proof"))
        met = met.select(*kept, "top", whole.alias("proof"))
        return met.unionByName(alone) if k in found.ends else met

    return of(0)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(proof, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(rows: DataFrame) -> DataFrame:
    """``rows`` of ``leaves`` with ``subroot``, ``root``, ``proof`` (structs of the siblings left and right, level
    by level to the root), ``folded_root`` (what ``given`` and the proof come to) and ``verified``.

    Leaves ascend by id within their part, a null id first, rows of one id by their hash; parts ascend
    by their bytes, a null part first and a part of its own. Repeated rows are leaves each. An empty
    table gives an empty result.
    """
    placed = numbered(stored(rows), [F.col("part").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), "leaf"])
    placed = stored(placed)
    parts = placed.groupBy("part").agg(F.min("place").alias("__first"), F.count("*").alias("n")).withColumnRenamed("part", "__part")
    nodes = placed.join(parts, same("part", "__part")).select("doc_id", "part", "leaf", "given", (F.col("place") - F.col("__first")).alias("i"), "n", F.col("leaf").alias("h"))
    whole = tree(nodes)
    tops = stored(numbered(whole.tops, [F.col("part").asc_nulls_first()]))
    n_parts = tops.count()
    over = tree(tops.select(F.lit("").alias("part"), F.col("part").alias("of"), F.col("place").alias("i"), F.lit(n_parts).cast("long").alias("n"), "h"))
    root = (over.tops.first() or {"h": None})["h"]
    none = rows.sparkSession.range(1).select(F.lit("").alias("part"), F.lit(root).cast("string").alias("top"), F.array().cast(NO_PROOF).alias("proof"))
    tops_proofs = proofs(over, none).select(F.col("of").alias("part"), F.col("h").alias("top"), "proof")
    out = proofs(whole, stored(tops_proofs)).withColumn("folded_root", folded(F.col("given"), F.col("proof")))
    return out.select("doc_id", "part", "leaf", "given", F.col("top").alias("subroot"), F.lit(root).cast("string").alias("root"), "proof", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"))


def proof_digest(proof: Column) -> Column:
    """The hash of all siblings, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda x: F.concat(x["left"], x["right"])), ""), 256)
