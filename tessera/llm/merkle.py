"""Merkle manifest of a table: leaves by language, runs of eight, and a proof for each row.

A row's rank within its language is written in digits of base FAN.  Blocks of
FAN ** DIGITS leaves are rolled up by grouping the lowest digit away, then the
next, each child struct nested in its parent's.  What a block leaves, one digest,
is a leaf of the next tier, until a language has a single block.  Inside a block
no join is made: a transform over the nested structs finds each leaf's siblings
and an explode emits them.  A block's own way to the top comes back to it by one
equi-join of blocks, one row for FAN ** DIGITS leaves; nesting that too would put a
whole language in one row.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import table, written

FAN = 8
DIGITS = 4
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEP = "array<struct<l:string,r:string>>"
#: What a leaf carries through the nesting.
OWN = ["doc_id", "leaf", "tampered"]


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, concatenated."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def netted(value: Column) -> Column:
    """A value with its length in bytes before it; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def lowered(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def leaf(text: Column | None = None) -> Column:
    """The digest of a row, with ``text`` in place of its own if given."""
    return digest(*[netted(text if text is not None and c == "text" else F.col(c)) for c in FIELDS])


def ranked(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rank`` (from 0, by ``order``) within ``key`` and its size ``n``, for rows of any skew.

    Rows are dealt in ranges of key and order, so that a key with most of the rows
    spreads over many tasks; a rank is the place within a range's share of the key
    and the number of rows in the ranges before.  Shares number at most ranges and
    keys together.
    """
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(dealt.select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("at")), "placed")
    part = F.shiftrightunsigned("at", 33)
    cells = placed.groupBy(part.alias("part"), F.col(f"row.{key}").alias("key")).agg(F.count("*").alias("cell"), F.min("at").alias("first"))
    before = Window.partitionBy("key").orderBy("part")
    cells = cells.select(
        "part", "key", "first",
        (F.sum("cell").over(before) - F.col("cell")).alias("offset"),
        F.sum("cell").over(Window.partitionBy("key")).alias("n"),
    )
    found = placed.withColumn("in_part", part).join(cells, (F.col("in_part") == F.col("part")) & F.col(f"row.{key}").eqNullSafe(F.col("key")))
    return found.select("row.*", (F.col("at") - F.col("first") + F.col("offset")).alias("rank"), "n")


def nodes_at(level: int) -> Column:
    """How many nodes a tree over ``n`` leaves has at a level above them."""
    return F.ceil(F.col("n") / F.lit(FAN**level))


def rolled_up(leaves: DataFrame, key: str) -> DataFrame:
    """Blocks of leaves (key, rank, n, h, own): digits of the rank are grouped away, the lowest first.

    Returns key, block, n, and ``tree`` with h, the block's digest, and the nested
    children ``c`` with their digits ``d``.  A level that has a single node to
    begin with is passed through, without hashing.
    """
    digits = [F.shiftright("rank", 3 * i).bitwiseAND(FAN - 1).cast("int").alias(f"d{i}") for i in range(DIGITS)]
    names = [f"d{i}" for i in range(DIGITS)]
    tree = leaves.select(key, F.shiftright("rank", 3 * DIGITS).alias("block"), "n", *digits, F.struct("h", "own").alias("node"))
    for i in range(DIGITS):
        keep = [key, "block", *names[i + 1 :]]
        met = tree.groupBy(*keep).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct(F.col(names[i]).alias("d"), F.col("node").alias("v")))).alias("c"))
        one = digest(F.array_join(F.transform("c", lambda x: x["v"]["h"]), ""))
        tree = met.select(*keep, "n", F.struct(F.when(nodes_at(i) > 1, one).otherwise(F.col("c")[0]["v"]["h"]).alias("h"), "c").alias("node"))
    return tree.withColumnRenamed("node", "tree")


def steps_to(node: Column, level: int) -> Column:
    """(own, steps) for every leaf under ``node`` at ``level``: the siblings left and right of each node on the way up."""
    if not level:
        return F.array(F.struct(node["own"].alias("own"), F.array().cast(STEP).alias("steps")))

    def below(child: Column) -> Column:
        def beside(test) -> Column:
            return F.array_join(F.transform(F.filter(node["c"], test), lambda x: x["v"]["h"]), "")

        step = F.struct(beside(lambda x: x["d"] < child["d"]).alias("l"), beside(lambda x: x["d"] > child["d"]).alias("r"))
        here = F.when(nodes_at(level - 1) > 1, F.array(step)).otherwise(F.array().cast(STEP))
        return F.transform(steps_to(child["v"], level - 1), lambda at: F.struct(at["own"].alias("own"), F.concat(at["steps"], here).alias("steps")))

    return F.flatten(F.transform(node["c"], below))


def climbed(leaves: DataFrame, key: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of each tier over the leaves (key, rank, n, h, own), lowest first, and (key, top): where each key ends."""
    limit, made, tops = FAN**DIGITS, [], None
    while True:
        blocks = written(rolled_up(leaves, key), "blocks")
        made.append(blocks)
        ended = blocks.filter(F.col("n") <= limit).select(key, F.col("tree.h").alias("top"))
        tops = ended if tops is None else tops.unionByName(ended)
        more = blocks.filter(F.col("n") > limit)
        if more.isEmpty():
            return made, tops
        leaves = more.select(key, F.col("block").alias("rank"), F.ceil(F.col("n") / limit).alias("n"), F.col("tree.h").alias("h"), F.col("block").alias("own"))


def descended(made: list[DataFrame], key: str, last: DataFrame) -> DataFrame:
    """(key, own, steps, end) for every leaf; ``last`` (key, steps, end) has the steps that follow a key's own tree.

    A key's single block meets the key's row of ``last``, any other block its own
    row of the tier above: one row to one, before blocks are exploded.
    """
    limit, above = FAN**DIGITS, None
    after = last.select(F.col(key).alias("a_key"), F.lit(0).cast("long").alias("a_block"), F.col("steps").alias("a_steps"), "end")
    for blocks in reversed(made):
        met = after.withColumn("a_last", F.lit(True))
        if above is not None:
            met = met.unionByName(above.select(F.col(key).alias("a_key"), F.col("own").alias("a_block"), F.col("steps").alias("a_steps"), "end", F.lit(False).alias("a_last")))
        ends = F.col("n") <= limit
        held = blocks.join(met, F.col(key).eqNullSafe(F.col("a_key")) & (F.col("block") == F.col("a_block")) & (ends == F.col("a_last")))
        found = held.select(key, "n", "a_steps", "end", F.explode(steps_to(F.col("tree"), DIGITS)).alias("at"))
        above = found.select(key, "at.own", F.concat("at.steps", "a_steps").alias("steps"), "end")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, tampered, subroot, root, steps): each row's leaf, and the siblings on its way to the root.

    ``docs`` has doc_id, source, lang, n_chars and text; other columns are not
    read.  Nulls are hashed as ``-``; a null lang is a language of its own, first
    of all; rows of one doc_id stand in the order of their leaves, and repeated
    rows are leaves as often as they stand there.  An empty table gives no rows.
    """
    changed = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, leaf(lowered(F.col("text"))))
    leaves = written(docs.select("doc_id", "lang", leaf().alias("leaf"), changed.alias("tampered")), "leaves")
    own = F.struct(*OWN).alias("own")
    made, subroots = climbed(ranked(leaves, "lang", ["doc_id", "leaf"]).select("lang", "rank", "n", F.col("leaf").alias("h"), own), "lang")
    langs = ranked(subroots.withColumn("all", F.lit(0)), "all", ["lang"]).select("all", "rank", "n", F.col("top").alias("h"), F.struct("lang", F.col("top").alias("subroot")).alias("own"))
    made_langs, root = climbed(langs, "all")
    nothing = root.select("all", F.array().cast(STEP).alias("steps"), F.col("top").alias("end"))
    ways = descended(made_langs, "all", nothing).select("own.lang", "steps", F.struct("own.subroot", F.col("end").alias("root")).alias("end"))
    out = descended(made, "lang", ways)
    return out.select("own.doc_id", "lang", "own.leaf", "own.tampered", "end.subroot", "end.root", "steps")


def folded(start: Column) -> Column:
    """The root that ``start`` leads to along the row's steps."""
    return F.aggregate("steps", start, lambda h, s: digest(s["l"], h, s["r"]))


def proofs(made: DataFrame) -> DataFrame:
    """The manifest with its digest columns: what the siblings hash to, where a leaf leads, and whether it is the root."""
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["l"], s["r"])), "")
    led = made.select("doc_id", "leaf", "subroot", "root", digest(siblings).alias("proof_sha256"), folded(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return led.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of every row of ``documents``, and whether it stands after tampering."""
    return proofs(manifest(table(spark, sf_dir, "documents")))


def _net(value: str) -> str:
    return f"coalesce(strlen({value}::varchar) || ':' || {value}::varchar, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_net(text if c == "text" else c) for c in FIELDS) + ")"


_LOWER = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
# CRC-32 of the decimal doc_id: bytes, then eight shifts for each, by the polynomial's reversed form
_BIT = "CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END"
_CRC = f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda d: ascii(d)::bigint)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda v, z: {_BIT})), 4294967295::bigint)"

OP11_SQL = f"""
WITH RECURSIVE leaves AS (
    SELECT doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql(_LOWER)} ELSE {_leaf_sql("text")} END AS held
    FROM documents
), ranks AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf, held) - 1 AS rank FROM leaves
), nodes AS (
    SELECT 0 AS level, lang, rank AS idx, leaf AS h FROM ranks
    UNION ALL
    SELECT level + 1, lang, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1 GROUP BY level, lang, idx // 8
), subroots AS (
    SELECT lang, h, level, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank
    FROM (SELECT * FROM nodes QUALIFY row_number() OVER (PARTITION BY lang ORDER BY level DESC) = 1)
), tops AS (
    SELECT 0 AS level, rank AS idx, h FROM subroots
    UNION ALL
    SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx))
    FROM (SELECT *, count(*) OVER () AS n FROM tops) WHERE n > 1 GROUP BY level, idx // 8
), root AS (SELECT h FROM tops ORDER BY level DESC LIMIT 1),
runs AS (
    SELECT level, lang, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes GROUP BY ALL
), top_runs AS (SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM tops GROUP BY ALL),
ways AS (
    SELECT doc_id, lang, leaf, held, rank, 0 AS level, rank AS idx, 0 AS tier, held AS acc, '' AS proof FROM ranks
    UNION ALL
    SELECT w.doc_id, w.lang, w.leaf, w.held, w.rank,
        CASE WHEN w.tier = 0 AND w.level = s.level THEN 0 ELSE w.level + 1 END,
        CASE WHEN w.tier = 0 AND w.level = s.level THEN s.rank ELSE w.idx // 8 END,
        CASE WHEN w.tier = 0 AND w.level = s.level THEN 1 ELSE w.tier END,
        CASE WHEN w.tier = 0 AND w.level = s.level THEN w.acc
             ELSE sha256(list_aggregate(list_concat(coalesce(r.hs, t.hs)[1:w.idx % 8], [w.acc], coalesce(r.hs, t.hs)[w.idx % 8 + 2:]), 'string_agg', '')) END,
        CASE WHEN w.tier = 0 AND w.level = s.level THEN w.proof
             ELSE w.proof || array_to_string(coalesce(r.hs, t.hs)[1:w.idx % 8], '') || array_to_string(coalesce(r.hs, t.hs)[w.idx % 8 + 2:], '') END
    FROM ways w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang
    LEFT JOIN runs r ON w.tier = 0 AND r.level = w.level AND r.lang IS NOT DISTINCT FROM w.lang AND r.run = w.idx // 8
    LEFT JOIN top_runs t ON w.tier = 1 AND t.level = w.level AND t.run = w.idx // 8
    WHERE w.tier = 0 OR w.level < (SELECT max(level) FROM tops)
)
SELECT w.doc_id, w.leaf, s.h AS subroot, root.h AS root, sha256(w.proof) AS proof_sha256, w.acc AS folded_root, w.acc = root.h AS verified
FROM ways w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang CROSS JOIN root
WHERE w.tier = 1 AND w.level = (SELECT max(level) FROM tops)
"""
