"""Best-fit packing of documents into fixed windows, planned over a length histogram.

Documents are tokenised once into pieces of at most ``window`` tokens.  The plan
is made from the histogram of piece lengths alone (at most ``window`` rows): best
fit places *counts* of a length into counts of equally filled sequences, so the
plan's size follows the window, never the number of documents.  Each piece then
takes the planned slot that its rank within its length points to.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written
from tessera.llm.tokens import part_ids, default_path

WINDOW = 4096
END_ID = 1
#: A length's pieces are ranked in groups of about this share of all pieces.
GROUPS = 4096

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
SLOTS = "p_length long, lo long, hi long, copies long, first_sequence long, first_offset long"


def pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: its ids, then the end id, cut only beyond ``window``."""
    end = END_ID.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = part_ids(tokenizer)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")}
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = cache.ids(text) + end
                for k, at in enumerate(range(0, len(ids), 4 * window)):
                    part = ids[at : at + 4 * window]
                    out["doc_id"].append(doc_id)
                    out["piece"].append(k)
                    out["start"].append(at // 4)
                    out["length"].append(len(part) // 4)
                    out["ids_crc32"].append(zlib.crc32(part))
                    if keep_ids:
                        out["ids"].append(part)
            columns = [pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32())]
            columns += [pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32")]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                columns, names = [*columns, pa.array(out["ids"], pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = PIECES + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(cut, schema)


def plan_slots(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts.

    ``counts`` maps a length to how many pieces have it.  A row of the plan,
    ``(length, lo, hi, copies, first_sequence, first_offset)``, seats the pieces
    of that length with rank in [lo, hi): rank ``lo + i`` goes to sequence
    ``first_sequence + i // copies`` at ``first_offset + (i % copies) * length``.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens -> runs of sequence ids (first, number)
    free: list[int] = []
    plan: list[tuple[int, int, int, int, int, int]] = []
    made = 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(free, length)
            if at < len(free):
                left = free[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], free[at]
            else:
                left, first = window, made
                n = -(-todo // (window // length))
                made += n
            copies = left // length
            whole = min(n, todo // copies)
            if whole:
                plan.append((length, rank, rank + whole * copies, copies, first, window - left))
                put(left - copies * length, first, whole)
                rank, todo = rank + whole * copies, todo - whole * copies
            if todo and whole < n:  # fewer are left than one more sequence takes
                plan.append((length, rank, rank + todo, todo, first + whole, window - left))
                put(left - todo * length, first + whole, 1)
                rank, todo, whole = rank + todo, 0, whole + 1
            put(left, first + whole, n - whole)
    return plan


def pack(pieces_df: DataFrame, window: int = WINDOW) -> DataFrame:
    """Seat each row of ``pieces_df`` (p_row, length, ...): adds sequence_id and offset, drops p_row.

    ``p_row`` tells the rows apart, repeated ones too.  ``pieces_df`` is read
    three times and must be a written table.
    """
    spark = pieces_df.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces_df.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    total = sum(histogram.values())
    plan = plan_slots(histogram, window)

    # Ranks within a length: the rows of a length are dealt to groups of bounded share, so that
    # a length that a third of all pieces have is ranked by many tasks. There are at most
    # window + GROUPS groups, whatever the input.
    salts = [(n, max(1, -(-c * GROUPS // max(total, 1)))) for n, c in histogram.items()]
    dealt = pieces_df.join(
        F.broadcast(spark.createDataFrame(salts, "s_length long, n_salts long")), F.col("length") == F.col("s_length")
    ).withColumn("salt", F.pmod(F.xxhash64("p_row"), F.col("n_salts")))
    base, seen = [], {}
    for r in sorted(dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()):
        base.append((r["length"], r["salt"], seen.get(r["length"], 0)))
        seen[r["length"]] = seen.get(r["length"], 0) + r["n"]
    order = Window.partitionBy("length", "salt").orderBy("p_row")
    ranked = (
        dealt.withColumn("place", F.row_number().over(order) - 1)
        .join(F.broadcast(spark.createDataFrame(base, "b_length long, b_salt long, base long")), (F.col("length") == F.col("b_length")) & (F.col("salt") == F.col("b_salt")))
        .withColumn("rank", F.col("base") + F.col("place"))
    )
    slots = F.broadcast(spark.createDataFrame(plan, SLOTS))
    i = F.col("rank") - F.col("lo")
    return ranked.join(slots, (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select(
        *[c for c in pieces_df.columns if c != "p_row"],
        (F.col("first_sequence") + F.floor(i / F.col("copies"))).cast("long").alias("sequence_id"),
        (F.col("first_offset") + (i % F.col("copies")) * F.col("length")).cast("long").alias("offset"),
    )


def pack_documents(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all of ``docs`` (doc_id, text, ...) into sequences of at most ``window`` tokens.

    Null text counts as empty (a piece that holds the end id alone); a null
    doc_id is kept; repeated rows are packed as often as they stand there; other
    columns are not read.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    cut = pieces(docs, tokenizer or default_path(), window).withColumn("p_row", F.monotonically_increasing_id())
    return pack(written(cut, "pieces"), window)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``, packed."""
    return pack_documents(table(spark, sf_dir, "documents"))
