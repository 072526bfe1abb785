"""Removal of repeated byte strings by a suffix array in buckets.

A byte goes if a string of ``length`` bytes over it also starts earlier.  The
suffix array is sorted in buckets that hold all strings which can be equal: a
string's bucket is the smallest hash among its parts of PART bytes (its anchor),
so equal strings have equal anchors at equal places.  Neighbouring strings with
one anchor make a run, and a run's bytes are hashed:

1. of equal runs the earliest stays, all strings of the others start earlier
   somewhere.  This is found first in a chunk, then in a task, then in all;
2. earliest runs that share an anchor with a different run, the ends of repeated
   passages, are sorted: their strings go by deep-shallow sorting, bucket by
   bucket, and of equal strings the earliest stays.  A bucket of more than LARGE
   runs is dealt out string by string and sorted by Spark instead;
3. a document's removed stretches are put together and cut out of its bytes.

Equal runs are told by 64 bits of a hash over 64-bit hashes, besides the anchor's
64; strings in buckets by their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written
from tessera.llm.suffixes import deep_shallow

LENGTH = 100
PART = 16
#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Runs of a bucket that one task sorts.
LARGE = 20_000
#: Bytes of runs that are sorted at once, if whole buckets allow.
SORTED = 1 << 21
#: Runs a task remembers because a chunk holds them so often.
OFTEN, REMEMBERED = 4, 1 << 16

ODD = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xBF58476D1CE4E5B9)]
LOW = np.uint64((1 << 24) - 1)
RUNS = "g long, u long, uid long, at long"
STRETCH = "uid long, s long, e long"


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(29))) * ODD[2]
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.cumprod(out)


def sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours, by doubling."""
    span = 1
    while span < width:
        step = min(span, width - span)
        v = np.minimum(v[:-step], v[step:])
        span += step
    return v


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs in ``data``, texts one after another: anchor hash, run hash, text, first string's start in the buffer and strings besides it."""
    n, width = len(data), length - PART + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    padded = np.r_[data, np.zeros(2 * PART, np.uint8)]
    words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (n + PART,), (1,))
    part = mixed(words[:n] * ODD[0] + mixed(words[8 : n + 8] * ODD[1]))
    # the place in the low bits: of equal parts the last one is the anchor
    least = sliding_least((part[: n - PART + 1] & ~LOW) | (LOW - np.arange(n - PART + 1, dtype=np.uint64)), width)
    text = np.repeat(np.arange(len(starts)), ends - starts)[: len(least)]
    p = np.flatnonzero(np.arange(len(least)) + length <= ends[text])
    anchor = (LOW - (least[p] & LOW)).astype(np.int64)
    text = text[p]
    if not len(p):
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    first = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])
    last = np.r_[first[1:], len(p)] - 1
    p0, p1, anchor = p[first], p[last], anchor[first]
    sums = np.r_[np.uint64(0), np.cumsum(part * powers(ODD[0], n))]
    back = powers(np.uint64(pow(int(ODD[0]), -1, 1 << 64)), n)
    run = mixed((sums[p1 + width] - sums[p0]) * back[p0])
    shape = ((p1 - p0) << 10 | (anchor - p0)).astype(np.uint64)
    return part[anchor], mixed(run ^ shape * ODD[1]), text[first], p0, p1 - p0


def joined(key: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches [s, e) of each key, overlapping and touching ones put together."""
    if not len(key):
        return key, s, e
    order = np.lexsort((s, key))
    key, s, e = key[order], s[order], e[order]
    _, number = np.unique(key, return_inverse=True)
    wide = int(e.max()) + 2
    reach = np.maximum.accumulate(e + number * wide)
    first = np.flatnonzero(np.r_[True, s[1:] + number[1:] * wide > reach[:-1]])
    ends = reach[np.r_[first[1:], len(s)] - 1] - number[first] * wide
    return key[first], s[first], ends


def earlier(uid: np.ndarray, at: np.ndarray, uid_2: np.ndarray, at_2: np.ndarray) -> np.ndarray:
    return (uid < uid_2) | ((uid == uid_2) & (at < at_2))


class Seen:
    """Runs that a task has met often, with their earliest place."""

    def __init__(self) -> None:
        self.key, self.uid, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def later(self, key: np.ndarray, uid: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of these runs were met before, at an earlier place."""
        if not len(self.key):
            return np.zeros(len(key), bool)
        i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return (self.key[i] == key) & earlier(self.uid[i], self.at[i], uid, at)

    def add(self, key: np.ndarray, uid: np.ndarray, at: np.ndarray) -> None:
        key, uid, at = np.r_[self.key, key], np.r_[self.uid, uid], np.r_[self.at, at]
        order = np.lexsort((at, uid, key))
        order = order[np.r_[True, key[order][1:] != key[order][:-1]]] if len(order) else order
        if len(order) <= REMEMBERED:
            self.key, self.uid, self.at = key[order], uid[order], at[order]


def found_runs(docs: DataFrame, length: int) -> DataFrame:
    """RUNS of ``docs`` (uid, raw): ``at`` is start << 31 | strings besides the first.

    A run that starts earlier within its chunk or task is settled: it comes, with
    its neighbours put together, as -1 - at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for rows, offset, data, starts, ends in chunks(batch.column(1), length):
                g, u, text, p0, more = runs_of(data, starts, ends, length)
                uid, start = ids[rows][text], p0 - starts[text] + offset
                order = np.lexsort((start, uid, u))
                u_, uid_, start_ = u[order], uid[order], start[order]
                first = np.r_[True, u_[1:] != u_[:-1]][: len(u_)]
                settled = np.zeros(len(u), bool)
                settled[order] = ~first
                at = np.flatnonzero(first)
                often = at[np.diff(np.r_[at, len(u_)]) >= OFTEN]
                settled |= seen.later(u, uid, start)
                seen.add(u_[often], uid_[often], start_[often])
                known, s, e = joined(uid[settled], start[settled], start[settled] + more[settled] + 1)
                keep = ~settled
                columns = [
                    np.r_[g[keep], mixed(known.astype(np.uint64) * ODD[0])].view(np.int64), np.r_[u[keep].view(np.int64), np.zeros(len(known), np.int64)],
                    np.r_[uid[keep], known], np.r_[start[keep] << 31 | more[keep], -1 - (s << 31 | (e - s - 1))],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["g", "u", "uid", "at"])

    return docs.select("uid", "raw").mapInArrow(run, RUNS)


def chunks(raw: pa.BinaryArray, length: int) -> Iterator[tuple]:
    """(rows, offset, data, starts, ends): whole texts up to CHUNK bytes together; a longer one in pieces that overlap by ``length`` - 1."""
    bounds = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    i = 0
    while i < len(raw):
        j = max(int(np.searchsorted(bounds, bounds[i] + CHUNK, "right")) - 1, i + 1)
        size = bounds[j] - bounds[i]
        if size <= CHUNK:
            if size >= length:
                yield np.arange(i, j), 0, data[bounds[i] : bounds[j]], bounds[i:j] - bounds[i], bounds[i + 1 : j + 1] - bounds[i]
        else:
            for at in range(0, size - length + 1, CHUNK):
                piece = data[bounds[i] + at : min(bounds[i] + at + CHUNK + length - 1, bounds[j])]
                yield np.array([i]), at, piece, np.array([0]), np.array([len(piece)])
        i = j


def slices(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(g, uid, p0, raw): the bytes of the wanted runs (g, uid, p0, more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gs, uids, starts, parts = [], [], [], []
            for uid, raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                for f in found:
                    gs.append(f["g"])
                    uids.append(uid)
                    starts.append(f["p0"])
                    parts.append(raw[f["p0"] : f["p0"] + f["more"] + length])
            yield pa.RecordBatch.from_arrays([pa.array(gs, pa.int64()), pa.array(uids, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["g", "uid", "p0", "raw"])

    lists = wanted.groupBy("uid").agg(F.collect_list(F.struct("g", "p0", "more")).alias("found"))
    return docs.join(lists, "uid").select("uid", "raw", "found").mapInArrow(run, "g long, uid long, p0 long, raw binary")


def later_strings(uid: np.ndarray, p0: np.ndarray, raw: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of the strings in whole buckets that also start earlier, by deep-shallow sorting."""
    sizes = np.array([len(r) for r in raw])
    begin = np.r_[0, np.cumsum(sizes)[:-1]]
    data = np.frombuffer(b"".join(raw) + bytes(16), np.uint8)
    n = sizes - length + 1
    of = np.repeat(np.arange(len(raw)), n)
    inside = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
    who, start = uid[of], p0[of] + inside
    given = np.lexsort((start, who))
    order, begins = deep_shallow(data, (begin[of] + inside)[given], length)
    late = given[order[~begins]]  # equal strings stay in the order given: all but the first start earlier too
    return joined(who[late], start[late], start[late] + length)


def sorted_buckets(runs: DataFrame, length: int) -> DataFrame:
    """STRETCH of the strings that start earlier, from runs (g, uid, p0, raw); a bucket stands in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(part: pa.Table) -> pa.RecordBatch:
            found = later_strings(part["uid"].to_numpy(), part["p0"].to_numpy(), part["raw"].to_pylist(), length)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["uid", "s", "e"])

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) < SORTED:
                continue
            whole = pa.Table.from_batches(held)
            g = whole["g"].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))  # the last bucket may go on
            if cut:
                yield done(whole.slice(0, cut))
            held = whole.slice(cut).combine_chunks().to_batches()
        if held:
            yield done(pa.Table.from_batches(held))

    dealt = runs.repartition("g").sortWithinPartitions("g")
    return dealt.mapInArrow(run, STRETCH)


def sorted_strings(runs: DataFrame, length: int) -> DataFrame:
    """As ``sorted_buckets`` for buckets of any size: string by string, the order made by Spark."""
    strings = runs.select("uid", F.col("p0"), "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - length)).alias("i"))
    strings = strings.select("uid", (F.col("p0") + F.col("i")).alias("s"), F.substring(F.col("raw"), F.col("i") + 1, F.lit(length)).alias("string"))
    numbered = strings.withColumn("n", F.row_number().over(Window.partitionBy("string").orderBy("uid", "s")))
    return numbered.filter("n > 1").select("uid", "s", (F.col("s") + length).alias("e"))


def repeated_stretches(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """STRETCH of the bytes of ``docs`` (uid, raw) that go, with overlaps."""
    same = Window.partitionBy("g", "u").orderBy("uid", "at")
    bucket = Window.partitionBy("g")
    first = (F.col("at") >= 0) & (F.col("n") == 1)
    met = (
        found_runs(docs, length)
        .repartition("g")
        .withColumn("n", F.when(F.col("at") >= 0, F.row_number().over(same)))
        .withColumn("runs", F.count_if(first).over(bucket))
        .filter((F.col("at") < 0) | (F.col("n") > 1) | (F.col("runs") > 1))
    )
    at = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at"))
    met = written(met.select("g", "uid", F.shiftright(at, 31).alias("p0"), at.bitwiseAND((1 << 31) - 1).alias("more"), F.when(first, F.col("runs")).alias("runs")), "runs")
    settled = met.filter("runs is null").select("uid", F.col("p0").alias("s"), (F.col("p0") + F.col("more") + length).alias("e"))
    open_ = met.filter("runs is not null")
    out = settled.unionByName(sorted_buckets(slices(docs, open_.filter(F.col("runs") <= large), length), length))
    if not open_.filter(F.col("runs") > large).isEmpty():
        out = out.unionByName(sorted_strings(slices(docs, open_.filter(F.col("runs") > large), length), length))
    return out


def numbered(docs: DataFrame) -> DataFrame:
    """(uid, doc_id, raw): uid orders rows by doc_id, null first, and rows of one doc_id by their texts."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().cast("binary").alias("raw"))
    odd = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null")
    if odd.isEmpty():
        return rows.select(F.col("doc_id").alias("uid"), "doc_id", "raw")
    ordered = rows.repartitionByRange("doc_id", "raw").sortWithinPartitions("doc_id", "raw")
    return written(ordered.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "raw"), "numbered")


def deduplicated(docs: DataFrame, length: int = LENGTH, large: int = LARGE, keep: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of all ``docs`` (doc_id, text, ...); with ``keep``, the bytes that stay as ``kept``.

    Null text counts as empty; a null doc_id is the smallest; rows of one doc_id
    stand in the order of their texts, so that of repeated rows one keeps its
    bytes.  Texts of fewer than ``length`` bytes stay whole.  Other columns are
    not read.  An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = numbered(docs)
    found = repeated_stretches(rows, length, large)
    lists = found.groupBy(F.col("uid").alias("f_uid")).agg(F.collect_list(F.struct("s", "e")).alias("found"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw, found in zip(*(c.to_pylist() for c in batch.columns)):
                stretches = []
                if found:
                    s, e = (np.array([f[k] for f in found]) for k in "se")
                    _, s, e = joined(np.zeros(len(s), np.int64), s, e)
                    stretches = list(zip(s.tolist(), e.tolist()))
                stays = b"".join([raw[a:b] for a, b in zip([0, *[e for _, e in stretches]], [*[s for s, _ in stretches], len(raw)])])
                out.append((doc_id, len(raw), len(raw) - len(stays), len(stretches), hashlib.sha256(stays).hexdigest(), stays))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()][: 5 + keep]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names[: 5 + keep])

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")
    return rows.join(lists, F.col("uid") == F.col("f_uid"), "left").select("doc_id", "raw", "found").mapInArrow(cut, schema)


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` without repeated strings of 100 bytes."""
    return deduplicated(table(spark, sf_dir, "documents"))
