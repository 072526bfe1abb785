"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked by pigeonring search.

Cut a fingerprint's bits into m = max_bits + 1 segments laid on a ring.  If two
fingerprints differ in at most ``max_bits`` bits, some segment starts a chain
in which every run of l segments differs in at most floor(l * max_bits / m)
bits: the first segment not at all, the first two together in one bit at most,
and so on.  A candidate must agree on the whole first segment, on one half of
the second (it differs in at most one bit) and on one of max_bits + 1 parts of
the rest; then the chain's budgets are held against it, and only what survives
gets the full Hamming check.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written
from tessera.llm.components import component_labels, tree_edges

BITS = 64
SEED = 42  # of the shingles' XXH64


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each run of ``words`` ASCII-space-separated words, A-Z lowered; of the whole if there are fewer."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    whole, n = b" ".join(parts), max(1, len(parts) - words + 1)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends]
    last = min(words, len(parts)) - 1
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(whole[starts[i] : ends[i + last] - 1], SEED) for i in range(n)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; no hashes: zero."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.ascontiguousarray(hashes[at : at + (1 << 16)])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle_words: int = 5) -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [majority_bits(shingle_hashes(t, shingle_words)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def even_cut(lo: int, hi: int, parts: int) -> list[tuple[int, int]]:
    edges = [lo + (hi - lo) * k // parts for k in range(parts + 1)]
    return list(zip(edges, edges[1:]))


def bits_mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def chain_masks(max_bits: int) -> list[tuple[int, list[int]]]:
    """For each key, its mask and the masks of the chain's segments in order from the key's start."""
    m = max_bits + 1
    segments = [list(range(*x)) for x in even_cut(0, BITS, m)]
    keys = []
    for i in range(m):
        chain = [segments[(i + k) % m] for k in range(m)]
        second = chain[1]
        for lo, hi in even_cut(0, len(second), 2):
            rest = second[:lo] + second[hi:] + [b for s in chain[2:] for b in s]
            for a, b in even_cut(0, len(rest), max_bits + 1):
                keys.append((bits_mask(chain[0] + second[lo:hi] + rest[a:b]), [bits_mask(s) for s in chain]))
    return keys


def chain_holds(diff: np.ndarray, chain: list[int], max_bits: int) -> np.ndarray:
    """Which differences keep to the budget of every run that starts the chain; the last run is the full Hamming check."""
    ok, total = np.ones(diff.shape, bool), np.zeros(diff.shape, np.int64)
    for k, mask in enumerate(chain, 1):
        total = total + np.bitwise_count(diff & np.uint64(mask))
        ok &= total <= k * max_bits // len(chain)
    return ok


#: Beyond this many fingerprints in a bucket, partners are looked up by flipping bits instead of compared.
COMPARE = 2048


def bucket_groups(fps: np.ndarray, mask: int, chain: list[int], max_bits: int) -> list[list[int]]:
    """The connected groups of two and more among distinct sorted fingerprints that share a key."""
    groups = []
    if len(fps) <= COMPARE:
        left = np.arange(len(fps))
        while len(left) > 1:
            group, front, left = [left[0]], [left[0]], left[1:]
            while front and len(left):
                near = chain_holds(fps[left] ^ fps[front.pop()], chain, max_bits)
                found, left = left[near], left[~near]
                group.extend(found)
                front.extend(found)
            if len(group) > 1:
                groups.append([int(fps[i]) for i in group])
        return groups
    # A bucket holds at most 2 ** (bits outside the key) fingerprints; each has a fixed number of possible partners.
    free = [b for b in range(BITS) if not mask >> b & 1]
    parent = np.arange(len(fps))
    for n in range(1, max_bits + 1):
        for bits in combinations(free, n):
            flip = np.uint64(bits_mask(list(bits)))
            if not chain_holds(np.array([flip]), chain, max_bits)[0]:
                continue
            other = fps ^ flip
            at = np.minimum(np.searchsorted(fps, other), len(fps) - 1)
            for i in np.flatnonzero((fps[at] == other) & (fps < other)):
                a, b = int(i), int(at[i])
                while parent[a] != a:
                    parent[a] = parent[parent[a]]
                    a = int(parent[a])
                while parent[b] != b:
                    parent[b] = parent[parent[b]]
                    b = int(parent[b])
                parent[max(a, b)] = min(a, b)
    found: dict[int, list[int]] = {}
    for i in range(len(fps)):
        root = i
        while parent[root] != root:
            root = int(parent[root])
        found.setdefault(root, []).append(int(fps[i]))
    return [g for g in found.values() if len(g) > 1]


def fingerprint_links(distinct: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) over a table of distinct fingerprints ``fp``: edges whose components are those of all pairs within ``max_bits``.

    Within a bucket a tree stands for all its pairs, so that a large group of
    near copies makes as many edges as it has members.
    """
    masks = chain_masks(max_bits)
    signed = [int(np.array([m], np.uint64).view(np.int64)[0]) for m, _ in masks]
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("k", "v"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def linked(k: np.ndarray, v: np.ndarray, fp: np.ndarray) -> Iterator[tuple[int, int]]:
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (v[1:] != v[:-1])) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(k)]
            for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1]):
                mask, chain = masks[k[s]]
                for group in bucket_groups(np.sort(fp[s:e].view(np.uint64)), mask, chain, max_bits):
                    yield from tree_edges(sorted(np.array(group, np.uint64).view(np.int64).tolist()))

        def out(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], ["a", "b"])

        held: list[np.ndarray] | None = None  # rows of the last key so far, which may go on in the next batch
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            if not len(now[0]):
                continue
            k, v, fp = now
            last = np.flatnonzero((k != k[-1]) | (v != v[-1]))
            cut = last[-1] + 1 if len(last) else 0
            held = [x[cut:].copy() for x in now]
            if cut and (pairs := list(linked(k[:cut], v[:cut], fp[:cut]))):
                yield out(pairs)
        if held is not None and (pairs := list(linked(*held))):
            yield out(pairs)

    dealt = keyed.repartition(F.col("k"), F.col("v")).sortWithinPartitions("k", "v").select("k", "v", "fp")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, max_bits: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text, ...).

    Null text counts as empty; texts without words have fingerprint zero and
    link like any others.  component_id is the smallest doc_id of the component;
    a null doc_id keeps its row and never names a component unless all are null.
    Repeated rows stay; other columns are not read; no rows give no rows.
    """
    bounded_batches(docs.sparkSession)
    fps = written(fingerprints(docs, shingle_words), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    if max_bits > 0:
        labels = component_labels(fingerprint_links(nodes.select("fp"), max_bits))
        named = written(nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label")), "labelled")
    else:
        named = nodes.withColumn("label", F.col("fp"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    by_fp = written(named.join(least, "label").select("fp", "component_id"), "components")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``: three-word shingles, links at two or fewer differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)
