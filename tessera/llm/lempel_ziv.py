"""Lempel-Ziv phrase fingerprints: how much of one text's dictionary another shares.

A text is parsed into dictionary phrases (each new phrase is the longest known
one and a character more), the phrase set is hashed, and the smallest hash in
each of BINS bins is kept.  Likeness is the share of bins that agree, an
estimate of how far two phrase sets coincide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written

BINS = 64
NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


class Parse:
    """A parse that can go on, and be taken back to where it stood."""

    def __init__(self) -> None:
        self.phrases: set[str] = set()
        self.open = ""

    def feed(self, text: str) -> list[str]:
        """The new phrases that ``text`` adds."""
        known, w, new = self.phrases, self.open, []
        for c in text:
            w += c
            if w not in known:
                known.add(w)
                new.append(w)
                w = ""
        self.open = w
        return new


def least_hashes(phrases: Iterable[str]) -> np.ndarray:
    """The smallest hash of each bin, bins by the hash's leading bits."""
    h = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, phrases), np.uint64))
    out = np.full(BINS, NONE)
    if len(h):
        bins = (h >> np.uint64(58)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
        out[bins[first]] = h[first]
    return out


def fingerprint(least: np.ndarray) -> str:
    """Four hex digits of each bin's hash; dashes for an empty bin."""
    return "".join("----" if x == NONE else f"{int(x) & 0xFFFF:04x}" for x in least)


def likeness(a: str, b: str) -> float:
    """Of the bins that either fingerprint fills, the share that agree; two empty ones are alike."""
    x, y = ([s[i : i + 4] for i in range(0, 4 * BINS, 4)] for s in (a, b))
    filled = [(p, q) for p, q in zip(x, y) if p != "----" or q != "----"]
    return sum(p == q for p, q in filled) / len(filled) if filled else 1.0


def text_fingerprint(text: str) -> str:
    return fingerprint(least_hashes(Parse().feed(text)))


class Edited:
    """A text with its fingerprint, ready to take a new last quarter."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 4
        self.parse = Parse()
        self.least = least_hashes(self.parse.feed(text[: self.cut]))
        self.open = self.parse.open
        self.fingerprint = fingerprint(np.minimum(self.least, least_hashes(self._tail(text[self.cut :]))))

    def _tail(self, text: str) -> list[str]:
        new = self.parse.feed(text)
        self.parse.phrases.difference_update(new)
        self.parse.open = self.open
        return new

    def row(self, following: str, following_fingerprint: str) -> tuple:
        head = following[: len(self.text) - self.cut]
        edited = self.text[: self.cut] + head
        fp = fingerprint(np.minimum(self.least, least_hashes(self._tail(head))))
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return (self.doc_id, len(self.text), digest, self.fingerprint, fp, likeness(self.fingerprint, fp), likeness(self.fingerprint, following_fingerprint))


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FIELDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
NAMES = [f.split()[0] for f in RESULT.split(", ")]


def batch_of(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def phrase_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of all ``docs`` (doc_id, text, ...) and of their edits by the next document.

    The next document is the one with the next greater doc_id (after the last:
    the first); of several rows with that id, the one with the smallest text.
    Null text counts as empty; a null doc_id is the smallest; repeated rows stay,
    each edited by the same next document; a table of one document is its own
    next.  Other columns are not read.

    Rows are dealt in ranges of doc_id and sorted, so that the next document is
    the next row; only the last row of each range waits for the first of the
    next one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        waiting: list[Edited] = []
        nothing = (None,) * len(NAMES)
        kinds = [pa.int32(), pa.string(), pa.string(), *FIELDS]
        names = ["part", "role", "text", *NAMES]
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if waiting and waiting[0].doc_id == doc_id and waiting[-1].text == text:
                    waiting.append(waiting[-1])
                    continue
                now = Edited(doc_id, text)
                if not waiting:
                    out.append((part, "first", text, *nothing[:3], now.fingerprint, *nothing[4:]))
                elif waiting[0].doc_id != doc_id:
                    out += [(part, "row", None, *w.row(now.text, now.fingerprint)) for w in waiting]
                    waiting = []
                waiting.append(now)
            if out:
                yield batch_of(out, kinds, names)
        if waiting:
            yield batch_of([(part, "last", w.text, w.doc_id, *nothing[1:]) for w in waiting], kinds, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    made = written(ordered.mapInArrow(run, f"part int, role string, text string, {RESULT}"), "phrases")

    # a row or two for each range of ids
    parts = sorted(r["part"] for r in made.filter("role = 'first'").select("part").collect())
    follows = spark.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]])), "part int, next_part int")
    first = made.filter("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fp"))
    last = made.filter("role = 'last'").select("part", "doc_id", "text").join(F.broadcast(follows), "part").join(first, "next_part").select("doc_id", "text", "next_text", "next_fp")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [Edited(i, t).row(nt, nf) for i, t, nt, nf in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch_of(rows, FIELDS, NAMES)

    return made.filter("role = 'row'").select(*NAMES).unionByName(last.mapInArrow(finish, RESULT))


def op4_lempel_ziv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all ``documents`` and of their edited texts."""
    return phrase_fingerprints(table(spark, sf_dir, "documents"))
