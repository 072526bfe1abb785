"""How two tokenizers cut the same texts: groups of tokens that end together, and how often ids are linked.

A text is encoded by a byte-level BPE (A) and by a piece BPE (B).  Byte offsets
where tokens of both end cut them into groups, and the two tokens that end there
are linked.  Most groups are one token of each with the same bytes: an identity
map from A's ids to B's of the same bytes is made once, and these links are
counted in vectors of vocabulary length.  Only the links of irregular groups are
shuffled as id pairs.

Both tokenizers cut at a single space between two other characters, so a text's
tokens and groups are those of its words in order.  Words repeat; each process
keeps the groups of those it has seen, up to a bound.  If a tokenizer does not
keep the bytes of a word, it does not keep the text's.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written
from tessera.llm.tokens import byte_letters

#: Python's white space includes that of both tokenizers.
CUT = re.compile(r"(?<=\S) (?=\S)")
#: A pair with more than this share of all irregular links, one in HOT, is looked up in the task and never shuffled by its ids.
HOT = 1 << 16

DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, ids array<int>, id_ns array<long>, pairs array<long>, pair_ns array<long>, whole boolean"
SUMS = "n_best long, count_sum long"


def paths() -> tuple[str, str]:
    """Where this machine keeps the two public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Aligned:
    """Two vocabularies, and the groups of the words met so far: numbered, in flat arrays."""

    def __init__(self, a_path: str, b_path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(a_path)
        whole.encode_special_tokens = True
        others = byte_letters()
        byte_of = {others.get(i, chr(i)): i for i in range(256)}
        pieces = [whole.id_to_token(i) for i in range(whole.get_vocab_size())]
        # a special token stands for its own characters; it is never met, as specials are off
        self.a_bytes = [bytes(byte_of[c] for c in p) if all(c in byte_of for c in p) else p.encode() for p in pieces]
        self.a_encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        # where the file's ids ascend as its merges do, they are ranks, and a reader of ranks gives the same ids faster
        with open(a_path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if [whole.token_to_id(m) for m in made] == list(range(256, 256 + len(made))):
            ranks = {x: i for i, x in enumerate(self.a_bytes[: 256 + len(made)])}
            self.a_encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.b = SentencePieceProcessor(model_file=b_path)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        by_bytes = {x: i for i, x in enumerate(self.b_bytes) if self.b.is_byte(i)}
        by_bytes |= {x: i for i, x in enumerate(self.b_bytes) if not self.b.is_byte(i)}
        #: for each id of A, the id of B with the same bytes, or -1
        self.same = np.array([by_bytes.get(x, -1) for x in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        self.same_text = np.array([f"{i}|{j}" for i, j in enumerate(self.same.tolist())], object)
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.texts: list[str] = []
        #: tokens of A, of B, and groups of each word; -1 where a tokenizer's bytes are others
        self.counts = np.zeros((0, 3), np.int64)
        #: ids of identical links, and pairs of the others, with each word's bounds
        self.flat = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        self.bounds = [np.zeros(1, np.int64), np.zeros(1, np.int64)]

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()

    def learn(self, words: list[str]) -> None:
        """Number ``words``, each with a space in front when encoded, and put their groups to the arrays."""
        raw = [(" " + w).encode() for w in words]
        a, b = [self.a_encode(" " + w) for w in words], self.b.encode(words, num_threads=1)
        good = np.ones(len(words), bool)
        if b"".join([self.b_bytes[i] for ids in b for i in ids]) != b"".join(raw):
            good = np.array([b"".join([self.b_bytes[i] for i in ids]) == r for ids, r in zip(b, raw)])
            a, b = ([ids if ok else [] for ids, ok in zip(side, good)] for side in (a, b))
        n_a, n_b = (np.array([len(ids) for ids in side], np.int64) for side in (a, b))
        ids_a, ids_b = (np.array([i for ids in side for i in ids], np.int64) for side in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        common = np.intersect1d(ends_a, ends_b, assume_unique=True)
        upto_a, upto_b = np.searchsorted(ends_a, common) + 1, np.searchsorted(ends_b, common) + 1
        last_a, last_b = ids_a[upto_a - 1], ids_b[upto_b - 1]
        single = (np.diff(np.r_[0, upto_a]) == 1) & (np.diff(np.r_[0, upto_b]) == 1)
        same = single & (self.same[last_a] == last_b)
        text = self.same_text[np.where(same, last_a, 0)].tolist()
        list_a, list_b, odd = ids_a.tolist(), ids_b.tolist(), np.flatnonzero(~same)
        for k, a0, a1, b0, b1 in zip(odd.tolist(), np.r_[0, upto_a][odd].tolist(), upto_a[odd].tolist(), np.r_[0, upto_b][odd].tolist(), upto_b[odd].tolist()):
            text[k] = f"{','.join(map(str, list_a[a0:a1]))}|{','.join(map(str, list_b[b0:b1]))}"
        upto = np.searchsorted(upto_a, np.cumsum(n_a), "right")  # groups of each word end with its last token
        begin = np.r_[0, upto][:-1]
        self.texts += [";".join(text[s:e]) for s, e in zip(begin.tolist(), upto.tolist())]
        self.number.update(zip(words, range(len(self.number), len(self.number) + len(words))))
        self.counts = np.concatenate([self.counts, np.where(good[:, None], np.stack([n_a, n_b, upto - begin], 1), -1)])
        for k, (take, values) in enumerate(((same, last_a), (~same, last_a << 32 | last_b))):
            self.bounds[k] = np.r_[self.bounds[k], self.bounds[k][-1] + np.r_[0, np.cumsum(take)][upto]]
            self.flat[k] = np.r_[self.flat[k], values[take]]

    def texts_of(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], list[tuple[np.ndarray, np.ndarray]]]:
        """Counts (tokens of A, of B, groups) and the groups' text of each of ``texts``, and (text, value) of its identical ids and irregular pairs."""
        if len(self.number) > self.most:
            self.forget()
        cut = [CUT.split(t) if t else [] for t in texts]
        numbers = [list(map(self.number.get, words)) for words in cut]
        new = {w for words, ks in zip(cut, numbers) if None in ks for w, k in zip(words, ks) if k is None}
        if new:
            self.learn(list(new))
            numbers = [[self.number[w] if k is None else k for w, k in zip(words, ks)] if None in ks else ks for words, ks in zip(cut, numbers)]
        flat = np.array([k for ks in numbers for k in ks], np.int64)
        row = np.repeat(np.arange(len(texts)), [len(ks) for ks in numbers])
        counts = np.zeros((len(texts), 3), np.int64)
        np.add.at(counts, row, self.counts[flat])
        bad = np.unique(row[self.counts[flat, 0] < 0])
        counts[bad] = 0
        ok = ~np.isin(row, bad)
        flat, row = flat[ok], row[ok]
        held = self.texts
        joined = [";".join([held[k] for k in ks]) for ks in numbers]
        found = []
        for values, bounds in zip(self.flat, self.bounds):
            n = bounds[flat + 1] - bounds[flat]
            inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            found.append((np.repeat(row, n), values[np.repeat(bounds[flat], n) + inside]))
        for i in bad.tolist():
            joined[i] = ""
        return counts, joined, found


_open: dict[tuple[str, str], Aligned] = {}


def aligned(a_path: str, b_path: str) -> Aligned:
    """One cache for each pair of vocabularies in a Python worker."""
    if (a_path, b_path) not in _open:
        _open[a_path, b_path] = Aligned(a_path, b_path)
    return _open[a_path, b_path]


def counted(rows: int, row: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct values of each row and how often they stand there, as lists."""
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    first = np.flatnonzero(np.r_[True, (values[1:] != values[:-1]) | (row[1:] != row[:-1])][: len(values)])
    n = np.diff(np.r_[first, len(values)])
    offsets = pa.array(np.searchsorted(row[first], np.arange(rows + 1)).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values[first])), pa.ListArray.from_arrays(offsets, pa.array(n))


def cut_together(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A row for each document with its groups and links (DOCS), and, ``whole``, one for each task with its vector of identical links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = aligned(a_path, b_path)
        vector = np.zeros(len(cache.same), np.int64)
        names = [f.split()[0] for f in DOCS.split(", ")]
        for batch in batches:
            counts, texts, ((row, same), (pair_row, pairs)) = cache.texts_of(batch.column(1).to_pylist())
            vector += np.bincount(same, minlength=len(vector))
            ids, id_ns = counted(len(texts), row, same)
            pair_ids, pair_ns = counted(len(texts), pair_row, pairs)
            digests = pa.array([hashlib.sha256(t.encode()).hexdigest() if t else "" for t in texts], pa.string())
            numbers = [pa.array(counts[:, k]) for k in (0, 1, 2, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *numbers, digests, ids.cast(pa.list_(pa.int32())), id_ns, pair_ids, pair_ns, pa.array(np.zeros(len(texts), bool))], names
            )
        met = np.flatnonzero(vector)
        none = pa.array([None], pa.int64())
        row = [none, none, none, none, none, pa.array([None], pa.string()), pa.array([met], pa.list_(pa.int32())), pa.array([vector[met]], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*row, pa.array([[]], pa.list_(pa.int64())), pa.array([[]], pa.list_(pa.int64())), pa.array([True])], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(run, DOCS)


def exploded(rows: DataFrame, values: str, ns: str, *others: str) -> DataFrame:
    """(others, value, n) of two lists side by side."""
    return rows.select(*others, F.explode(F.arrays_zip(F.col(values).alias("value"), F.col(ns).alias("n"))).alias("both")).select(*others, "both.value", "both.n")


def alignments(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, hot: int = HOT) -> DataFrame:
    """Groups and links of all ``docs`` (doc_id, text, ...) and how common the links are in the corpus.

    Returns doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and
    groups_sha256 for every row.  Null and empty texts, and texts whose bytes a
    tokenizer does not keep, have no tokens: zeros and ''.  A null doc_id is
    kept; repeated rows stay and count as often as they stand there; other
    columns are not read.  An empty table gives no rows.

    To the driver come vectors of vocabulary length, and fewer than ``hot`` pairs.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = paths()
    a_path, b_path = a_path or own[0], b_path or own[1]
    made = written(cut_together(docs, a_path, b_path).withColumn("at", F.monotonically_increasing_id()), "alignment")
    whole, texts = made.filter("whole"), made.filter("not whole")

    cache = aligned(a_path, b_path)
    same, n_b = cache.same, len(cache.b_bytes)
    identical = np.zeros(len(same), np.int64)
    for r in exploded(whole, "ids", "id_ns").groupBy("value").agg(F.sum("n").alias("n")).collect():  # at most a row for each id of A
        identical[r["value"]] = r["n"]
    pairs = written(exploded(texts, "pairs", "pair_ns").groupBy("value").agg(F.sum("n").alias("count")), "pairs")
    best = np.zeros(n_b, np.int64)
    np.maximum.at(best, same[same >= 0], identical[same >= 0])
    of_b = F.col("value").bitwiseAND((1 << 32) - 1)
    for r in pairs.groupBy(of_b.alias("b")).agg(F.max("count").alias("most")).collect():  # at most a row for each id of B
        best[r["b"]] = max(best[r["b"]], r["most"])
    links = pairs.agg(F.sum("count")).first()[0] or 0
    common = F.col("count") * hot > links
    top = sorted(tuple(r) for r in pairs.filter(common).collect())  # fewer than `hot` rows
    top_ids, top_n = np.array([p for p, _ in top], np.int64), np.array([n for _, n in top], np.int64)

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((2, batch.num_rows), np.int64)

            def add(lists: pa.ListArray, ns: pa.ListArray, count, b) -> np.ndarray:
                """Adds each known value's links; tells which values are known."""
                row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
                values, n = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (lists, ns))
                c, known = count(values)
                np.add.at(out[0], row[known], (n * (c == best[b(values)]))[known])
                np.add.at(out[1], row[known], (n * c)[known])
                return known

            def of_pairs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                if not len(top_ids):
                    return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
                at = np.minimum(np.searchsorted(top_ids, values), len(top_ids) - 1)
                return top_n[at], top_ids[at] == values

            c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            add(c["ids"], c["id_ns"], lambda v: (identical[v], np.ones(len(v), bool)), lambda v: same[v])
            known = add(c["pairs"], c["pair_ns"], of_pairs, lambda v: v & 0xFFFFFFFF)
            left, of = ~known, np.r_[0, np.cumsum(~known)]
            lengths = c["pairs"].value_lengths().to_numpy(zero_copy_only=False)
            offsets = pa.array(of[np.r_[0, np.cumsum(lengths)].astype(np.int64)].astype(np.int32))
            rest = [pa.ListArray.from_arrays(offsets, pa.array(x.flatten().to_numpy(zero_copy_only=False)[left])) for x in (c["pairs"], c["pair_ns"])]
            head = ["at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
            yield pa.RecordBatch.from_arrays([c[n] for n in head] + [pa.array(out[0]), pa.array(out[1]), *rest], [*head, "n_best", "count_sum", "pairs", "pair_ns"])

    head = "at long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    known = texts.select("at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "ids", "id_ns", "pairs", "pair_ns").mapInArrow(
        looked_up, f"{head}, {SUMS}, pairs array<long>, pair_ns array<long>"
    )
    known = written(known, "known")
    # the pairs that are left: each has at most one in `hot` of the links
    peak = spark.createDataFrame([(b, int(n)) for b, n in enumerate(best) if n], "b long, most long")
    rare = pairs.filter(~common).withColumn("b", of_b).join(F.broadcast(peak), "b").select("value", "count", (F.col("count") == F.col("most")).cast("long").alias("is_best"))
    rest = (
        exploded(known, "pairs", "pair_ns", "at").join(rare, "value").groupBy(F.col("at").alias("r_at"))
        .agg(F.sum(F.col("n") * F.col("is_best")).alias("r_best"), F.sum(F.col("n") * F.col("count")).alias("r_sum"))
    )
    both = known.join(rest, F.col("at") == F.col("r_at"), "left")
    zero = F.lit(0).cast("long")
    return both.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("r_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("r_sum", zero)).alias("count_sum"), "groups_sha256",
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of all ``documents``."""
    return alignments(table(spark, sf_dir, "documents"))
