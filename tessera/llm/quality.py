"""Quality scores from weak labels.

Overlapping heuristics vote good, bad or nothing on each document.  How often
each is right is estimated without labels, by expectation-maximisation over the
counts of vote patterns; the posterior of each document's pattern then trains a
linear scorer over hashed features of the text's form.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written

BUCKETS = 1 << 14
#: Documents that the scorer is trained on, at most; chosen by a hash.
MOST_TRAINING_ROWS = 20_000
ROUNDS = 500  # of expectation-maximisation, at most
#: Votes (bad, none, good) that each heuristic is imagined to have cast on good text and on junk.
IMAGINED = np.array([[0.1, 1.0, 1.0], [1.0, 1.0, 0.1]])

SIGNS = rb"#$%&*|{}<>=~^@_\\`"
CAPITALS = bytes(range(65, 91))
SHAPE = bytes(ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 or c >= 128 else ord("9") if 48 <= c <= 57 else c for c in range(256))
RUNS = re.compile(rb"(.)\1+", re.S)
PLAIN = re.compile(r"""["'(]?[^\W_]+(?:['-][^\W_]+)*[.,;:?!)"']?\Z""")


def measures(text: str) -> dict[str, float]:
    """What the heuristics look at, from the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = text.lower().split()
    n = max(1, len(words))
    letters = max(1, len(raw) - len(raw.translate(None, bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))))
    lines = [x for x in text.split("\n") if x.strip()]
    triples = list(zip(words, words[1:], words[2:]))
    return {
        "words": len(words),
        "signs": (len(raw) - len(raw.translate(None, SIGNS))) / max(1, len(raw)),
        "capitals": (len(raw) - len(raw.translate(None, CAPITALS))) / letters,
        "echo": sum(map(str.__eq__, words, words[1:])) / n,
        "phrases_again": 1 - len(set(triples)) / len(triples) if triples else 0.0,
        "bars": raw.count(b"|") / n,
        "different": len(set(words)) / n,
        "stops": (raw.count(b".") + raw.count(b",") + raw.count(b";")) / n,
        "plain": sum(map(bool, map(PLAIN.match, words))) / n,
        "lines_again": 1 - len(set(lines)) / max(1, len(lines)),
    }


#: measure -> (bad below, good from, good to, bad above); between, the heuristic says nothing.
#: Most only recognise one kind of junk; they never vouch for a text (good from 9).
HEURISTICS: dict[str, tuple[float, float, float, float]] = {
    "signs": (-1, 9, 9, 0.05),
    "capitals": (-1, 9, 9, 0.40),
    "echo": (-1, 9, 9, 0.10),
    "phrases_again": (-1, 9, 9, 0.45),
    "bars": (-1, 9, 9, 0.20),
    "different": (0.25, 0.45, 1, 2),
    "stops": (0.03, 0.06, 0.40, 1.0),
    "plain": (0.60, 0.92, 1, 2),
    "lines_again": (-1, 9, 9, 0.60),
}


def votes(m: dict[str, float]) -> str:
    """One sign for each heuristic: + good, - bad, 0 nothing."""
    if not m["words"]:
        return "0" * len(HEURISTICS)
    out = ""
    for name, (low, lo, hi, high) in HEURISTICS.items():
        x = m[name]
        out += "-" if x < low or x > high else "+" if lo <= x <= hi else "0"
    return out


def hashed_features(text: str, m: dict[str, float]) -> list[int]:
    """Buckets of the text's word shapes, by how much of the text they make, and of its measures by steps."""
    shapes: Counter[bytes] = Counter()
    for word, n in Counter(text.encode("utf-8", "surrogatepass").translate(SHAPE).split()).items():
        shapes[RUNS.sub(rb"\1", word)] += n
    total = max(1, sum(shapes.values()))
    names = [b"%s@%d" % (s, int(np.log2(total / n))) for s, n in shapes.most_common()]
    names += [f"{k}={int(20 * v) if v < 1 else 20 + int(np.log2(v) * 2)}".encode() for k, v in m.items() if k != "words"]
    return sorted({zlib.crc32(x) % BUCKETS for x in names})


def signals(docs: DataFrame) -> DataFrame:
    """(doc_id, pattern, features) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            patterns, features = [], []
            for text in batch.column(1).to_pylist():
                m = measures(text)
                patterns.append(votes(m))
                features.append(hashed_features(text, m))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(patterns, pa.string()), pa.array(features, pa.list_(pa.int32()))], ["doc_id", "pattern", "features"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), plain_text().alias("text")).mapInArrow(run, "doc_id long, pattern string, features array<int>")


def posteriors(counts: dict[str, int]) -> tuple[dict[str, float], np.ndarray]:
    """P(good | pattern) for each pattern, and P(vote | class) for each heuristic, by expectation-maximisation.

    The classes are good text and junk; within a class votes are taken as
    independent.  The start is each pattern's share of good votes, and from
    there the counts decide: a heuristic that cries wolf among documents that
    the others agree on ends with the same vote shares in both classes, and its
    vote no longer counts.  Two imagined votes for each class hold that good
    text is seldom called bad and junk seldom called good.
    """
    patterns = sorted(counts)
    n = np.array([counts[p] for p in patterns], float)
    seen = np.array([["-0+".index(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    one_hot = np.eye(3)[seen]  # pattern, heuristic, vote
    bad, good = one_hot[:, :, 0].sum(1), one_hot[:, :, 2].sum(1)
    p = (1 + good) / (2 + good + bad)
    for _ in range(ROUNDS):
        belongs = np.stack([p, 1 - p], 1)  # pattern, class
        share = (n @ belongs + 1) / (n.sum() + 2)
        mass = np.einsum("p,pk,phv->khv", n, belongs, one_hot) + IMAGINED[:, None]
        accuracy = mass / mass.sum(2, keepdims=True)
        logs = np.log(share) + np.einsum("phv,khv->pk", one_hot, np.log(accuracy))
        before, p = p, 1 / (1 + np.exp(np.clip(logs[:, 1] - logs[:, 0], -700, 700)))
        if np.abs(p - before).max(initial=0) < 1e-9:
            break
    return dict(zip(patterns, p.tolist())), accuracy


def trained(rows: list[tuple[list[int], float]], epochs: int = 12) -> tuple[np.ndarray, float]:
    """Logistic weights over the buckets from soft labels, by adaptive gradient steps in blocks."""
    w, b = np.zeros(BUCKETS), 0.0
    if not rows:
        return w, b
    gw, gb = np.full(BUCKETS, 1e-6), 1e-6
    at = np.cumsum([0, *(len(f) for f, _ in rows)])
    flat = np.concatenate([np.asarray(f, np.int64) for f, _ in rows]) if at[-1] else np.zeros(0, np.int64)
    y = np.array([p for _, p in rows])
    owner = np.repeat(np.arange(len(rows)), np.diff(at))
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for block in np.array_split(order.permutation(len(rows)), max(1, len(rows) // 256)):
            chosen = np.zeros(len(rows), bool)
            chosen[block] = True
            part = chosen[owner]
            z = np.bincount(owner[part], w[flat[part]], len(rows))[block] + b
            err = np.zeros(len(rows))
            err[block] = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[block]) / len(block)
            grad = np.bincount(flat[part], err[owner[part]], BUCKETS) + 1e-5 * w
            gw += grad * grad
            gb += err.sum() ** 2
            w -= 0.3 * grad / np.sqrt(gw)
            b -= 0.3 * err.sum() / np.sqrt(gb)
    return w, b


def quality_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, votes, posterior, score, keep) for every row of ``docs`` (doc_id, text, ...).

    posterior is the label model's, score the trained scorer's (0 to 1, higher:
    better), keep whether the score reaches 0.5.  Null text counts as empty, on
    which no heuristic votes; repeated rows get the same; other columns are not
    read; no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    made = written(signals(docs), "quality-signals")
    counts = {r["pattern"]: r["count"] for r in made.groupBy("pattern").count().collect()}  # 3 ** len(HEURISTICS) rows at most
    good, _ = posteriors(counts) if counts else ({}, None)
    total = sum(counts.values())
    sample = made.select("pattern", "features")
    if total > MOST_TRAINING_ROWS:
        share = 1.05 * MOST_TRAINING_ROWS / total
        drawn = F.pmod(F.xxhash64("doc_id", "features"), F.lit(1 << 24))
        # the hash decides alone, so that a rerun trains on the same rows
        sample = made.withColumn("drawn", drawn).filter(F.col("drawn") < int(share * (1 << 24))).orderBy("drawn", "doc_id", "features").limit(MOST_TRAINING_ROWS).select("pattern", "features")
    w, b = trained([(r["features"], good[r["pattern"]]) for r in sample.collect()])  # MOST_TRAINING_ROWS at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, patterns, features = batch.columns
            lengths = np.array([len(f) for f in features.to_pylist()], np.int64) if batch.num_rows else np.zeros(0, np.int64)
            flat = np.asarray(features.flatten(), np.int64)
            z = np.bincount(np.repeat(np.arange(batch.num_rows), lengths), w[flat], batch.num_rows) + b
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p = [good[x] for x in patterns.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, patterns, pa.array(p, pa.float64()), pa.array(s, pa.float64()), pa.array(s >= 0.5)], ["doc_id", "votes", "posterior", "score", "keep"])

    return made.mapInArrow(score, "doc_id long, votes string, posterior double, score double, keep boolean")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all ``documents``; the given labels are not used."""
    return quality_scores(table(spark, sf_dir, "documents"))
