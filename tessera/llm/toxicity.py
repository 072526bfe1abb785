"""Toxicity scores of restored text.

Disguised words (digits and signs for letters, letters and pieces set apart,
letters repeated) are decoded as a noisy channel: each written character opens
edges of a lattice (itself, a letter it stands for, nothing, the end of a word),
and Viterbi's algorithm picks the most likely path under a character trigram
model counted over the whole corpus.  Words and word beginnings of the restored
text are weighed by how strongly the labelled rows tie them to the toxic label;
a logistic curve turns a text's weights into a score.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import bounded_batches, plain_text, table, written

# Characters of the model: 0 is whatever is not a letter, then a-z, the Latin-1 letters, any other letter.
LATIN = [chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha()]
SYMBOLS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz" + "".join(LATIN), 1)}
OTHER_LETTER = len(SYMBOLS) + 1
SIZE = OTHER_LETTER + 1

# What a sign may stand for.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "(": "c",
}
SEPARATORS = " .-_*/,;:" + "\u00ad\u200b\u200c\u200d\u2060\ufeff"  # the last ones take no room on a page
PUNCTUATION = "!|+("

# The channel: log probabilities of what may have been written for what was meant.
SAME, STANDS_FOR, AGAIN = math.log(0.9), math.log(0.5), math.log(0.37)  # a letter as it is, a sign for a letter, a character once more
ITSELF, ALONE, AT_END, POINT = -9.0, -6.0, -4.0, -0.5  # a sign that is none: within a word, set apart, at the end, at an end as punctuation
# A separator (dropped, meant as the end of a word): between single characters; white space and signs that set words apart; other separators.
SET_APART, SPACE, JOINT = (math.log(0.9), math.log(0.3)), (-3.0, -0.05), (-1.2, -0.4)

BREAKS = re.compile(f"[{re.escape(SEPARATORS)}]")
EDGES = "".join(sorted(set(string.punctuation) - set(READINGS))) + "…“”„«»¿¡–—"  # around words; no part of a disguise there

AROUND = EDGES + PUNCTUATION
BREAKLESS = set(SEPARATORS).isdisjoint

WORD = re.compile(r"[^\W\d_]+")
PIECES = re.compile(rf"(?:[^\W\d_]|[{re.escape(''.join(READINGS) + SEPARATORS)}])+")
TWICE = re.compile(r"(.)\1")
THRICE = re.compile(r"(.)\1\1")
RUN = re.compile(r"(.)\1+")
PREFIXES = range(3, 9)  # lengths of the word beginnings that are features
NOTHING: dict[str, float] = {}

# Characters that may be read alike count as one when disguises of known words are looked up.
ALIKE = str.maketrans({"l": "i"} | {c: "i" if r[0] == "l" else r[0] for c, r in READINGS.items()} | dict.fromkeys(SEPARATORS))
ALIKE_BYTES = bytes(ord(ALIKE.get(c) or chr(c)) for c in range(128)) + bytes(range(128, 256))

#: Labelled rows that the weights are learned from, at most; chosen by a hash of their id.
MOST_TRAINING_ROWS = 50_000
#: Training rows with a feature and the toxic label, at least, before it is tried as a weight.
LEAST_ROWS = 3
#: A text's weights are summed up to this; the curve is flat long before.
MOST_EVIDENCE = 30.0


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of character trigrams over all texts: SIZE ** 3 cells, summed by Spark."""
    lut = np.zeros(0x20000, np.int64)
    lut[[i for i in range(0x20000) if chr(i).isalpha()]] = OTHER_LETTER
    for c, i in SYMBOLS.items():
        lut[ord(c)] = i

    lut[0] = -(SIZE**3) * 2  # stands between texts: no cell holds it

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)

        def add(joined: str) -> None:
            nonlocal total
            s = lut[np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), 0x1FFFF)]
            cell = (s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:]
            total += np.bincount(cell[cell >= 0], minlength=SIZE**3)

        for batch in batches:
            waiting, size = [], 0
            for text in batch.column(0).to_pylist():
                for at in range(0, len(text), 1 << 20):  # a slice overlaps the next by the two characters of a trigram
                    part = "  " * (at == 0) + text[max(0, at - 2) : at + (1 << 20)].lower().replace("\x00", " ") + " "
                    waiting.append(part)
                    size += len(part)
                    if size > 1 << 20:
                        add("\x00".join(waiting))
                        waiting, size = [], 0
            add("\x00".join(waiting) + "\x00\x00")
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    # as many rows for each task as it saw kinds of trigram, at most SIZE ** 3
    sums = docs.select(plain_text().alias("text")).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    total = np.zeros(SIZE**3, np.int64)
    for r in sums.toLocalIterator():
        total[r["cell"]] = r["n"]
    return total.reshape(SIZE, SIZE, SIZE)


def log_model(counts: np.ndarray) -> np.ndarray:
    """log P(third | first two), trigrams interpolated with bigrams and single characters."""
    c3 = counts.astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    p1 = (c1 + 1) / (c1.sum() + SIZE)
    p2 = (c2 + 5 * p1) / (c2.sum(1, keepdims=True) + 5)
    p3 = (c3 + 5 * p2[None]) / (c3.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def lattice(written: str) -> list[list[tuple[str, float]]]:
    """For each character as written, lower case, what may have been meant, with the channel's log probability.

    A letter, " " for the end of a word, "" for nothing; a sign may stand for itself.
    """
    end = len(written.rstrip("".join(READINGS) + SEPARATORS))
    begin = len(written) - len(written.lstrip(PUNCTUATION + SEPARATORS))
    edges, last = [], ""
    for i, c in enumerate(written):
        if c in SEPARATORS:
            single = all(len(BREAKS.split(side)[k]) == 1 for side, k in ((written[max(0, i - 2) : i], -1), (written[i + 1 : i + 3], 0)))
            dropped, meant = SET_APART if single else SPACE if c in " /,;:" else JOINT
            edges.append([(" ", meant), ("", dropped)])
            continue
        if c.isalpha():
            steps = [(c, SAME)]
        else:
            alone = (i == 0 or written[i - 1] in SEPARATORS) and (i + 1 == len(written) or written[i + 1] in SEPARATORS)
            point = c in PUNCTUATION
            itself = (AT_END if point else ALONE) if alone else (POINT if point else AT_END) if i >= end or (point and i < begin) else ITSELF
            steps = [(c, itself), *((x, STANDS_FOR) for x in READINGS.get(c, ""))]
        if c == last:
            steps.append(("", AGAIN))
        last = c
        edges.append(steps)
    return edges


def symbol(c: str) -> int:
    return SYMBOLS.get(c, OTHER_LETTER if c.isalpha() else 0)


def decoded(written: str, model: np.ndarray) -> str:
    """The most likely path through the lattice of ``written``: channel and character model together.

    Of several breaks in a row the model counts one.
    """
    Node = tuple  # (node before, character): paths share what they have in common
    paths: dict[tuple[int, int], tuple[float, Node | None]] = {(0, 0): (0.0, None)}  # last two symbols -> score, node
    for steps in lattice(written):
        onward: dict[tuple[int, int], tuple[float, Node | None]] = {}
        for (a, b), (score, node) in paths.items():
            for c, cost in steps:
                if c:
                    s = symbol(c)
                    state, now, then = ((b, s), score + cost + float(model[a, b, s]), (node, c)) if b or s else ((a, b), score + cost, (node, c))
                else:
                    state, now, then = (a, b), score + cost, node
                if state not in onward or now > onward[state][0]:
                    onward[state] = (now, then)
        paths = onward
    node = max(((score + (float(model[a, b, 0]) if b else 0.0), n) for (a, b), (score, n) in paths.items()), key=lambda x: x[0])[1]
    letters = []
    while node:
        node, c = node
        letters.append(c)
    return "".join(reversed(letters))


def may_mean(written: str, word: str) -> bool:
    """Whether some path through the lattice reads ``word`` without a break."""
    at = {0}
    for steps in lattice(written):
        at = {k + len(c) for k in at for c, _ in steps if not c or word.startswith(c, k)}
    return len(word) in at


def folded(written: str) -> str:
    """The text with characters that may be read alike made one, separators dropped and repetitions written once."""
    written = written.encode().translate(ALIKE_BYTES, SEPARATORS.encode()).decode() if written.isascii() else written.translate(ALIKE)
    return RUN.sub(r"\1", written) if TWICE.search(written) else written


class Restorer(dict):
    """Puts the readings of disguised words into a text: token -> token restored, kept from when it is first met.

    Always decoded: tokens with signs, separators or a letter three times among
    letters, and runs of single characters.  Letters written twice, and words
    in pieces, are too common for that: they are decoded where they may stand
    for one of ``lexicon``.
    """

    def __init__(self, model: np.ndarray, lexicon: Iterable[str] = (), most: int = 150_000):
        super().__init__()
        self.model, self.most = model, most
        self.lexicon: dict[str, list[str]] = {}  # folded -> words
        for w in sorted(lexicon):
            self.lexicon.setdefault(folded(w), []).append(w)
        self.starts: dict[str, str] = {}  # what a known word begins with, folded -> characters, as written, that may follow
        alike: dict[str, str] = {}
        for c in [*map(chr, range(97, 123)), *READINGS]:
            alike[folded(c)] = alike.get(folded(c), "") + c
        for f in self.lexicon:
            for k in range(1, len(f)):
                same, after = alike.get(f[k - 1], f[k - 1]), alike.get(f[k], f[k])
                self.starts[f[:k]] = self.starts.get(f[:k], SEPARATORS) + same + after
        # the first characters, three at most, as written and without separators, of what may fold to a start
        letters = {*"".join(self.lexicon), *map(chr, range(97, 123)), *READINGS}
        self.openings, longer = set(), {""}
        for _ in range(3):
            longer = {x + c for x in longer for c in letters if folded(x + c) in self.starts} if self.starts else set()
            self.openings |= longer
        self.folded: dict[str, str] = {}  # of tokens met after those
        self.folds: dict[str, str] = {}  # of the tokens met that may begin a word in pieces

    def __missing__(self, token: str) -> str:
        self[token] = out = self.restored(token)
        return out

    def bound(self) -> None:
        """Forget all tokens once there are many: between texts, so that a text's own are at hand until it is done."""
        if len(self) >= self.most:
            self.clear()
            self.folds.clear()

    def read(self, written: str) -> str:
        """The best path, or the known word that differs from it in breaks and repetitions alone and is a path as well."""
        best = decoded(written, self.model)
        once = RUN.sub(r"\1", best.replace(" ", ""))
        for word in self.lexicon.get(folded(written), ()):
            if RUN.sub(r"\1", word) == once and may_mean(written, word):
                return word
        return best

    def read_run(self, tokens: list[str]) -> str:
        """What several tokens read as one, with the signs around them as they are."""
        whole = " ".join(tokens)
        core = whole.strip(EDGES)
        if folded(core) not in self.lexicon and folded(inner := core.strip(AROUND)) in self.lexicon:
            core = inner
        return whole.replace(core, self.read(core), 1) if core else whole

    def twice(self, word: str) -> bool:
        """Whether a word of letters may be a known one with letters repeated."""
        known = self.lexicon.get(folded(word))
        return known is not None and word not in known

    def restored(self, token: str) -> str:
        """A token (lower case, no white space) with its disguised words restored."""
        opening = token[:3]
        if (opening in self.openings or not BREAKLESS(opening)) and (fold := folded(token)) in self.starts:
            self.folds[token] = fold
        elif token[0] in AROUND and (fold := folded(token.lstrip(AROUND))) in self.starts:
            self.folds[token] = fold
        if not token.isalpha():
            core = token.strip(EDGES)
            if not core.isalpha():
                return PIECES.sub(self.piece, token)
            return token.replace(core, self.restored(core), 1)
        if TWICE.search(token) and (THRICE.search(token) or self.twice(token)):
            return self.read(token)
        return token

    def piece(self, found: re.Match) -> str:
        """A run of letters, signs and separators within a token."""
        whole = found[0]
        core = whole.strip(SEPARATORS)
        if core.isalpha():
            return self.read(core) if TWICE.search(core) and (THRICE.search(core) or self.twice(core)) else whole
        return whole.replace(core, self.read(core), 1) if any(map(str.isalpha, core)) else whole

    def spans(self, tokens: list[str], kinds: set[str]) -> list[tuple[int, int]]:
        """Runs of tokens that are read as one: three or more single characters, or pieces that may make a known word."""
        found = []
        single = bytes([len(t) == 1 for t in tokens])
        if b"\1\1" in single:
            for m in re.finditer(rb"\x01{2,}", single):
                lo, hi = m.span()
                if lo > (found[-1][1] if found else 0) and len(tokens[lo - 1].lstrip(AROUND)) == 1:  # the first one behind a quote, the last one before a sign
                    lo -= 1
                if hi < len(tokens) and len(tokens[hi].rstrip(AROUND)) == 1:
                    hi += 1
                if hi - lo > 2 and any(map(str.isalpha, tokens[m.start() : m.end()])):
                    found.append((lo, hi))
        folds, starts = self.folds, self.starts
        first = [i for i, t in enumerate(tokens) if t in folds] if folds else []
        if not first:
            return found
        taken = {i for lo, hi in found for i in range(lo, hi)}
        after, n = 0, len(tokens)
        for i in first:
            fold, k = folds[tokens[i]], i + 1
            if k == n or tokens[k][0] not in starts[fold] or i < after or i in taken:
                continue
            while k < n and fold in starts and tokens[k][0] in starts[fold] and k not in taken:
                more = self.folded.get(tokens[k])
                if more is None:
                    if len(self.folded) >= self.most:
                        self.folded.clear()
                    more = self.folded[tokens[k]] = folded(tokens[k].rstrip(EDGES))
                if tokens[k][-1] in PUNCTUATION:  # at the end of a known word it is a sign, else it may be a letter
                    bare = folded(tokens[k].rstrip(AROUND))
                    if fold + (bare[1:] if fold.endswith(bare[:1]) else bare) in self.lexicon:
                        more = bare
                if fold.endswith(more[:1]):
                    more = more[1:]
                if not more:
                    break
                fold, k = fold + more, k + 1
                if fold in self.lexicon:
                    found.append((i, k))
                    after = k
                    break
        return sorted(found)

    def read_spans(self, tokens: list[str], spans: list[tuple[int, int]]) -> tuple[list[str], list[str]]:
        """The tokens outside of ``spans``, as they are, and what the spans read."""
        outside, at = [], 0
        for lo, hi in spans:
            outside += tokens[at:lo]
            at = hi
        return outside + tokens[at:], [self.read_run(tokens[lo:hi]) for lo, hi in spans]

    def words(self, text: str) -> set[str]:
        """The distinct words of the restored text."""
        self.bound()
        tokens = text.lower().split()
        kinds = set(tokens)
        units = set(map(self.__getitem__, kinds))
        if spans := self.spans(tokens, kinds):
            outside, read = self.read_spans(tokens, spans)
            units = {*map(self.__getitem__, set(outside)), *read}
        out = set(filter(str.isalpha, units))
        for u in units - out:
            out.update(WORD.findall(u))
        return out

    def __call__(self, text: str) -> str:
        """The whole text, restored; white space becomes one space."""
        self.bound()
        tokens = text.lower().split()
        restored = list(map(self.__getitem__, tokens))
        for lo, hi in reversed(self.spans(tokens, set(tokens))):
            restored[lo:hi] = [self.read_run(tokens[lo:hi])]
        return " ".join(restored)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, MOST_TRAINING_ROWS at most.

    Several labels of one document count as toxic if any is; null labels are none.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").alias("l_id"), "toxic")
    n = known.count()
    if n > MOST_TRAINING_ROWS:
        drawn = F.pmod(F.xxhash64("l_id"), F.lit(1 << 20))
        # the hash decides alone, so that a rerun trains on the same rows
        known = known.withColumn("l_drawn", drawn).filter(F.col("l_drawn") < int(1.05 * MOST_TRAINING_ROWS / n * (1 << 20)) + 1)
        known = known.orderBy("l_drawn", "l_id").limit(MOST_TRAINING_ROWS).drop("l_drawn")
    # at most MOST_TRAINING_ROWS rows of 16 bytes
    texts = docs.select(F.col("doc_id").alias("l_id"), plain_text().alias("text"))
    return texts.join(F.broadcast(known), "l_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def learned_weights(train: DataFrame, model: np.ndarray) -> dict[str, float]:
    """feature -> log odds, for features whose tie to the toxic label chance would hardly make."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restore = Restorer(model)
        kinds = (0, *PREFIXES)  # 0: the word as a whole
        seen = {k: (Counter(), Counter()) for k in kinds}  # texts of each label that hold a feature
        texts = [0, 0]

        def rows() -> pa.RecordBatch:
            features, counts = [""], [[texts[0]], [texts[1]]]
            for k in kinds:
                names = list({**seen[k][0], **seen[k][1]})
                features += ["=" + w for w in names] if k == 0 else names
                for label in (0, 1):
                    counts[label] += map(seen[k][label].__getitem__, names)
                    seen[k][label].clear()
            texts[:] = [0, 0]
            return pa.RecordBatch.from_arrays([pa.array(features, pa.string()), *(pa.array(c, pa.int64()) for c in counts)], ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                texts[toxic] += 1
                words = restore.words(text)
                seen[0][toxic].update(words)
                for k in PREFIXES:
                    seen[k][toxic].update({w[:k] for w in words if len(w) >= k})
            if sum(len(c) for pair in seen.values() for c in pair) > 200_000:
                yield rows()
        yield rows()

    sums = written(train.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")), "feature-counts")
    whole = sums.filter("feature = ''").first()
    if not whole or not whole["toxic"] or not whole["clean"]:
        return {}
    n0, n1 = whole["clean"], whole["toxic"]
    tried = sums.filter(F.col("toxic") >= LEAST_ROWS).count()
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (n1 + 1.0)) - F.log(b / (n0 + 1.0))
    share = n1 / (n0 + n1)
    k, n = F.col("toxic"), F.col("toxic") + F.col("clean")
    p = k / n
    evidence = 2 * (k * F.log(p / share) + F.when(k < n, (n - k) * F.log((1 - p) / (1 - share))).otherwise(0.0))
    strong = (
        sums.filter((F.col("feature") != "") & (F.col("toxic") >= LEAST_ROWS)).select("feature", odds.alias("odds"), evidence.alias("evidence"))
        .filter((F.col("odds") > 2.0) & (F.col("evidence") > 2 * math.log(max(tried, 2))))
    )
    return {r["feature"]: r["odds"] for r in strong.collect()}  # bounded by the training rows: each stands in LEAST_ROWS of them and more


class Evidence(dict):
    """The summed weights of a restored text's distinct words, each by its strongest feature.

    token -> the words of its restored form that have a weight, kept from when it is first met.
    """

    def __init__(self, model: np.ndarray, weights: dict[str, float], most: int = 150_000):
        super().__init__()
        self.restore, self.weights, self.most = Restorer(model, [f[1:] for f in weights if f[0] == "="]), weights, most
        self.stems = {f[:k] for f in weights if f[0] != "=" for k in PREFIXES if k <= len(f)}

    def __missing__(self, token: str) -> dict[str, float]:
        core, folds = token.strip(EDGES), self.restore.folds
        if core and core != token:
            found = self[core]
            if core in folds and token.endswith(core):  # a word in pieces may begin behind a quote
                folds[token] = folds[core]
        else:
            found = self.of_unit(self.restore.restored(token))
        self[token] = found
        return found

    def of_unit(self, unit: str) -> dict[str, float]:
        """The words with a weight in a restored token or run."""
        found = NOTHING
        for w in (unit,) if unit.isalpha() else WORD.findall(unit):
            weight = self.weights.get("=" + w, 0.0)
            for k in PREFIXES:
                if k > len(w) or w[:k] not in self.stems:
                    break
                weight = max(weight, self.weights.get(w[:k], 0.0))
            if weight:
                found = found | {w: weight}
        return found

    def __call__(self, text: str) -> tuple[float, float]:
        """The sum, and the strongest word's weight."""
        if len(self) >= self.most:  # between texts, with the folds that go with the tokens
            self.clear()
            self.restore.folds.clear()
        tokens = text.lower().split()
        kinds = set(tokens)
        known = list(filter(None, map(self.__getitem__, kinds)))
        if spans := self.restore.spans(tokens, kinds):
            outside, read = self.restore.read_spans(tokens, spans)
            known = [*filter(None, map(self.__getitem__, set(outside))), *map(self.of_unit, read)]
        found: dict[str, float] = {}
        for words in known:
            found |= words
        return (min(MOST_EVIDENCE, math.fsum(found.values())), max(found.values())) if found else (0.0, 0.0)


def logistic_curve(counts: Counter[tuple[float, float, int]]) -> tuple[float, float, float]:
    """Slopes of the sum and the strongest weight, and the offset, that fit (sum, strongest, label) -> how many.

    Newton's method with a slight pull to zero.
    """
    if not counts:
        return 0.0, 0.0, -2.0
    design = np.array([(s, m, 1.0) for s, m, _ in counts])
    y = np.array([k[2] for k in counts], float)
    n = np.array(list(counts.values()), float)
    w = np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        grad = design.T @ (n * (y - p)) - 0.05 * w
        hess = (design * (n * p * (1 - p))[:, None]).T @ design + 0.05 * np.eye(3)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, float], tuple[float, float, float]]:
    """The character model of all texts, and the weights and curve of the training rows."""
    model = log_model(trigram_counts(docs))
    train = written(training_rows(docs, labels), "toxic-training")
    weights = learned_weights(train, model)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        evidence = Evidence(model, weights)
        for batch in batches:
            found = [evidence(t) for t in batch.column(0).to_pylist()]
            columns = [pa.array([round(x[i] * 4) / 4 for x in found], pa.float64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(1)], ["total", "most", "toxic"])

    # the bins are quarters of bounded weights: a few thousand rows at most
    rows = train.mapInArrow(binned, "total double, most double, toxic int").groupBy("total", "most", "toxic").count().collect()
    return model, weights, logistic_curve(Counter({(r["total"], r["most"], r["toxic"]): r["count"] for r in rows}))


def scored(docs: DataFrame, labels: DataFrame, name: str = "toxicity") -> DataFrame:
    """``docs`` with all its columns and a column ``name`` (0 to 1); a column of that name is replaced.

    Null text counts as empty; repeated rows get the same score; a null doc_id
    has no label; other columns are kept whatever their names; an empty table
    gives no rows.  Without any labelled toxic or clean training row every text
    gets the same low score.
    """
    bounded_batches(docs.sparkSession)
    model, weights, (by_total, by_most, offset) = fit(docs, labels)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        evidence = Evidence(model, weights)
        for texts in batches:
            found = np.array([evidence(t) for t in texts]).reshape(-1, 2)
            x = found[:, 0] * by_total + found[:, 1] * by_most + offset
            yield pd.Series(1 / (1 + np.exp(-np.clip(x, -30, 30))))

    return docs.withColumn(name, score(plain_text()))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; labels teach only outside the held-out fold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )
