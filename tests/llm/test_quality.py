import math
import random
from collections import Counter

from tessera.llm.quality import HEURISTICS, IMAGINED, ROUNDS, measures, posteriors, quality_scores, votes
from tests.llm.fixtures import empty, frame, rows, words


def sentences(seed):
    w = words(120, seed).split()
    return " ".join(x.capitalize() if i % 9 == 0 else x + ("." if i % 9 == 8 else "") for i, x in enumerate(w))


def junk(kind, seed):
    w = words(120, seed).split()
    return {0: " ".join(x + "%%%" for x in w), 1: " ".join(x.upper() + "!!" for x in w), 2: " ".join([w[0]] * 120), 3: " | ".join(w)}[kind]


def test_junk_and_prose_are_told_apart(spark):
    docs = [(i, sentences(i)) for i in range(300)] + [(1000 + i, junk(i % 4, i)) for i in range(60)]
    got = {r.doc_id: r for r in quality_scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(got[i].keep and got[i].posterior > 0.9 for i in range(300))
    assert sum(got[1000 + i].keep for i in range(60)) <= 1
    assert all(0 <= r.score <= 1 for r in got.values())


def test_expectation_maximisation_finds_the_kinds():
    good = "0000" + "0" + "+++" + "0"
    counts = {good: 900, "-0000++-0": 40, "0-0000+-0": 30, "00--0-++0": 30}
    p, accuracy = posteriors(counts)
    assert p[good] > 0.99 and all(p[k] < 0.05 for k in counts if k != good)
    assert accuracy.shape == (2, len(HEURISTICS), 3)


def planted(seed, n=4000):
    """Vote patterns of documents of known class: eight fair heuristics, and one (the last) that cries wolf at random."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        good = r.random() < 0.85
        fair = [r.choices("-0+", (1, 50, 0) if good else (30, 70, 0))[0] for _ in range(5)] + [r.choices("-0+", (1, 9, 90) if good else (60, 20, 20))[0] for _ in range(3)]
        out.append(("".join(fair) + r.choices("-0", (40, 60))[0], good))
    return out


def test_a_poor_heuristic_is_found_out():
    rows_ = planted(3)
    p, accuracy = posteriors(Counter(x for x, _ in rows_))
    right = sum((p[x] >= 0.5) == good for x, good in rows_) / len(rows_)
    no_alarm_is_good = sum(("-" not in x) == good for x, good in rows_) / len(rows_)
    assert right > 0.97 and no_alarm_is_good < 0.65
    assert abs(accuracy[0, 8, 0] - accuracy[1, 8, 0]) < 0.06  # its alarms tell nothing
    assert all(accuracy[1, h, 0] > 5 * accuracy[0, h, 0] for h in range(8))


def test_expectation_maximisation_against_a_plain_one():
    counts = Counter(x for x, _ in planted(4, 800))
    votes_ = {"-": 0, "0": 1, "+": 2}
    p = {x: (1 + x.count("+")) / (2 + x.count("+") + x.count("-")) for x in counts}
    for _ in range(ROUNDS):
        shares = []
        for c in (0, 1):
            of = {x: p[x] if c == 0 else 1 - p[x] for x in counts}
            tables = []
            for h in range(len(HEURISTICS)):
                cells = [IMAGINED[c][v] + sum(counts[x] * of[x] for x in counts if votes_[x[h]] == v) for v in range(3)]
                tables.append([v / sum(cells) for v in cells])
            shares.append(((sum(counts[x] * of[x] for x in counts) + 1) / (sum(counts.values()) + 2), tables))
        was, p = p, {}
        for x in counts:
            like = [share * math.prod(t[h][votes_[x[h]]] for h in range(len(HEURISTICS))) for share, t in shares]
            p[x] = like[0] / sum(like)
        if max(abs(p[x] - was[x]) for x in counts) < 1e-9:
            break
    got, _ = posteriors(counts)
    assert all(abs(got[x] - p[x]) < 1e-6 for x in counts)


def test_awkward_rows(spark):
    assert len(quality_scores(frame(spark)).collect()) == len(rows())
    assert quality_scores(empty(spark)).collect() == []
    assert votes(measures("")) == "0" * len(HEURISTICS)
