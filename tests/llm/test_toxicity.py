import math
import random
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tessera.llm.toxicity import OTHER_LETTER, SIZE, SYMBOLS, Evidence, Restorer, decoded, lattice, learned_weights, log_model, may_mean, op5_toxicity, scored, trigram_counts
from tests.llm.fixtures import empty, frame, rows, words

BAD = ["grubnik", "snolfet"]
LABELS = "doc_id long, quality int, toxic int"


def documents():
    docs, labels = [], []
    for i in range(400):
        w = words(60, i).split()
        toxic = i % 4 == 0
        if toxic:
            w[i % 50] = BAD[i % 8 // 4]
            w[(i + 7) % 50] = {0: "gr0bn1k".replace("0", "u"), 1: "sn0lf3t", 2: "g r u b n i k", 3: "snoooolfet"}[i // 4 % 4]
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_trigrams_over_all_texts(spark):
    texts = ["Ab ab!", "", None, "ñÑ", "日本"]
    got = trigram_counts(spark.createDataFrame([(t,) for t in texts], "text string"))
    want = Counter()
    for t in texts:
        s = [0, 0, *(SYMBOLS.get(c, SIZE - 1 if c.isalpha() else 0) for c in (t or "").lower()), 0]
        if t:
            want.update(zip(s, s[1:], s[2:]))
    assert {k: v for k, v in np.ndenumerate(got) if v} == dict(want)


def test_restoring(spark):
    docs, _ = documents()
    model = log_model(trigram_counts(spark.createDataFrame([(f"{a} {b}",) for a, b in zip(BAD * 50, BAD[::-1] * 50)] + [(t,) for _, t in docs], "text string")))
    r = Restorer(model)
    for written, meant in [("gru8nik", "grubnik"), ("5nolfet", "snolfet"), ("g r u b n i k", "grubnik"), ("snoooolfet", "snolfet"), ("sn0lf3t", "snolfet"), ("plain", "plain")]:
        assert r(written) == meant
    assert r("gr" + "u" * 500 + "bn1k") == "grubnik"
    assert r("sn0lf3t" * 30) == "snolfet" * 30


def test_restoring_signs_at_the_end_and_phrases_set_apart(spark):
    docs, _ = documents()
    said = [(f"you {a} are {b} grass",) for a, b in zip(BAD * 200, BAD[::-1] * 200)]
    r = Restorer(log_model(trigram_counts(spark.createDataFrame(said + [(t,) for _, t in docs], "text string"))))
    phrase = "you grubnik are snolfet grass"
    for written, meant in [
        ("gra$$", "grass"), ("gra55", "grass"), ("gra5$!", "grass!"), ("g r u 8 n 1 k", "grubnik"), ("5 n 0 l f 3 t", "snolfet"), ("gr" + "u" * 60 + "bnik", "grubnik"),
        ("y o u g r u b n i k", "you grubnik"), (" ".join(phrase.replace(" ", "")), phrase), ("1 0 1 0", "1 0 1 0"), ("grass!", "grass!"),
    ]:
        assert r(written) == meant


@pytest.fixture(scope="module")
def model(spark):
    docs, _ = documents()
    said = [(f"you {a} are {b} grass",) for a, b in zip(BAD * 200, BAD[::-1] * 200)]
    return log_model(trigram_counts(spark.createDataFrame(said + [(t,) for _, t in docs], "text string")))


@pytest.mark.parametrize(
    "written,meant",
    [
        ("g r u 8 n i k", "grubnik"), ("gr ub nik", "grubnik"), ("g rubnik", "grubnik"), ("grub-nik", "grubnik"), ("g  r  u  b  n  i  k", "grubnik"), ("gruubnik", "grubnik"),
        ("grub\nnik", "grubnik"), ("g.r.u.b.n.i.k", "grubnik"), ("gr_ub n1k", "grubnik"), ("ggrr uubb nniikk", "grubnik"), ("you gru8 nik are", "you grubnik are"), ("g r u b n i k g r a $ $", "grubnik grass"),
        ("(gr-ubnik),", "(grubnik),"), ("g/r/u/b/n/i/k", "grubnik"), ("g,r,u,b,n,i,k", "grubnik"), ("gru bnik", "grubnik"), ('"gru bnik"', '"grubnik"'), ("(gru bnik)", "(grubnik)"), ("gru bnik!", "grubnik!"),
        ("!grubnik", "!grubnik"), ("+grubnik", "+grubnik"), ("(grubnik)", "(grubnik)"), ("gr\u200bub\u200bnik", "grubnik"), ('"g r u b n i k"', '"grubnik"'), ("say: gru bnik, you", "say: grubnik, you"), ("and/or", "and or"), ("12:30", "12:30"), ("you are grass", "you are grass"),
    ],
)
def test_disguises_of_known_words(model, written, meant):
    assert Restorer(model, [*BAD, "grass"])(written) == meant
    if "grubnik" in meant:
        assert Evidence(model, {"=grubnik": 5.0})(written) == (5.0, 5.0)


def test_scores_do_not_depend_on_what_was_read_before(model):
    """Any bound of the caches, any order of texts: the same evidence."""
    r = random.Random(4)
    texts = ["gru bnik", "you are", "gr ubnik snol fet", "gru are you", '"gru bnik" said', "g r u b n i k", "grass sn olfet gru"] + [words(12, k) for k in range(5)]
    weights = {"=grubnik": 5.0, "=snolfet": 4.0}
    fresh = [Evidence(model, weights)(t) for t in texts]
    assert fresh[0] == (5.0, 5.0) and fresh[2] == (9.0, 5.0)
    for most in (1, 2, 3, 150_000):
        evidence = Evidence(model, weights, most)
        order = [r.randrange(len(texts)) for _ in range(80)]
        assert [evidence(texts[i]) for i in order] == [fresh[i] for i in order]
        restore = Restorer(model, [w[1:] for w in weights], most)
        assert [restore(texts[i]) for i in order] == [Restorer(model, [w[1:] for w in weights])(texts[i]) for i in order]


def test_viterbi_against_every_path(model):
    r = random.Random(5)

    def plain(path: str) -> float:
        """The character model's log probability of a text; breaks in a row count once."""
        symbols = [0, 0] + [SYMBOLS.get(c, OTHER_LETTER if c.isalpha() else 0) for c in path]
        once = symbols[:2] + [s for was, s in zip(symbols[1:], symbols[2:]) if s or was]
        if once[-1]:
            once.append(0)
        return sum(float(model[x]) for x in zip(once, once[1:], once[2:]))

    for _ in range(300):
        written = "".join(r.choice("grubnik  .-/15$!@0(") for _ in range(r.randint(1, 7)))
        scores = {}
        for steps in product(*lattice(written)):
            path = "".join(c for c, _ in steps)
            scores[path] = max(scores.get(path, -1e9), sum(x for _, x in steps) + plain(path))
        got = decoded(written, model)
        assert abs(scores[got] - max(scores.values())) < 1e-3, (written, got)
        assert all(may_mean(written, p) for p in scores if " " not in p)


def test_weights_against_plain_counts(spark):
    docs, labels = documents()
    texts = [(t, lab[2]) for (_, t), lab in zip(docs, labels)]
    got = learned_weights(spark.createDataFrame(texts, "text string, toxic int"), np.zeros((SIZE, SIZE, SIZE), np.float32))
    r, seen = Restorer(np.zeros((SIZE, SIZE, SIZE), np.float32)), [Counter(), Counter()]
    for t, toxic in texts:
        words_ = set("".join(c if c.isalpha() else " " for c in r(t)).split())
        seen[toxic].update({"=" + w for w in words_} | {w[:k] for w in words_ for k in range(3, 9) if len(w) >= k})
    n = [sum(x[1] == k for x in texts) for k in (0, 1)]
    for f, odds in got.items():
        a, b = seen[1][f], seen[0][f]
        assert a >= 3 and abs(odds - (math.log((a + 0.5) / (n[1] + 1)) - math.log((b + 0.5) / (n[0] + 1)))) < 1e-9
    assert {"=" + w for w in BAD} <= set(got)


def test_held_out_rows(spark, tmp_path):
    docs, labels = documents()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    got = op5_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == (r.score >= 0.5)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in held]) > 0.95


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)], [(1, 1, None), (None, 1, 1), (2, 0, 0), (2, 0, 0)]])
def test_awkward_rows_and_few_labels(spark, labels):
    out = scored(frame(spark), spark.createDataFrame(labels, LABELS))
    assert sorted(out.columns) == sorted(frame(spark).columns)
    assert len(out.collect()) == len(rows()) and all(0 <= r.toxicity <= 1 for r in out.collect())
    assert scored(empty(spark), spark.createDataFrame(labels, LABELS)).collect() == []
