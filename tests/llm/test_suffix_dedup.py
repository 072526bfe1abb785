import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import suffix_dedup
from tessera.llm.suffix_dedup import deduplicated, joined
from tessera.llm.suffixes import deep_shallow
from tests.llm.fixtures import empty, frame, rows


def plain(docs, length=100):
    """docs: (doc_id, text)."""
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, (docs[i][1] or "").encode()))
    met, out = set(), []
    for i in order:
        raw = (docs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            string = raw[p : p + length]
            if string in met:
                gone[p : p + length] = b"\1" * length
            met.add(string)
        stays = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((docs[i][0], len(raw), sum(gone), spans, hashlib.sha256(stays).hexdigest()))
    return Counter(out)


def documents(seed=1, n=150):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéö") for _ in range(r.randint(1, 7)))
    prose = lambda k: " ".join(word() for _ in range(k))
    passages = [prose(r.randint(12, 60)) for _ in range(6)]
    docs = []
    for i in range(n):
        parts = [prose(r.randint(0, 40)) for _ in range(3)]
        if r.random() < 0.6:
            parts.insert(r.randint(0, 3), r.choice(passages))
        if r.random() < 0.3:
            p = r.choice(passages)
            parts.insert(1, p[r.randint(0, 40) : len(p) - r.randint(0, 40)])
        if r.random() < 0.1:
            parts.append(r.choice(["ab", "x", "abc "]) * r.randint(1, 120))
        docs.append((i * 37 % 1009, (" " if r.random() < 0.5 else "").join(parts)))
        if r.random() < 0.15:
            docs.append((2000 + i, docs[-1][1]))
        if r.random() < 0.15:
            text = docs[-1][1]
            at = r.randint(0, len(text))
            docs.append((3000 - i, text[:at] + "#" + text[at + 1 :]))
    return docs


def table(spark, docs):
    return spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, text string, raw string, uid long").repartition(5)


@pytest.mark.parametrize("large, chunk, sort", [(20_000, 1 << 20, 1 << 21), (3, 700, 4000), (0, 1500, 1)])
def test_equals_brute_force(spark, monkeypatch, large, chunk, sort):
    """Whole and small chunks, buckets sorted together, singly, and by Spark alone."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", chunk)
    monkeypatch.setattr(suffix_dedup, "SORTED", sort)
    docs = documents()
    assert Counter(map(tuple, deduplicated(table(spark, docs), large=large).collect())) == plain(docs)


def test_odd_rows_and_empty_table(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert Counter(map(tuple, deduplicated(frame(spark)).collect())) == plain(docs)
    assert deduplicated(empty(spark)).count() == 0
    docs = [(5, "a" * 99), (6, "a" * 100), (7, "a" * 101), (8, "b" * 300), (None, "b" * 150), (None, "b" * 150), (5, "a" * 250), (1, None)]
    assert Counter(map(tuple, deduplicated(table(spark, docs)).collect())) == plain(docs)


def test_kept_bytes(spark):
    docs = documents(2, 40)
    out = deduplicated(table(spark, docs), keep=True).collect()
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["kept"]) == r["n_bytes"] - r["n_removed"] for r in out)


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=300), st.integers(1, 60), st.sampled_from([b"", b"a" * 90, b"ab" * 60]), st.integers(1, 3))
def test_deep_shallow_is_sorting(data, length, more, times):
    data = (data + more) * times
    length = min(length, len(data))
    at = np.arange(len(data) - length + 1)
    random.Random(len(data)).shuffle(at)
    order, begins = deep_shallow(np.frombuffer(data + bytes(16), np.uint8), at, length)
    strings = [data[i : i + length] for i in at]
    assert list(order) == sorted(range(len(at)), key=lambda i: strings[i])
    assert begins.tolist() == [k == 0 or strings[order[k]] != strings[order[k - 1]] for k in range(len(at))]


@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50), st.integers(1, 10)), max_size=40))
def test_joined_stretches(items):
    key, s, n = (np.array([i[k] for i in items], np.int64) for k in range(3))
    covered = {(k, x) for k, a, m in items for x in range(a, a + m)}
    k_, s_, e_ = joined(key, s, s + n)
    assert {(k, x) for k, a, b in zip(k_, s_, e_) for x in range(a, b)} == covered
    assert all((k, b) not in covered for k, b in zip(k_, e_)) and len(k_) == sum((k, x - 1) not in covered for k, x in covered)
