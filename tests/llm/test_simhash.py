import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tests.llm.fixtures import empty, frame, rows


def plain_fingerprint(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", low) if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def plain_components(fps, ids, bits):
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                parent[find(i)] = find(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(fps))]


def test_awkward_rows_against_brute_force(spark):
    got = simhash.near_duplicates(frame(spark), shingle_words=3, max_bits=2).collect()
    data = [(r[0], r[1]) for r in rows()]
    fps = [plain_fingerprint(t, 3) for _, t in data]
    want = sorted(zip([d for d, _ in data], [f"{f:016x}" for f in fps], plain_components(fps, [d for d, _ in data], 2)), key=str)
    assert sorted([(r.doc_id, r.fingerprint, r.component_id) for r in got], key=str) == want


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == []


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_links_join_what_all_pairs_join(spark, bits):
    r = np.random.default_rng(bits)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    fps = set()
    for f in base:
        for _ in range(12):
            g = int(f)
            for b in r.integers(0, 64, r.integers(0, 7)):
                g ^= 1 << int(b)
            fps.add(g)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bits).collect()
    at = {f: i for i, f in enumerate(signed)}
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[find(at[a])] = find(at[b])
    mine = [find(i) for i in range(len(fps))]
    want = plain_components(fps, list(range(len(fps))), bits)
    assert len(set(zip(mine, want))) == len(set(mine)) == len(set(want))


def test_large_bucket_looks_up_partners(monkeypatch):
    mask, chain = simhash.chain_masks(2)[0]
    r = np.random.default_rng(0)
    free = [b for b in range(64) if not mask >> b & 1]
    fps = np.unique(np.array([sum(int(r.integers(0, 2)) << b for b in free[:14]) for _ in range(400)], np.uint64))
    slow = simhash.bucket_groups(fps, mask, chain, 2)
    monkeypatch.setattr(simhash, "COMPARE", 1)
    fast = simhash.bucket_groups(fps, mask, chain, 2)
    assert sorted(map(sorted, slow)) == sorted(map(sorted, fast))
