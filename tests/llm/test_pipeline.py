import numpy as np

import corpus_pipeline
from tessera.llm.near_copies import FAR, SKETCH, bucket_edges, copy_links, one_of_each
from tessera.llm.simhash import shingle_hashes
from tests.llm.fixtures import empty, frame, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    texts = []
    for i in range(60):
        w = words(150 + i, i).split()
        texts.append(" ".join(w))
        for k in range(i % 4):
            v = list(w)
            for j in range(k):
                v[(37 * j + i) % len(v)] = f"edit{k}"
            texts.append(" ".join(v))
    return [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]


def similarity(a, b):
    x, y = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(b, 5).tolist())
    return len(x & y) / max(1, len(x | y))


def test_one_of_each_against_all_pairs(spark):
    docs = corpus()
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if similarity(docs[i][1], docs[j][1]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = sorted(r.doc_id for r in one_of_each(spark.createDataFrame(docs, SCHEMA)).collect())
    assert got == sorted({find(i) for i in range(len(docs))})


def test_one_of_each_awkward_rows(spark):
    out = one_of_each(frame(spark))
    assert out.columns == frame(spark).columns
    # 1, 2 and 3 are near copies; null, empty and blank texts are one group, in which the null id is the smallest
    assert sorted([r.doc_id for r in out.collect()], key=str) == sorted([1, 7, 8, 9, 10, None, None, 12, 13, 14], key=str)
    assert one_of_each(empty(spark)).collect() == []


def test_large_group_of_near_copies(spark):
    base = words(300, 1).split()
    docs = []
    for i in range(600):
        w = list(base)
        w[i % 300] = f"own{i}"
        docs.append((i, " ".join(w), "en", "s", 0))
    assert [r.doc_id for r in one_of_each(spark.createDataFrame(docs, SCHEMA)).collect()] == [0]


def test_large_bucket_of_many_small_groups(spark):
    r = np.random.default_rng(3)
    rows = []
    for i in range(700):
        fp, sketch = r.integers(-(1 << 62), 1 << 62), r.integers(1, 1 << 32, SKETCH, dtype=np.uint32)
        for k in range(2):
            sketch[k] += 1
            rows.append((2 * i + k, int(fp) ^ k, [5], bytearray(sketch.tobytes())))
    links = copy_links(spark.createDataFrame(rows, "set_key long, fp long, samples array<long>, sketch binary"), 0.8)
    assert sorted((x.a, x.b) for x in links.collect()) == [(2 * i, 2 * i + 1) for i in range(700)]


def test_pairs_about_the_limit_are_decided_by_their_sets(spark):
    """Pairs just at and just below 0.8, which the sketch's estimate mistakes on both sides; each text's partner stays if and only if they are too far apart."""
    docs = []
    for i in range(60):
        w = words(204, 1000 + i).split()
        v = list(w)
        # each lone edit takes five of 200 shingles: 4 leave 180/220, the fifth at the end takes 2 (178/222 = 0.802) or 3 (177/223 = 0.794)
        for at in (20, 60, 100, 140, 204 - 2 - i % 2):
            v[at] = f"edit{i}"
        docs += [(2 * i, " ".join(w), "en", "s", 0), (2 * i + 1, " ".join(v), "en", "s", 0)]
    want = {2 * i for i in range(60)} | {2 * i + 1 for i in range(60) if similarity(docs[2 * i][1], docs[2 * i + 1][1]) < 0.8}
    assert len(want) == 90
    # a pair shares no sample at all with a probability of 0.009
    got = {r.doc_id for r in one_of_each(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert want <= got and len(got - want) <= 1


def test_differing_bits_may_crowd_anywhere():
    sketches = np.full((2, SKETCH), 7, np.uint32)
    for shift in range(0, 64, 16):
        for n in (6, 11, 16):
            assert bucket_edges(np.array([1, 2]), np.array([0, ((1 << n) - 1) << shift], np.uint64), sketches, 0.8) == [(1, 2)]
    assert bucket_edges(np.array([1, 2]), np.array([0, (1 << (FAR + 1)) - 1], np.uint64), sketches, 0.8) == []


def test_repeated_shingles_do_not_part_a_pair(spark):
    base = words(120, 4)
    docs = [(1, base, "en", "s", 0), (2, base + " one phrase said again" * 60, "en", "s", 0)]
    assert similarity(docs[0][1], docs[1][1]) >= 0.8
    assert [r.doc_id for r in one_of_each(spark.createDataFrame(docs, SCHEMA)).collect()] == [1]


def test_stages_in_order(spark, tmp_path):
    docs = corpus()
    spark.createDataFrame(docs, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "packing":
            assert now.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert now.count() > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert np.all(out.groupby("sequence_id").length.sum() <= 4096)


NAMES = ["hot", "m_source", "m_u", "m_times", "m_id", "m_digest", "_x", "spans", "base_spans", "key", "toxic", "l_id", "m_toxicity", "score", "row", "own_id", "m_n", "rate", "set_key"]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    docs = [(*r, *[f"{n}{r[0]}" for n in NAMES]) for r in corpus()[:40]]
    now = spark.createDataFrame(docs, SCHEMA + "".join(f", {n} string" for n in NAMES))
    columns = now.columns
    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns, name
        rows = out.collect()
        assert rows, name
        for r in rows:
            assert all(r[n] == f"{n}{r.doc_id}" for n in NAMES), name
    assert corpus_pipeline.STAGES[-1][1](spark, now, str(tmp_path)).count() == 40


def test_stages_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
