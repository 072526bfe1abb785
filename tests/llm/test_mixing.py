import hashlib
import math
from collections import Counter

from tessera.llm.mixing import SEED, TEMPER, replicated
from tests.llm.fixtures import empty, frame, rows


def plain_copies(doc_id, rate):
    u = int(hashlib.md5(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2**52
    k, below, p = 0, math.exp(-rate), math.exp(-rate)
    while below <= u:
        k += 1
        p *= rate / k
        below += p
    return k


def test_against_plain_inversion(spark):
    sizes = Counter(r[3] for r in rows())
    weights = {s: n**TEMPER for s, n in sizes.items()}
    rate = {s: weights[s] / sum(weights.values()) * len(rows()) / n for s, n in sizes.items()}
    want = Counter()
    for r in rows():
        for k in range(plain_copies(r[0], rate[r[3]])):
            want[(r[0], r[1], r[3], k)] += 1
    out = replicated(frame(spark))
    assert Counter((r.doc_id, r.text, r.source, r.copy) for r in out.collect()) == want
    keys = [r.shuffle_key for r in out.collect()]
    assert keys == sorted(keys)


def test_weights_reach_their_targets(spark):
    df = spark.range(20000).selectExpr("id as doc_id", "case when id % 10 = 0 then 'small' when id % 10 = 1 then 'none' else 'large' end as source")
    got = {r.source: r["count"] for r in replicated(df, {"small": 1.0, "large": 3.0}, total=40000).groupBy("source").count().collect()}
    assert set(got) == {"small", "large"}
    assert abs(got["small"] - 10000) < 500 and abs(got["large"] - 30000) < 900
    big = replicated(df.filter("source = 'small'").limit(50), total=50 * 2000).count()
    assert abs(big - 100000) < 2000


def test_empty_table(spark):
    assert replicated(empty(spark)).collect() == []


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "source", "hot", "m_source", "m_u", "m_n", "rate", "ident", "row", "copy", "shuffle_key"]
    df = spark.createDataFrame([(i, "s", *[f"{n}{i}" for n in names[2:]]) for i in range(20)], ", ".join(f"{n} {'long' if n == 'doc_id' else 'string'}" for n in names))
    got = replicated(df, total=200)
    assert got.columns == names
    for r in got.collect():
        assert all(r[n] == f"{n}{r.doc_id}" for n in names[2:-2]) and isinstance(r["copy"], int)
