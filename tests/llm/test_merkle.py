import hashlib
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from tessera.llm import merkle
from tests.llm.fixtures import empty, frame, rows

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(leaves):
    """Digest at the top, and for each leaf the siblings left and right, level by level."""
    ways, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            ways[k].append((run[: i % 8], run[i % 8 + 1 :]))
            at[k] = i // 8
        level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
    return level[0], ways


def plain(docs):
    """docs: (doc_id, source, lang, n_chars, text)."""
    by_lang = defaultdict(list)
    for d in docs:
        odd = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0
        changed = (*d[:4], d[4].translate(LOWER) if d[4] is not None else None) if odd else d
        by_lang[d[2]].append((d[0] is not None, d[0] or 0, leaf_of(*d), leaf_of(*changed), d[0]))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    tops = [climb([x[2] for x in sorted(by_lang[k])]) for k in langs]
    root, over = climb([t[0] for t in tops])
    out = []
    for k, (subroot, ways), last in zip(langs, tops, over):
        for (_, _, own, held, doc_id), way in zip(sorted(by_lang[k]), ways):
            way = way + last
            h = held
            for left, right in way:
                h = sha("".join([*left, h, *right]))
            proof = sha("".join("".join(left + right) for left, right in way))
            out.append((doc_id, own, subroot, root, proof, h, h == root))
    return out


def table(spark, docs):
    return spark.createDataFrame([(*d, "x", 3) for d in docs], "doc_id long, source string, lang string, n_chars long, text string, rank string, n long")


def got(made):
    return Counter(map(tuple, merkle.proofs(made).collect()))


@pytest.mark.parametrize("digits", [1, 4])
def test_proofs_equal_plain_ones(spark, monkeypatch, digits):
    """Blocks of 8 leaves make several tiers of blocks; 600 rows in one language, single ones, 1, 8, 9, 64 and 65 in others."""
    monkeypatch.setattr(merkle, "DIGITS", digits)
    docs = [(i * 7 % 1009, "s", "en", i, f"Text {i} Ä") for i in range(600)]
    for lang, n in (("a", 1), ("b", 8), ("c", 9), ("d", 64), ("e", 65), (None, 3), ("é", 1), ("", 1), ("f", 1), ("zz", 2)):
        docs += [(5000 + i, None, lang, None, "ABC" if i % 2 else None) for i in range(n)]
    docs += [(None, "x", "en", 1, "one"), (None, "x", "en", 1, "one"), (None, None, None, None, None), (3, "s", "en", 5, "same id"), (3, "s", "en", 5, "same id"), (4, "s", "en", 9000, "Word " * 9000)]
    assert got(merkle.manifest(table(spark, docs))) == Counter(plain(docs))


def test_odd_rows_and_empty_table(spark):
    docs = [(r[0], r[3], r[2], r[4], r[1]) for r in rows()]
    assert got(merkle.manifest(frame(spark))) == Counter(plain(docs))
    assert not got(merkle.manifest(empty(spark)))
    one = [(7, "s", "en", 1, "x")]
    (row,) = got(merkle.manifest(table(spark, one)))
    assert row[1] == row[2] == row[3] and row[4] == sha("")


def test_sql_gives_the_same_rows(spark, tmp_path):
    docs = [(i, "s", "en" if i % 3 else None, i, f"Text {i}") for i in range(200)]
    docs.append((500, None, "fr", None, None))
    table(spark, docs).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(con.sql(merkle.OP11_SQL).fetchall()) == Counter(plain(docs)) == Counter(map(tuple, merkle.op11_merkle_manifest(spark, str(tmp_path)).collect()))
