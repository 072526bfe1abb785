import uuid
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import token_counts
from tessera.llm.common import shared_dir
from tessera.llm.token_counts import Rollup, deletes, inserts, op6_token_counts, revisions, with_token_counts
from tessera.llm.tokens import default_path
from tests.llm.fixtures import empty, frame, rows


def test_counts_are_the_tokenizers(spark):
    plain = Tokenizer.from_file(default_path())
    want = sorted(((r[0], len(plain.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows()), key=str)
    assert sorted([(r.doc_id, r.n_tokens) for r in with_token_counts(frame(spark)).collect()], key=str) == want
    assert with_token_counts(empty(spark)).collect() == []


def test_batches_count_once(spark):
    r = Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    assert r.totals().collect() == []
    rows_ = spark.createDataFrame([("a", "en", 10, 12), ("a", "en", 5, 5), (None, "de", 7, 1), ("b", None, 0, 3)], "source string, lang string, old long, new long")
    r.commit("1", inserts(rows_, "v1", "old"))
    r.commit("2", revisions(rows_, "v1", "old", "new"))
    for _ in range(3):
        r.commit("2", revisions(rows_, "v1", "old", "new"))
    assert {(x.source, x.lang, x.n_docs, x.n_tokens) for x in r.totals().collect()} == {("a", "en", 2, 17), (None, "de", 1, 1), ("b", None, 1, 3)}
    r.commit("3", deletes(rows_.filter("source = 'a'"), "v1", "new"))
    assert {(x.source, x.n_docs, x.n_tokens) for x in r.totals().collect()} == {(None, 1, 1), ("b", 1, 3)}


def test_a_commit_that_breaks_off_leaves_the_totals(spark):
    r = Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    one = spark.createDataFrame([("a", "en", "v1", 1, 10)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    assert r.commit("1", one) and not r.commit("1", one)
    broken = one.withColumn("n_tokens", F.expr("if(n_tokens = 10, raise_error('lost'), 1)").cast("long"))
    with pytest.raises(Exception, match="lost"):
        r.commit("2", broken)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert r.commit("2", one) and r.commit("3", one.filter("false")) and r.commit("4", one)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 3, 30)]
    assert [x.batch for x in r.log().orderBy("version").collect()] == ["1", "2", "3", "4"]
    assert op6_totals_of_nothing(spark) == []


def test_what_lost_writers_leave_is_no_entry(spark, monkeypatch):
    """Unfinished folders where entries, totals and the log's own files would stand, at any step, and an empty log."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    r = Rollup(spark, path)
    one = spark.createDataFrame([("a", "en", "v1", 1, 10)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    local = Path(path.removeprefix("file:"))
    (local / "log").mkdir(parents=True)
    assert r.totals().collect() == [] and r.log().collect() == []
    assert r.commit("1", one)
    (local / "log" / "000000000002" / "_temporary").mkdir(parents=True)
    (local / "entry-lost" / "_temporary").mkdir(parents=True)
    (local / "totals-lost" / "_temporary").mkdir(parents=True)
    put, lost = Rollup.put, []

    def breaks(self, entries, name):
        lost.append(name)
        raise OSError("lost")

    monkeypatch.setattr(Rollup, "put", breaks)
    with pytest.raises(OSError, match="lost"):
        r.commit("2", one)
    monkeypatch.setattr(Rollup, "put", put)
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 1, 10)]
    assert r.commit("2", one) and not r.commit("2", one) and lost == ["000000000002"]
    with pytest.raises(FileExistsError):
        r.put(spark.createDataFrame([(2, "other", "x")], "version long, batch string, totals string"), "000000000002")
    assert [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 2, 20)]


def test_the_log_is_put_together(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "COMPACTED", 3)
    r = Rollup(spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}")
    one = spark.createDataFrame([("a", "en", "v1", 1, 10)], "source string, lang string, tokenizer_version string, n_docs long, n_tokens long")
    for k in range(1, 7):
        assert r.commit(str(k), one)
    assert len(r.files()) <= 3 and sorted(x.batch for x in r.log().collect()) == list("123456")
    assert not r.commit("2", one) and [tuple(x) for x in r.totals().collect()] == [("a", "en", "v1", 6, 60)]


def op6_totals_of_nothing(spark):
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    empty(spark).write.parquet(f"{path}/documents.parquet")
    return op6_token_counts(spark, path).collect()


def test_query_against_plain_sums(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in op6_token_counts(spark, str(tmp_path)).collect()}
    plain = Tokenizer.from_file(default_path())
    first = {}
    for r in rows():
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    want = Counter(), Counter()
    for r in rows():
        t = r[1] or ""
        if r[0] is not None and r[0] > first[t]:
            continue
        for version, n in (("guess-4", -(-len(t) // 4)), ("word-bpe-49k", len(plain.encode(t, add_special_tokens=False).ids))):
            want[0][(r[3], r[2], version)] += 1
            want[1][(r[3], r[2], version)] += n
    assert got == {k: (want[0][k], want[1][k]) for k in want[0]}
