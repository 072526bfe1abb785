import hashlib
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.alignment import Aligned, alignments, paths
from tessera.llm.tokens import byte_letters
from tests.llm.fixtures import empty, frame, rows

LETTERS = {byte_letters().get(b, chr(b)): b for b in range(256)}


def encoded(text):
    """Ids and byte ends of both tokenizers over the whole text, or None."""
    if not text:
        return None
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(encoded, "a"):
        encoded.a, encoded.b = Tokenizer.from_file(paths()[0]), SentencePieceProcessor(model_file=paths()[1])
        encoded.a.encode_special_tokens = True
    a, b, out = encoded.a.encode(" " + text, add_special_tokens=False), encoded.b.encode(text), []
    bytes_a = [bytes(LETTERS[c] for c in t) for t in a.tokens]
    bytes_b = [bytes([int(p[3:5], 16)]) if encoded.b.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [encoded.b.id_to_piece(i)]]
    if b"".join(bytes_a) != (" " + text).encode() or b"".join(bytes_b) != (" " + text).encode():
        return None
    for ids, parts in ((a.ids, bytes_a), (b, bytes_b)):
        at, ends = 0, []
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append(list(zip(ids, ends)))
    return out


def links_of(text):
    cut = encoded(text)
    if cut is None:
        return [], 0, 0, 0, ""
    a, b = cut
    common = sorted({e for _, e in a} & {e for _, e in b})
    group = {e: ([], []) for e in common}
    for side, tokens in enumerate(cut):
        for i, end in tokens:
            group[next(e for e in common if e >= end)][side].append(i)
    text_ = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in group.values())
    links = [(i, j) for i, e in a for j, f in b if e == f]
    return links, len(a), len(b), len(common), hashlib.sha256(text_.encode()).hexdigest()


def plain(docs):
    made = [(i, *links_of(t)) for i, t in docs]
    count = Counter(p for m in made for p in m[1])
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter((i, na, nb, ng, len(ls), sum(count[p] == best[p[1]] for p in ls), sum(count[p] for p in ls), sha) for i, ls, na, nb, ng, sha in made)


def texts():
    r = random.Random(5)
    own = ["the", "naïve", "日本", "é", "I'll", "<s>", "<|endoftext|>", "▁", "<0x41>", "x\x00y", "a  b", "\n", "\t", " ", "!!!", "12345", "antidisestablishment", " ", "\x1c", "ﬁ", "𝒳", "'s"]
    return ["".join(r.choice(own) + r.choice([" ", " ", " ", "", "  ", "\n", " \n "]) for _ in range(r.randint(1, 25))) for _ in range(250)]


@pytest.mark.parametrize("hot", [1 << 16, 4])
def test_alignment_equals_plain_one(spark, hot):
    docs = [(i, t) for i, t in enumerate(texts())]
    docs += [(900, docs[0][1]), (0, docs[0][1]), (None, "no id"), (None, None), (901, ""), (902, "word " * 3), (903, " leading"), (904, "trailing ")]
    made = alignments(spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, at long, pairs string"), hot=hot)
    assert Counter(map(tuple, made.collect())) == plain(docs)


def test_odd_rows_and_empty_table(spark):
    docs = [(r[0], r[1] if r[0] != 9 else r[1][:3000]) for r in rows()]
    made = alignments(frame(spark).withColumn("text", F.expr("if(doc_id = 9, substring(text, 1, 3000), text)")))
    assert Counter(map(tuple, made.collect())) == plain(docs)
    assert alignments(empty(spark)).count() == 0


def test_identity_map_holds_same_bytes():
    cache = Aligned(*paths())
    kept = [(a, b) for a, b in enumerate(cache.same) if b >= 0]
    assert len(kept) > 10_000 and all(cache.a_bytes[a] == cache.b_bytes[b] for a, b in kept)


CACHE = []


def word_by_word(text):
    if not CACHE:
        CACHE.append(Aligned(*paths(), most=50))
    counts, groups, (same, pairs) = CACHE[0].texts_of([None, text, "", "a"])
    back = [(a, CACHE[0].same[a]) for a in same[1][same[0] == 1].tolist()] + [(p >> 32, p & 0xFFFFFFFF) for p in pairs[1][pairs[0] == 1].tolist()]
    return sorted(back), *counts[1].tolist(), hashlib.sha256(groups[1].encode()).hexdigest() if groups[1] else ""


def same_as_whole(text):
    links, *others = links_of(text)
    assert word_by_word(text) == (sorted(links), *others)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t.,'’a1Ж▁ \x1f"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_word_by_word_is_the_whole_text(text):
    same_as_whole(text)


def test_long_text():
    same_as_whole("many words and " * 100 + "x" * 2000 + " end")
    a, b = encoded("word and " * 30_000)
    assert word_by_word("word and " * 30_000)[1:3] == (len(a), len(b))
