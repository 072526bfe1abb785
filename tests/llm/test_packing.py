import random
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from tessera.llm.packing import pack_documents, plan_slots
from tessera.llm.tokens import PartIds, default_path, part_ids
from tests.llm.fixtures import empty, frame, rows


def best_fit_decreasing(lengths, window):
    """How many sequences a plain best fit over single pieces takes."""
    free = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(free, n)
        left = free.pop(at) if at < len(free) else window
        insort(free, left - n)
    return len(free)


def test_plan_seats_every_piece_once_and_tightly():
    r = random.Random(3)
    for window in (16, 100, 4096):
        counts = {n: r.randint(1, 500) for n in r.sample(range(1, window + 1), min(60, window))}
        used = defaultdict(list)
        for length, lo, hi, copies, first, offset in plan_slots(counts, window):
            for i in range(hi - lo):
                used[first + i // copies].append((offset + (i % copies) * length, length))
        assert sum(len(v) for v in used.values()) == sum(counts.values())
        for spans in used.values():
            at = 0
            for start, length in sorted(spans):
                assert start == at
                at += length
            assert at <= window
        assert len(used) <= best_fit_decreasing([k for k, n in counts.items() for _ in range(n)], window)


def test_repeated_rows_and_ties(spark):
    rows_ = [(7, "the same words again")] * 300 + [(i, "of one length") for i in range(200)]
    got = pack_documents(spark.createDataFrame(rows_, "doc_id long, text string"), window=64).collect()
    assert len(got) == len({(r.sequence_id, r.offset) for r in got}) == 500
    assert len({r.sequence_id for r in got}) == best_fit_decreasing([r.length for r in got], 64)


def test_documents_against_the_tokenizer(spark):
    got = pack_documents(frame(spark), window=512).collect()
    plain = Tokenizer.from_file(default_path())
    want = []
    for d, t, *_ in rows():
        ids = plain.encode(t or "", add_special_tokens=False).ids + [1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = np.array(ids[at : at + 512], "<u4").tobytes()
            want.append((d, k, at, len(part) // 4, zlib.crc32(part)))
    assert sorted([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], key=str) == sorted(want, key=str)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for spans in by.values():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at <= 512


def test_empty_table(spark):
    assert pack_documents(empty(spark)).collect() == []


def test_part_ids_equal_whole_ids():
    cache = part_ids(default_path())
    for t in ["It's we'RE DON'T", "á Á H̱ ẖ", "ΣΑΣ", "x\x1dy", "<|startoftext|> <|STARTOFTEXT|>", "½ ② ٣ 12", "", "   z", "İstanbul", "emoji 🙂🙂 __init__"]:
        assert cache.ids(t) == cache.encoded(t), t


def test_part_ids_of_any_characters():
    cache, r = part_ids(default_path()), random.Random(2)
    kinds = [*map(chr, range(1, 0x250)), *"\u0300\u0301Σς\u1e9eİı\u2028\u3000一٠Ⅰ😀가ᄀ\u212b\u212a\xad\u200d\ufe0f", "'s", "'LL", "<|endoftext|>", "###", "  ", "the"]
    for _ in range(3000):
        t = "".join(r.choice(kinds) for _ in range(r.randint(1, 14)))
        assert cache.ids(t) == cache.encoded(t), t


def test_other_vocabularies_encode_whole_texts():
    import public_tokenizers

    cache = PartIds(public_tokenizers.path("byte_bpe_50k.json"))
    assert not cache.by_parts
    assert cache.ids("Two  words, 12!") == np.array(cache.tokenizer.encode("Two  words, 12!", add_special_tokens=False).ids, "<u4").tobytes()
