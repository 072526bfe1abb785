import hashlib

import xxhash

from tessera.llm.lempel_ziv import likeness, phrase_fingerprints, text_fingerprint
from tests.llm.fixtures import empty, frame, rows


def plain_fingerprint(text):
    """A phrase is the shortest piece, from where the last one ended, that is no phrase yet; of each 64th of the hashes the smallest."""
    phrases, at = [], 0
    while at < len(text):
        n = 1
        while at + n <= len(text) and text[at : at + n] in phrases:
            n += 1
        if at + n <= len(text):
            phrases.append(text[at : at + n])
        at += n
    out = ""
    hashes = [xxhash.xxh64(p.encode()).intdigest() for p in phrases]
    for k in range(64):
        mine = [h for h in hashes if k * 2**58 <= h < (k + 1) * 2**58]
        out += hex(min(mine) % 65536)[2:].zfill(4) if mine else "----"
    return out


def plain_likeness(a, b):
    same = both = 0
    for k in range(64):
        x, y = a[4 * k : 4 * k + 4], b[4 * k : 4 * k + 4]
        both += (x, y) != ("----", "----")
        same += x == y != "----"
    return same / both if both else 1.0


def test_fingerprints_against_plain_ones():
    for r in rows():
        text = (r[1] or "")[:3000]
        other = text[: len(text) // 2] + "changed" + text[len(text) // 3 :]
        f, g = text_fingerprint(text), text_fingerprint(other)
        assert (f, g) == (plain_fingerprint(text), plain_fingerprint(other))
        assert likeness(f, g) == plain_likeness(f, g)


def test_against_plain_order(spark):
    data = sorted([(r[0], r[1] or "") for r in rows()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    ids = sorted({d for d, _ in data}, key=lambda d: (d is not None, d or 0))
    first = {d: next(t for e, t in data if e == d) for d in ids}
    want = []
    for d, t in data:
        following = first[ids[(ids.index(d) + 1) % len(ids)]]
        k = len(t) // 4
        edited = t[: len(t) - k] + following[:k]
        f, e = text_fingerprint(t), text_fingerprint(edited)
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), f, e, likeness(f, e), likeness(f, text_fingerprint(following))))
    got = [tuple(r) for r in phrase_fingerprints(frame(spark)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_one_document_and_none(spark):
    assert phrase_fingerprints(empty(spark)).collect() == []
    (only,) = phrase_fingerprints(frame(spark).filter("doc_id = 14")).collect()
    assert only.near_next == 1.0 and only.near_edited < 1.0


def test_likeness_tells_edits_from_other_texts(spark):
    long = [r for r in phrase_fingerprints(frame(spark).filter("doc_id in (9, 14)")).collect()]
    assert all(r.near_edited > r.near_next + 0.2 for r in long)
