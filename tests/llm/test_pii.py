import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import pii
from tests.llm.fixtures import empty, frame, rows

# the contract's patterns as they are written there
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def kept(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    return [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "") if kept(k, m[0])]


HARD = [
    "a@b.com_x@y.co.uk,z@@q.r a@b a@b. c@d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1..2.3.4 999999999999.1.1.1", "4111-1111 1111 1111 5500000000000004x 4111111111111112",
    "+1 (980) 555-6268 +12 +4915112345678 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "é🙂 mail me: é@x.y ñ+tag@host-1.example 🙂10.0.0.1🙂", "9" * 4000, "a" * 3000 + "@", "1 " * 3000, "x@" * 500, "a." * 2000, "+" * 300 + "1" * 30,
]


def test_base_spans_against_plain_patterns(spark):
    texts = HARD + [r[1] for r in rows()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.base_spans] for r in pii.with_base_spans(df).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_base(t), (t or "")[:80]


SECRET = re.compile(r"(?i:token|secret|password|passwd|pwd|credential|bearer|auth|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key)[\"']?\x20{0,3}[:=]\x20{0,3}[\"']?(?<![A-Za-z0-9+/_~.-])([A-Za-z0-9+/_~.-]{16,}={0,2})")


def plain_secrets(text):
    return [m.span(1) for m in SECRET.finditer(text) if re.search("[0-9]", m[1])]


@pytest.mark.parametrize(
    "text,want",
    [
        ('x token = "f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda" y', ["f3ef4d6b2755a36d7d9c25bd72c4d5f67e061fda"]), ("API_KEY: sk-abcdefghijklmnop0123", ["sk-abcdefghijklmnop0123"]),
        ("password='YWxhZGRpbjpvcGVu0TIz=='", ["YWxhZGRpbjpvcGVu0TIz=="]), ("token of the realm = nothing at all", []), ("token = short1", []), ("token = onlylettersareinhereandmore", []),
        ("number = 123456789012345678901234", []), ("client-key=0123456789abcdef pwd:fedcba9876543210", ["0123456789abcdef", "fedcba9876543210"]), ("", []),
    ],
)
def test_credentials(spark, text, want):
    (row,) = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [text[s.start : s.end] for s in row.spans if s.kind == "secret"] == want == [text[a:b] for a, b in plain_secrets(text)]
    assert not [s for s in row.base_spans if s.kind == "secret"]
    (clean,) = pii.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert clean.text.count("[SECRET]") == len(want) and not any(w in clean.text for w in want)


def corpus():
    """Texts with addresses of one person in several, a name that stands by them and elsewhere, copies, and unique words."""
    r, docs = random.Random(9), []
    common = ["common", "words", "kappa", "lambda", "here", "and", "there", "é", "x"]
    for i in range(1500):
        w = [r.choice(common) for _ in range(r.randint(3, 90))]
        if i % 5 == 0:
            w.insert(r.randint(0, len(w)), f"once{'abcdefghij'[i // 5 % 10]}{'klmnopqrst'[i // 50 % 10]}{'uvwxyzabcd'[i // 500]}")
        if i < 50:
            w.insert(len(w) // 2, f"Mallory ann@mail.org{',' * (i % 2)} {'Oscar' if i < 8 else 'Peggy' if i < 24 else ''}")
        elif i in (51, 52):
            w.insert(len(w) // 2, f'token = "{"0123456789abcdef" * 2}{i}"')
        elif i < 70:
            w.insert(len(w) // 2, r.choice([f"user{i}@mail.org", "+1 (980) 555-62%02d" % i, f"10.0.0.{i}", "4111 1111 1111 1111"]))
        elif i == 70:
            w += ["mallory"]
        elif i == 73:
            w += ["oscar", "peggy"]
        docs.append((i, " ".join(w) + ("." if i % 2 else "")))
    return docs + [(5000, docs[13][1]), (5001, docs[13][1]), (5002, docs[3][1])]


def plain_entities(text):
    """(kind and value, what is near it) of every valid match."""
    out = []
    for k, p in (*PLAIN.items(), ("secret", None)):
        found = [(m.start(), m.end(), kept(k, m[0])) for m in re.finditer(p, text)] if p else [(a, b, True) for a, b in plain_secrets(text)]
        for i, (a, b, good) in enumerate(found):
            if not good:
                continue
            before = text[found[i - 1][1] if i else 0 : a]
            after = text[b : found[i + 1][0] if i + 1 < len(found) else len(text)]
            if len(before) > pii.CONTEXT:
                before = re.sub(r"^[^\W\d_]+", "", before[-pii.CONTEXT :])
            if len(after) > pii.CONTEXT:
                after = re.sub(r"[^\W\d_]+$", "", after[: pii.CONTEXT])
            m = text[a:b]
            value = m.lower() if k == "email" else m if k in ("ip", "secret") else re.sub("[^0-9]", "", m)
            out.append((f"{k}:{value}", before + " " + after))
    return out


def plain_words(text):
    for a, b in reversed(plain_secrets(text)):
        text = text[:a] + " " + text[b:]
    return set(re.findall(r"[^\W\d_]+", re.sub(PLAIN["email"], " ", text).lower()))


def plain_open(texts):
    """term -> (the fewest bits left open, whether it is certain where the entity is not), of terms that are flagged."""
    seen, both, places = Counter(), Counter(), defaultdict(set)
    for t in texts:
        seen.update(plain_words(t))
        near = defaultdict(set)
        for entity, around in plain_entities(t):
            for w in plain_words(around):
                near[entity].add(w)
                places[entity, w].add(around)
        both.update((entity, w) for entity, words in near.items() for w in words)
    out = {}
    for (entity, w), n in both.items():
        left = -math.log2(n / (seen[w] + 1))
        if len(places[entity, w]) >= pii.MEETINGS and left <= pii.GENERALISE:
            was = out.get(w, (9.0, False))
            out[w] = (min(was[0], left), was[1] or (seen[w] > n and left <= pii.CERTAIN))
    return out


@pytest.mark.parametrize("broadcast", [pii.MOST_BROADCAST, 0])
def test_terms_that_disclose(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "MOST_BROADCAST", broadcast)
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.with_spans(df).collect()}
    left = plain_open([t for _, t in docs])
    assert left["mallory"][0] <= pii.REMOVE < left["oscar"][0] <= pii.GENERALISE and not any(w.startswith("once") for w in left)
    assert left["mallory"][1] and not left["peggy"][1]
    for i, t in docs:
        near = {w for _, around in plain_entities(t) for w in plain_words(around)}
        want = plain_base(t) + [("secret", *s) for s in plain_secrets(t)]
        for kind, test in (("term", lambda s: s > pii.REMOVE), ("removed", lambda s: s <= pii.REMOVE)):
            want += [
                (kind, m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", t.lower())
                if m[0] in left and (m[0] in near or left[m[0]][1]) and test(left[m[0]][0]) and not any(m.start() < e and m.end() > s for _, s, e in plain_base(t) + [("secret", *s) for s in plain_secrets(t)])
            ]
        assert got[i] == want, (i, t)
    # the name is removed where the address itself does not stand; another, less telling one is not
    assert [s[0] for s in got[70]] == ["removed"] and not got[72] and not got[73]


@pytest.mark.parametrize("n", [300, 6000])
def test_thresholds_mean_the_same_in_a_corpus_of_any_size(spark, n):
    """A name beside one address in three texts is found; words that stand once beside a value, in copies too, are not."""
    r = random.Random(n)
    docs = [(i, " ".join(r.choice("the of and in to it kappa was".split()) for _ in range(30))) for i in range(n)]
    for k in range(3):
        docs[7 * k] = (7 * k, f"words {k} by quillon ann@mail.org on day {k}")
    docs[40] = docs[41] = (40, "a singular flumber at 10.0.0.7 stands here")
    got = {x.doc_id: [(s.kind, docs[x.doc_id][1][s.start : s.end]) for s in x.spans] for x in pii.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).filter("size(spans) > 0").collect()}
    assert {k: [w for kind, w in v if kind in ("term", "removed")] for k, v in got.items()} == {0: ["words", "by", "quillon", "on", "day"], 7: ["words", "by", "quillon", "on", "day"], 14: ["words", "by", "quillon", "on", "day"], 40: []}


def test_a_name_is_evidence_however_far_from_the_entity_it_stands(spark):
    """Far from the address, and beyond another match of its kind; a signature that is the same everywhere is one meeting."""
    r = random.Random(4)

    def filler(n):
        return " ".join(r.choice("the of and in to it kappa was".split()) for _ in range(n))

    docs = [(i, filler(30)) for i in range(200)]
    for k in range(3):
        docs[k] = (k, f"quillon {filler(300)} user{k}@else.org {filler(100)} ann@mail.org {filler(300)} sandrel {k}")
        docs[10 + k] = (10 + k, f"flumber{'abc'[k]} zindrak {filler(150)}. {'Regards and so on. ' * 20} bob@mail.org")
    got = {x.doc_id: {docs[x.doc_id][1][s.start : s.end] for s in x.spans if s.kind in ("term", "removed")} for x in pii.with_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(3)] == [{"quillon", "sandrel"}] * 3
    assert not any(got[i] for i in range(3, 200))


def test_a_credential_may_begin_with_any_number_of_letters(spark):
    text = "token = " + "a" * 500 + "1"
    (row,) = pii.with_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("secret", *s) for s in plain_secrets(text)] == [("secret", 8, 509)]


def test_columns_of_any_name_are_kept(spark):
    names = ["doc_id", "text", "spans", "base_spans", "_x", "key", "row", "flagged", "m_email", "term", "open", "n_chars"]
    values = (1, "to ann@mail.org now", "s", "b", "x", "k", "r", "f", "m", "t", 0.5, 19)
    df = spark.createDataFrame([values], ", ".join(f"{n} {'long' if n in ('doc_id', 'n_chars') else 'double' if n == 'open' else 'string'}" for n in names))
    got = pii.sanitised(df).first().asDict()
    assert list(got) == names and got["text"] != values[1] and "[EMAIL]" in got["text"]
    assert all(got[n] == v for n, v in zip(names, values) if n not in ("text", "n_chars"))
    kept_ = pii.with_spans(df)
    assert kept_.columns == [n for n in names if n not in ("spans", "base_spans")] + ["base_spans", "spans"]
    assert kept_.first().key == "k" and kept_.first()["_x"] == "x"


def test_sanitised_texts_keep_their_columns(spark):
    out = pii.sanitised(frame(spark))
    assert out.columns == frame(spark).columns
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    assert len(out.collect()) == len(rows())
    assert "[EMAIL]" in by[13].text and "[PHONE]" in by[13].text and "[IP]" in by[13].text and "[CARD]" in by[13].text and "@" not in by[13].text
    assert by[13].n_chars == len(by[13].text) and by[4].text is None and by[9].text == rows()[8][1]


def test_empty_table(spark):
    assert pii.with_spans(empty(spark)).collect() == []


def test_digest_of_no_spans(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    row = pii.with_spans(df).select(pii.F.sha2(pii.listed("base_spans"), 256).alias("h"), pii.listed("spans").alias("s")).first()
    assert (row.h, row.s) == (hashlib.sha256(b"").hexdigest(), "")


@pytest.mark.parametrize("text,want", [("plain", "plain"), ("İ x@y.zz İ", "İ [EMAIL] İ")])
def test_replacement(spark, text, want):
    assert pii.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == want
