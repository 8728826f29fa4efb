"""Personal data: base spans against the plain patterns, the scans and scores against plain Python, and discovery."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hopframe.llm import pii

SCHEMA = "doc_id long, text string, base string, found string, _row long"
PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_base(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1]))
            ok = [True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True, 14 <= len(d) <= 19 and total % 10 == 0, 10 <= len(d) <= 15][k]
            out += [(m.start(), k, m.end())] if ok else []
    return sorted(out)


def texts():
    rng = random.Random(11)
    bits = ["a", "b.c", "@", "mail.x", ".", "1", "23", "256", "4111111111111111", "4111 1111-1111 1111", "+1", "(555)", " ", "-", "é", "\n", "+", "999.1.2.3", "10.0.0.1", "+1 (555) 555-1234", "jo@x.org", "word "]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(600)]


def test_base_spans_equal_the_patterns():
    for t in [*texts(), "", "x@y", "a@b@c.com", "@a.b", "1.2.3.4.5.6.7.8", "00000255.1.1.1", "+1" + " " * 50, "😀 jo@x.org 😀 +1 (555) 555-1234"]:
        assert pii.base_spans(t) == brute_base(t), t


def test_long_texts_take_linear_time():
    for t in ("a" * 500_000, "1" * 500_000, "1 " * 250_000 + "x", "@" * 250_000, "a@" * 100_000, "+1 " * 100_000, "1." * 100_000, " dot at" * 200_000):
        spans = pii.base_spans(t)
        pii.candidates(t, spans)


def words_of(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall("[A-Za-z\x80-\U0010ffff]+", text or "")]


def key(words):
    data = "\n".join(words).encode()
    return int(pii.gram_keys(pii.word_keys(np.frombuffer(data, np.uint8))[1], len(words))[0])


def test_words_and_their_keys(monkeypatch):
    for size in (1, 7, 1 << 20):
        monkeypatch.setattr(pii, "SEGMENT", size)
        for t in [*texts()[:50], "Über ÜBER straße\nWord word"]:
            data = np.frombuffer(t.encode(), np.uint8)
            _, keys = pii.word_keys(data)
            assert [int(k) for k in keys.view(np.int64)] == [int(pii.word_keys(np.frombuffer(w.encode(), np.uint8))[1].view(np.int64)[0]) for w in words_of(t)]
    assert len({key([w]) for w in {"".join(random.Random(i).choices("abcdef", k=5)) for i in range(2000)}}) == len({"".join(random.Random(i).choices("abcdef", k=5)) for i in range(2000)})


def test_occurrences_are_counted_over_whole_texts(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate([*texts()[:80], "word one two", None, "", "word " * 3000])]
    counts = Counter()
    for _, t in rows:
        w = words_of(t)
        for n in (1, 2, 3):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    asked = random.Random(1).sample(sorted(counts), 200) + [("never", "seen")]
    want = {key(g): counts[g] for g in asked if counts[g]}
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.occurrences(df, spark.createDataFrame([(key(g),) for g in asked], "pattern long")).collect()
    assert {r.pattern: r.n for r in got} == want


def brute_scores(edges, fills, rounds):
    """edges: {(side, pattern, kind, value): (seed, n)}"""
    seeds = {(k, v): 1.0 for (_, _, k, v), (seed, _) in edges.items() if seed}
    known = dict(seeds)
    for _ in range(rounds):
        hits, unknown, support = defaultdict(float), Counter(), defaultdict(set)
        for (s, p, k, v), (_, n) in edges.items():
            if (k, v) in known:
                hits[s, p, k] += n * known[k, v]
                support[s, p, k].add(v)
            else:
                unknown[s, p, k] += n
        conf = {x: h / (max(fills[x[1]] - min(unknown[x], h), h) + 1) for x, h in hits.items() if len(support[x]) >= pii.MIN_SUPPORT}
        best = defaultdict(float)
        for s, p, k, v in edges:
            if conf.get((s, p, k), 0) >= pii.MIN_CONFIDENCE:
                best[k, v, s] = max(best[k, v, s], conf[s, p, k])
        score = {(k, v): 1 - (1 - best.get((k, v, 0), 0)) * (1 - best.get((k, v, 1), 0)) for k, v, _ in best}
        now = seeds | {i: c for i, c in score.items() if c >= pii.ACCEPT and i not in seeds}
        if len(now) == len(known):
            return now
        known = now
    return known


def test_scores_equal_plain_python(spark):
    rng = random.Random(2)
    edges = {}
    for v in range(300):
        kind, seed = rng.randrange(2), rng.random() < 0.5
        for _ in range(rng.randint(1, 4)):
            edges[rng.randrange(2), rng.randrange(25), kind, v] = (seed, rng.randint(1, 3))
    fills = {p: rng.choice([0, 10, 40, 2000]) for p in range(25)}
    df = spark.createDataFrame([(*e, *x) for e, x in edges.items()], "side int, pattern long, kind int, value long, seed boolean, n long")
    got = {(r.kind, r.value): r.score for r in pii.scored(df, spark.createDataFrame(list(fills.items()), "pattern long, n long"), 4).collect()}
    want = brute_scores(edges, fills, 4)
    assert set(got) == set(want) and any(not any(s for (_, _, k, v), (s, _) in edges.items() if (k, v) == i) for i in want)
    assert all(math.isclose(got[i], want[i]) for i in want)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    some = lambda n: " ".join(word() for _ in range(n))
    out = [f"{some(20)} reach me by phone: +1 (555) 555-{1000 + i} {some(9)}" for i in range(12)]
    out += [f"{some(9)} my address is user{i}@mail{i}.example.org {some(9)}" for i in range(12)]
    unseen = {len(out): ("phone", "(555) 777-1234"), len(out) + 1: ("email", "jane dot doe at mail dot example"), len(out) + 2: ("email", "jane (at) home.example")}
    out += [f"{some(5)} reach me by phone: (555) 777-1234 {some(5)}", f"{some(5)} my address is jane dot doe at mail dot example {some(3)}", f"{some(5)} My address is jane (at) home.example {some(5)}"]
    clean = [f"the part number 555 777 {1000 + i} {some(6)}" for i in range(30)] + [f"{some(5)} the phone {some(4)}" for _ in range(30)] + [f"{some(3)} look at page dot five {some(4)}" for _ in range(5)]
    return out + clean, unseen


def test_patterns_discover_unseen_identifiers(spark, corpus):
    texts, unseen = corpus
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(i, t, "x", "y", 3) for i, t in enumerate(texts)], SCHEMA).repartition(4)).collect()}
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == brute_base(t)
        added = [(pii.KINDS[s.kind], t[s.start : s.end]) for s in got[i].added]
        if i in unseen:
            kind, piece = unseen[i]
            assert [k for k, _ in added] == [kind] and piece.endswith(added[0][1])
        else:
            assert not added, t


def test_odd_rows(spark, corpus):
    rows = [(0, corpus[0][0], "a", "b", 1), (0, corpus[0][0], "a", "b", 1), (None, "jo@x.org", None, None, None), (None, None, None, None, None), (3, "", "", "", 3), (4, "w " * 100_000 + "10.0.0.1", None, None, None)]
    got = [(r.doc_id, len(r.base), r.added) for r in pii.find(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got, key=repr) == sorted([(0, 1, []), (0, 1, []), (None, 1, []), (None, 0, []), (3, 0, []), (4, 1, [])], key=repr)
    assert pii.find(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op13(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        base = brute_base(docs[r.doc_id])
        said = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(r.spans.split(","))
        assert len([x for x in r.spans.split(",") if x]) == len(base) + r.n_added
