"""Disguises of every kind, and the whole of learning and scoring in plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hopframe.llm import toxicity as tx

BAD = ["scumbag", "idiot", "moron", "ass", "vermin"]


def corpus():
    rng = random.Random(8)
    words = ["".join(rng.choice(["ba", "ne", "ti", "lo", "su", "ra", "mi", "do"]) for _ in range(rng.randint(1, 4))) for _ in range(150)]
    disguise = [lambda w: w, lambda w: " ".join(w), lambda w: "  ".join(w), lambda w: w.replace("i", "1").replace("s", "$"), lambda w: w.replace("o", "ooo")]
    docs, labels = [], []
    for i in range(600):
        text = [rng.choice(words) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                text.insert(rng.randrange(len(text)), rng.choice(disguise)(rng.choice(BAD)))
        docs.append((i, " ".join(text)))
        if i % 10:
            labels.append((i, 1, int(toxic)))
    docs += [(None, "idiot"), (3, "another text"), (601, None), (602, "")]
    return docs, [*labels, (5, 1, 1), (7, 1, None), (9999, 0, 1)]


@pytest.fixture(scope="module")
def restorer():
    text = " ".join(["a big ass of an idiot"] * 50 + ["some other words of the text"] * 20)
    return tx.Restorer(Counter(tx.trigram_index(text).tolist()))


@pytest.mark.parametrize(
    "text,word",
    [("you a s s now", "ass"), ("you i  d  i  o  t now", "idiot"), ("you a$$ now", "ass"), ("an 1d10t", "idiot"), ("i-d-i-o-t", "idiot"), ("i. d. i. o. t", "idiot"), ("i - d - i - o - t", "idiot"), ("idiiiiot", "idiot")],
)
def test_disguises_are_restored(restorer, text, word):
    assert word in restorer.words(text)


def shrunk(t, n, toxic, all_):
    c = n - t
    odds = math.log((t + 0.5) / (toxic - t + 0.5)) - math.log((c + 0.5) / (all_ - toxic - c + 0.5))
    error = math.sqrt(1 / (t + 0.5) + 1 / (toxic - t + 0.5) + 1 / (c + 0.5) + 1 / (all_ - toxic - c + 0.5))
    return max(odds - tx.ERRORS * error, 0.0) if t >= tx.SUPPORT else 0.0


def beginnings(w):
    return {w} | {w[:n] + "*" for n in tx.BEGINNINGS if len(w) > n}


def slope(x, y, w):
    """The gradient of the penalised loss at w; the loss is convex, so zero only at its least."""
    x = np.hstack([x, np.ones((len(x), 1))])
    keep = np.array([1e-3 * len(x)] * (x.shape[1] - 1) + [1e-9])
    return x.T @ (y - 1 / (1 + np.exp(-x @ w))) - keep * w


def test_learning_and_scores_in_plain_python(spark):
    docs, labels = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    model = tx.learn(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    # the half of a text is a hash of its id: Spark's own, as which half is which does not matter to the method
    half = {r[0]: r[1] for r in df.selectExpr("doc_id", "pmod(xxhash64(doc_id), 2)").distinct().collect()}
    counts = Counter()
    for _, t in docs:
        counts.update(tx.trigram_index(t or "").tolist())
    assert model.counts == counts
    toxic = {}
    for d, _, t in labels:
        if t is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            toxic[d] = max(toxic.get(d, 0), t)
    restore = tx.Restorer(counts)
    taught = {d: (restore.parts(t), toxic[d], half[d]) for d, t in docs if d in toxic and (d != 3 or t != "another text")}
    if tx_first := [r[0] for r in df.filter("doc_id = 3").selectExpr("text", "xxhash64(text) AS h").orderBy("h").select("text").collect()]:
        if 3 in toxic:
            taught[3] = (restore.parts(tx_first[0]), toxic[3], half[3])
    lexicons = []
    for keep in (None, 1, 0):  # all, and for either half the other one's
        rows = [(p, y) for p, y, h in taught.values() if keep is None or h == keep]
        seen, bad = Counter(), Counter()
        for (words, apart, _), y in rows:
            es = {e for w in words | apart for e in beginnings(w)}
            seen.update(es)
            bad.update(es if y else ())
        total = sum(y for _, y in rows)
        lexicons.append({e: v for e in seen if (v := shrunk(bad[e], seen[e], total, len(rows))) > 0})
    assert set(model.lexicon) == set(lexicons[0]) and all(math.isclose(model.lexicon[e], v) for e, v in lexicons[0].items())
    assert {"idiot", "moron"} <= set(lexicons[0])

    def features(parts, lexicon):
        words, apart, tokens = parts
        best = {w: max((lexicon.get(e, 0.0) for e in beginnings(w)), default=0.0) for w in words | apart}
        for x in apart:
            best |= {x[i:j]: lexicon[x[i:j]] for i in range(len(x)) for j in range(i + 4, min(len(x), i + 24) + 1) if x[i:j] in lexicon}
        found = [v for v in best.values() if v]
        return max(found, default=0.0), math.log1p(math.fsum(found)), math.log1p(tokens)

    weights, x = np.array(model.weights), np.array([features(p, lexicons[1 + h]) for p, _, h in taught.values()])
    assert np.abs(slope(x, np.array([y for _, y, _ in taught.values()]), weights)).max() < 1e-5
    own = Counter()
    for (words, apart, _), _, _ in taught.values():
        own.update(tx.trigram_index("\n".join(sorted(w for w in words | apart if max(lexicons[0].get(e, 0.0) for e in beginnings(w)) >= tx.STRONG))).tolist())
    assert model.own == own
    final = tx.Restorer(counts, own)
    want = Counter()
    for d, t in docs:
        z = float(np.dot(weights, (*features(final.parts(t), lexicons[0]), 1.0)))
        want[d, round(1 / (1 + math.exp(-z)), 9)] += 1
    got = tx.score(df, model).collect()
    assert Counter((r.doc_id, round(r.score, 9)) for r in got) == want
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.3) for r in got)
    hits = [(r.predicted, (r.doc_id or 0) % 4 == 0) for r in got if r.held_out]
    assert sum(p == y for p, y in hits) >= 0.9 * len(hits)
