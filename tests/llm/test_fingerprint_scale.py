"""The plan of the fingerprints does not grow with the rows, and near copies are found over all pairs of documents."""

import glob
import re
import time
from collections import defaultdict

import pytest

from hopframe.llm import fingerprints

RECALL_DIR = "/root/testdata/sf0.1"


def test_many_cut_points_make_no_plan(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "ROWS_PER_BUCKET", 1)
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('word ', id, ' and some more words of a text') AS text")
    start = time.time()
    df = fingerprints.in_falling_order(docs)
    rows = df.filter("not ghost").selectExpr("doc_id", "next_text").collect()
    assert time.time() - start < 120
    assert len(df._jdf.queryExecution().toString()) < 200_000
    assert {r.doc_id: r.next_text.split()[1] for r in rows} == {i: str(i - 1 if i else 19_999) for i in range(20_000)}


def similar_pairs(texts, share=0.8):
    """Pairs of different texts whose five-word shingles are at least `share` alike; every pair that shares one of the
    rarest shingles that a pair this alike must share is compared."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets.append({" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set())
    count = defaultdict(int)
    for s in sets:
        for x in s:
            count[x] += 1
    found, lists = set(), defaultdict(list)
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (count[x], x))[: len(s) - int(-(-share * len(s) // 1)) + 1]:
            for j in lists[x]:
                if (j, i) not in found and len(s & sets[j]) >= share * len(s | sets[j]):
                    found.add((j, i))
            lists[x].append(i)
    return found


def recall(spark, folder):
    texts = sorted({r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").collect() if r.text})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
    fp = {r.i: ((r.fp.a & (2**64 - 1)) << 64) | (r.fp.b & (2**64 - 1)) for r in fingerprints.fingerprints(df, ["i"], "text").collect()}
    pairs = similar_pairs(texts)
    return sum((fp[i] ^ fp[j]).bit_count() <= fingerprints.RADIUS for i, j in pairs), len(pairs)


@pytest.mark.skipif(not glob.glob(RECALL_DIR), reason="needs the test tables")
def test_recall_over_all_pairs(spark):
    found, total = recall(spark, RECALL_DIR)
    assert total >= 10 and found >= 0.9 * total
