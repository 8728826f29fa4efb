"""Fill-in-the-middle against a plain reading of its definition, with chunks of every size."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hopframe.llm import fim

SCHEMA = "doc_id long, text string, output string, size long"


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fim.MARKS):
        return n, "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", "é", "😀", "\n", "\n\n", " ", "<", "P>", "<M", ">", "S", "word "]) for _ in range(rng.randint(1, 300))) for _ in range(80)]
    texts += [None, "", "\n", "\n\n\n", "a", "a\n", "\na", "<P>", "x<S", "<<S>y", "<P<M>", "no newline " * 500, "line\n" * 3000, "line\n" * 3000, "<P", ">", "\r\n\x0b", "a" * 70_000 + "\nb"]
    out = [(i, t, "clash", 5) for i, t in enumerate(texts)]
    return [*out, out[2], out[2], (None, "null\nid\n", None, None), (None, None, None, None), (2, "another\ntext under an id in use", "x", 1)]


@pytest.mark.parametrize("chunk", [3, 64, fim.CHUNK])
def test_equals_brute_force(spark, rows, chunk):
    got = fim.transformed(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fim.restored().alias("back"), "size").collect()
    want = [(d, *brute(d, t), t or "", z) for d, t, _, z in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_functions_compose_over_every_cut(rows):
    marked, inside = fim.automaton()[3:]
    for _, text, _, _ in rows[:100]:
        data = np.frombuffer((text or "").encode(), np.uint8)
        whole = fim.transition(fim.symbols(data)[1])
        for cut in range(0, len(data) + 1, max(1, len(data) // 7)):
            (to_a, n_a), (to_b, n_b) = (fim.transition(fim.symbols(x)[1]) for x in (data[:cut], data[cut:]))
            assert (to_b[to_a] == whole[0]).all() and (n_a + n_b[to_a] == whole[1]).all()
        assert bool(marked[whole[0][0]]) == any(m in (text or "") for m in fim.MARKS)
        assert whole[1][0] + inside[whole[0][0]] == len(re.findall(r"[^\n]*\n|[^\n]+", text or ""))


def test_rates_and_empty_table(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.form for r in fim.transformed(df, rate_percent=0).select("form").distinct().collect()} == {"plain"}
    assert "spm" not in {r.form for r in fim.transformed(df, spm_percent=0).select("form").distinct().collect()}
    assert fim.transformed(spark.createDataFrame([], SCHEMA)).count() == 0


def test_equals_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(fim.ORACLE_SQL)
    df = fim.op11(spark, sf)
    assert df.columns == rel.columns
    assert sorted(map(tuple, df.collect())) == sorted(rel.fetchall())
    assert df.filter(F.col("restored_sha256").isNull()).count() == 0
