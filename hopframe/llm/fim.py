"""Fill-in-the-middle transformation: a parallel automaton scan finds where the units of a text end.

One automaton reads bytes. Its states are pairs of (in a unit or between units) and (how much of a marker has been
read); it tells how many units a text has and whether the text holds a marker already. A text of at most CHUNK code
points is scanned where it is read. A longer one is cut into chunks that are dealt out: each chunk gives its
state-transition function, the end state for every start state, and the units that end in it for every start state.
Functions compose associatively, so the entry state of every chunk and the units before it come from the functions
alone; the chunk that holds a cut is then known, and only that chunk is read again to find the cut's place.

Null and empty texts have no units and stay plain. Null ids draw like the empty id. Repeated rows are transformed one
by one and alike. Texts of any length are whole. Other columns pass through, and names of results that clash with a
column of the input replace it. An empty table gives an empty result.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, ByteType, LongType, StructType

from hopframe.llm.common import checkpointed, partitions_for, table

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Code points of a chunk.
CHUNK = 1 << 16
#: Chunks a task scans, about.
CHUNKS_EACH = 64
SEED, RATE_PERCENT, SPM_PERCENT = 7, 100, 50
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")

# ---- the automaton


@functools.cache
def automaton(marks: tuple[str, ...] = MARKS, end: str = "\n"):
    """classes (byte to class; class 0 is any byte without a meaning), steps (state x class), ends (class: a unit
    ends here), marked (state: a marker was read) and inside (state: in a unit that has not ended).

    Markers are matched as by one trie with failure links; a marker read is never forgotten.
    """
    import numpy as np

    words = [m.encode() for m in marks]
    letters = sorted(set(b"".join(words)) | set(end.encode()))
    classes = np.zeros(256, np.uint8)
    for c, b in enumerate(letters, 1):
        classes[b] = c
    heads = sorted({w[:k] for w in words for k in range(len(w))}, key=lambda h: (len(h), h))
    found = len(heads)

    def read(head: bytes, byte: int | None) -> int:
        if byte is None:
            return 0
        seen = head + bytes([byte])
        if any(seen.endswith(w) for w in words):
            return found
        return heads.index(max((h for h in heads if seen.endswith(h)), key=len))

    states = [(inside, m) for inside in (0, 1) for m in range(found + 1)]
    steps = np.zeros((len(states), len(letters) + 1), np.uint8)
    for s, (_, m) in enumerate(states):
        for c, byte in enumerate([None, *letters]):
            at = found if m == found else read(heads[m], byte)
            steps[s, c] = states.index((0 if byte == ord(end) else 1, at))
    ends = np.array([False] + [b == ord(end) for b in letters])
    return classes, steps, ends, np.array([m == found for _, m in states]), np.array([bool(i) for i, _ in states])


def symbols(data):
    """(places, classes) of the bytes that can change the state: in a run of bytes without a meaning only the first can."""
    import numpy as np

    cls = automaton()[0][data]
    keep = cls != 0
    keep[1:] |= keep[:-1]
    keep[:1] = True
    at = np.flatnonzero(keep)
    return at, cls[at]


def transition(cls):
    """(end state, units ended) of a run of classes for every start state, by composing neighbours pairwise."""
    import numpy as np

    _, steps, ends, _, _ = automaton()
    if not len(cls):
        return np.arange(len(steps)), np.zeros(len(steps), np.int64)
    to, n = steps.T[cls].astype(np.int64), np.repeat(ends[cls].astype(np.int64)[:, None], len(steps), 1)
    while len(to) > 1:
        odd = (to[-1:], n[-1:]) if len(to) % 2 else (to[:0], n[:0])
        a, b, na, nb = to[: len(to) // 2 * 2 : 2], to[1::2], n[: len(to) // 2 * 2 : 2], n[1::2]
        to = np.concatenate([np.take_along_axis(b, a, 1), odd[0]])
        n = np.concatenate([na + np.take_along_axis(nb, a, 1), odd[1]])
    return to[0], n[0]


def chars(data) -> int:
    """Code points that begin in these bytes."""
    import numpy as np

    return int(np.count_nonzero((data & 0xC0) != 0x80))


def end_of(data, at, cls, nth: int) -> int:
    """Code points up to the end of the nth unit (from 1) that ends in this run, or of all of it."""
    import numpy as np

    if nth <= 0:
        return 0
    places = at[np.flatnonzero(automaton()[2][cls])]
    return chars(data[: places[nth - 1] + 1]) if nth <= len(places) else chars(data)


def _texts(column):
    """The UTF-8 bytes of each text of an Arrow string column."""
    import numpy as np

    column = column.cast(pa.large_string())
    offsets, data = np.frombuffer(column.buffers()[1], np.int64), column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [data[offsets[i] : offsets[i + 1]] for i in range(column.offset, column.offset + len(column))]


@F.arrow_udf(StructType().add("n", LongType()).add("marked", BooleanType()).add("lo", LongType()).add("hi", LongType()))
def _scan(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    """Units, marker and both cuts of whole texts."""
    _, _, _, marked, inside = automaton()
    out = []
    for data, a, b in zip(_texts(text), h1.to_pylist(), h2.to_pylist(), strict=True):
        at, cls = symbols(data)
        to, ended = transition(cls)
        n = int(ended[0]) + int(inside[to[0]])
        cuts = sorted((a % (n + 1), b % (n + 1)))
        out.append({"n": n, "marked": bool(marked[to[0]]), "lo": end_of(data, at, cls, cuts[0]), "hi": end_of(data, at, cls, cuts[1])})
    return pa.array(out, pa.struct([("n", pa.int64()), ("marked", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64())]))


@F.arrow_udf(StructType().add("to", ArrayType(ByteType())).add("ended", ArrayType(LongType())))
def _chunk_function(piece: pa.Array) -> pa.Array:
    """The transition function of each chunk."""
    got = [transition(symbols(data)[1]) for data in _texts(piece)]
    return pa.array([{"to": to.tolist(), "ended": n.tolist()} for to, n in got], pa.struct([("to", pa.list_(pa.int8())), ("ended", pa.list_(pa.int64()))]))


@F.arrow_udf(LongType())
def _end_in_chunk(piece: pa.Array, nth: pa.Array) -> pa.Array:
    return pa.array([end_of(data, *symbols(data), k) for data, k in zip(_texts(piece), nth.to_pylist(), strict=True)], pa.int64())


# ---- documents


def draws(seed: int = SEED, doc_id: str = "doc_id") -> list[Column]:
    """h1 to h4 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def composed(functions: DataFrame) -> DataFrame:
    """_key, n, marked and, for each cut, its chunk and the units that end in that chunk up to the cut.

    functions: _key, h1, h2, k, f, a row a chunk. The functions of one text are some 70 bytes for each chunk of 65,536
    code points, a small part of the row that the text itself was.
    """
    states, inside, marked = len(automaton()[1]), automaton()[4], automaton()[3]
    flags = lambda v: F.array(*(F.lit(bool(x)) for x in v))
    df = functions.groupBy("_key", "h1", "h2").agg(F.array_sort(F.collect_list(F.struct("k", "f"))).alias("c"))
    # states and counts on the way in, one entry a chunk, and the state at the end
    walk = """aggregate(c, named_struct('s', 0, 'n', 0L, 'before', cast(array() AS array<bigint>)),
                        (a, x) -> named_struct('s', cast(get(x.f.to, a.s) AS int), 'n', a.n + get(x.f.ended, a.s), 'before', concat(a.before, array(a.n))))"""
    df = df.withColumn("w", F.expr(walk)).withColumn("n", F.col("w.n") + F.get(flags(inside), F.col("w.s")).cast("long"))
    assert states < 128  # tinyint holds a state
    df = df.withColumns({"_a": F.col("h1") % (F.col("n") + 1), "_b": F.col("h2") % (F.col("n") + 1), "marked": F.get(flags(marked), F.col("w.s"))})
    df = df.withColumns({"_lo": F.least("_a", "_b"), "_hi": F.greatest("_a", "_b")})
    # the last chunk with fewer units before it than the cut asks for; a unit that spans chunks ends in that one
    chunk = lambda cut: F.greatest(F.size(F.filter("w.before", lambda v: v < F.col(cut))), F.lit(1)) - 1
    cut = lambda c: F.struct(chunk(c).cast("long").alias("k"), (F.col(c) - F.get(F.col("w.before"), chunk(c))).alias("nth"))
    return df.select("_key", "n", "marked", cut("_lo").alias("lo"), cut("_hi").alias("hi"))


def _long(docs: DataFrame, chunk: int) -> DataFrame:
    """Cuts of texts of several chunks: _doc, text, h1 to h4 and cut."""
    spark = docs.sparkSession
    docs = checkpointed(docs.withColumn("_key", F.monotonically_increasing_id()))
    cuts = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))
    pieces = docs.select("_key", "h1", "h2", F.posexplode(cuts).alias("k", "piece")).withColumn("k", F.col("k").cast("long"))
    n = partitions_for(spark, docs.select(F.sum(F.char_length("text"))).first()[0] or 0, chunk * CHUNKS_EACH)
    pieces = checkpointed(pieces.repartition(n, "_key", "k"))
    whole = checkpointed(composed(pieces.select("_key", "h1", "h2", "k", _chunk_function("piece").alias("f"))))
    # at most two chunks of a text are read again
    asked = whole.select("_key", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("c")).select("_key", "c.k", "c.nth")
    found = asked.join(pieces.select("_key", "k", "piece"), ["_key", "k"]).select("_key", "k", "nth", (F.col("k") * chunk + _end_in_chunk("piece", "nth")).alias("at"))
    places = found.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("k", "nth"), "at"))).alias("at"))
    cut = whole.join(places, "_key").select("_key", F.struct("n", "marked", F.col("at")[F.col("lo")].alias("lo"), F.col("at")[F.col("hi")].alias("hi")).alias("cut"))
    return docs.join(cut, "_key").drop("_key")


def transformed(docs: DataFrame, seed: int = SEED, rate_percent: int = RATE_PERCENT, spm_percent: int = SPM_PERCENT, chunk: int = CHUNK) -> DataFrame:
    """docs with n (lines), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    kept = [c for c in docs.columns if c not in RESULTS]
    df = docs.select(F.struct(*kept).alias("_doc"), F.coalesce("text", F.lit("")).alias("text"), *draws(seed))
    wide = F.char_length("text") > chunk
    parts = df.filter(~wide).withColumn("cut", _scan("text", "h1", "h2")).unionByName(_long(df.filter(wide), chunk))
    plain = (F.col("text") == "") | F.col("cut.marked") | (F.col("h3") % 100 >= rate_percent)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    lo, hi, text = F.col("cut.lo").cast("int"), F.col("cut.hi").cast("int"), F.col("text")
    p, s, m = (F.lit(x) for x in MARKS)
    prefix, middle, suffix = F.substring(text, F.lit(1), lo), F.substring(text, lo + 1, hi - lo), F.substring(text, hi + 1, F.lit(2**31 - 1))
    output = F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle)).otherwise(text)
    df = parts.withColumn("form", form)
    return df.select(
        *(F.col("_doc")[c].alias(c) for c in kept),
        F.col("cut.n").alias("n"),
        "form",
        F.when(F.col("form") != "plain", F.col("cut.lo")).alias("prefix_chars"),
        F.when(F.col("form") != "plain", F.col("cut.hi") - F.col("cut.lo")).alias("middle_chars"),
        output.alias("output"),
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output was made of. Cut texts hold no marker, so the markers part the output."""
    part = lambda k: F.get(F.split(output, "|".join(MARKS), -1), F.lit(k))
    return F.when(F.col(form) == "psm", F.concat(part(1), part(3), part(2))).when(F.col(form) == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col(output))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return df.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u
  FROM documents
), c AS (
  SELECT doc_id, text, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS a, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
              WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM d
), p AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS prefix,
         array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS middle, array_to_string(u[greatest(a, b) + 1:], '') AS suffix
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
