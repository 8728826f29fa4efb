"""Personal data by bootstrapped contextual extraction.

Strict patterns find the seeds: e-mail and IP addresses, card and phone numbers. Beside them every text gives its
candidates, pieces in the looser shape of a kind (an address written out with "at" and "dot", a phone number without
its plus, a number that fails its check digit). Seeds and candidates are the instances; a lexical pattern is the one,
two or three words before or after an instance. Instances and patterns form a graph that Spark scores in rounds:

* a pattern's confidence for a kind is the share of known instances among all places where its words occur, counted
  over the whole corpus, and it needs MIN_SUPPORT distinct known instances; candidates of the kind that are not known
  yet count as neither, up to as many as are known;
* an instance's score joins its best pattern on either side, 1 - (1 - left)(1 - right);
* instances that score ACCEPT or more become known and support patterns in the next round.

Every place of a known candidate becomes a span. Base spans always stay, and an added span overlaps none.

Words of patterns are runs of letters (or of bytes beyond ASCII), letter case of A-Z apart, within CONTEXT code points
of the instance. Their sequences travel as 64-bit keys. The places where the words of patterns occur are counted in a
second scan, which asks a bitmap of fixed size whether a key may be a pattern's; what the bitmap lets through wrongly
falls out in the join that follows.

Null and empty texts have no spans. Null and repeated ids and repeated rows are rows of their own. Texts are read
whole, in time linear in their length. Columns other than those asked for are ignored, so none can clash. An empty
table gives an empty result.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, table, tidied

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Distinct known instances that a pattern needs; the least confidence of a pattern and score of an instance; rounds.
MIN_SUPPORT, MIN_CONFIDENCE, ACCEPT, ROUNDS = 3, 0.5, 0.8, 5
#: Code points of text on either side of an instance in which its patterns' words lie, and words of the longest pattern.
CONTEXT, MOST_WORDS = 200, 3
#: 64-bit words of the bitmap of pattern keys.
SLOTS = 1 << 17
#: Bytes whose words are hashed at a time.
SEGMENT = 1 << 20

# ---- base spans; each pattern is written so that no text is read more often than a few times

_TAIL = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+ from left to right, found at the @."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = _TAIL.match(text, at)
        start = done + len(text[done:at].rstrip(_LOCAL))
        if m and start < at:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans in their order."""
    out = [(s, EMAIL, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
                out.append((m.start(), IP, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 40 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                out.append((m.start(), CARD, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                    out.append((m.start(), PHONE, m.end()))
    return sorted(out)


# ---- candidates

_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\])\x20?|\x20at\x20", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]++(?:(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9-]++){0,8}+", re.I)
_LOCAL_PART = re.compile(r"[A-Za-z0-9._%+-]++(?:(?:\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20)[A-Za-z0-9._%+-]++)*+\Z", re.I)
_DOT = re.compile(r"\x20?(?:\.|\(dot\)|\[dot\])\x20?|\x20dot\x20", re.I)
_NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9]++(?:[\x20().:/-]{1,3}[0-9]++)*+")
_IPV6 = re.compile(r"(?<![A-Za-z0-9:])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{0,4}+){3,7}(?![A-Za-z0-9:])")


def normal(kind: int, piece: str) -> str:
    """What pieces have in common that are the same instance of a kind."""
    if kind == EMAIL:
        return _DOT.sub(".", _AT.sub("@", piece, count=1)).lower()
    return piece.lower() if kind == IP else _NOT_DIGIT.sub("", piece)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, possible kinds) of pieces in a looser shape that overlap no base span and not each other: the
    leftmost first, of those the longest.
    """
    found = []
    if "@" in text or (low := text.lower()) and ("(at)" in low or "[at]" in low or " at " in low and " dot " in low):
        for m in _AT.finditer(text):
            host = _HOST.match(text, m.end())
            near = text[max(0, m.start() - CONTEXT) : m.start()] if host else ""
            local = len(near) - len(near.rstrip(_LOCAL))
            if "dot" in near.lower():
                name = _LOCAL_PART.search(near)
                local = len(name.group()) if name else 0
            if host and 0 < local < CONTEXT and (m.group() != " at " or " dot " in host.group().lower()):
                found.append((m.start() - local, host.end(), (EMAIL,)))
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            if text[m.end() : m.end() + 1].isalnum():
                continue
            parts, n = len(_NOT_DIGIT.split(m.group().strip("+("))), len(_NOT_DIGIT.sub("", m.group()))
            dotted = parts == 4 and m.group().count(".") == 3 == len(m.group()) - n
            kinds = tuple(k for k, ok in ((IP, dotted), (CARD, 12 <= n <= 19), (PHONE, 7 <= n <= 15)) if ok)
            if kinds:
                found.append((m.start(), m.end(), kinds))
        if ":" in text:
            found += [(m.start(), m.end(), (IP,)) for m in _IPV6.finditer(text) if _DIGIT.search(m.group())]
    # spans of one kind do not overlap: of those that start before e the last ends last
    starts, ends = ([[t[i] for t in taken if t[1] == k] for k in range(len(KINDS))] for i in (0, 2))
    free = lambda s, e: all(not (i := bisect_left(a, e)) or b[i - 1] <= s for a, b in zip(starts, ends, strict=True))
    out, end = [], -1
    for s, e, kinds in sorted(found, key=lambda x: (x[0], -x[1])):
        if s >= end and free(s, e):
            out.append((s, e, kinds))
            end = e
    return out


# ---- words and keys

_MIX, _STEP = 0x9E3779B97F4A7C15, 0x100000001B3


@functools.cache
def _tables():
    import numpy as np

    lower = np.arange(256, dtype=np.uint64) + np.uint64(1)
    lower[65:91] = lower[97:123]
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True
    powers = np.array([pow(_STEP, i, 1 << 64) for i in range(256)], np.uint64)
    return lower, letter, powers


def _stirred(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def word_keys(data):
    """(place, key) of every word of UTF-8 bytes, in their order; SEGMENT bytes at a time, cut between words."""
    import numpy as np

    lower, letter, powers = _tables()
    places, keys, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data) and letter[data[end]] and letter[data[end - 1]]:
            end += 1
        part = data[at:end]
        at_letter = np.flatnonzero(letter[part])
        if len(at_letter):
            first = np.flatnonzero(np.diff(at_letter, prepend=-2) != 1)
            sizes = np.diff(first, append=len(at_letter))
            inside = np.arange(len(at_letter)) - np.repeat(first, sizes)
            sums = np.add.reduceat(lower[part[at_letter]] * powers[inside & 255], first)
            places.append(at_letter[first] + at)
            keys.append(_stirred(sums + sizes.astype(np.uint64) * np.uint64(_MIX)))
        at = end
    return np.concatenate(places), np.concatenate(keys)


def gram_keys(words, n: int):
    """Keys of all runs of n words, as signed 64-bit numbers."""
    import numpy as np

    if len(words) < n:
        return np.zeros(0, np.int64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = _stirred(out * np.uint64(_STEP) + words[i : len(words) - n + 1 + i])
    return out.view(np.int64)


def contexts(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """(side, key) of the patterns around a span: up to MOST_WORDS words before (side 0) and after it (side 1)."""
    import numpy as np

    _, letter, _ = _tables()
    left, right = text[max(0, start - CONTEXT) : start].encode(), text[end : end + CONTEXT].encode()
    before, after = word_keys(np.frombuffer(left, np.uint8))[1], word_keys(np.frombuffer(right, np.uint8))[1]
    # words that the window or the span cuts are none
    if start > CONTEXT and left and letter[left[0]]:
        before = before[1:]
    if left and letter[left[-1]]:
        before = before[:-1]
    if end + CONTEXT < len(text) and right and letter[right[-1]]:
        after = after[:-1]
    if right and letter[right[0]]:
        after = after[1:]
    out = []
    for n in range(1, MOST_WORDS + 1):
        out += [(0, int(k)) for k in gram_keys(before[len(before) - n :], n)] if len(before) >= n else []
        out += [(1, int(k)) for k in gram_keys(after[:n], n)]
    return out


# ---- first scan: instances and their contexts

_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_IDENTITY = pa.struct([("kind", pa.int32()), ("value", pa.int64())])
_CONTEXT = pa.struct([("side", pa.int32()), ("pattern", pa.int64())])
_FOUND = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("names", pa.list_(_IDENTITY)), ("contexts", pa.list_(_CONTEXT))])
_SQL = (
    "base array<struct<start:bigint,kind:int,end:bigint>>,"
    "found array<struct<start:bigint,end:bigint,seed:boolean,names:array<struct<kind:int,value:bigint>>,contexts:array<struct<side:int,pattern:bigint>>>>"
)


def _value(kind: int, piece: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(normal(kind, piece)) - (1 << 63)


def _instances(batches):
    for b in batches:
        base, found = [], []
        for text in b.column(0):
            text = text.as_py()
            spans = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
            rows = [(s, e, True, (k,)) for s, k, e in spans] + [(s, e, False, k) for s, e, k in candidates(text, spans)]
            found.append(
                [
                    {
                        "start": s, "end": e, "seed": seed, "names": [{"kind": k, "value": _value(k, text[s:e])} for k in kinds],
                        "contexts": [{"side": side, "pattern": key} for side, key in contexts(text, s, e)],
                    }
                    for s, e, seed, kinds in rows
                ]
            )
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(base, pa.list_(_SPAN)), pa.array(found, pa.list_(_FOUND))], [*b.schema.names[1:], "base", "found"])


# ---- second scan: how often the words of patterns occur


def occurrences(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """pattern, n: how often each of patterns (pattern) occurs in the texts."""
    slots = patterns.select(F.pmod(F.shiftright("pattern", 6), F.lit(SLOTS)).alias("slot"), F.expr("shiftleft(1L, cast(pattern & 63 AS int))").alias("bit"))
    # at most SLOTS rows
    bits = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()

    def counted(batches):
        import numpy as np

        bitmap = np.zeros(SLOTS, np.uint64)
        bitmap[bits["slot"].to_numpy()] = bits["bits"].to_numpy().astype(np.int64).view(np.uint64)
        for b in batches:
            column = b.column(0).cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
            got, at = [], 0
            while at < len(column):  # some texts at a time, one newline between them
                end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SEGMENT)) - 1)
                places, words = word_keys(data[offsets[at] : offsets[end]]) if end == at + 1 else word_keys(np.insert(data[offsets[at] : offsets[end]], offsets[at + 1 : end] - offsets[at], 10))
                text_of = np.searchsorted(offsets[at + 1 : end] - offsets[at] + np.arange(end - at - 1), places)
                for n in range(1, MOST_WORDS + 1):
                    keys = gram_keys(words, n)
                    keys = keys[text_of[: len(keys)] == text_of[n - 1 :]] if n > 1 else keys
                    hit = bitmap[(keys >> 6) % SLOTS] >> (keys & 63).view(np.uint64) & np.uint64(1)
                    got.append(keys[hit != 0])
                at = end
            keys, n = np.unique(np.concatenate(got), return_counts=True) if got else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["pattern", "n"])

    seen = docs.select(F.coalesce(text, F.lit("")).alias("text")).mapInArrow(tidied(counted), "pattern long, n long")
    return seen.groupBy("pattern").agg(F.sum("n").alias("n")).join(patterns, "pattern", "left_semi")


# ---- the graph


def scored(edges: DataFrame, fills: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """kind, value, score of all known instances.

    edges: side, pattern, kind, value, seed, n (places); fills: pattern, n.
    """
    node, link = ["side", "pattern", "kind"], ["kind", "value"]
    edges = edges.join(fills.withColumnRenamed("n", "fills"), "pattern")
    seeds = edges.filter("seed").select(*link).distinct().withColumn("score", F.lit(1.0))
    known = seeds = checkpointed(seeds)
    for _ in range(rounds):
        # a value may be a seed in one place and a candidate in another: it is known in both
        with_score = edges.join(known, link, "left")
        sums = with_score.groupBy(*node, "fills").agg(
            F.sum(F.col("n") * F.coalesce("score", F.lit(0.0))).alias("hits"),
            F.sum(F.when(F.col("score").isNull(), F.col("n")).otherwise(0)).alias("unknown"),
            F.count_distinct(F.when(F.col("score").isNotNull(), F.col("value"))).alias("support"),
        )
        confidence = F.col("hits") / (F.greatest(F.col("fills") - F.least("unknown", "hits"), "hits") + 1)
        patterns = sums.filter(F.col("support") >= MIN_SUPPORT).select(*node, confidence.alias("confidence")).filter(F.col("confidence") >= MIN_CONFIDENCE)
        best = edges.join(patterns, node).groupBy(*link, "side").agg(F.max("confidence").alias("c"))
        instances = best.groupBy(*link).agg((1 - F.coalesce(F.max(F.when(F.col("side") == 0, 1 - F.col("c"))), F.lit(1.0)) * F.coalesce(F.max(F.when(F.col("side") == 1, 1 - F.col("c"))), F.lit(1.0))).alias("score"))
        now = checkpointed(seeds.unionByName(instances.filter(F.col("score") >= ACCEPT).join(seeds, link, "left_anti")))
        if now.count() == known.count():
            return now
        known = now
    return known


def find(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """The columns `keep` of every row of docs with base and added: arrays of (start, kind, end), kind an index into KINDS."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    rows = docs.select(F.coalesce(text, F.lit("")).alias("_text"), *keep).mapInArrow(tidied(_instances), f"{fields}, {_SQL}")
    rows = checkpointed(rows.withColumn("_row", F.monotonically_increasing_id()))
    places = rows.select("_row", F.explode("found").alias("f")).select("_row", "f.*").withColumn("name", F.explode("names")).select("*", "name.*")
    edges = places.select("kind", "value", "seed", F.explode("contexts").alias("c")).groupBy("c.side", "c.pattern", "kind", "value").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    edges = checkpointed(edges)
    # patterns that could ever have the support
    pool = edges.groupBy("side", "pattern", "kind").count().filter(F.col("count") >= MIN_SUPPORT).select("side", "pattern", "kind")
    pool = checkpointed(pool)
    fills = checkpointed(occurrences(docs, pool.select("pattern").distinct(), text))
    # instances without such a pattern stay in the graph as what they are
    known = scored(edges.join(pool, ["side", "pattern", "kind"], "left_semi"), fills, rounds)
    seeds = places.filter("seed").select("kind", "value").distinct().withColumn("score", F.lit(1.0))
    known = known.unionByName(seeds).groupBy("kind", "value").agg(F.max("score").alias("score"))
    new = places.filter(~F.col("seed")).join(known, ["kind", "value"])
    new = new.groupBy("_row", "start", "end").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
    new = new.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    return rows.join(new, "_row", "left").withColumn("added", F.coalesce("added", F.expr("cast(array() AS array<struct<start:bigint,kind:int,end:bigint>>)"))).drop("_row", "found")


def written(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return df.select(
        "doc_id", *map(count, range(4)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added")
    )
