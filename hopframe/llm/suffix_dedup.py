"""Suffix-array deduplication: every byte covered by a 100-byte string that also starts earlier is removed.

Sorting all suffixes of a corpus would move every byte a hundred times. Instead the suffixes at minimizers are sorted:
each 100-byte window holds the 32-byte gram with the least hash among its own, so equal windows hold equal grams at
equal offsets, and every repeat meets at a shared anchor.

1. A scan finds the anchors of each text, about 3 in 100 bytes, with a hash of the gram and one of all the bytes that
   the windows around it can reach (its context).
2. Anchors meet by gram. Of those with equal contexts all but the first are covered whole, which a task's own anchors
   settle before the shuffle. Where a gram has several contexts, only the first anchor of each goes on.
3. Those anchors' contexts are gathered by gram. The texts to the right and the reversed texts to the left of a gram
   are sorted deep-shallow: multikey quicksort to a shallow depth, then a blind trie for what still agrees. Common
   prefixes in the two orders tell for each offset which windows are equal, and all but the first are covered.
   A gram with more contexts than a task should hold goes by the hashes of its windows instead, pre-aggregated.
4. Covered spans join the texts, which are cut and hashed.

Order is by id, then by a hash of the text; null ids come first. Null texts count as empty. Rows that repeat id and
text are one document and share a result; such a row is no earlier copy of itself. Texts under 100 bytes lose
nothing. An empty table gives no rows. Other columns pass through the stage, not the query.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, partitions_for, ranked, table, tidied

LENGTH, GRAM = 100, 32
SIDE = LENGTH - GRAM  # bytes on each side that windows with a gram can reach
POS_BITS = 21
#: Bytes hashed at a time; anchors held in a task before they are thinned; documents a partition stands for.
CHUNK, FLUSH, DOCS_PER_PART = (1 << POS_BITS) - 1024, 800_000, 6_000
#: Contexts of one gram that a task sorts.
HOT_GROUP = 200_000
SHALLOW = 8
_NULL_ID = -(1 << 63)
_tables: dict[str, object] = {}


def _constants():
    import numpy as np

    if not _tables:
        base, n = 0x9E3779B97F4A7C15, CHUNK + 1024
        _tables["byte"] = np.random.default_rng(20240501).integers(0, 1 << 64, 256, np.uint64)
        for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
            x = np.full(n + 1, b, np.uint64)
            x[0] = 1
            _tables[name] = np.cumprod(x, dtype=np.uint64)
    return _tables["byte"], _tables["power"], _tables["inverse"]


def _mixed(x, k: int):
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(k)
    return x ^ (x >> np.uint64(29))


def anchors(data, lo, hi, first, last):
    """place, gram hash, context hash, left, right of the anchors in a buffer of texts.

    Text k is data[lo[k]:hi[k]]; of its windows those that start in [first[k], last[k]) are looked at.
    """
    import numpy as np

    byte, power, inverse = _constants()
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(byte[data] * power[:n], out=prefix[1:])
    grams = n - GRAM + 1
    empty = np.empty(0, np.int64)
    if grams < SIDE + 1:
        return empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty
    hashes = _mixed((prefix[GRAM:] - prefix[:grams]) * inverse[:grams], 0xD6E8FEB86659FD93)
    # the least hash of each window with its place: leftmost of equals
    m = (hashes >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= SIDE + 1:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    rest = SIDE + 1 - span
    m = np.minimum(m[: len(m) - rest], m[rest:]) if rest else m
    wanted = np.zeros(len(m) + 1, np.int8)
    ok = last > first
    np.add.at(wanted, first[ok], 1)
    np.add.at(wanted, last[ok], -1)
    chosen = np.zeros(grams, bool)
    chosen[(m[np.cumsum(wanted[:-1], dtype=np.int8) > 0] & np.uint64((1 << POS_BITS) - 1)).astype(np.int64)] = True
    place = np.flatnonzero(chosen)
    text = np.searchsorted(hi, place, side="right")
    left = np.minimum(place - lo[text], SIDE)
    right = np.minimum(hi[text] - place - GRAM, SIDE)
    b, e = place - left, place + GRAM + right
    context = _mixed((prefix[e] - prefix[b]) * inverse[b] + _mixed((left * 128 + right + 1).astype(np.uint64), 0xA24BAED4963EE407), 0x9FB21C651E98DF25)
    return place, hashes[place], context, left, right


def chunked(ids, texts):
    """(ids, starts in the text, data, lo, hi, first, last) of buffers no longer than CHUNK, long texts overlapping."""
    import numpy as np

    part: list = []
    size = 0

    def out():
        lens = np.array([len(x[2]) for x in part], np.int64)
        hi = np.cumsum(lens)
        lo = hi - lens
        first, last = lo + np.array([x[3] for x in part]), lo + np.array([x[4] for x in part])
        return np.array([x[0] for x in part], np.int64), np.array([x[1] for x in part], np.int64), np.frombuffer(b"".join(x[2] for x in part), np.uint8), lo, hi, first, last

    for i, t in zip(ids, texts, strict=True):
        windows = len(t) - LENGTH + 1
        step = CHUNK - 4 * LENGTH
        for s in range(0, max(0, windows), step):
            e = min(windows, s + step)
            # the bytes that contexts of these windows' anchors reach
            b, f = max(0, s - SIDE), min(len(t), e + LENGTH + SIDE)
            if size + f - b > CHUNK and part:
                yield out()
                part, size = [], 0
            part.append((i, b, t[b:f], s - b, e - b))
            size += f - b
    if part:
        yield out()


def _pack(bucket, arrays, kind: bytes):
    """Rows (bucket, blob): the arrays' entries of each bucket one array after another."""
    import numpy as np

    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [a[order] for a in arrays]
    at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    ends = np.append(at[1:], len(bucket)) if len(bucket) else at
    blobs = [kind + b"".join(a[s:e].tobytes() for a in arrays) for s, e in zip(at, ends, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[at].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "blob"])


def _unpack(blobs: list[bytes], types):
    import numpy as np

    width = sum(np.dtype(t).itemsize for t in types)
    cols: list[list] = [[np.empty(0, t)] for t in types]
    for b in blobs:
        k, at = (len(b) - 1) // width, 1
        for c, t in zip(cols, types, strict=True):
            c.append(np.frombuffer(b, t, k, at))
            at += k * np.dtype(t).itemsize
    return [np.concatenate(c) for c in cols]


def _spread(ids, buckets: int):
    import numpy as np

    return (_mixed(ids.astype(np.uint64), 0xD6E8FEB86659FD93) % np.uint64(buckets)).astype(np.int64)


def merged(starts, ends):
    """Sorted disjoint spans that cover the same bytes; touching spans are one."""
    import numpy as np

    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def _merge_by(ids, starts, ends):
    """The spans of each id merged."""
    import numpy as np

    if not len(ids):
        return ids, starts, ends
    _, k = np.unique(ids, return_inverse=True)
    width = int(ends.max()) + 2
    s, e = merged(k * width + starts, k * width + ends)
    own = np.unique(ids)[s // width]
    return own, s % width, e - (s - s % width)


_ANCHOR = ("u8", "u8", "i8", "u4", "u1", "u1")  # gram, context, id, place, left, right
_SPAN = ("i8", "i8", "i8")  # id, start, end
_ASK = ("i8", "i8", "u8", "i1")  # id, place, gram, hot


def _first_of_each(gram, context, id_, place):
    """The order by gram, context, id, place and where a new gram, and a new context of it, begins."""
    import numpy as np

    order = np.lexsort((place, id_, context, gram))
    g, c = gram[order], context[order]
    new_gram = np.append(True, g[1:] != g[:-1]) if len(g) else np.empty(0, bool)
    new = new_gram | np.append(True, c[1:] != c[:-1]) if len(g) else new_gram
    return order, new_gram, new


def repeated_anchors(docs: DataFrame, parts: int) -> DataFrame:
    """id, spans, asks: what each document with repeats has covered at once, and its anchors whose contexts differ."""
    buckets = 4 * parts

    def post(batches):
        import numpy as np

        held: list = []
        count = 0

        def flush():
            gram, context, id_, place, left, right = (np.concatenate([h[k] for h in held]) for k in range(6))
            order, _, new = _first_of_each(gram, context, id_, place)
            later = order[~new]
            spans = _merge_by(id_[later], place[later] - left[later], place[later] + GRAM + right[later])
            keep = np.sort(order[new])
            yield _pack((gram[keep] % np.uint64(buckets)).astype(np.int64), [x[keep].astype(t) for x, t in zip((gram, context, id_, place, left, right), _ANCHOR, strict=True)], b"p")
            yield _pack(_spread(spans[0], buckets), [x.astype("i8") for x in spans], b"s")

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                for ids, begin, data, lo, hi, first, last in chunked(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    place, gram, context, left, right = anchors(data, lo, hi, first, last)
                    text = np.searchsorted(hi, place, side="right")
                    held.append((gram, context, ids[text], place - lo[text] + begin[text], left, right))
                    count += len(place)
                    if count >= FLUSH:
                        yield from flush()
                        held, count = [], 0
        if held:
            yield from flush()
        _tables.clear()  # workers outlive their tasks

    def meet(batches):
        import numpy as np

        posts, spans = [], []
        for b in batches:
            for blob in b.column(1).to_pylist():
                (posts if blob[:1] == b"p" else spans).append(blob)
        for s in spans:
            yield pa.RecordBatch.from_arrays([pa.array(_spread(_unpack([s], _SPAN)[0][:1], buckets)), pa.array([s], pa.binary())], ["bucket", "blob"])
        gram, context, id_, place, left, right = _unpack(posts, _ANCHOR)
        del posts
        order, new_gram, new = _first_of_each(gram, context, id_, place)
        later = order[~new]
        place, left, right = place.astype(np.int64), left.astype(np.int64), right.astype(np.int64)
        own = _merge_by(id_[later], place[later] - left[later], place[later] + GRAM + right[later])
        yield _pack(_spread(own[0], buckets), [x.astype("i8") for x in own], b"s")
        group = np.cumsum(new_gram) - 1
        contexts = np.bincount(group[new], minlength=group[-1] + 1 if len(group) else 0)
        several = new & (contexts[group] > 1) if len(group) else new
        ask = order[several]
        hot = (contexts[group[several]] > HOT_GROUP).astype("i1")
        yield _pack(_spread(id_[ask], buckets), [id_[ask].astype("i8"), place[ask].astype("i8"), gram[ask].astype("u8"), hot], b"a")

    def gather(batches):
        import numpy as np

        spans, asks = [], []
        for b in batches:
            for blob in b.column(1).to_pylist():
                (spans if blob[:1] == b"s" else asks).append(blob)
        si, ss, se = _merge_by(*_unpack(spans, _SPAN))
        ai, ap, ag, ah = _unpack(asks, _ASK)
        order = np.argsort(ai, kind="stable")
        ai, ap, ag, ah = ai[order], ap[order], ag[order], ah[order]
        ids = np.union1d(si, ai)
        for at in range(0, len(ids), 2000):
            some = ids[at : at + 2000]
            s = [np.searchsorted(si, some, side=x) for x in ("left", "right")]
            a = [np.searchsorted(ai, some, side=x) for x in ("left", "right")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(some),
                    pa.array([ss[x:y].tobytes() + se[x:y].tobytes() for x, y in zip(*s, strict=True)], pa.binary()),
                    pa.array([ap[x:y].tobytes() + ag[x:y].tobytes() + ah[x:y].tobytes() for x, y in zip(*a, strict=True)], pa.binary()),
                ],
                ["id", "spans", "asks"],
            )

    met = docs.select("id", "body").mapInArrow(tidied(post), "bucket long, blob binary").repartition(parts, "bucket").mapInArrow(tidied(meet), "bucket long, blob binary")
    return checkpointed(met.repartition(parts, "bucket").mapInArrow(tidied(gather), "id long, spans binary, asks binary"))


def _common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of a and b, which agree up to at."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    lo, hi = at, n
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Orders strings that share a long prefix: inner nodes hold a depth, edges the byte there, and only leaves text."""

    def __init__(self, strs: list[bytes], depth: int):
        self.strs, self.depth, self.root = strs, depth, None

    @staticmethod
    def _at(s: bytes, d: int) -> int:
        return s[d] if d < len(s) else -1

    def insert(self, k: int) -> None:
        if self.root is None:
            self.root = [k]
            return
        s, node = self.strs[k], self.root
        while isinstance(node, tuple):  # blindly down to some leaf
            node = node[1].get(self._at(s, node[0])) or next(iter(node[1].values()))
        other = self.strs[node[0]]
        d = _common(s, other, self.depth)
        if d == len(s) == len(other):
            node.append(k)
            return
        parent, char, node = None, 0, self.root
        while isinstance(node, tuple) and node[0] < d:
            parent, char = node, self._at(s, node[0])
            node = node[1][char]
        if isinstance(node, tuple) and node[0] == d:
            node[1][self._at(s, d)] = [k]
            return
        new = (d, {self._at(other, d): node, self._at(s, d): [k]})
        if parent is None:
            self.root = new
        else:
            parent[1][char] = new

    def walk(self, order: list[int], lcp: list[int], before: int) -> None:
        """Appends the strings in order, each with its common prefix with the one before; before: the first one's."""
        stack = [(self.root, before)]
        while stack:
            node, common = stack.pop()
            if isinstance(node, tuple):
                kids = [node[1][c] for c in sorted(node[1])]
                stack += [(x, node[0]) for x in reversed(kids[1:])] + [(kids[0], common)]
            else:
                for j, k in enumerate(node):
                    order.append(k)
                    lcp.append(common if not j else len(self.strs[k]))


def deep_shallow_sort(strs: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """The order of strs and each one's common prefix with the one before it (0 for the first)."""
    order: list[int] = []
    lcp: list[int] = []
    # indices, the depth up to which they agree, the common prefix with what stands before, whether they end there
    stack = [(list(range(len(strs))), 0, 0, False)]
    while stack:
        group, d, before, ended = stack.pop()
        if ended or len(group) < 2:
            order += group
            lcp += [before, *([d] * (len(group) - 1))][: len(group)]
        elif d >= shallow:
            trie = BlindTrie(strs, d)
            for k in group:
                trie.insert(k)
            trie.walk(order, lcp, before)
        else:  # multikey quicksort: three parts by the byte at d
            middle = strs[group[len(group) // 2]][d : d + 1]
            less, same, more = [], [], []
            for k in group:
                c = strs[k][d : d + 1]
                (less if c < middle else more if c > middle else same).append(k)
            parts, common = [], before
            for g, deep, end in ((less, d, False), (same, d + len(middle), not middle), (more, d, False)):
                if g:
                    parts.append((g, deep, common, end))
                    common = d
            stack += reversed(parts)
    return order, lcp


def covered(gram, id_, place, left: list[bytes], right: list[bytes]):
    """For anchors sorted by gram: id, start and end of the bytes that windows repeating an earlier one cover."""
    import numpy as np

    n = len(gram)
    starts = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])) if n else np.empty(0, np.int64)
    sides = []
    for strs in ([x[::-1] for x in left], right):
        order, lcp = np.empty(n, np.int64), np.empty(n, np.int64)
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True):
            o, c = deep_shallow_sort(strs[s:e])
            order[s:e] = o
            order[s:e] += s
            lcp[s:e] = c
            lcp[s] = -1  # another gram
        sides.append((order, lcp, np.array([len(x) for x in strs])))
    rank = np.empty(n, np.int64)
    rank[np.lexsort((place, id_))] = np.arange(n)
    low, high = np.full(n, LENGTH), np.full(n, -1)
    (lo, ll, ln), (ro, rl, rn) = sides
    lc, rc = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(SIDE + 1):  # windows that start a bytes before the gram
        lc[lo] = np.cumsum(ll < a)
        rc[ro] = np.cumsum(rl < SIDE - a)
        k = np.flatnonzero((ln >= a) & (rn >= SIDE - a))
        if len(k) < 2:
            continue
        key = lc[k] * (n + 1) + rc[k]
        by = np.lexsort((rank[k], key))
        again = by[1:][key[by][1:] == key[by][:-1]]
        again = k[again]
        low[again] = np.minimum(low[again], a)
        high[again] = a
    hit = np.flatnonzero(high >= 0)
    # all windows of an anchor hold its gram, so they overlap
    return id_[hit], place[hit] - high[hit], place[hit] - low[hit] + LENGTH


def spans_of_contexts(docs: DataFrame, found: DataFrame, parts: int) -> DataFrame:
    """id, spans: what windows around the asked anchors have covered."""

    def contexts(batches):
        import numpy as np

        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                gram, ids, places, lefts, rights, hots = [], [], [], [], [], []
                for i, asks, body in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    k = len(asks) // 17
                    place = np.frombuffer(asks, np.int64, k)
                    gram.append(np.frombuffer(asks, np.int64, k, 8 * k))
                    hots.append(np.frombuffer(asks, "i1", k, 16 * k))
                    ids.append(np.full(k, i, np.int64))
                    places.append(place)
                    for p in place.tolist():
                        lefts.append(body[max(0, p - SIDE) : p])
                        rights.append(body[p + GRAM : p + GRAM + SIDE])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (gram, ids, places)] + [pa.array(lefts, pa.binary()), pa.array(rights, pa.binary()), pa.array(np.concatenate(hots).astype(np.int32))],
                    ["gram", "id", "place", "lefts", "rights", "hot"],
                )

    def resolve(batches):
        import numpy as np

        cols: list[list] = [[] for _ in range(5)]
        for b in batches:
            for k in range(3):
                cols[k].append(b.column(k).to_numpy())
            for k in (3, 4):
                cols[k] += b.column(k).to_pylist()
        if not cols[0]:
            return
        gram, id_, place = (np.concatenate(c) for c in cols[:3])
        order = np.argsort(gram, kind="stable")
        ids, s, e = covered(gram[order], id_[order], place[order], [cols[3][k] for k in order], [cols[4][k] for k in order])
        ids, s, e = _merge_by(ids, s, e)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([np.array([x, y], np.int64).tobytes() for x, y in zip(s, e, strict=True)], pa.binary())], ["id", "spans"])

    asked = found.filter(F.octet_length("asks") > 0).select("id", "asks").join(docs, "id").select("id", "asks", "body")
    rows = asked.mapInArrow(tidied(contexts), "gram long, id long, place long, lefts binary, rights binary, hot int")
    if not found.filter(F.octet_length("asks") > 0).filter(F.expr(f"octet_length(asks) > 0 AND instr(hex(substring(asks, octet_length(asks) div 17 * 16 + 1)), '1') > 0")).limit(1).count():
        return rows.drop("hot").repartition(parts, "gram").mapInArrow(tidied(resolve), "id long, spans binary")
    rows = checkpointed(rows)
    cold = rows.filter("hot = 0").drop("hot").repartition(parts, "gram").mapInArrow(tidied(resolve), "id long, spans binary")
    # the windows of hot grams by their hashes; the first of each is found before the shuffle
    offsets = F.sequence(F.greatest(F.lit(0), SIDE - F.octet_length("rights")), F.octet_length("lefts"))
    hot = rows.filter("hot = 1 AND octet_length(lefts) + octet_length(rights) >= " + str(SIDE)).withColumn("a", F.explode(offsets))
    window = F.sha2(F.concat(F.col("a").cast("string").cast("binary"), F.expr("substring(lefts, octet_length(lefts) - a + 1, a)"), F.expr(f"substring(rights, 1, {SIDE} - a)"), F.col("gram").cast("string").cast("binary")), 256)
    hot = hot.select(window.alias("w"), "id", (F.col("place") - F.col("a")).alias("s"))
    first = hot.groupBy("w").agg(F.min(F.struct("id", "s")).alias("m"), F.count("*").alias("c")).filter("c > 1").select("w", F.col("m.id").alias("mi"), F.col("m.s").alias("ms"))
    later = hot.join(first, "w").filter("id <> mi OR s <> ms").select("id", "s")

    def spans(batches):
        import numpy as np

        for b in batches:
            s = b.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array([x, x + LENGTH], np.int64).tobytes() for x in s.tolist()], pa.binary())], ["id", "spans"])

    return cold.union(later.mapInArrow(tidied(spans), "id long, spans binary"))


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with `_id`, an order of documents: doc_id where ids tell texts apart, else ranks by id and text."""
    key = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long").alias("_id"), F.xxhash64("text").alias("_th"))
    clash = key.groupBy("_id").agg(F.min("_th").alias("a"), F.max("_th").alias("b")).filter("a <> b").limit(1).count()
    docs = docs.withColumns({"_id": F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long")})
    if not clash:
        return docs
    ranks = ranked(key.distinct(), [F.col("_id"), F.col("_th")], {}).withColumnRenamed("_id", "_key")
    return docs.withColumn("_th", F.xxhash64("text")).withColumnRenamed("_id", "_key").join(ranks, ["_key", "_th"]).drop("_key", "_th").withColumnRenamed("rank", "_id")


def removed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and maybe a struct `_doc`) with `_id` and `_spans`: the covered bytes as two arrays of longs in one binary, null for none."""
    docs = _numbered(docs)
    parts = partitions_for(docs.sparkSession, docs.count(), DOCS_PER_PART)
    bodies = docs.select(F.col("_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("body")).filter(F.octet_length("body") >= LENGTH)
    found = repeated_anchors(bodies, parts)
    more = spans_of_contexts(bodies, found, parts)
    spans = found.filter(F.octet_length("spans") > 0).select("id", "spans").union(more).groupBy(F.col("id").alias("_id")).agg(F.collect_list("spans").alias("_spans"))
    return docs.join(spans, "_id", "left")


def _cut(body: bytes, blobs) -> tuple[bytes, int, int]:
    """What is left of body, and how many bytes and runs are removed."""
    import numpy as np

    if blobs is None or not len(blobs):
        return body, 0, 0
    halves = [np.frombuffer(x, np.int64).reshape(2, -1) for x in blobs]
    s, e = merged(np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves]))
    at, kept = 0, []
    for x, y in zip(s.tolist(), e.tolist(), strict=True):
        kept.append(body[at:x])
        at = y
    kept.append(body[at:])
    return b"".join(kept), int((e - s).sum()), len(s)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                out = []
                for body, blobs in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    kept, n, k = _cut(body, blobs)
                    out.append((len(body), n, k, hashlib.sha256(kept).hexdigest()))
                cols = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    rows = removed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), "_spans")
    return rows.mapInArrow(tidied(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: texts without the covered bytes, n_chars anew. A text with nothing left goes if it lost any.

    A cut can part a character; its remaining bytes are dropped from the text.
    """

    @F.pandas_udf("string")
    def cut(body, blobs):
        import pandas as pd

        return pd.Series([_cut(bytes(b), list(x))[0].decode("utf-8", "ignore") for b, x in zip(body, blobs, strict=True)], dtype=object)

    rows = removed(docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text"))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(cut(F.coalesce("text", F.lit("")).cast("binary"), F.coalesce("_spans", F.array().cast("array<binary>"))))
    rows = rows.withColumn("_text", text).filter(F.col("_spans").isNull() | (F.trim("_text") != ""))
    new = {"text": F.col("_text"), "n_chars": F.char_length("_text").cast("long")}
    return rows.select(*(new[c].alias(c) if c in new else F.col("_doc")[c].alias(c) for c in docs.columns))
