"""N-gram Jaccard join: every link between documents whose five-word shingle sets are 0.8 alike, and its components.

1. Each text becomes a set of shingle hashes. Texts with equal sets are one class, known by a 128-bit digest.
2. Shingles are counted over all documents in hashed cells, and ordered rare first. Two sets that alike share one of
   their n // 5 + 1 rarest shingles, so only those are posted, with the set's size.
3. Postings meet by shingle. A list of a few sets gives its pairs, a longer list stays a list. Each set also has a
   bitmap of the parities of its shingles; two bitmaps differ in no more bits than the sets do in shingles, so pairs
   that differ too much are dropped, and a long list joins its members only where they may link, asking no further
   once they are connected.
4. What remains forms blocks (connected components), about the size of the groups of near copies.
5. The sets of each block are gathered, once each, and every block is searched by T-occurrence: the short
   inverted lists of a set's shingles are merged, the long ones are probed by binary search for the sets that can
   still reach the overlap (DivideSkip). Sets already connected are not looked for again. A block too large for a task
   is cut into parts, and each pair of parts is searched by a task of its own.

A text without words, and null, has an empty set and links with nothing; its component is its own id. A text of fewer
than five words is one shingle. Null ids are the largest: a component is named by its least id, and by null only if it
has no other. Repeated rows are copies. An empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import heapq
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.llm.common import checkpointed, partitions_for, table, tidied
from hopframe.llm.graph import components

WORDS, PERCENT = 5, 80
#: Cells of the shingle counts; their number bounds what is sent to the driver and broadcast.
CELL_BITS = 20
#: Postings held in a task before they are thinned and passed on; documents a postings partition stands for.
FLUSH, DOCS_PER_PART = 1_500_000, 6_000
#: Shingles of a block that one task searches.
BLOCK_SHINGLES = 6_000_000
_NULL_ID = -(1 << 63)


def shingles(text: str | None):
    """The sorted distinct hashes of a text's shingles."""
    import numpy as np
    from xxhash import xxh3_64_intdigest

    ws = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space parts words
    n = len(ws)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxh3_64_intdigest, ws), np.uint64, n)
    k = min(n, WORDS)
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def _digest(s) -> tuple[int, bytes]:
    from xxhash import xxh3_128_digest

    d = xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), d


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")


#: A list of so many sets at most gives all its pairs.
SHORT_LIST = 6
#: A longer list than this is checked by vector operations.
WIDE_LIST = 48
_SETS = "kind int, id long, th long, n int, node long, digest binary, map binary"


def described(docs: DataFrame) -> DataFrame:
    """kind 0: a row a document with its set's size, node and digest; kind 1: a shingle cell (id) and its count (th)."""

    def run(batches):
        import numpy as np

        cells, seen = np.zeros(1 << CELL_BITS, np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                n, node, digest, maps = [], [], [], []
                for text in part.column(2).to_pylist():
                    s = shingles(text)
                    np.add.at(cells, (s >> np.uint64(64 - CELL_BITS)).astype(np.int64), 1)
                    seen += len(s)
                    a, d = _digest(s)
                    n.append(len(s))
                    node.append(a)
                    digest.append(d)
                    maps.append(_bytes(bitmap(s)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), np.int32)), part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(node, pa.int64()), pa.array(digest, pa.binary()), pa.array(maps, pa.binary())],
                    ["kind", "id", "th", "n", "node", "digest", "map"],
                )
        # cells that stand out of the noise; the order they give need not be exact, only the same for all
        hot = np.flatnonzero(cells >= 4 + 3 * (seen >> CELL_BITS))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(len(hot), np.int32)), pa.array(hot), pa.array(cells[hot]), pa.nulls(len(hot), pa.int32()), pa.nulls(len(hot), pa.int64()), pa.nulls(len(hot), pa.binary()), pa.nulls(len(hot), pa.binary())],
            ["kind", "id", "th", "n", "node", "digest", "map"],
        )

    return _keyed(docs).mapInArrow(tidied(run), _SETS)


def shared_postings(docs: DataFrame, levels, parts: int) -> DataFrame:
    """kind, a, b: pairs of nodes (kind 0) from lists of a few sets that share a rare shingle and allow a link by their
    sizes, and the members b of longer lists a (kind 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)  # one byte a cell
    buckets = 4 * parts

    def post(batches):
        import numpy as np

        level, held, count = shared.value, [], 0

        def flush():
            token, node, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            order = np.lexsort((node, token))
            token, node, n = token[order], node[order], n[order]
            keep = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))  # copies post once
            token, node, n = token[keep], node[keep], n[keep]
            bucket = (token % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            token, node, n, bucket = token[order], node[order], n[order], bucket[order]
            at = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            ends = np.append(at[1:], len(bucket))
            blobs = [token[s:e].tobytes() + node[s:e].tobytes() + n[s:e].astype("<i4").tobytes() for s, e in zip(at, ends, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(bucket[at]), pa.array(blobs, pa.binary())], ["bucket", "blob"])

        for b in batches:
            for text in b.column(0).to_pylist():
                s = shingles(text)
                if not len(s):
                    continue
                p = len(s) // 5 + 1
                order = np.lexsort((s, level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]))[:p]
                held.append((s[order], np.full(p, _digest(s)[0], np.int64), np.full(p, len(s), np.int64)))
                count += p
                if count >= FLUSH:
                    yield flush()
                    held, count = [], 0
        if held:
            yield flush()

    def meet(batches):
        import numpy as np

        tokens, nodes, sizes = [], [], []
        for b in batches:
            for blob in b.column(1).to_pylist():
                k = len(blob) // 20
                tokens.append(np.frombuffer(blob, np.uint64, k))
                nodes.append(np.frombuffer(blob, np.int64, k, 8 * k))
                sizes.append(np.frombuffer(blob, "<i4", k, 16 * k).astype(np.int64))
        if not tokens:
            return
        token, node, n = np.concatenate(tokens), np.concatenate(nodes), np.concatenate(sizes)
        del tokens, nodes, sizes
        order = np.lexsort((node, n, token))
        token, node, n = token[order], node[order], n[order]
        keep = np.append(True, (token[1:] != token[:-1]) | (node[1:] != node[:-1]))
        token, node, n = token[keep], node[keep], n[keep]
        # a run: sets of one list, by size, each of which the next may link with
        at = np.flatnonzero(np.append(True, (token[1:] != token[:-1]) | (100 * n[:-1] < PERCENT * n[1:])))
        size = np.diff(np.append(at, len(token)))
        pairs = [np.empty((0, 2), np.int64)]
        few = at[(size > 1) & (size <= SHORT_LIST)]
        few_size = size[(size > 1) & (size <= SHORT_LIST)]
        for i in range(SHORT_LIST - 1):
            for j in range(i + 1, SHORT_LIST):
                x = few[few_size > j]
                x = x[100 * n[x + i] >= PERCENT * n[x + j]]
                pairs.append(np.stack([np.minimum(node[x + i], node[x + j]), np.maximum(node[x + i], node[x + j])], 1))
        pairs = np.unique(np.concatenate(pairs), axis=0)
        run = np.repeat(np.arange(len(at)), size)
        long_ = size[run] > SHORT_LIST
        # runs of a list are told apart by where they begin
        name = (token[at][run[long_]] + n[at][run[long_]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
        kind = np.repeat(np.array([0, 1], np.int32), [len(pairs), int(long_.sum())])
        a, b = np.concatenate([pairs[:, 0], name]), np.concatenate([pairs[:, 1], node[long_]])
        for at_ in range(0, len(kind), 100_000):
            cut = slice(at_, at_ + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(kind[cut]), pa.array(a[cut]), pa.array(b[cut])], ["kind", "a", "b"])

    posted = docs.select("text").mapInArrow(tidied(post), "bucket long, blob binary")
    return posted.repartition(parts, "bucket").mapInArrow(tidied(meet), "kind int, a long, b long")


def _bytes(x: int) -> bytes:
    return x.to_bytes(-(-x.bit_length() // 8), "little")


def bitmap(s) -> int:
    """The parities of the shingles' counts by their low bits, on a power of two of bits, about as many as shingles."""
    import numpy as np

    bits = max(64, 1 << (3 * len(s) // 4 - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return int.from_bytes(np.packbits(odd.astype(np.uint8), bitorder="little").tobytes(), "little")


def folded(x: int, n: int, m: int) -> int:
    """The bitmap of a set of n shingles as one of m shingles would have it, for m <= n."""
    now, want = (max(64, 1 << (3 * k // 4 - 1).bit_length()) for k in (n, m))
    while now > want:
        now //= 2
        x = (x & ((1 << now) - 1)) ^ (x >> now)
    return x


def may_link(n: int, x: int, m: int, y: int) -> bool:
    """Whether sets of n and m shingles (n <= m) with these bitmaps can be alike; false only if they can't."""
    if 100 * n < PERCENT * m:
        return False
    # 100 i >= P (n + m - i) for the overlap i, and n + m - 2 i is what differs
    least = -(-PERCENT * (n + m) // (100 + PERCENT))
    return (x ^ folded(y, m, n)).bit_count() <= n + m - 2 * least


def wide_list_edges(nodes: list[int], sizes: list[int], maps: list[int]) -> list[tuple[int, int]]:
    """list_edges() for long lists: each member is held against all not yet reached, one vector operation a member."""
    import numpy as np

    n = np.array(sizes, np.int64)
    bits = np.array([max(64, 1 << (3 * k // 4 - 1).bit_length()) for k in sizes])
    rows = {}
    for b in set(bits.tolist()):  # every bitmap of at least so many bits, folded to so many
        out = np.zeros((len(nodes), b // 64), np.uint64)
        for k in np.flatnonzero(bits >= b).tolist():
            x, now = maps[k], int(bits[k])
            while now > b:
                now //= 2
                x = (x & ((1 << now) - 1)) ^ (x >> now)
            out[k] = np.frombuffer(x.to_bytes(b // 8, "little"), np.uint64)
        rows[b] = out
    new, edges = np.ones(len(nodes), bool), []
    for start in range(len(nodes)):
        if not new[start]:
            continue
        new[start], queue = False, [start]
        while queue:
            x = queue.pop()
            lo, hi = np.searchsorted(n, -(-PERCENT * n[x] // 100)), np.searchsorted(n, 100 * n[x] // PERCENT, side="right")
            rest = lo + np.flatnonzero(new[lo:hi])
            for b in set(np.minimum(bits[rest], bits[x]).tolist()):
                some = rest[np.minimum(bits[rest], bits[x]) == b]
                differ = np.bitwise_count(rows[b][some] ^ rows[b][x]).sum(1, dtype=np.int64)
                total = n[x] + n[some]
                hit = some[differ <= total - 2 * -(-PERCENT * total // (100 + PERCENT))]
                new[hit] = False
                queue += hit.tolist()
                edges += [(nodes[x], nodes[k]) for k in hit.tolist()]
    return edges


def list_edges(nodes: list[int], sizes: list[int], maps: list[int], known: set) -> list[tuple[int, int]]:
    """Edges that connect all members of a list (by rising size) that may link."""
    groups: list[list[int]] = []
    edges = []
    for k in range(len(nodes)):
        own: list[int] | None = None
        for g in range(len(groups) - 1, -1, -1):
            for j in groups[g]:
                pair = (nodes[j], nodes[k])
                if pair in known or may_link(sizes[j], maps[j], sizes[k], maps[k]):
                    known.add(pair)
                    edges.append(pair)
                    if own is None:
                        own = groups[g]
                    else:
                        own += groups.pop(g)
                    break
        if own is None:
            groups.append([k])
        else:
            own.append(k)
    return edges


def block_edges(found: DataFrame, sets: DataFrame, parts: int) -> DataFrame:
    """a, b: edges between nodes that may link. sets: node, n, map."""

    def check(batches):
        for b in batches:
            cols = [b.column(k).to_pylist() for k in range(6)]
            keep = []
            for n, x, m, y in zip(*cols[2:], strict=True):
                x, y = int.from_bytes(x, "little"), int.from_bytes(y, "little")
                keep.append(may_link(n, x, m, y) if n <= m else may_link(m, y, n, x))
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), b.column(1).filter(pa.array(keep))], ["a", "b"])

    def lists(batches):
        name, held, known = None, [], set()

        def done():
            held.sort(key=lambda r: r[1])
            cols = [[r[k] for r in held] for k in range(3)]
            edges = list_edges(*cols, known) if len(held) <= WIDE_LIST else wide_list_edges(*cols)
            if edges:
                yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], ["a", "b"])

        for b in batches:
            for a, node, n, x in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if a != name:
                    yield from done()
                    name, held = a, []
                    if len(known) > 200_000:  # only spares repeated checks
                        known.clear()
                held.append((node, n, int.from_bytes(x, "little")))
        yield from done()

    end = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("map").alias(f"map_{c}"))
    pairs = found.filter("kind = 0").select("a", "b").distinct().join(end("a"), "a").join(end("b"), "b").select("a", "b", "n_a", "map_a", "n_b", "map_b")
    members = found.filter("kind = 1").select("a", "b").join(end("b"), "b").select("a", "b", "n_b", "map_b").repartition(parts, "a").sortWithinPartitions("a")
    return pairs.mapInArrow(tidied(check), "a long, b long").union(members.mapInArrow(tidied(lists), "a long, b long")).distinct()


def _merged(lists: list, size: int):
    """How many of the sorted lists hold each of 0 .. size - 1: a heap merge for few entries, counting for many."""
    import numpy as np

    total = sum(map(len, lists))
    if total <= 256:
        counts = np.zeros(size, np.int64)
        for owner, same in groupby(heapq.merge(*(x.tolist() for x in lists))):
            counts[owner] = sum(1 for _ in same)
        return counts
    return np.bincount(np.concatenate(lists), minlength=size)


class Block:
    """T-occurrence search among the sets of a block."""

    def __init__(self, sets: list):
        import numpy as np

        self.m, self.n = len(sets), np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(self.m), self.n)
        _, token = np.unique(np.concatenate(sets), return_inverse=True)
        self.tokens = np.split(token, np.cumsum(self.n)[:-1])
        keys = np.sort(token.astype(np.int64) * self.m + owner)  # all lists, one after another, each sorted
        self.keys, self.owners = keys, keys % self.m
        self.start = np.searchsorted(keys // self.m, np.arange(token.max() + 2))
        self.length = np.diff(self.start)

    def search(self, x: int, skip=None):
        """The sets alike to set x, without those that skip marks."""
        import numpy as np

        need = -(-PERCENT * int(self.n[x]) // 100)
        toks = self.tokens[x]
        lens = self.length[toks]
        # DivideSkip: as many long lists as pay for themselves, fewer than the overlap
        n_long = min(need - 1, int(need / (0.0085 * np.log2(max(2, lens.max())) + 1)))
        order = np.argsort(lens, kind="stable")
        short, long_ = toks[order[: len(toks) - n_long]], toks[order[len(toks) - n_long :]]
        counts = _merged([self.owners[self.start[t] : self.start[t + 1]] for t in short if self.length[t] > 1], self.m)
        counts[x] = 0
        if skip is not None:
            counts[skip] = 0
        # lists of x alone were left out; they hold no other set
        found = np.flatnonzero(counts >= max(1, need - n_long))
        if not len(found):
            return found
        overlap = counts[found]
        if n_long:
            probe = (long_[:, None] * self.m + found[None, :]).ravel()
            at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
            overlap = overlap + (self.keys[at] == probe).reshape(n_long, -1).sum(0)
        union = self.n[x] + self.n[found] - overlap
        return found[(100 * overlap >= PERCENT * union)]

    def roots(self) -> list[int]:
        """The component of each set; a set is searched unless all others are its own or the largest component's."""
        import numpy as np

        root, members = np.arange(self.m), {i: [i] for i in range(self.m)}
        largest, todo = 0, list(range(self.m))
        while todo:
            late = []
            for x in todo:
                if len(members) == 1:
                    return root.tolist()
                r = int(root[x])
                if r == largest and len(members[r]) > 1:
                    late.append(x)
                    continue
                for y in self.search(x, np.array(members[r])).tolist():
                    a, b = int(root[x]), int(root[y])
                    if a != b:
                        a, b = (a, b) if len(members[a]) >= len(members[b]) else (b, a)
                        root[members[b]] = a
                        members[a] += members.pop(b)
                        if len(members[a]) > len(members[largest]) if largest in members else True:
                            largest = a
            # of the largest component nothing more need be asked: all others have been searched
            todo = [x for x in late if root[x] != largest]
        return root.tolist()


def _block_links(batches):
    """digest, other: for rows (key columns, digest, set) sorted by key, a spanning star of each component."""
    import numpy as np

    key, digests, sets = None, [], []

    def done():
        own = {}
        for d, s in zip(digests, sets, strict=True):
            own[d] = s  # a set may come from several rows
        names = list(own)
        if len(names) < 2:
            return
        roots = Block([np.frombuffer(own[d], np.uint64) for d in names]).roots()
        first: dict[int, bytes] = {}
        for d, r in zip(names, roots, strict=True):
            first[r] = min(first.get(r, d), d)
        pairs = [(d, first[r]) for d, r in zip(names, roots, strict=True) if d != first[r]]
        if pairs:
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"])

    for b in batches:
        cols = [b.column(i).to_pylist() for i in range(5)]
        for r, i, j, d, s in zip(*cols, strict=True):
            if (r, i, j) != key:
                yield from done()
                key, digests, sets = (r, i, j), [], []
            digests.append(d)
            sets.append(s)
    yield from done()


def classes(docs: DataFrame) -> DataFrame:
    """id, th, n, digest of each document and `class`, the digest its component is known by (null without links)."""
    spark = docs.sparkSession
    import numpy as np

    info = checkpointed(described(docs))
    meta = info.filter("kind = 0").select("id", "th", "n", "node", "digest")
    n_docs = meta.count()
    levels = np.zeros(1 << CELL_BITS, np.uint8)
    for r in info.filter("kind = 1").groupBy("id").agg(F.sum("th").alias("n")).collect():  # a row a cell at most
        levels[r["id"]] = int(r["n"]).bit_length()
    parts = partitions_for(spark, n_docs, DOCS_PER_PART)
    found = checkpointed(shared_postings(docs, levels, parts))
    asked = found.filter("kind = 0").select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    sets = info.filter("kind = 0").select("node", "n", "map").join(asked, "node", "left_semi").dropDuplicates(["node"])
    blocks = components(block_edges(found, sets, parts))
    # one document stands for each set in a block
    members = meta.join(blocks, "node").groupBy("digest", "n", "root").agg(F.min(F.struct("id", "th")).alias("_k"))
    members = checkpointed(members.select("digest", "n", "root", "_k.id", "_k.th"))
    weight = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("parts"))
    members = members.join(weight, "root")
    texts = _keyed(docs).join(members, ["id", "th"]).select("root", "parts", "digest", "text")

    def build(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([shingles(t).tobytes() for t in part.column(3).to_pylist()], pa.binary())], ["root", "parts", "digest", "shingles"])

    found = texts.mapInArrow(tidied(build), "root long, parts int, digest binary, shingles binary")
    own = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    pairs = F.when(F.col("parts") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: k != own), lambda k: F.struct(F.least(k, own).alias("i"), F.greatest(k, own).alias("j")))
    )
    found = found.select("root", F.explode(pairs).alias("_p"), "digest", "shingles").select("root", "_p.i", "_p.j", "digest", "shingles")
    found = found.repartition(partitions_for(spark, n_docs, DOCS_PER_PART), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    links = checkpointed(found.mapInArrow(tidied(_block_links), "a binary, b binary"))
    parted = weight.filter("parts > 1").limit(1).count()
    groups = components(links).select(F.col("node").alias("digest"), F.col("root").alias("class")) if parted else links.select(F.col("a").alias("digest"), F.col("b").alias("class"))
    return meta.select("id", "th", "n", "digest").join(groups, "digest", "left")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """id, th, n and component (the least id) of each document; id is least possible for null, th hashes the text."""
    rows = classes(docs).withColumn("class", F.coalesce("class", "digest"))
    least = rows.filter("n > 0").groupBy("class").agg(F.min(F.when(F.col("id") != _NULL_ID, F.col("id"))).alias("component"), F.min(F.struct(F.col("id") == _NULL_ID, "id", "th")).alias("_stays"))
    out = rows.join(least, "class", "left")
    own = F.when(F.col("id") != _NULL_ID, F.col("id"))
    return out.select("id", "th", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(own).alias("component"), "_stays")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("id") != _NULL_ID, F.col("id"))
    return near_duplicates(table(spark, sf_dir, "documents")).select(own.alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the least id stays; texts without words all stay."""
    go = near_duplicates(docs).filter((F.col("n") > 0) & ((F.col("id") != F.col("_stays.id")) | (F.col("th") != F.col("_stays.th"))))
    go = go.select("id", "th").distinct()
    whole = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "text")
    rows = whole.withColumns({"id": F.coalesce("doc_id", F.lit(_NULL_ID)).cast("long"), "th": F.xxhash64("text")})
    rows = rows.join(go, ["id", "th"], "left_anti")
    # rows that repeat id and text are one document
    again = F.row_number().over(Window.partitionBy("id", "th").orderBy("id"))
    wordless = F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\x0c\r", "") == ""
    return rows.withColumn("_again", again).filter((F.col("_again") == 1) | wordless).select("_doc.*")
