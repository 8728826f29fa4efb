"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents.

Documents are encoded and cut into pieces of at most `size` ids. A hash of the document deals it to a group of a few
thousand documents, so no source, length or group of copies can fill a group, and every group is packed on its own.
Full pieces are sequences by themselves; the others go, longest first, into the leftmost open sequence with room,
which a tournament tree of remaining capacities finds in logarithmic time.

Null texts count as empty; every document ends with the end id, so each has a piece. Repeated rows are packed each on
its own, dealt apart by their place in their batch. An empty table gives no pieces. Other columns are not used.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopframe.llm.common import table, tidied
from hopframe.llm.token_files import vocabulary

SIZE = 1024
DOCS_PER_GROUP = 4096
PIECES = "doc_id long, copy long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """A tournament tree over bins: each inner node holds the most room of any bin below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [size] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """The leftmost bin with room for need."""
        node, room, leaves = 1, self.room, self.leaves
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        return node - leaves

    def take(self, bin_: int, need: int) -> int:
        """Uses need of a bin; returns how much of it was in use before."""
        room, node = self.room, bin_ + self.leaves
        left = room[node] = room[node] - need
        node //= 2
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node //= 2
        return left


def first_fit_decreasing(lengths: list[int], size: int = SIZE) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each item, in the order given; lengths are 1 to size."""
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    full = sum(1 for x in lengths if x == size)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    tree = CapacityTree(max(1, len(lengths) - full), size)
    for n, k in enumerate(order):
        if n < full:  # a full piece opens a bin and closes it
            bins[k] = n
            continue
        b = tree.first(lengths[k])
        bins[k], offsets[k] = full + b, size - tree.take(b, lengths[k]) - lengths[k]
    return bins, offsets


def pieces(docs: DataFrame, vocabulary_path: str, end_id: int, size: int = SIZE, word_spaces: bool = False, with_ids: bool = False) -> DataFrame:
    """Every document's ids cut at multiples of size, a row a piece; with_ids adds the ids themselves."""

    def cut(batches):
        from collections import Counter

        import numpy as np

        from hopframe.llm.token_cache import tokenizer

        tok = tokenizer(vocabulary_path, word_spaces)
        for batch in batches:
            seen: Counter = Counter()
            for first, ids, offsets in tok.encode(batch.column(1), end_id):
                docs_, data, out = batch.column(0).slice(first, len(offsets) - 1).to_pylist(), ids.view(np.uint8), []
                for doc, s, e in zip(docs_, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    copy = seen[doc]
                    seen[doc] += 1
                    for at in range(s, e, size):
                        to = min(at + size, e)
                        out.append((doc, copy, at - s, to - at, zlib.crc32(data[4 * at : 4 * to]), e - s))
                cols = [pa.array(x, pa.int64()) for x in zip(*out, strict=True)]
                names = ["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    cuts = np.append(0, np.cumsum([x[3] for x in out])).astype(np.int32)
                    cols, names = [*cols, pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.view("<i4")))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names)

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(tidied(cut), PIECES + (", ids array<int>" if with_ids else ""))


def pack(cut: DataFrame, n_docs: int, size: int = SIZE, docs_per_group: int = DOCS_PER_GROUP, seed: int = 17) -> DataFrame:
    """Deals pieces to groups by document and packs each group; sequence_id is unique over all groups."""
    groups = max(1, -(-n_docs // docs_per_group))
    rest = [f for f in cut.schema.fields if f.name not in ("copy",)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rest) + ", sequence_id long, offset long"

    def packed(key, pdf):
        pdf = pdf.sort_values(["length", "doc_id", "copy", "start"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(pdf["length"].tolist(), size)
        out = pdf[[f.name for f in rest]].copy()
        out["sequence_id"] = [(int(key[0]) << 32) + b for b in bins]
        out["offset"] = offsets
        return out

    group = F.pmod(F.xxhash64("doc_id", "copy", F.lit(seed)), F.lit(groups))
    return cut.withColumn("_group", group).groupBy("_group").applyInPandas(packed, schema)


def pack_documents(docs: DataFrame, vocabulary_path: str, end_id: int, size: int = SIZE, with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, vocabulary_path, end_id, size, with_ids=with_ids), docs.count(), size)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), 0)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the pieces of all documents in their sequences."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), 0)
