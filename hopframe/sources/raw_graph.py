"""A raw graph document of any size read by many tasks: node types, node ids and what is said of each node.

The file is read as records that end with a closing brace, which Spark's text source splits by byte ranges in any
store it can read. A range may begin anywhere, in a string too, so there are two scans:

1. each range is scanned under both hypotheses, beginning outside and inside a string; it gives the change in depth,
   whether it ends in a string, its bytes, and for each relative depth the objects opened there and the last one's
   name. Folded over the ranges of a file, a row a range, this gives every range's true depth, node type and offset;
2. each range is cut into entries with its true state. Entries that lie in one range are whole; the pieces of those
   that cross ranges are put together afterwards.

A malformed structure, a node whose value is no object, and a closing brace in a type's name are errors that name the
file and the byte. Entries' values are parsed by Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hopframe.session import checkpointed

_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*+"|"(?:[^"\\]|\\.)*+\\?\Z|[{}\[\]:,]|[^\s{}\[\]:,"]++', re.S)
_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_RANGES = "file string, block long, bytes long, ends array<struct<inside:boolean,delta:int,opened:map<int,struct<n:int,last:string>>>>"
_PIECES = "file string, block long, seq long, at long, type_pos int, node_type string, part string, piece string"


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, size, block, octets, value: the pieces between closing braces, in the order of the file within a block."""
    lines = spark.read.option("lineSep", "}").text(path)
    meta = lambda c: F.col(f"_metadata.{c}")
    return lines.select(meta("file_path").alias("file"), meta("file_size").alias("size"), meta("file_block_start").alias("block"), F.octet_length("value").cast("long").alias("octets"), "value")


class _Depths:
    """One hypothesis about how a range begins."""

    def __init__(self, inside: bool) -> None:
        self.inside, self.delta, self.opened, self.name = inside, 0, {}, None

    def read(self, value: str) -> None:
        at = 0
        if self.inside:
            m = _REST.match(value)
            if not m:
                return
            self.inside, at = False, m.end()
        for m in _TOKEN.finditer(value, at):
            t = m.group()
            if t[0] == '"':
                if len(t) == 1 or t[-1] != '"' or not _REST.fullmatch(t[1:]):
                    self.inside = True
                    return
                self.name = t
            elif t == "{":
                n, _ = self.opened.get(self.delta, (0, None))
                self.opened[self.delta] = (n + 1, self.name)
                self.delta += 1
            elif t == "}":
                self.delta -= 1
        self.delta -= 1  # the brace that ends the record


def _blocks(batches):
    """Rows of the batches by block: (file, size, block), then its (octets, value)."""
    for b in batches:
        files, sizes, blocks, octets = (b.column(i).to_pylist() for i in range(4))
        for i, value in enumerate(b.column(4)):
            yield (files[i], sizes[i], blocks[i]), octets[i], value.as_py(), (b, i)


def _scanned(batches):
    import pyarrow as pa

    now, both, size = None, [], 0
    out = []

    def close():
        ends = [{"inside": h.inside, "delta": h.delta, "opened": [(k, {"n": n, "last": s}) for k, (n, s) in h.opened.items()]} for h in both]
        out.append({"file": now[0], "block": now[2], "bytes": size, "ends": ends})

    for key, octets, value, _ in _blocks(batches):
        if key != now:
            if now:
                close()
            now, both, size = key, [_Depths(False), _Depths(True)], 0
        size += octets + 1
        for h in both:
            h.read(value)
    if now:
        close()
    opened = pa.map_(pa.int32(), pa.struct([("n", pa.int32()), ("last", pa.string())]))
    ends = pa.list_(pa.struct([("inside", pa.bool_()), ("delta", pa.int32()), ("opened", opened)]))
    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("bytes", pa.int64()), ("ends", ends)])
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _entered(ranges):
    """The true state on the way into each range of one file."""
    import pandas as pd

    inside, depth, at, type_pos, name, out = False, 0, 0, -1, None, []
    for r in ranges.sort_values("block").itertuples():
        out.append((r.file, r.block, inside, depth, at, type_pos, name))
        end = r.ends[1 if inside else 0]
        opened = dict(end["opened"])
        if 1 - depth in opened:
            found = opened[1 - depth]
            type_pos, name = type_pos + int(found["n"]), found["last"]
        inside, depth, at = bool(end["inside"]), depth + int(end["delta"]), at + int(r.bytes)
    return pd.DataFrame(out, columns=["file", "block", "inside", "depth", "at", "type_pos", "node_type"])


class _Cutter:
    """Cuts the records of one range into entries. Depth 0 is the document, 1 the types, 2 the nodes of a type."""

    def __init__(self, file, size, block, inside, depth, at, type_pos, node_type):
        self.file, self.size, self.block, self.at, self.depth, self.inside = file, size, block, at, depth, inside
        self.type_pos, self.name, self.out, self.seq = type_pos, node_type, [], 0
        # what may come next at depths 0 to 2; a range begins after a brace or in a string
        self.want = "document" if depth == 0 and at == 0 else "nothing" if depth == 0 else "next"
        self.open = depth > 2 or (depth == 2 and inside)
        self.part, self.text, self.start, self.key = ("end" if self.open else None), [], at, None
        if inside and depth < 2:
            self.fail("a closing brace in a node type's name", at)

    def fail(self, what: str, at: int):
        raise ValueError(f"malformed graph: {what} at byte {at} of {self.file}")

    def emit(self, part: str) -> None:
        self.out.append({"file": self.file, "block": self.block, "seq": self.seq, "at": self.start, "type_pos": self.type_pos, "node_type": self.name, "part": part, "piece": "".join(self.text)})
        self.seq, self.text = self.seq + 1, []

    def done(self) -> None:
        """The entry that is open ends here."""
        self.emit("whole" if self.part == "start" else "end")
        self.open, self.part = False, None

    def finish(self) -> list[dict]:
        if self.at >= self.size and (self.inside or self.depth or self.want == "document"):
            self.fail("the end of the file", self.size)
        if self.open:
            self.emit("start" if self.part == "start" else "middle")
        return self.out

    def read(self, value: str, octets: int, last: bool) -> None:
        """last: the record ends with the file, not with a brace."""
        begin, copied, base = 0, 0, self.at
        place = lambda i: base + len(value[:i].encode())
        if self.inside:
            m = _REST.match(value)
            begin = m.end() if m else len(value)
            self.inside = not m
            if m and self.depth == 2:
                self.want = "colon"
        if not self.inside:
            for m in _TOKEN.finditer(value, begin):
                t, i = m.group(), m.start()
                text = t[0] == '"'
                if text and (len(t) == 1 or t[-1] != '"' or not _REST.fullmatch(t[1:])):
                    self.inside = True
                if self.depth > 2:
                    self.depth += (t == "{") - (t == "}")
                    if self.depth == 2:
                        self.want = "next"
                        self.text.append(value[copied : m.end()])
                        copied = m.end()
                        self.done()
                elif self.want == "document" and t == "{":
                    self.depth, self.want = 1, "name"
                elif self.want in ("name", "name or end") and text:
                    if self.depth == 2:
                        self.open, self.part, self.start, self.text, copied = True, "start", place(i), [], i
                    elif self.inside:
                        self.fail("a closing brace in a node type's name", place(i))
                    self.key, self.want = t, "name" if self.inside else "colon"
                elif self.want == "colon" and t == ":":
                    self.want = "value"
                elif self.want == "value" and self.depth == 1 and t == "{":
                    self.depth, self.want = 2, "name or end"
                    self.type_pos, self.name = self.type_pos + 1, self.key
                elif self.want == "value" and t == "{":
                    self.depth = 3
                elif self.want == "next" and t == "," and self.depth:
                    self.want = "name"
                else:
                    self.fail(f"{t[:20]!r}", place(i))
        if self.open:
            self.text.append(value[copied:] + ("" if last else "}"))
        self.at += octets + 1
        if last or self.inside:
            return
        # the brace that ends the record
        at = self.at - 1
        if self.depth > 2:
            self.depth -= 1
            if self.depth == 2:
                self.want = "next"
                self.done()
        elif self.depth and self.want in ("next", "name or end") or self.depth == 1 and self.want == "name" and self.type_pos < 0:
            self.depth -= 1
            self.want = "next" if self.depth else "nothing"
        else:
            self.fail("'}'", at)


def _cut(batches):
    import pyarrow as pa

    schema = pa.schema([("file", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("at", pa.int64()), ("type_pos", pa.int32()), ("node_type", pa.string()), ("part", pa.string()), ("piece", pa.string())])
    now, cutter = None, None
    for key, octets, value, (b, i) in _blocks(batches):
        if key != now:
            if cutter:
                yield pa.RecordBatch.from_pylist(cutter.finish(), schema=schema)
            state = [b.column(j)[i].as_py() for j in range(5, 10)]
            if state[1] is None:
                raise RuntimeError(f"the ranges of {key[0]} changed between the scans; read it again")
            now, cutter = key, _Cutter(*key, *state)
        cutter.read(value, octets, cutter.at + octets >= key[1])
        if len(cutter.out) >= 1000:
            rows, cutter.out = cutter.out, []
            yield pa.RecordBatch.from_pylist(rows, schema=schema)
    if cutter:
        yield pa.RecordBatch.from_pylist(cutter.finish(), schema=schema)


def entries(spark: SparkSession, path: str) -> DataFrame:
    """file, at, type_pos, node_type, entry: each node as JSON, `"id": value`, at its byte, under its type's name (JSON)."""
    lines = records(spark, path)
    ranges = lines.mapInArrow(_scanned, _RANGES)
    # a row a range of 128 MB or so
    states = checkpointed(ranges.groupBy("file").applyInPandas(_entered, "file string, block long, inside boolean, depth int, at long, type_pos int, node_type string"))
    pieces = checkpointed(lines.join(F.broadcast(states), ["file", "block"], "left").select("file", "size", "block", "octets", "value", "inside", "depth", "at", "type_pos", "node_type").mapInArrow(_cut, _PIECES))
    whole = pieces.filter("part = 'whole'").select("file", "at", "type_pos", "node_type", F.col("piece").alias("entry"))
    # at most two pieces a range
    w = Window.partitionBy("file").orderBy("block", "seq")
    cut = pieces.filter("part <> 'whole'").withColumn("_start", F.last(F.when(F.col("part") == "start", F.col("at")), True).over(w))
    cut = cut.groupBy("file", "_start").agg(F.min_by(F.struct("type_pos", "node_type"), F.struct("block", "seq")).alias("t"), F.array_sort(F.collect_list(F.struct("block", "seq", "piece"))).alias("p"))
    cut = cut.select("file", F.col("_start").alias("at"), "t.type_pos", "t.node_type", F.array_join("p.piece", "").alias("entry"))
    return whole.unionByName(cut)
