"""Decoder inputs: token ids with a span for graph tokens, padded on the left, with a label mask; and batches of
subgraphs renumbered into one graph.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

IGNORED = -100
#: What opens an instruction, ends the user's part and ends the text.
BOS, EOS_USER, EOS = "<s>[INST]", "[/INST]", "</s>"
#: Bytes of text that a worker encodes at once.
AT_ONCE = 1 << 20


def encoder(vocabulary: str) -> Callable[[Column], Column]:
    """A function that encodes a text column with a tokenizer file; workers load the file once."""
    @F.arrow_udf(ArrayType(IntegerType()))
    def ids(text: pa.Array) -> pa.Array:
        # an encoding takes a few hundred bytes a token, so few are held at a time
        type_ = pa.list_(pa.int32())
        parts = [pa.array([e.ids for e in loaded(vocabulary).encode_batch(some.to_pylist(), add_special_tokens=False)], type_) for some in pieces(text.fill_null(""), AT_ONCE)]
        return pa.concat_arrays(parts) if parts else pa.array([], type_)

    return ids


def pieces(text: pa.Array, size: int) -> Iterator[pa.Array]:
    """The texts in runs of about size bytes, one text at least."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(text).to_pylist()):
        if i > start and held + n > size or i - start == size >> 8:
            yield text[start:i]
            start, held = i, 0
        held += n
    if start < len(text):
        yield text[start:]


_LOADED: dict = {}


def loaded(vocabulary: str):
    """The tokenizer of a file, kept by the worker."""
    if vocabulary not in _LOADED:
        from tokenizers import Tokenizer

        _LOADED[vocabulary] = Tokenizer.from_file(vocabulary)
    return _LOADED[vocabulary]


def text_layout(samples: DataFrame, vocabulary: str, pad_id: int, max_text: int, max_new: int, with_labels: bool = True) -> DataFrame:
    """samples (batch, id, question, desc, label, graph_tokens) with token_ids, attention, labels, graph_start.

    A sequence is the opening ids, a span of graph_tokens places (which hold the padding id), the first max_text ids of
    desc, question, the user's end, and, with labels, the first max_new ids of the label and the end. All sequences of a
    batch are padded on the left to its longest. labels holds the label's ids in their places and IGNORED elsewhere, or
    is null without labels.
    """
    encode, tok = encoder(vocabulary), loaded(vocabulary)
    fixed = lambda t: F.array(*(F.lit(i) for i in tok.encode(t, add_special_tokens=False).ids)).cast("array<int>")
    x = samples.withColumns({"_q": encode("question"), "_d": encode("desc")} | ({"_l": encode("label")} if with_labels else {}))
    label = F.concat(F.slice("_l", 1, max_new), fixed(EOS)) if with_labels else F.array().cast("array<int>")
    count = F.greatest(F.coalesce("graph_tokens", F.lit(1)), F.lit(0)).cast("int")
    x = x.select(*samples.columns, label.alias("_l"), F.concat(F.slice("_d", 1, max_text), "_q", fixed(EOS_USER)).alias("_t"), count.alias("_g"))
    bos = fixed(BOS)
    x = x.withColumn("_n", F.size(bos) + F.col("_g") + F.size("_t") + F.size("_l"))
    x = x.withColumn("_pad", F.max("_n").over(Window.partitionBy("batch")) - F.col("_n"))  # a batch is a few sequences by definition
    fill = lambda v, n: F.array_repeat(F.lit(v), n)
    return x.select(
        *samples.columns,
        F.concat(fill(pad_id, F.col("_pad")), bos, fill(pad_id, F.col("_g")), "_t", "_l").alias("token_ids"),
        F.concat(fill(0, F.col("_pad")), fill(1, F.col("_n"))).alias("attention"),
        (F.concat(fill(IGNORED, F.col("_pad") + F.col("_n") - F.size("_l")), "_l") if with_labels else F.lit(None).cast("array<int>")).alias("labels"),
        (F.col("_pad") + F.size(bos)).alias("graph_start"),
    )


def batched(nodes: DataFrame, edges: DataFrame, batch: Column) -> tuple[DataFrame, DataFrame]:
    """Subgraphs of questions as one graph a batch: nodes with batch, graph (place of the question in its batch) and
    local (place of the node in the batch), edges with both ends renumbered.

    nodes: qid, node_idx and others. edges: qid, src_idx, dst_idx and others; edges without both ends are not kept.
    """
    sizes = nodes.groupBy("qid").agg(F.count("*").alias("_n")).withColumn("batch", batch)  # a row a question
    w = Window.partitionBy("batch").orderBy("qid")
    sizes = sizes.select("qid", "batch", (F.row_number().over(w) - 1).alias("graph"), F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))
    own = F.row_number().over(Window.partitionBy("qid").orderBy("node_idx")) - 1
    n = nodes.withColumn("_own", own).join(sizes, "qid").withColumn("local", (F.col("_first") + F.col("_own")).cast("long")).drop("_first", "_own")
    end = lambda c, to: n.select("qid", F.col("node_idx").alias(c), F.col("local").alias(to), *(["batch"] if to == "src_local" else []))
    return n, edges.join(end("src_idx", "src_local"), ["qid", "src_idx"]).join(end("dst_idx", "dst_local"), ["qid", "dst_idx"])
