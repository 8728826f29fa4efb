"""Byte ranges of files: what is asked for is read, and nothing else.

Spark deals the ranges out by file and place; each task opens its files and reads its ranges in their order, those that
touch in one read. Files may lie in any store that Arrow's file systems reach.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file whose ranges go to one task, and bytes read at once, at most, unless one range is longer.
NEAR, AT_ONCE = 64 << 20, 8 << 20


def opened(path: str):
    """Arrow's file system and path of a URI."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def read_ranges(rows: DataFrame) -> DataFrame:
    """rows (file, at, length, and others) with `data`, the bytes, and `read`, the bytes of the read that began with
    this row (0 where an earlier one brought its bytes). A range beyond its file's end is an error."""

    def fetched(batches):
        import numpy as np

        name, file = None, None
        for b in batches:
            files, at, length = b.column("file").to_pylist(), *(b.column(c).to_numpy() for c in ("at", "length"))
            data, read, i = [], np.zeros(len(files), np.int64), 0
            while i < len(files):
                j = i + 1
                while j < len(files) and files[j] == files[i] and at[j] == at[j - 1] + length[j - 1] and at[j] + length[j] - at[i] <= AT_ONCE:
                    j += 1
                if files[i] != name:
                    name = files[i]
                    store, path = opened(name)
                    file = store.open_input_file(path)
                got = file.read_at(int(at[j - 1] + length[j - 1] - at[i]), int(at[i]))
                if len(got) != at[j - 1] + length[j - 1] - at[i]:
                    raise ValueError(f"{name} ends before byte {at[j - 1] + length[j - 1]}")
                read[i] = len(got)
                data += [got[at[k] - at[i] : at[k] - at[i] + length[k]] for k in range(i, j)]
                i = j
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary()), pa.array(read)], [*b.schema.names, "data", "read"])

    near = rows.repartition("file", F.floor(F.col("at") / NEAR)).sortWithinPartitions("file", "at")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return near.mapInArrow(fetched, f"{fields}, data binary, read long")
