"""Problem 8: filling containers of fixed capacity along a space-filling curve."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.tokens import TOKENIZER, size_rows
from weftline.session import materialize, spread

CAPACITY = 2048
#: Neighbours on the curve that are packed together, best fit, largest first.
WINDOW = 8192
PACKED = "doc_id long, piece_no int, token_start long, n_tokens long, container_id long, place_in_container int"


def fit(sizes: np.ndarray, rooms: list[tuple[int, int]], first: int, capacity: int) -> tuple[np.ndarray, int]:
    """Best fit, largest first, ties in curve order. ``rooms``: sorted (room, container) of the open containers, updated."""
    where = np.zeros(len(sizes), dtype=np.int64)
    for i in np.lexsort((np.arange(len(sizes)), -sizes)):
        size = int(sizes[i])
        k = bisect_left(rooms, (size, -1))
        if k < len(rooms):
            room, box = rooms.pop(k)
        else:
            room, box = capacity, first
            first += 1
        where[i] = box
        if room > size or size == 0:
            insort(rooms, (room - size, box))
    return where, first


def pack_stream(capacity: int, window: int):
    """A mapInPandas function over rows in curve order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 33
        rooms: list[tuple[int, int]] = []
        filled: dict[int, int] = {}
        first, held = 0, []

        def flush(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal first, rooms, filled
            sizes = pdf["n_tokens"].to_numpy()
            where, first = fit(sizes, rooms, first, capacity)
            at = []
            for box in where.tolist():
                at.append(filled.get(box, 0))
                filled[box] = at[-1] + 1
            # fullest first: keep the emptiest open containers for the next neighbours, a bounded number of them
            rooms = rooms[-window:]
            live = {box for _, box in rooms}
            filled = {b: n for b, n in filled.items() if b in live}
            return pdf.drop(columns="curve_key").assign(container_id=base + where, place_in_container=np.array(at, dtype=np.int32))

        n = 0
        for pdf in batches:
            held.append(pdf)
            n += len(pdf)
            if n >= window:
                yield flush(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield flush(pd.concat(held, ignore_index=True))

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, window: int = WINDOW) -> DataFrame:
    """Assign every document to a container of ``capacity`` tokens.

    Needs doc_id and text; other columns are ignored. One row for each piece; a text of up to ``capacity`` tokens is one
    piece, a longer one is cut after every ``capacity`` tokens. Null and empty texts are pieces of no tokens and share
    containers with others. Repeated doc_ids are packed once for each row; rows without one are left out. An empty table gives no rows.

    Plan: tokens and curve key in one pass over the text; only ids, sizes and keys are range-sorted by (key, id), so copies of
    one text spread over tasks; each task packs its stretch of the curve with a bounded set of open containers.
    """
    sized = spread(docs.where("doc_id is not null").select("doc_id", "text")).mapInPandas(size_rows(tokenizer, ["doc_id"], True, False), "doc_id long, n_tokens long, curve_key long")
    sized = materialize(sized, "pack-sizes")  # the range sort samples its input: else every text is tokenized twice
    n = F.col("n_tokens")
    pieces = sized.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((n - 1) / capacity)).cast("int")))).select(
        "doc_id",
        "piece_no",
        (F.col("piece_no") * F.lit(capacity).cast("long")).alias("token_start"),
        F.least(F.lit(capacity).cast("long"), n - F.col("piece_no") * F.lit(capacity).cast("long")).alias("n_tokens"),
        "curve_key",
    )
    order = ["curve_key", "doc_id", "piece_no"]
    return pieces.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(pack_stream(capacity, window), PACKED)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, mean fill, and the fewest containers that any packing could use."""
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("items"))
    return boxes.agg(
        F.count("*").alias("containers"),
        F.sum("items").alias("items"),
        F.sum("used").alias("tokens"),
        F.max("used").alias("fullest"),
        F.ceil(F.sum("used") / capacity).alias("least_containers"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
    )
