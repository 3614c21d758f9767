"""Problem 4: cutting oversized items at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import spread

LIMIT, OVERLAP = 1024, 50
PIECES = "chunk_id long, piece_no int, pieces int, start_char long, end_char long, start_line int, end_line int, chunk_type string, cut string, content string"
TOKEN = re.compile(r"\r\n|\n|[^\S\n]+|\w+|[^\w\s]")
BLANK = re.compile(r"\n[^\S\n]*\n")


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    """Sorted offsets at which a cut is natural, best kind first: after a blank line, after a line, after a token.

    Token offsets are the prefix sums of token lengths, so no offset is inside a word, number or CRLF."""
    sizes = np.fromiter((len(t) for t in TOKEN.findall(text)), dtype=np.int64)
    ends = np.cumsum(sizes)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lines = np.flatnonzero(points == 10) + 1
    blanks = np.fromiter((m.end() for m in BLANK.finditer(text)), dtype=np.int64)
    white = ends[np.isin(points[ends - 1], (9, 10, 13, 32))] if len(ends) else ends
    return [("paragraph", blanks), ("line", lines), ("space", white), ("token", ends)]


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, kind of the cut at the end) of the pieces: at most ``limit`` characters each, the next one beginning
    ``overlap`` before the last end. The last boundary under the limit is found by binary search, the best kind at which
    the piece is at least half full, else the best at all; without any boundary the cut is hard, at the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n, "end")]
    kinds = boundaries(text)
    out, start = [], 0
    while n - start > limit:
        cut, how = start + limit, "hard"
        for floor, (kind, at) in [(f, x) for f in (start + limit // 2, start + overlap) for x in kinds]:
            k = int(np.searchsorted(at, start + limit, side="right")) - 1
            if k >= 0 and at[k] > floor:
                cut, how = int(at[k]), kind
                break
        out.append((start, cut, how))
        start = cut - overlap
    out.append((start, n, "end"))
    return out


def pieces_of(limit: int, overlap: int):
    """A mapInPandas function from chunks to pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for cid, text, line, kind in zip(pdf["id"], pdf["content"], pdf["start_line"], pdf["chunk_type"]):
                cuts = cut_points(text, limit, overlap)
                breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) == 10)
                for k, (a, b, how) in enumerate(cuts):
                    first = last = None
                    if line == line and line is not None:
                        first = int(line) + int(np.searchsorted(breaks, a))
                        last = int(line) + int(np.searchsorted(breaks, max(a, b - 1)))
                    rows.append((cid, k, len(cuts), a, b, first, last, kind, how, text[a:b]))
            out = pd.DataFrame(rows, columns=["chunk_id", "piece_no", "pieces", "start_char", "end_char", "start_line", "end_line", "chunk_type", "cut", "content"])
            yield out.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of every chunk whose content is longer than ``limit`` characters (code points).

    Needs id, content, start_line and chunk_type. Concatenating the pieces without their overlap gives the content back.
    A null start_line gives null lines; a null content is never oversized; repeated rows are split each for itself; chunks
    within the limit, rows without an id and empty tables give no rows. Only oversized rows leave the JVM; nothing is shuffled unless the table has
    fewer splits than there are cores.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    big = chunks.select("id", "content", "start_line", "chunk_type").where((F.char_length("content") > limit) & F.col("id").isNotNull())
    return spread(big).mapInPandas(pieces_of(limit, overlap), PIECES)
