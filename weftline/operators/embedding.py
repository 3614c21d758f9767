"""Embedding backends as pandas UDFs."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Backend = Callable[[list[str]], np.ndarray]


def offline_backend(dimension: int, uniform: bool = False) -> Backend:
    """Vectors seeded by the SHA-256 of each text: the same in every process. Normal and of length one, or uniform in [0, 1)."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.empty((len(texts), dimension), dtype=np.float32)
        for k, t in enumerate(texts):
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode("utf-8", "replace")).digest()[:8], "big"))
            v = rng.random(dimension) if uniform else rng.standard_normal(dimension)
            out[k] = v if uniform else v / np.linalg.norm(v)
        return out

    return encode


def embed(text: Column, load: Callable[[], Backend], batch: int = 32) -> Column:
    """Embed a text column. ``load`` runs once in each worker; a null text gives a null vector; an error of the backend fails the job."""
    state: dict[str, Backend] = {}

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        if "b" not in state:
            state["b"] = load()
        out: list = [None] * len(s)
        known = [k for k, t in enumerate(s) if t is not None]
        for a in range(0, len(known), batch):
            part = known[a : a + batch]
            for k, v in zip(part, state["b"]([s.iloc[k] for k in part])):
                out[k] = v
        return pd.Series(out)

    return run(text)
