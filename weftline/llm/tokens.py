"""Token counts of a public tokenizer, and a small hashed vector of each text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd

#: Rank file of the tokenizer; a parameter of every operator that counts tokens.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern by which byte-level BPE splits a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Features of a hashed document vector, its projected dimensions, and bits a dimension of the curve.
FEATURES, DIMS, BITS = 1024, 4, 10


@lru_cache(maxsize=2)
def encoder(path: str = TOKENIZER):
    """The encoder of a rank file, one for each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(text: str | None, path: str = TOKENIZER) -> np.ndarray:
    """Token ids of a whole text; none for null and empty texts. Lone surrogates become replacement marks."""
    if not text:
        return np.zeros(0, dtype=np.uint32)
    enc = encoder(path)
    try:
        return enc.encode_to_numpy(text, disallowed_special=())
    except UnicodeEncodeError:
        return enc.encode_to_numpy(text.encode("utf-8", "replace").decode(), disallowed_special=())


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """A fixed Gaussian matrix, the same in every worker."""
    return np.random.default_rng(7).standard_normal((FEATURES, DIMS)).astype(np.float32)


def place(ids: np.ndarray) -> np.ndarray:
    """Grid coordinates of a text: hashed token counts, damped, of length one, projected and squashed to BITS bits."""
    if not len(ids):
        return np.zeros(DIMS, dtype=np.int64)
    slots = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    v = np.log1p(np.bincount(slots.astype(np.int64), minlength=FEATURES))
    p = (v / np.linalg.norm(v)) @ projection()
    return np.clip((np.tanh(p) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(grid: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each grid point on the Hilbert curve, by Skilling's transform over all rows at once."""
    x = np.array(grid, dtype=np.int64, copy=True)
    n, d = x.shape
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(high, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(n, dtype=np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[:, d - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    key = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[:, i] >> b) & 1)
    return key


#: A text of this many characters a token, and one of so many tokens, is worth its full weight in that respect.
CHARS_A_TOKEN, TOKENS_ENOUGH = 4.0, 128


def quality(text: str | None, ids: np.ndarray) -> float:
    """A weight in [0.05, 1]: the share of letters, how well the tokenizer knows the text's words (characters a token: noise and encoded data
    have few), how little it repeats itself (distinct pairs of tokens), and whether it is long enough to say something."""
    if not text or not len(ids):
        return 0.05
    letters = sum(map(str.isalpha, text)) / len(text)
    known = min(1.0, len(text) / len(ids) / CHARS_A_TOKEN)
    pairs = ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)
    fresh = len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0
    return round(0.05 + 0.95 * letters * known * fresh * min(1.0, len(ids) / TOKENS_ENOUGH), 6)


def size_rows(path: str, keep: list[str], curve: bool, weigh: bool):
    """A mapInPandas function: ``keep`` columns, n_tokens, and the curve key or weight where asked for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[keep].copy()
            ids = [encode(t, path) for t in pdf["text"]]
            out["n_tokens"] = np.array([len(x) for x in ids], dtype=np.int64)
            if curve:
                grid = np.array([place(x) for x in ids], dtype=np.int64).reshape(len(ids), DIMS)
                out["curve_key"] = hilbert(grid)
            if weigh:
                out["weight"] = np.array([quality(t, x) for t, x in zip(pdf["text"], ids)], dtype=np.float64)
            yield out

    return run
