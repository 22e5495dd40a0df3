"""Vectorised tokenising and hashing of byte strings with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r.  Its 64-bit
hash is a position-free polynomial over per-byte random values, so that a
whole buffer of texts is hashed with a few array passes and no word objects.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelloom.llm import common

CHUNK_BYTES = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_RANDOM = np.random.default_rng(20240229).integers(1, 1 << 64, 256, dtype=np.uint64, endpoint=False)
_RANDOM[_SPACE] = 0
_powers = np.ones(1, np.uint64)
_inverses = np.ones(1, np.uint64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        n = max(n, CHUNK_BYTES + CHUNK_BYTES // 4)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _BASE, np.uint64)]))
            _inverses = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, _INVERSE, np.uint64)]))
    return _powers, _inverses


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads entropy to all bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Tokens:
    """Words of several texts: text i has words ``offsets[i]:offsets[i+1]``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    text_starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """Runs of texts of about ``limit`` bytes; a longer text comes alone."""
    at, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > at and size + n > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, texts[at:]


def tokenize(texts: list, lower: bool = True) -> Tokens:
    """Words of ``texts`` (bytes; None has none); ``lower`` maps A-Z to a-z."""
    raw = b" " + b" ".join([t or b"" for t in texts]) + b" "
    buf = np.frombuffer(raw, np.uint8)
    if lower:
        buf = _LOWER[buf]
    space = _SPACE[buf]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = edges[0::2], edges[1::2]
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    text_starts = np.concatenate([[0], np.cumsum(lengths + 1)]) + 1
    offsets = np.searchsorted(starts, text_starts)
    if len(starts):
        powers, inverses = _tables(len(buf))
        values = _RANDOM[buf]
        values *= powers[: len(buf)]
        hashes = np.add.reduceat(values, starts)
        hashes *= inverses[starts]
        hashes = mix64(hashes)
    else:
        hashes = np.zeros(0, np.uint64)
    return Tokens(buf, starts, ends, hashes, offsets, text_starts)


def word_hash(word: bytes) -> int:
    """The hash of one word as :func:`tokenize` gives it."""
    return int(tokenize([word], lower=False).hashes[0])


def combine(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out *= np.uint64(_BASE)
        out += hashes[j : j + n]
    return mix64(out)


def sums_by_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Row sums per text; texts without words get zeros."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[:-1][full], axis=0)
    return out


def map_texts(
    docs: DataFrame, fn, fields: str, id_col: str = "doc_id", text_col: str = "text", keep: dict | None = None
) -> DataFrame:
    """``fn(list of bytes or None) -> list of arrays`` beside each document id.

    Arrow batches go through whole; ids and ``keep`` (name to Column) stay
    Arrow values, so nulls and large numbers survive.  ``fields`` is the DDL
    of the added columns.
    """
    common.bounded_batches(docs.sparkSession)
    kept = {id_col: F.col(id_col), **(keep or {})}
    own = "_text"
    while own in kept:
        own += "_"
    slim = docs.select(*[c.alias(n) for n, c in kept.items()], F.encode(F.col(text_col), "UTF-8").alias(own))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema[:-1])
    names, passing = [*kept, *[f.strip().split()[0] for f in fields.split(",")]], len(kept)

    def run(batches):
        for batch in batches:
            arrays = fn(batch.column(passing).to_pylist())
            columns = [a if isinstance(a, pa.Array) else pa.array(a) for a in arrays]
            passed = [batch.column(i) for i in range(passing)]
            yield pa.RecordBatch.from_arrays([*passed, *columns], names=names)

    return slim.mapInArrow(run, f"{schema}, {fields}")
