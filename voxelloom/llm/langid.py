"""Operator 10 - language identification by compression.

For each language a raw-content zstandard dictionary is made from a bounded
sample of its documents.  A text, reduced to lower-case letters and blanks, is
compressed whole with every dictionary; the smallest result names the
language.  Where the smallest two differ by less than a margin the decision is
marked as rejected.

Defined results
    * null text or text without a letter: ``und``, score 0, rejected.
    * no language to learn from: ``und`` for all rows.
    * equal sizes (also of languages with equal texts): the language that
      sorts first, rejected.
    * repeated rows are scored alike; other columns never matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelloom.llm import common, textkit

FOLDS, HELD = 3, 1
#: Documents that each language's dictionary is made from, at most.
DICTIONARY_DOCS = 400
DICTIONARY_BYTES = 110_000
WORD_LIST_BYTES = 30_000
#: About so many bytes of a text stay together in the sample.
PIECE_BYTES = 120
LEVEL = 9
#: A margin below this many bytes is narrow.
MIN_MARGIN = 2

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> str:
    """Lower-case letters of the text, words divided by single blanks."""
    return _NOT_LETTERS.sub(" ", text.lower()).strip()


def pieces(cleaned: str) -> list[str]:
    """The whole text in runs of about PIECE_BYTES, in an order given by their hash."""
    size = max(1, PIECE_BYTES * len(cleaned) // max(1, len(cleaned.encode())))
    out, at = set(), 0
    while at < len(cleaned):
        end = cleaned.find(" ", at + size, at + 2 * size)
        end = end if end > 0 else at + size
        out.add(cleaned[at:end].strip())
        at = end
    return sorted(out - {""}, key=lambda p: hashlib.blake2b(p.encode(), digest_size=8).digest())


def spread_sample(cleaned: list[str], room: int) -> str:
    """Distinct pieces from all over the texts: one of each text in turn, while there is room."""
    seen: set[str] = set()
    taken: list[str] = []
    waiting = [iter(pieces(t)) for t in cleaned]
    while waiting:
        left = []
        for own in waiting:
            piece = next((p for p in own if p not in seen), None)
            if piece is None:
                continue
            room -= len(piece.encode()) + 1
            if room < 0:
                return " ".join(taken)
            seen.add(piece)
            taken.append(piece)
            left.append(own)
        waiting = left
    return " ".join(taken)


def build_dictionary(texts: list[str]) -> bytes:
    """Sample text followed by frequent words, the most frequent at the end."""
    cleaned = [letters(t) for t in texts]
    counts = Counter(w for t in cleaned for w in t.split())
    listed, size = [], 0
    for word, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        size += len(word.encode()) + 1
        if size > WORD_LIST_BYTES or n < 2:
            break
        listed.append(word)
    sample = spread_sample(cleaned, DICTIONARY_BYTES - WORD_LIST_BYTES).encode()
    return b" " + sample + b" " + " ".join(reversed(listed)).encode() + b" "


def learn_dictionaries(docs: DataFrame) -> dict[str, bytes]:
    """Dictionary of each language: at most DICTIONARY_BYTES each are sent."""
    known = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold_of("doc_id", FOLDS) != HELD)
    )
    first = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("lang"), "doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").withColumn("at", F.row_number().over(first))
    ids = ids.where(F.col("at") <= DICTIONARY_DOCS).select("doc_id", "lang").distinct()
    ids = common.durable(ids.coalesce(1), "lang-sample")
    # DICTIONARY_DOCS ids for each language are broadcast
    sample = known.join(F.broadcast(ids), ["doc_id", "lang"])

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("text")
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "content": [build_dictionary(list(pdf["text"]))]})

    rows = sample.groupBy("lang").applyInPandas(build, "lang string, content binary").collect()
    return {r["lang"]: bytes(r["content"]) for r in sorted(rows, key=lambda r: r["lang"])}


class Identifier:
    """Sizes under every dictionary, smallest first."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = list(dictionaries)
        self.contents = dictionaries
        self._coders = None

    def __getstate__(self):
        return {"languages": self.languages, "contents": self.contents, "_coders": None}

    def _load(self):
        if self._coders is None:
            self._coders = []
            for content in self.contents.values():
                data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                data.precompute_compress(level=LEVEL)
                self._coders.append(
                    zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False)
                )
        return self._coders

    def identify(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        cleaned = letters(text) if text else ""
        if not self.languages or not any(map(str.isalpha, cleaned)):
            return "und", 0.0, True
        raw = b" " + cleaned.encode() + b" "
        sizes = np.array([len(c.compress(raw)) for c in self._load()])
        best = int(sizes.argmin())
        others = np.delete(sizes, best) - sizes[best]
        margin = int(others.min()) if len(others) else MIN_MARGIN
        score = 1.0 / (1.0 + float(np.exp2(-np.minimum(others, 60.0)).sum()))
        return self.languages[best], score, margin < MIN_MARGIN


def identify_languages(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, lang_pred, score, rejected."""
    model = Identifier(learn_dictionaries(docs))

    def run(texts):
        found = [model.identify(t.decode("utf-8", "replace") if t is not None else None) for t in texts]
        return [
            pa.array([f[0] for f in found], pa.string()),
            pa.array([f[1] for f in found], pa.float64()),
            pa.array([f[2] for f in found], pa.bool_()),
        ]

    return textkit.map_texts(docs, run, "lang_pred string, score double, rejected boolean")
