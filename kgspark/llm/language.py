"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter trigram binds its letters' vectors, each permuted by its place
(rotated, then multiplied); a text bundles (adds) its trigrams' vectors, and a language's prototype bundles the unit
vectors of its texts. A text gets the language whose prototype, centred on the mean of all prototypes, has the largest
cosine.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM, BLOCK = 1024, 64
SPACE = " "
_RUN = re.compile(r"[^\W\d_]+")


def letter_vector(letter: str) -> np.ndarray:
    seed = int.from_bytes(hashlib.sha256(letter.encode("utf-8", "surrogatepass")).digest()[:8], "big")
    return (np.random.default_rng(seed).integers(0, 2, DIM, dtype=np.int8) * 2 - 1).astype(np.int8)


class Encoder:
    """Bundles the texts of a batch; keeps the vectors of recent trigrams."""

    def __init__(self):
        self.letters: dict[str, np.ndarray] = {}
        self.at: dict[int, int] = {}
        self.table = np.zeros((0, DIM), dtype=np.float32)

    def _letter(self, code: int, turn: int) -> np.ndarray:
        letter = chr(code)
        if letter not in self.letters:
            self.letters[letter] = letter_vector(letter)
        return np.roll(self.letters[letter], turn)

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of distinct trigrams (three 21-bit code points each)."""
        if len(self.at) > 20_000:
            self.at, self.table = {}, np.zeros((0, DIM), dtype=np.float32)
            self.letters = {}
        new = [g for g in grams.tolist() if g not in self.at]
        if new:
            more = np.array([self._letter(g >> 42, 2) * self._letter(g >> 21 & 0x1FFFFF, 1) * self._letter(g & 0x1FFFFF, 0) for g in new], dtype=np.float32)
            self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate((self.table, more))
        return self.table[[self.at[g] for g in grams.tolist()]]

    def unit(self, texts) -> np.ndarray:
        """A unit vector for each text, zero for one without letters."""
        out = np.zeros((len(texts), DIM), dtype=np.float32)
        for start in range(0, len(texts), BLOCK):
            counted = [trigrams(t) for t in texts[start : start + BLOCK]]
            grams = np.unique(np.concatenate([g for g, _ in counted]))
            if not len(grams):
                continue
            # a block of very long or strange texts is bundled in columns, so that memory stays bounded
            sums = np.zeros((len(counted), DIM), dtype=np.float32)
            for a in range(0, len(grams), 8192):
                part = grams[a : a + 8192]
                weights = np.zeros((len(counted), len(part)), dtype=np.float32)
                for i, (g, n) in enumerate(counted):
                    inside = (g >= part[0]) & (g <= part[-1])
                    weights[i, np.searchsorted(part, g[inside])] = n[inside]
                sums += weights @ self.rows(part)
            out[start : start + len(counted)] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return out


def trigrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of the letters, words being set off by a space, and their counts."""
    runs = _RUN.findall(text.lower()) if text else []
    if not "".join(runs).isalpha():  # numerals such as ½ and Ⅷ are no letters
        runs = [x for run in runs for x in "".join(c if c.isalpha() else SPACE for c in run).split()]
    if not runs:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    codes = np.frombuffer(f" {SPACE.join(runs)} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and their unit prototypes, from all rows (text, lang). A few sums a partition come together.

    A repeated row counts as often as it stands. Sums of partitions are rounded to six places, so rows dealt otherwise can
    turn a score's last digits, and a tie that is closer than that.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = Encoder(), {}
        for batch in batches:
            vectors = encoder.unit(batch.column(0).to_pylist())
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs.tolist()):
                total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        for lang, v in total.items():
            for i in range(0, DIM, 64):
                yield pa.RecordBatch.from_pylist([{"lang": lang, "i": j, "x": float(round(v[j], 6))} for j in range(i, i + 64)], schema=pa.schema([("lang", pa.string()), ("i", pa.int32()), ("x", pa.float64())]))

    rows = docs.where("lang is not null").select("text", "lang").mapInArrow(sums, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v")).orderBy("lang").collect()
    found = np.array([r["v"] for r in rows], dtype=np.float64).reshape(-1, DIM)
    return [r["lang"] for r in rows], found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], profiles: np.ndarray, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (half of one more than the best cosine).

    A null text, one without a letter, and any text where there are no prototypes get `und` and 0. Ties go to the language
    that sorts first; columns of these names are replaced.
    """
    centre = profiles.mean(axis=0) if len(langs) > 1 else np.zeros(DIM)
    turned = profiles - centre
    turned /= np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-12)
    shared = docs.sparkSession.sparkContext.broadcast((langs, turned.astype(np.float32), centre.astype(np.float32)))

    def judge(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names, protos, mean = shared.value
        encoder, names = Encoder(), np.array([*names, "und"], dtype=object)
        for batch in texts:
            vectors = encoder.unit(batch.tolist())
            has = np.abs(vectors).sum(axis=1) > 0
            off = (vectors - mean) * has[:, None]
            cosine = off @ protos.T / np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-9) if len(protos) else np.zeros((len(batch), 1))
            has &= len(protos) > 0
            yield pd.DataFrame({"lang_pred": names[np.where(has, cosine.argmax(axis=1), -1)], "score": np.where(has, np.clip(0.5 + 0.5 * cosine.max(axis=1), 0, 1), 0.0).astype(float)})

    udf = F.pandas_udf(judge, "lang_pred string, score double")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*kept, udf(text).alias("_found")).select(*kept, "_found.*")


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row. Held-out rows, and the source, teach nothing."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id"), 4, 2).alias("held_out"))
    langs, profiles = prototypes(rows.where(~F.col("held_out")))
    return predict(rows.select("doc_id", "held_out", "text"), langs, profiles).select("doc_id", "held_out", "lang_pred", "score")
