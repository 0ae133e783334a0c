"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins. Boosting goes round the features in turn, each time fitting a shallow tree to the
residuals over that feature's bins and adding it, shrunk, to the feature's lookup table; then it goes round the pairs of
features that explain most of what is left, with a tree of two cuts each. A score is the sum of one entry from each table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.language import held_out

#: At most so many labelled rows are fitted: those with the least hash of their id.
FIT_ROWS = 20_000
BINS, COARSE, ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 32, 8, 120, 40, 6, 0.15
_PUNCTUATION = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_FLAT = bytes(i for i in range(256) if not 65 <= i <= 90)
_NO_DIGITS = bytes(i for i in range(256) if not 48 <= i <= 57)
_NO_MARKS = bytes(i for i in range(256) if i not in _PUNCTUATION)
_RARE = b"|#$%&*+<=>@[]^_{}~\\/!"
_NO_RARE = bytes(i for i in range(256) if i not in _RARE)
FEATURES = ("log_bytes", "log_words", "word_bytes", "distinct_words", "repeats", "capitals", "digits", "marks", "rare_marks", "marked_words", "log_lines", "distinct_lines", "line_words", "long_words", "top_word")


def features(text: str | None) -> list[float]:
    """FEATURES of a whole text; of a text without words, all are zero but for its length and marks."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size = len(words), max(len(raw), 1)
    kinds = set(words)
    counts = np.unique(np.fromiter(map(hash, words), dtype=np.int64, count=n), return_counts=True)[1] if n else np.zeros(0)
    return [
        np.log1p(len(raw)), np.log1p(n), sum(map(len, words)) / max(n, 1), len(kinds) / max(n, 1) ** 0.8, sum(a == b for a, b in zip(words, words[1:], strict=False)) / max(n - 1, 1),
        len(raw.translate(None, _FLAT)) / size, len(raw.translate(None, _NO_DIGITS)) / size, len(raw.translate(None, _NO_MARKS)) / size, len(raw.translate(None, _NO_RARE)) / size,
        sum(w[-1] in _RARE for w in words) / max(n, 1), np.log1p(len(lines)), len(set(lines)) / max(len(lines), 1), n / max(len(lines), 1), max(map(len, words), default=0), float(counts.max(initial=0)) / max(n, 1),
    ]


def matrix(texts) -> np.ndarray:
    return np.array([features(t) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and place of the best cut of a row of bins with gradients g and weights h."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1) - g.sum() ** 2 / (h.sum() + 1)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Values of a tree with so many leaves over the bins."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, at, part = max((*_cut(g[a:b], h[a:b]), (a, b)) for a, b in parts)
        if gain <= 1e-9:
            break
        parts.remove(part)
        parts += [(part[0], part[0] + at), (part[0] + at, part[1])]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and values of the best tree that cuts each of two features once."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, len(g)):
        for j in range(1, g.shape[1]):
            cells = [(slice(a, b), slice(c, d), cg[b, d] - cg[a, d] - cg[b, c] + cg[a, c], ch[b, d] - ch[a, d] - ch[b, c] + ch[a, c]) for a, b in ((0, i), (i, len(g))) for c, d in ((0, j), (j, g.shape[1]))]
            if (gain := sum(x * x / (w + 1) for _, _, x, w in cells)) > best:
                best, out = gain, np.zeros_like(g)
                for r, c, x, w in cells:
                    out[r, c] = x / (w + 1)
    return best, out


class Model:
    """Lookup tables; the sum of a row's entries is its log odds."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        self.coarse = [np.unique(np.quantile(c, np.linspace(0, 1, COARSE + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        share = (y.sum() + 1) / (len(y) + 2)
        self.base = float(np.log(share / (1 - share)))
        self.tables, self.pairs = [np.zeros(len(e) + 1) for e in self.edges], []
        bins, wide = self._bins(x, self.edges), self._bins(x, self.coarse)
        odds = np.full(len(y), self.base)
        for _ in range(ROUNDS if len(y) else 0):
            for f, table in enumerate(self.tables):
                p = 1 / (1 + np.exp(-odds))
                step = RATE * _tree(*(np.bincount(bins[f], w, len(table)) for w in (y - p, p * (1 - p))))
                table += step
                odds += step[bins[f]]
        gains = []
        for i in range(len(self.coarse)):
            for j in range(i):
                gains.append((self._pair(wide, i, j, y, odds)[0], i, j))
        self.pairs = [(i, j, np.zeros((len(self.coarse[i]) + 1, len(self.coarse[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
        for _ in range(PAIR_ROUNDS if len(y) else 0):
            for i, j, table in self.pairs:
                step = RATE * self._pair(wide, i, j, y, odds)[1]
                table += step
                odds += step[wide[i], wide[j]]

    def _pair(self, wide, i, j, y, odds) -> tuple[float, np.ndarray]:
        p, shape = 1 / (1 + np.exp(-odds)), (len(self.coarse[i]) + 1, len(self.coarse[j]) + 1)
        at = wide[i] * shape[1] + wide[j]
        return _quadrants(*(np.bincount(at, w, shape[0] * shape[1]).reshape(shape) for w in (y - p, p * (1 - p))))

    @staticmethod
    def _bins(x: np.ndarray, edges) -> list[np.ndarray]:
        return [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]

    def score(self, x: np.ndarray) -> np.ndarray:
        bins, wide = self._bins(x, self.edges), self._bins(x, self.coarse)
        odds = self.base + sum(t[b] for t, b in zip(self.tables, bins, strict=True)) + sum(t[wide[i], wide[j]] for i, j, t in self.pairs)
        return 1 / (1 + np.exp(-odds))


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """A model of quality from the labelled rows that are not held out, at most fit_rows of them.

    Rows without an id or a label teach nothing; an id labelled both ways has its larger label. Without any label the
    model scores 0.5.
    """
    ids = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"), 3, 1)).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame(matrix(batch["text"]), columns=[f"x{i}" for i in range(len(FEATURES))])
            yield out.assign(id=batch["doc_id"].astype(str).to_numpy(), y=batch["quality"].astype(float).to_numpy())

    schema = ", ".join(f"x{i} double" for i in range(len(FEATURES)))
    rows = rows.mapInPandas(measure, f"{schema}, id string, y double").orderBy(F.xxhash64("id"), "id", "x0").limit(fit_rows).toPandas()
    return Model(rows[[f"x{i}" for i in range(len(FEATURES))]].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the column quality_score (which replaces one of that name); null and empty texts are scored too."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model.__new__(Model)
        vars(own).update(shared.value)
        for batch in texts:
            yield pd.Series(own.score(matrix(batch)))

    return docs.withColumn("quality_score", F.pandas_udf(score, "double")("text"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the model does not reject."""
    model = fit(docs, labels)
    return scored(docs.withColumn("_row", F.struct(*docs.columns)).select("_row", "text"), model).where("quality_score >= 0.5").select("_row.*")
