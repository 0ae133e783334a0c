"""Benchmark decontamination by a prefix-filtered join of exact containment.

Every item window (13 words, or a shorter item whole) is a sequence of shingles. Shingles are ordered by rarity over all
documents. For containment 1 the necessary prefix of a window is one shingle, its rarest: a document holds the window only
if it holds that shingle. So documents are joined with windows on that shingle alone; the shingle's place in the window
gives where the window would start in the document, the length bound rejects what doesn't fit, and the rest is verified
word by word.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import written

WINDOW, SHINGLE = 13, 3
#: Item text up to this size is held as one index by each Python worker; a larger benchmark is joined in blocks of it.
BLOCK_BYTES = 4 << 20
#: ASCII other than letters and digits separates words; all else belongs to them.
_WORDS = bytes((i + 32 if 65 <= i <= 90 else i) if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def item_words(items: list[tuple]) -> list[tuple[str, list[bytes]]]:
    """id and words of the items that have any."""
    return [(item_id, words) for item_id, text in items if (words := words_of(text))]


def shingles(words: list[bytes]) -> list[bytes]:
    """The shingles at each place of an item; the whole of one that is shorter."""
    k = min(SHINGLE, len(words))
    return [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]


class Vocabulary:
    """Shingles of the windows, found in documents."""

    def __init__(self, tokens):
        self.tokens = set(tokens)
        self.first = {(x.partition(b" ")[0]) for x in self.tokens}
        self.lengths = sorted({x.count(b" ") + 1 for x in self.tokens})

    def found(self, words: list[bytes]) -> Iterator[tuple[int, bytes]]:
        first, tokens, lengths = self.first, self.tokens, self.lengths
        for i in [i for i, w in enumerate(words) if w in first]:
            for k in lengths:
                if (x := b" ".join(words[i : i + k])) in tokens and i + k <= len(words):
                    yield i, x


def shingle_counts(docs: DataFrame, items: list[tuple[str, list[bytes]]]) -> dict[bytes, int]:
    """How often each of the items' shingles occurs in all documents. As many rows come back as the block has shingles."""
    shared = docs.sparkSession.sparkContext.broadcast({x for _, words in items for x in shingles(words)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, total = Vocabulary(shared.value), Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(x for _, x in vocabulary.found(words_of(text.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total.keys()), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    shared.unpersist()
    return {bytes(r["token"]): r["n"] for r in rows}


class Windows:
    """The items' windows: for the rarest shingle of each, its place in the window, and the window's number.

    Windows with the same words are one, whether of one item or of many; so repetitive items have few.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], counts: dict[bytes, int]):
        self.anchors: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.words: list[list[bytes]] = []
        self.owners: list[set[str]] = []
        known: dict[tuple[bytes, ...], int] = {}
        for item_id, words in items:
            n = min(WINDOW, len(words))
            rarity = [(counts.get(x, 0), x) for x in shingles(words)]
            for start in range(len(words) - n + 1):
                own = words[start : start + n]
                number = known.setdefault(tuple(own), len(known))
                if number == len(self.words):
                    _, x, at = min((*rarity[start + i], i) for i in range(n - min(SHINGLE, n) + 1))
                    self.anchors[x].append((at, number))
                    self.words.append(own)
                    self.owners.append(set())
                self.owners[number].add(item_id)

    def hits(self, words: list[bytes], vocabulary: Vocabulary) -> tuple[list[int], set[str]]:
        """start, end, ... of the words that occurring windows cover, overlaps joined, and the ids of their items."""
        ranges, found = [], set()
        for place, token in vocabulary.found(words):
            for at, number in self.anchors[token]:
                window, start = self.words[number], place - at
                if start >= 0 and words[start : start + len(window)] == window:
                    found.add(number)
                    if ranges and ranges[-2] <= start <= ranges[-1]:
                        ranges[-1] = max(ranges[-1], start + len(window))
                    else:
                        ranges += (start, start + len(window))
        return ranges, set().union(*(self.owners[n] for n in found))


def merged(ranges: list[int]) -> list[int]:
    """start, end, start, end, ... of the union of ranges, in order."""
    out: list[int] = []
    for a, b in sorted(zip(ranges[::2], ranges[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def merged_all(ranges: pd.Series) -> pd.Series:
    return ranges.map(lambda x: [] if x is None else merged(list(x)))


def _scan(docs: DataFrame, windows: Windows) -> DataFrame:
    """docs with the hit words (as merged start, end pairs) and items of this block added to _hits and _items."""
    shared = docs.sparkSession.sparkContext.broadcast(windows)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        vocabulary = Vocabulary(known.anchors)
        for batch in batches:
            text, hits, found_items, n = batch.column("text"), [], [], []
            for t, h, i in zip(text, batch.column("_hits"), batch.column("_items"), strict=True):
                words = words_of(t.as_py())
                ranges, ids = known.hits(words, vocabulary)
                hits.append(merged(h.as_py() + ranges))
                found_items.append(sorted(ids.union(i.as_py())))
                n.append(len(words))
            new = {"_hits": pa.array(hits, pa.list_(pa.int32())), "_items": pa.array(found_items, pa.list_(pa.string())), "_n_words": pa.array(n, pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(f.name, batch.column(f.name)) for f in batch.schema], names=batch.schema.names)

    return docs.mapInArrow(scan, docs.schema)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The distinct items, block by block: only one is on the driver at a time."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), "text").distinct()
    items = written(items, "items")
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for i in range(n):
        yield [(r["id"], r["text"]) for r in items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == i).collect()]


def hits(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with _n_words, _hits (start, end, start, end, ... of hit words) and _items (sorted ids of items with occurring windows).

    One scan of the documents counts shingles and one joins; neither shuffles documents. For a benchmark larger than
    block_bytes the documents are written once, with a row number. Each further block then costs two scans of the texts and
    gives rows of hit documents alone, without texts, which are joined at the end. Null texts and items have no words;
    repeated documents are judged each by itself, repeated items are one; an id may be of any type.
    """
    none = {"_n_words": F.lit(0).cast("long"), "_hits": F.array().cast("array<int>"), "_items": F.array().cast("array<string>")}
    out, more = docs.withColumns(none), None
    for i, block in enumerate(item_blocks(benchmark, block_bytes)):
        items = item_words(block)
        if i == 0:
            out = _scan(out, Windows(items, shingle_counts(docs, items)))
            continue
        if i == 1:
            out = written(out.withColumn("_doc", F.monotonically_increasing_id()), "decontamination")
        texts = out.select("_doc", "text")
        found = _scan(texts.withColumns(none), Windows(items, shingle_counts(texts, items))).where("size(_hits) > 0")
        found = written(found.select("_doc", F.col("_hits").alias("_more"), F.col("_items").alias("_others")), "decontamination-hits")
        more = found if more is None else more.unionByName(found)
    if more is None:
        return out
    more = more.groupBy("_doc").agg(F.flatten(F.collect_list("_more")).alias("_more"), F.flatten(F.collect_list("_others")).alias("_others"))
    both = out.join(more, "_doc", "left")
    union = F.pandas_udf(merged_all, "array<int>")(F.concat("_hits", "_more"))
    both = both.withColumns({"_hits": F.when(F.col("_more").isNull(), F.col("_hits")).otherwise(union), "_items": F.when(F.col("_others").isNull(), F.col("_items")).otherwise(F.array_sort(F.array_distinct(F.concat("_items", "_others"))))})
    return both.drop("_doc", "_more", "_others")


def judged(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated: at least a twentieth of the words is hit."""
    found = hits(docs.select("doc_id", "text"), benchmark, block_bytes).withColumn("n_hit", _n_hit())
    return found.select("doc_id", F.col("_n_words").alias("n_words"), "n_hit", F.size("_items").cast("long").alias("n_items"), F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), _contaminated().alias("contaminated"))


def _n_hit() -> Column:
    """The summed lengths of the ranges in _hits: ends less starts."""
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign"))
    return F.aggregate("_hits", start, lambda a, x: F.struct((a["sum"] + a["sign"] * x).alias("sum"), (-a["sign"]).alias("sign")), lambda a: a["sum"])


def _contaminated() -> Column:
    return (_n_hit() > 0) & (20 * _n_hit() >= F.col("_n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated ones. Columns travel under numbers, so that no name can clash."""
    rest = [c for c in docs.columns if c != "text"]
    numbered = docs.select("text", *[F.col(c).alias(f"_{i}") for i, c in enumerate(rest)])
    back = {c: F.col(f"_{i}").alias(c) for i, c in enumerate(rest)}
    return hits(numbered, benchmark).where(~_contaminated()).select(*[back.get(c, F.col(c)) for c in docs.columns])
