"""Phrase collocations, counted in HAT-tries.

Each task counts word sequences in a shallow trie over word ids whose leaves are hash containers. A container that has grown
too large bursts into a node with a container for each next word. When the trie holds too many entries, whole subtrees, the
largest first, are spilled as sorted runs and leave the trie. Every word starts one sequence, with up to two words after it
in its piece, so a phrase's count is the sum over the sequences that it begins. Runs are dealt by prefix (language and first
two words), compressed, and merged in one stream a partition; only counts that can matter come out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.llm.common import written

LEAST, SHARE, TOP = 10, 50, 2000
#: Entries of a container before it bursts; entries of a task's tries, and words that have ids, before subtrees are spilled.
BURST, ENTRIES, WORDS = 4096, 2_000_000, 400_000
#: Words that are sorted together before they go into the trie.
STEP = 1_000_000
#: Bytes of runs that a merge holds before it makes one of them; what is left has each phrase once.
HELD = 32 << 20
_BITS = 21
_MASK = (1 << _BITS) - 1
#: Upper-case ASCII letters become lower-case, marks that end pieces become line ends.
_PLAIN = bytes(10 if chr(i) in ".,;:!?\n\x0b\x0c\r" else i + 32 if 65 <= i <= 90 else i for i in range(256))
RUN = "part int, lang string, run binary"
COUNTED = "lang string, w1 string, w2 string, w3 string, n long"


class Ids(dict):
    """Ids of words from 1, in the order in which they are met, and the words by id; the empty word, 0, ends a piece."""

    def __init__(self):
        self.names = [b""]
        self[b""] = 0

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self.names)
        self.names.append(word)
        return i


class Node(dict):
    """Containers by the next word's id."""


class HatTrie:
    """Counts of sequences of up to three words of one language, by ids from 1; 0 is no word.

    Below a first word is a hash container, whose keys are the two other ids, or, burst, a node with a container for each
    second word, whose keys are the third.
    """

    def __init__(self, burst: int = BURST):
        self.root, self.burst, self.entries = Node(), burst, 0

    def add(self, words: np.ndarray) -> None:
        """Counts the sequence that each word starts; pieces are set off by 0. Sequences go in in order, a subtree at a time."""
        ends = np.zeros(2, np.int64)
        a, b, c = words, np.append(words[1:], ends[:1]), np.append(words[2:], ends)[: len(words)]
        c = np.where(b == 0, 0, c)
        keys = np.sort((a << 2 * _BITS | b << _BITS | c)[a > 0])
        if not len(keys):
            return
        first = keys >> 2 * _BITS
        borders = [0, *(np.flatnonzero(np.diff(first)) + 1).tolist(), len(keys)]
        rest = (keys & ((1 << 2 * _BITS) - 1)).tolist()
        for at, a in enumerate(first[borders[:-1]].tolist()):
            self._below(a, rest[borders[at] : borders[at + 1]])

    def _below(self, a: int, rest: list[int]) -> None:
        """Counts sequences of one first word; a container that has become too large bursts."""
        child = self.root.get(a)
        if child is None:
            child = self.root[a] = {}
        if type(child) is Node:
            for key in rest:
                container = child.setdefault(key >> _BITS, {})
                before = len(container)
                container[key & _MASK] = container.get(key & _MASK, 0) + 1
                self.entries += len(container) - before
            return
        before = len(child)
        for key in rest:
            child[key] = child.get(key, 0) + 1
        self.entries += len(child) - before
        if len(child) > self.burst:
            node = self.root[a] = Node()
            for key, n in child.items():
                node.setdefault(key >> _BITS, {})[key & _MASK] = n

    def sizes(self) -> list[tuple[int, int]]:
        """Entries of each first word's subtree, with the word."""
        return [(sum(map(len, child.values())) if type(child) is Node else len(child), a) for a, child in self.root.items()]

    def take(self, firsts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Keys (three ids of 21 bits) and counts of first words' subtrees, which leave the trie."""
        keys, counts, owners, sizes = [], [], [], []
        for a in firsts:
            child = self.root.pop(a)
            for b, container in child.items() if type(child) is Node else ((0, child),):
                keys.append(container.keys())
                counts.append(container.values())
                owners.append(a << 2 * _BITS | b << _BITS)
                sizes.append(len(container))
        total = sum(sizes)
        self.entries -= total
        flat = lambda parts: np.fromiter(chain.from_iterable(parts), np.int64, total)
        return flat(keys) | np.repeat(np.array(owners, np.int64), sizes), flat(counts)


class Counter:
    """HAT-tries by language, with the words' ids; runs are dealt to `parts` partitions."""

    def __init__(self, parts: int, burst: int = BURST, entries: int = ENTRIES, words: int = WORDS, step: int = STEP):
        self.parts, self.burst, self.most, self.most_words, self.step = parts, burst, entries, words, step
        self.tries: dict[str, HatTrie] = {}
        self.waiting: dict[str, list[int]] = {}
        self.ids = Ids()

    def add(self, lang: str, text: str) -> Iterator[tuple[int, str, bytes]]:
        """Counts a text's sequences; yields runs where the tries have become too large."""
        words = self.waiting.setdefault(lang, [])
        for piece in text.encode().translate(_PLAIN).split(b"\n"):
            words += map(self.ids.__getitem__, piece.split())
            words.append(0)
            if len(words) > self.step or len(self.ids) > self.most_words:
                yield from self._settle()
                words = self.waiting.setdefault(lang, [])

    def _settle(self) -> Iterator[tuple[int, str, bytes]]:
        """Puts the waiting words into the tries, and spills what is too much."""
        for lang, words in self.waiting.items():
            self.tries.setdefault(lang, HatTrie(self.burst)).add(np.array(words, np.int64))
        self.waiting = {}
        if len(self.ids) > self.most_words:  # ids have 21 bits each, and words take memory
            yield from self.spill(0)
            self.ids = Ids()
        elif sum(t.entries for t in self.tries.values()) > self.most:
            yield from self.spill(self.most // 2)

    def finish(self) -> Iterator[tuple[int, str, bytes]]:
        yield from self._settle()
        yield from self.spill(0)

    def spill(self, keep: int) -> Iterator[tuple[int, str, bytes]]:
        """(part, lang, run) of whole subtrees, the largest first, until no more than keep entries are left."""
        sizes = sorted(((size, lang, a) for lang, trie in self.tries.items() for size, a in trie.sizes()), reverse=True)
        left, taken = sum(size for size, _, _ in sizes), {}
        for size, lang, a in sizes:
            if left <= keep:
                break
            left -= size
            taken.setdefault(lang, []).append(a)
        for lang, firsts in taken.items():
            keys, counts = self.tries[lang].take(firsts)
            a, b, c = keys >> 2 * _BITS, keys >> _BITS & _MASK, keys & _MASK
            total = np.bincount(a, counts, len(self.ids.names)).astype(np.int64)  # each first word's count stands alone
            first, none, more = np.flatnonzero(total), np.zeros(len(firsts), np.int64), b > 0
            columns = (np.concatenate((x, y[more])) for x, y in ((first, a), (none, b), (none, c), (total[first], counts)))
            yield from dealt(lang, Run(*columns, self.ids.names), self.parts)


class Run:
    """Sequences as ids into names (0: no word), and their counts."""

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, n: np.ndarray, names: list[bytes]):
        self.columns, self.n, self.names = (a, b, c), n, names

    def packed(self, rank: np.ndarray | None = None) -> bytes:
        """In order of its words, compressed: the distinct words in order, their places in each column, and the counts.

        The order of words is that of their checksums, which all runs share: rank, or where there is none that of names.
        """
        used = np.unique(np.concatenate(self.columns))
        used = used[used > 0]
        used = used if rank is None else used[np.argsort(rank[used])]
        place = np.zeros(len(self.names), np.int32)
        place[used] = np.arange(1, len(used) + 1)
        columns = [place[x] for x in self.columns]
        order = np.lexsort(columns[::-1])
        words = b"\n".join(map(self.names.__getitem__, used.tolist()))
        body = b"".join((words, *(x[order].tobytes() for x in columns), self.n[order].tobytes()))
        return zstandard.compress(b"%d %d\n" % (len(words), len(order)) + body, 3)

    @staticmethod
    def unpacked(run: bytes) -> Run:
        head, _, body = zstandard.decompress(run).partition(b"\n")
        size, n = map(int, head.split())
        ids = np.frombuffer(body, np.int32, 3 * n, size).astype(np.int64)
        return Run(*ids.reshape(3, n), np.frombuffer(body[size + 12 * n :], np.int64), [b"", *body[:size].split(b"\n")] if size else [b""])


def dealt(lang: str, run: Run, parts: int) -> Iterator[tuple[int, str, bytes]]:
    """The run divided by prefixes: a sequence goes by its language and first two words."""
    a, b, c = run.columns
    seed = np.uint64(zlib.crc32(lang.encode()))
    code = np.fromiter(map(zlib.crc32, run.names), np.uint64, len(run.names))
    part = ((code[a] * np.uint64(0x9E3779B97F4A7C15) ^ code[b] * np.uint64(0xC2B2AE3D27D4EB4F) ^ seed) >> np.uint64(20)) % np.uint64(parts)
    rank = np.argsort(np.argsort(code))
    order = np.argsort(part, kind="stable")
    borders = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for i in np.flatnonzero(np.diff(borders)).tolist():
        own = order[borders[i] : borders[i + 1]]
        yield i, lang, Run(a[own], b[own], c[own], run.n[own], run.names).packed(rank)


def merged(runs: list[bytes]) -> Run:
    """One run of sorted runs, each sequence once, with its counts summed."""
    opened = [Run.unpacked(r) for r in runs]
    names = [b"", *sorted(set(chain.from_iterable(r.names[1:] for r in opened)), key=zlib.crc32)]
    known = {w: i for i, w in enumerate(names)}
    to = [np.fromiter(map(known.__getitem__, r.names), np.int64, len(r.names)) for r in opened]
    a, b, c = (np.concatenate([t[r.columns[k]] for r, t in zip(opened, to, strict=True)]) for k in range(3))
    n = np.concatenate([r.n for r in opened])
    order = np.lexsort((c, b, a))  # a stable sort, which merges what is in order already
    a, b, c, n = a[order], b[order], c[order], n[order]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(c) != 0))))
    return Run(a[new], b[new], c[new], np.add.reduceat(n, new), names)


def phrases(run: Run, least: int) -> list[tuple]:
    """From a merged run of some prefixes: words and count of phrases with a count of `least` or more, and, without words, the count of rarer single words."""
    (a, b, c), n, name = run.columns, run.n, run.names.__getitem__
    new = np.flatnonzero(np.concatenate(([True], (np.diff(a) != 0) | (np.diff(b) != 0))))
    sums = np.add.reduceat(n, new)  # of one word, or of all sequences that begin with two words
    often, single = sums >= least, b[new] == 0
    out = [(name(a[i]), name(b[i]) or None, None, int(x)) for i, x in zip(new[often].tolist(), sums[often].tolist(), strict=True)]
    out += [(name(a[i]), name(b[i]), name(c[i]), int(n[i])) for i in np.flatnonzero((n >= least) & (c > 0)).tolist()]
    rare = int(sums[single & ~often].sum())
    return out + [(None, None, None, rare)] * (rare > 0)


def _runs(docs: DataFrame, parts: int, **sizes: int) -> DataFrame:
    """Sorted runs (RUN) of the sequences of docs' texts, by lang (null: und)."""

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        part, lang, run = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(lang, pa.string()), pa.array(run, pa.binary())], names=["part", "lang", "run"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(parts, **sizes)
        for rows in batches:
            for lang, text in zip(rows.column(0), rows.column(1), strict=True):
                if spilled := list(counter.add(lang.as_py(), text.as_py())):
                    yield batch(spilled)
        if spilled := list(counter.finish()):
            yield batch(spilled)

    texts = docs.where("text is not null").select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), "text")
    return texts.mapInArrow(count, RUN)


def counted(docs: DataFrame, least: int = LEAST, **sizes: int) -> DataFrame:
    """lang, w1, w2, w3 and n of each phrase of one to three words with n >= least, and of each language (w1 null) the number of its words.

    The runs of a partition arrive by language; they are held compressed, made one where they exceed HELD, and merged.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def batch(lang: str, runs: list[bytes]) -> pa.RecordBatch:
        w1, w2, w3, n = list(zip(*phrases(merged(runs), least), strict=True)) or [()] * 4
        text = lambda x: pa.array(x, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), text(w1), text(w2), text(w3), pa.array(n, pa.int64())], names=["lang", "w1", "w2", "w3", "n"])

    def merge(arriving: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, runs, held, most = None, [], 0, HELD
        for part in arriving:
            for name, run in zip(part.column(1), part.column(2), strict=True):
                if runs and name.as_py() != lang:
                    yield batch(lang, runs)
                    runs, held, most = [], 0, HELD
                lang = name.as_py()
                runs.append(run.as_py())
                held += len(runs[-1])
                if held > most:
                    runs = [merged(runs).packed()]
                    held = len(runs[0])
                    most = HELD + 2 * held
        if runs:
            yield batch(lang, runs)

    found = _runs(docs, parts, **sizes).repartitionById(parts, F.col("part")).sortWithinPartitions("lang").mapInArrow(merge, COUNTED)
    found = written(found, "phrases")
    total = found.where("w2 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    none = F.lit(None).cast("string")
    return found.where("w1 is not null").unionByName(total.select("lang", none.alias("w1"), none.alias("w2"), none.alias("w3"), "n"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), exactly: products of up to 38 digits."""
    wide = lambda c: c.cast("decimal(18, 0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7, 0)") * (wide(a) * wide(a)).cast("decimal(30, 0)"), wide(left) * wide(right)).cast("long")


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP, **sizes: int) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases of two or three words.

    a is a phrase's count, l and r those of the parts at its lowest-scoring cut, n all words of the language. Phrases with
    fewer than `least` occurrences are none; those whose words lie in a longer one that has at least share % of their
    occurrences are dropped. Null texts count nothing, a null lang is `und`, repeated rows count each; other columns are not
    read. Equal scores are ordered by a, then by the phrase's bytes, so there are no ties.
    """
    counts = counted(docs, least, **sizes)
    one = counts.where("w1 is not null and w2 is null").select("lang", F.col("w1").alias("x"), F.col("n").alias("one"))
    two = counts.where("w2 is not null and w3 is null").select("lang", "w1", "w2", F.col("n").alias("a"))
    three = counts.where("w3 is not null").select("lang", "w1", "w2", "w3", F.col("n").alias("a"))
    total = counts.where("w1 is null").select("lang", "n")
    word = lambda df, c, name: df.join(one.select("lang", F.col("x").alias(c), F.col("one").alias(name)), ["lang", c])
    part = lambda df, c, d, name: df.join(two.select("lang", F.col("w1").alias(c), F.col("w2").alias(d), F.col("a").alias(name)), ["lang", c, d])
    longer = three.select("lang", "w1", "w2", "a").unionByName(three.select("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longer = longer.groupBy("lang", "w1", "w2").agg(F.max("a").alias("longest"))
    kept = two.join(longer, ["lang", "w1", "w2"], "left").where(F.col("longest").isNull() | (100 * F.col("longest") < share * F.col("a")))
    pairs = word(word(kept, "w1", "l"), "w2", "r").select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", "l", "r", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))
    cut = part(part(word(word(three, "w1", "l1"), "w3", "r2"), "w2", "w3", "r1"), "w1", "w2", "l2")
    first, second = score(F.col("a"), F.col("l1"), F.col("r1")), score(F.col("a"), F.col("l2"), F.col("r2"))
    cut = cut.withColumns({"s1": first, "s2": second})
    lowest = lambda x, y: F.when(F.col("s1") <= F.col("s2"), F.col(x)).otherwise(F.col(y))
    triples = cut.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", lowest("l1", "l2").alias("l"), lowest("r1", "r2").alias("r"), lowest("s1", "s2").alias("score"))
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = pairs.unionByName(triples).withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
