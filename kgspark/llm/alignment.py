"""Alignment of two tokenizers' tokens of the same text, by divide and conquer at shared cuts.

Both token sequences cover the same bytes. A cut is a byte offset where tokens of both end. Near the middle of a sequence a
token's end is looked up among the other's ends by bisection; at the nearest one that both share the text is divided, and
both halves are treated alike. An interval without a shared end inside is a leaf: a group of tokens.

Words recur, and neither tokenizer joins what one blank between other characters divides, or a letter and the mark that ends
its word: those are cuts that need no search. So each worker keeps the groups of recent words, and a text is the sequence of
its words' groups.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import written
from kgspark.llm.vocabularies import byte_alphabet

#: Words after which a worker starts anew; of those before, it keeps what it meets again.
REMEMBERED = 100_000
#: Characters of texts whose words are encoded together.
STEP = 1 << 20
#: Id pairs that hold at least one in HOT of all rows are joined by broadcast; so at most HOT can be.
HOT = 100_000
_LETTER = "[A-Za-zÀ-ÖØ-öø-ɏ]"
_CUT = re.compile(rf"(?<=\S)(?= \S)|(?<={_LETTER})(?=[.,;:!?](?: \S|\Z))")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


def shared_cuts(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) with a[i] == b[j], in order; a and b are ascending ends with the same last one."""
    cuts, todo = [(len(a) - 1, len(b) - 1)], [(0, len(a) - 1, 0, len(b) - 1)]
    while todo:
        a_from, a_to, b_from, b_to = todo.pop()
        if a_from >= a_to or b_from >= b_to:
            continue
        middle = (a_from + a_to) // 2
        for step in range(a_to - a_from + 1):
            i = middle + (step + 1) // 2 * (1 if step % 2 else -1)
            if a_from <= i < a_to and (j := bisect_left(b, a[i], b_from, b_to)) < b_to and b[j] == a[i]:
                cuts.append((i, j))
                todo += ((a_from, i, b_from, j), (i + 1, a_to, j + 1, b_to))
                break
    return sorted(cuts)


def overlaps(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places (i, j) of tokens whose byte ranges overlap; a and b are the ends in one group, the last of which agree."""
    out, i, j = [(0, 0)], 0, 0
    while a[i] != a[-1] or b[j] != b[-1]:
        if a[i] < b[j]:
            i += 1
        else:
            j += 1
        out.append((i, j))
    return out


#: Numbers of A's tokens, B's tokens and groups; a << 32 | b of each link; and the groups as text.
Aligned = tuple[int, int, int, tuple[int, ...], str]


def align(a: list[int], b: list[int], a_ends: list[int], b_ends: list[int]) -> Aligned:
    """The groups and links of token ids a and b, given where each token ends."""
    if len(a) == 1 or len(b) == 1:
        pairs = tuple(x << 32 | y for x in a for y in b)
        return len(a), len(b), 1, pairs, f"{','.join(map(str, a))}|{','.join(map(str, b))}"
    pairs, groups, i, j = [], [], 0, 0
    for i_end, j_end in shared_cuts(a_ends, b_ends):
        i_end, j_end = i_end + 1, j_end + 1
        if i_end - i == j_end - j == 1:
            groups.append(f"{a[i]}|{b[j]}")
            pairs.append(a[i] << 32 | b[j])
        else:
            groups.append(f"{','.join(map(str, a[i:i_end]))}|{','.join(map(str, b[j:j_end]))}")
            pairs += [a[i + x] << 32 | b[j + y] for x, y in overlaps(a_ends[i:i_end], b_ends[j:j_end])]
        i, j = i_end, j_end
    return len(a), len(b), len(groups), tuple(pairs), ";".join(groups)


class Aligner:
    """Groups of words, from a byte-level vocabulary (A) and a piece model (B)."""

    def __init__(self, a_file: bytes, b_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's other cores have tasks of their own
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_file.decode())
        self.a.encode_special_tokens = True
        alphabet = byte_alphabet()
        vocabulary = json.loads(a_file)["model"]["vocab"]
        self.a_bytes = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        self.b = SentencePieceProcessor(model_proto=b_file)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        joined = re.compile(rf"[^▁]▁|{_LETTER}[.,;:!?]")
        if any(joined.search(p) for p in pieces):
            raise ValueError("a piece joins what a blank or the end of a word divides")
        if not set(alphabet) <= set(vocabulary):
            raise ValueError("the byte-level vocabulary lacks bytes")
        self.a_size, self.b_size = {i: len(x) for i, x in self.a_bytes.items()}, list(map(len, self.b_bytes))
        self.known: dict[str, Aligned | None] = {m: align([vocabulary[m]], [self.b.piece_to_id(m)], [1], [1]) for m in ".,;:!?"}
        self.marks, self.before = dict(self.known), {}

    def learn(self, words: list[str]) -> None:
        """Adds the groups of words with their blanks; None where the tokens' bytes are not the word's."""
        a_bytes, b_bytes, a_size, b_size = self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.a_size.__getitem__, self.b_size.__getitem__
        for word, a, b in zip(words, self.a.encode_batch_fast(words, add_special_tokens=False), self.b.encode([w[1:] for w in words], num_threads=1), strict=True):
            a = a.ids
            same = b"".join(map(a_bytes, a)) == b"".join(map(b_bytes, b)) == word.encode()
            self.known[word] = align(a, b, list(accumulate(map(a_size, a))), list(accumulate(map(b_size, b)))) if same else None

    def texts(self, texts: list[str | None]) -> Iterator[list[Aligned] | None]:
        """The words' groups of each text; None where the text has no tokens."""
        words = [_CUT.split(f" {t}") if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.before = dict(self.marks), self.known
        new = [w for w in set(chain.from_iterable(words)) if w not in self.known]
        self.known |= {w: self.before[w] for w in new if w in self.before}
        if new := [w for w in new if w not in self.known]:
            self.learn(new)
        for own in words:
            found = [self.known[w] for w in own]
            yield None if not found or None in found else found


@lru_cache(1)
def _aligner(a_file: bytes, b_file: bytes) -> Aligner:
    return Aligner(a_file, b_file)


def aligned(text: Column, a_vocabulary: Broadcast, b_model: Broadcast) -> Column:
    """A struct of n_a, n_b, n_groups, n_links, groups_sha256 and links: the text's distinct id pairs (a << 32 | b) and how often each is linked.

    All zero and empty for null and empty texts, and for those whose tokens don't give a blank and the text back in both.
    """
    links = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int64())]))
    fields = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", links)]

    @F.arrow_udf("n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, n: long>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        aligner = _aligner(a_vocabulary.value, b_model.value)
        for batch in batches:
            rows, pairs, counts, offsets = [], array("q"), array("q"), [0]
            for part in steps(batch):
                for found in aligner.texts(part):
                    n_a, n_b, n_groups, links_, groups = zip(*found, strict=True) if found else ((),) * 5
                    own = Counter(chain.from_iterable(links_))
                    pairs.extend(own.keys())
                    counts.extend(own.values())
                    offsets.append(len(pairs))
                    digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if found else ""
                    rows.append((sum(n_a), sum(n_b), sum(n_groups), own.total(), digest))
            values = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (pairs, counts)], names=["pair", "n"])
            columns = [pa.array([r[k] for r in rows], kind) for k, (_, kind) in enumerate(fields[:-1])]
            yield pa.StructArray.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], names=[n for n, _ in fields])

    return run(text)


def steps(batch: pa.Array) -> Iterator[list[str | None]]:
    """The batch's texts in parts of about STEP characters, so that the words encoded together are few."""
    part, size = [], 0
    for value in batch:
        part.append(text := value.as_py())
        size += len(text or "")
        if size >= STEP:
            yield part
            part, size = [], 0
    yield part


def link_counts(links: DataFrame) -> DataFrame:
    """pair, n (how many links hold it), best (whether no pair of its B id has more) and rows (of how many texts), over all texts.

    links: pair and n of each text's distinct pairs.
    """
    counts = written(links.groupBy("pair").agg(F.sum("n").alias("n"), F.count("*").alias("rows")), "links")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    best = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # as many rows as B has ids
    return counts.join(best, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"), "rows")


def scored(docs: DataFrame, a_vocabulary: Broadcast, b_model: Broadcast) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best and count_sum of each row.

    n_best counts links whose pair has its B id's highest count of all texts, ties included; count_sum adds the counts over
    links. Rows without tokens have zeros; repeated rows count each; other columns are not read. The texts are encoded once
    and the tables of links written. Frequent pairs, at most HOT of them, are broadcast, the others joined by the pair, and
    sums go back to the rows by their numbers.
    """
    rows = docs.select("doc_id", aligned(F.col("text"), a_vocabulary, b_model).alias("x")).select("doc_id", "x.*")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = rows.select("row", F.explode("links").alias("link")).select("row", "link.*")
    counts = written(link_counts(links.select("pair", "n")), "link-counts")
    total = counts.agg(F.sum("rows")).first()[0] or 0
    add = [F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    known = counts.select(F.col("pair").alias("known"), F.col("n").alias("count"), "best", (F.col("rows") * HOT >= total).alias("hot"))
    frequent = F.broadcast(known.where("hot").drop("hot"))
    found = links.join(frequent, F.col("pair") == F.col("known"), "left")
    often = found.where("known is not null").groupBy("row").agg(*add)
    seldom = found.where("known is null").select("row", "pair", "n").join(known.where("not hot"), F.col("pair") == F.col("known")).groupBy("row").agg(*add)
    plain = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    own = rows.select("row", F.struct(*plain).alias("own"), F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    sums = own.unionByName(often, allowMissingColumns=True).unionByName(seldom, allowMissingColumns=True)
    return sums.groupBy("row").agg(F.max("own").alias("own"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")).select("own.*", "n_best", "count_sum")
