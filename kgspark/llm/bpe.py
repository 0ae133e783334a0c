"""Exact byte-pair encoding by backtracking, and decoding by an offset table.

A greedy walk takes the longest token at each place. Two tokens may stand side by side only if byte-pair merges of their
joined text would give just these two; a pair-compatibility table, filled as pairs are met, holds that. Where a token does
not fit the one before it, shorter ones are tried, and where none does the walk steps back; a place from which it had to
step back is never entered again, so the walk is linear in the text. Sequences in which all neighbours are compatible are
the result of the merges, so the tokens are exactly those of a merge queue.

Normalising a text and splitting it into pieces follow the vocabulary file and are left to the library that defines them,
but for Latin letters, where they are lower-casing and a pattern; merges, and decoding, are done here. Pieces recur, so each
worker keeps the tokens of recent ones.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm.vocabularies import byte_alphabet

#: Words and pieces that a worker remembers, and pairs of tokens.
REMEMBERED, PAIRS = 150_000, 300_000
#: Longer words are encoded each time.
LONG_WORD = 100
#: Tokens decoded in one step.
STEP = 1 << 19
#: Added to the character that ends a word, so that it is another symbol than the same one within a word.
_LAST = 0x10000
_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
#: What Python takes for white space, but the pattern of the file does not.
_SEPARATORS = re.compile("[\x1c-\x1f]")


class Merges:
    """Tokens as merges of two tokens, and which tokens may be neighbours."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.word_end = word_end
        self.symbols = {i: self._symbols(token) for token, i in vocabulary.items()}
        self.id_of = {s: i for i, s in self.symbols.items()}
        self.rank = {i: -1 for i, s in self.symbols.items() if len(s) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self._fits: dict[int, bool] = {}  # by a << 32 | b
        reached = set(self.rank)
        for rank, (a, b) in enumerate(merges):
            pair = (vocabulary[a], vocabulary[b])
            made = self.id_of[self.symbols[pair[0]] + self.symbols[pair[1]]]
            if made in self.rank or pair[0] not in self.rank or pair[1] not in self.rank:
                raise ValueError(f"merge {rank} does not make a new token of earlier ones")
            self.rank[made], self.parts[made], self.merge[pair] = rank, pair, rank
            if pair[0] in reached and pair[1] in reached and self._undisturbed(*pair, joined=rank):
                reached.add(made)
        # tokens that merges never give, as another merge comes first in their own text, are left out
        known = {self.symbols[i] for i in reached}
        self.shorter = {i: next((self.id_of[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in known), None) for i in reached for s in (self.symbols[i],)}
        self.longest = ahocorasick.Automaton()
        for i in reached:  # reversed, as matches are reported by their ends
            self.longest.add_word(self.symbols[i][::-1], i)
        self.longest.make_automaton()
        self.length = {i: len(self.symbols[i]) for i in reached}

    def _symbols(self, token: str) -> str:
        if self.word_end and token.endswith(self.word_end):
            token = token[: -len(self.word_end)]
            return token[:-1] + chr(ord(token[-1]) + _LAST)
        return token

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's joined text give a and b."""
        found = self._fits.get(a << 32 | b)
        if found is None:
            if len(self._fits) >= PAIRS:
                self._fits.clear()
            found = self._fits[a << 32 | b] = self._undisturbed(a, b)
        return found

    def _undisturbed(self, a: int, b: int, joined: int | None = None) -> bool:
        """Whether no merge across the border of a and b comes before those that make a and b.

        Goes back in time: at each step the later made of the two tokens at the border is taken apart. A merge of the two
        would come first if its rank is below those of the merges that use them up; of equal ranks the left one is first.
        joined: the rank at which a and b themselves become one, which is no disturbance.
        """
        never = len(self.merge) + len(self.symbols)
        a_used = b_used = never if joined is None else joined
        while True:
            across = self.merge.get((a, b), never)
            if across < a_used and (across <= b_used if b_used != joined else across < b_used):
                return False
            if self.rank[a] > self.rank[b]:
                a_used = self.rank[a]
                a = self.parts[a][1]
            elif self.rank[b] >= 0:
                b_used = self.rank[b]
                b = self.parts[b][0]
            else:
                return True

    def encode(self, word: str) -> list[int]:
        """Tokens of a word that is written in the vocabulary's characters."""
        if self.word_end:
            word = word[:-1] + chr(ord(word[-1]) + _LAST)
        n, length, shorter, known = len(word), self.length, self.shorter, self._fits
        at: list[int | None] = [None] * n
        last = -1
        for end, token in self.longest.iter(word[::-1]):  # of matches with one end the longest comes first
            if end != last:
                last, at[n - 1 - end] = end, token
        token = at[0]
        if token is not None and length[token] == n:
            return [token]
        dead, out, place, before = bytearray(n + 1), [], 0, None
        while place < n:
            while token is not None:
                if not dead[place + length[token]]:
                    fits = before is None or known.get(before << 32 | token)
                    if fits or (fits is None and self.fits(before, token)):
                        break
                token = shorter[token]
            if token is not None:
                out.append(token)
                before = token
                place += length[token]
                token = at[place] if place < n else None
            elif out:
                dead[place] = 1
                token = out.pop()
                before = out[-1] if out else None
                place -= length[token]
            else:
                raise ValueError("a character is not in the vocabulary")
        return out


class Recent(dict):
    """What make() gives for a key. Of the keys before the last REMEMBERED ones it keeps what is met again; long ones it doesn't keep."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make, self.before = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.before = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Token ids, as int32, of texts, for vocabularies that drop white space."""

    def __init__(self, file: bytes):
        content = json.loads(file)
        model, kinds = content["model"], str(content["pre_tokenizer"])
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or "ByteLevel" not in kinds or "'Removed'" not in kinds:
            raise ValueError("only byte-level pair merges within words are supported")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.tokenizer = Tokenizer.from_str(file.decode())
        self.special = {t["content"]: t["id"] for t in content["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in content["added_tokens"]):
            raise ValueError("added tokens must be plain strings")
        by_length = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, by_length)) + ")") if by_length else None
        # to Latin letters without marks of their own the file does no more than lower-case and split by its pattern
        steps = (content["normalizer"] or {}).get("normalizers", [])
        splits = [p["pattern"]["Regex"] for p in content["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split" and "Regex" in p["pattern"]]
        simple = all(x["type"] in ("NFC", "Lowercase") or x.get("pattern") == {"Regex": "\\s+"} for x in steps) and len(splits) == 1
        self.latin = regex.compile(r"[\x00-\x1B\x20-\u024F]*+").fullmatch if simple else lambda text: None
        self.split = regex.compile(splits[0]).findall if simple else None
        self.letters = bool(simple and self.split("aébcà") == ["aébcà"])
        self.lower = any(x["type"] == "Lowercase" for x in steps)
        self.written = {b: c for c, b in byte_alphabet().items()}
        self.words, self.pieces = Recent(self._word), Recent(self._piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece of Latin text that merges stay within."""
        if not piece.isalpha() or not piece.isascii():
            piece = "".join(map(self.written.__getitem__, piece.encode()))
        return array("i", self.merges.encode(piece)).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of what stands between white space."""
        if self.latin(word):
            word = word.lower() if self.lower else word
            if self.letters and word.isalpha():
                return self.pieces[word]
            return b"".join(map(self.pieces.__getitem__, self.split(word)))
        normal = self.tokenizer.normalizer.normalize_str(word) if self.tokenizer.normalizer else word
        ids = [self.merges.encode(piece) for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return array("i", chain.from_iterable(ids)).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; strings of special tokens are those tokens."""
        if not text:
            return b""
        ids = []
        for part in self.specials.split(text) if self.specials else [text]:
            if part in self.special:
                ids.append(array("i", [self.special[part]]).tobytes())
            else:
                ids += map(self.words.__getitem__, part.split() if not _SEPARATORS.search(part) else filter(None, _SPACE.split(part)))
        return b"".join(ids)


class Decoder:
    """All tokens' bytes in one row, and the offset at which each begins."""

    def __init__(self, file: bytes):
        content = json.loads(file)
        tokens = {i: t for t, i in content["model"]["vocab"].items()} | {t["id"]: t["content"] for t in content["added_tokens"]}
        decoder = (content["decoder"] or {"type": None})["type"]
        if decoder not in (None, "ByteLevel"):
            raise ValueError(f"decoder {decoder} is not supported")
        self.blanks = decoder is None  # tokens are joined by blanks where the file names no decoder
        alphabet = byte_alphabet()
        plain = lambda t: t.encode() if self.blanks or not all(c in alphabet for c in t) else bytes(alphabet[c] for c in t)
        pieces = [plain(tokens[i]) + b" " * self.blanks if i in tokens else b"" for i in range(max(tokens, default=-1) + 1)]
        self.offsets = np.cumsum([0, *map(len, pieces)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)

    def decode(self, ids: np.ndarray) -> str:
        """The text of token ids; ids that no token has are passed over."""
        ids = ids[(ids >= 0) & (ids < len(self.offsets) - 1)]
        out = []
        for a in range(0, len(ids), STEP):
            some = ids[a : a + STEP]
            starts, sizes = self.offsets[some], self.offsets[some + 1] - self.offsets[some]
            ends = np.cumsum(sizes)
            out.append(self.bytes[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])].tobytes())
        joined = b"".join(out)
        return (joined[:-1] if self.blanks else joined).decode(errors="replace")


@lru_cache(2)
def _encoder(file: bytes) -> Encoder:
    return Encoder(file)


@lru_cache(2)
def _decoder(file: bytes) -> Decoder:
    return Decoder(file)


def encoded(text: Column, vocabulary: Broadcast) -> Column:
    """Token ids of a text, as an array of int, without tokens that the file would add around it. A null text is an empty one.

    Whole texts of any length are encoded; strings of special tokens within them are special tokens.
    """

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _encoder(vocabulary.value)
        for batch in batches:
            ids = [encoder.encode(text.as_py()) for text in batch]
            offsets = np.cumsum([0, *map(len, ids)]) // 4
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))

    return run(text)


def decoded(ids: Column, vocabulary: Broadcast) -> Column:
    """The text of token ids, special tokens included. No ids, or null, give an empty text."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _decoder(vocabulary.value)
        for batch in batches:
            flat, ends = batch.values.to_numpy(zero_copy_only=False), batch.offsets.to_numpy()
            yield pa.array([decoder.decode(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())

    return run(F.coalesce(ids, F.array().cast("array<int>")))


def round_trip(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: its text encoded, and these tokens decoded.

    Null and empty texts have no tokens and decode to an empty text; repeated rows are encoded each. Other columns are not
    read. Tokens and decoded texts stay in the worker, a few texts at a time.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(vocabulary.value), _decoder(vocabulary.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                ids = np.frombuffer(encoder.encode(text.as_py()), np.int32)
                listed = " ".join(map(str, ids.tolist()))
                rows.append((len(ids), sha256(listed.encode()).hexdigest(), sha256(decoder.decode(ids).encode()).hexdigest()))
            n, ids_, texts = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digests, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
