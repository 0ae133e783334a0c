"""Collocations, token alignment and byte-pair encoding, against brute-force versions and the tokenizers' own library."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kgspark.llm import alignment, bpe, collocations
from kgspark.llm.vocabularies import sent
from tests.llm.test_edges import LONG, docs

ODD = ["", " ", "ab  ", "the of and x1  \n\t", "  \x85\xa0a b", "0123456789'!?.-", "▁ a", "a.,;:!?é ×²1", "éèüß日本語中文한국\U0001f600́ͅ  ", "<s> </s><unk><0x41>", "ΣσςİıǅŉﬀK \x1c\x1d\x00", "àÉîõüñŁſĳŉƀɏªºµ½ x", "<|startoftext|> <|endoftext|>'s'TLl'RE", "aA \t\n\x0b\x0c\r"]


def texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice(rng.choice(ODD) or "x") for _ in range(rng.choice((1, 2, 4, 12, 60)))) for _ in range(n)] + ODD


def read(name):
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "doc_id long, text string, lang string, ids string, row long")


# byte-pair encoding


@pytest.fixture(scope="module")
def words():
    return Tokenizer.from_str(read("word_bpe_49k.json").decode()), bpe.Encoder(read("word_bpe_49k.json")), bpe.Decoder(read("word_bpe_49k.json"))


def test_encodes_like_the_library(words):
    library, encoder, decoder = words
    rng = random.Random(4)
    same_letters = ["".join(rng.choice(letters) for _ in range(rng.choice((3, 8, 40, 400)))) for letters in ("ab", "aeinrst", "0123456789", "lo ") for _ in range(150)]
    for text in texts(3, 1500) + same_letters + [LONG, "x" * 30_001, "ab" * 20_000]:
        ids = library.encode(text, add_special_tokens=False).ids
        own = np.frombuffer(encoder.encode(text), np.int32)
        assert own.tolist() == ids, text[:50]
        assert decoder.decode(own) == library.decode(ids, skip_special_tokens=False)


def test_neighbours_are_what_merges_give(words):
    """The pair table says the same as merging the joined texts, for pairs of all kinds."""
    _, encoder, _ = words
    merges, rng = encoder.merges, random.Random(1)
    inner = [i for i in merges.length if ord(merges.symbols[i][-1]) < 0x10000]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(inner)
        parts = [merges.id_of[c] for c in merges.symbols[a] + merges.symbols[b]]
        while True:  # the lowest rank first, of equal ones the left
            ranked = [(merges.merge[pair], at) for at, pair in enumerate(zip(parts, parts[1:], strict=False)) if pair in merges.merge]
            if not ranked:
                break
            _, at = min(ranked)
            parts[at : at + 2] = [merges.id_of[merges.symbols[parts[at]] + merges.symbols[parts[at + 1]]]]
        assert merges.fits(a, b) == (parts == [a, b])


def test_round_trip_rows(spark, words):
    library, _, _ = words
    rows = [(i, t, "en") for i, t in enumerate(texts(5, 60))] + [(1, None, None), (None, "a b", None), (1, "x", "de"), (1, "x", "de"), (2, LONG, "en")]
    vocabulary = sent(spark, public_tokenizers.path("word_bpe_49k.json"))
    out = sorted(map(tuple, bpe.round_trip(table(spark, rows), vocabulary).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert out == sorted(want, key=repr)
    assert bpe.round_trip(docs(spark).limit(0), vocabulary).count() == 0 and bpe.round_trip(docs(spark), vocabulary).count() == docs(spark).count()
    both = table(spark, rows[:20]).select("text", bpe.encoded(F.col("text"), vocabulary).alias("own"))
    for r in both.select("text", "own", bpe.decoded(F.col("own"), vocabulary).alias("back")).collect():
        assert r.own == library.encode(r.text or "", add_special_tokens=False).ids and r.back == library.decode(r.own, skip_special_tokens=False)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError, match="within words"):
        bpe.Encoder(read("byte_bpe_50k.json"))


def test_byte_level_decoding():
    library, decoder = Tokenizer.from_str(read("byte_bpe_50k.json").decode()), bpe.Decoder(read("byte_bpe_50k.json"))
    for text in texts(6, 200):
        ids = library.encode(text).ids
        assert decoder.decode(np.array(ids, np.int64)) == library.decode(ids, skip_special_tokens=False)
    assert decoder.decode(np.array([0, 10**6, -1, 1])) == library.decode([0, 1])


# alignment


def plain_alignment(a_library, b_library, text):
    """ids of both, groups as text and linked id pairs: ends as sets, all pairs of tokens in a group compared; None without tokens."""
    alphabet = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    alphabet |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if chr(b) not in alphabet)}
    a = a_library.encode(f" {text}", add_special_tokens=False).ids
    b = b_library.encode(text)
    a_bytes = [bytes(alphabet[c] for c in a_library.id_to_token(i)) for i in a]
    pieces = [b_library.id_to_piece(i) for i in b]
    b_bytes = [bytes([int(p[3:5], 16)]) if b_library.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(pieces, b, strict=True)]
    if not text or b"".join(a_bytes) != f" {text}".encode() or b"".join(b_bytes) != f" {text}".encode():
        return None
    spans = lambda parts: [(sum(map(len, parts[:i])), sum(map(len, parts[: i + 1]))) for i in range(len(parts))]
    a_spans, b_spans = spans(a_bytes), spans(b_bytes)
    groups, links, start = [], Counter(), 0
    for cut in sorted({e for _, e in a_spans} & {e for _, e in b_spans}):
        own_a = [(i, s, e) for i, (s, e) in zip(a, a_spans, strict=True) if start < e <= cut]
        own_b = [(i, s, e) for i, (s, e) in zip(b, b_spans, strict=True) if start < e <= cut]
        groups.append(",".join(str(x[0]) for x in own_a) + "|" + ",".join(str(x[0]) for x in own_b))
        links.update((x[0], y[0]) for x in own_a for y in own_b if x[1] < y[2] and y[1] < x[2])
        start = cut
    return a, b, groups, links


@pytest.fixture(scope="module")
def two_libraries():
    a = Tokenizer.from_str(read("byte_bpe_50k.json").decode())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def test_alignment_like_the_plain_one(spark, two_libraries):
    rows = [(i, t, "en") for i, t in enumerate(texts(7, 400))]
    rows += [(1, None, None), (None, "one text", None), (3, "one text", "en"), (3, "one text", "en"), (4, "<|endoftext|> is plain text", "en"), (5, "x" * 300, "en"), (6, "the end. The end, again: end", "en")]
    found = [(i, plain_alignment(*two_libraries, t or "")) for i, t, _ in rows]
    assert sum(f is not None for _, f in found) > 200 and sum(f is None for _, f in found) > 3
    counts = Counter()
    for _, f in found:
        counts.update(f[3] if f else {})
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for i, f in found:
        if f is None:
            want.append((i, 0, 0, 0, 0, "", 0, 0))
            continue
        a, b, groups, links = f
        top = sum(n for pair, n in links.items() if counts[pair] == best[pair[1]])
        want.append((i, len(a), len(b), len(groups), links.total(), sha(";".join(groups)), top, sum(n * counts[pair] for pair, n in links.items())))
    sending = [sent(spark, public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert sorted(map(tuple, alignment.scored(table(spark, rows), *sending).collect()), key=repr) == sorted(want, key=repr)
    hot, alignment.HOT = alignment.HOT, 50  # most pairs then take the way of seldom ones
    try:
        assert sorted(map(tuple, alignment.scored(table(spark, rows), *sending).collect()), key=repr) == sorted(want, key=repr)
    finally:
        alignment.HOT = hot
    assert alignment.scored(docs(spark).limit(0), *sending).count() == 0 and alignment.scored(docs(spark), *sending).count() == docs(spark).count()


def test_cuts_by_bisection():
    rng = random.Random(2)
    for _ in range(3000):
        n = rng.randint(1, 40)
        a, b = ([*sorted(rng.sample(range(1, n), rng.randint(0, n - 1))), n] for _ in range(2))
        assert alignment.shared_cuts(a, b) == [(a.index(x), b.index(x)) for x in sorted(set(a) & set(b))]
    far = [*range(2, 100_000, 2), 100_001], [*range(1, 100_000, 2), 100_001]
    assert alignment.shared_cuts(*far) == [(len(far[0]) - 1, len(far[1]) - 1)]


def test_long_text_without_cuts(two_libraries):
    aligner = alignment.Aligner(read("byte_bpe_50k.json"), read("piece_bpe_32k.model"))
    for text in ("x" * 2000, "ab" * 700, "日" * 500, "a\n" * 500, " " * 900):
        (own,) = aligner.texts([text])
        a, b, groups, links = plain_alignment(*two_libraries, text)
        assert ";".join(x[4] for x in own) == ";".join(groups) and Counter(p for x in own for p in x[3]) == Counter({a << 32 | b: n for (a, b), n in links.items()})


# collocations


def plain_collocations(rows, least, share, top):
    counts, out = defaultdict(Counter), []
    for _, text, lang in rows:
        plain = "".join("\n" if c in ".,;:!?\n\x0b\x0c\r" else c.lower() if c.isascii() else c for c in text or "")
        for piece in plain.split("\n"):
            ws = [w for w in piece.replace("\t", " ").split(" ") if w]
            for k in (1, 2, 3):
                counts[lang or "und"].update(tuple(ws[i : i + k]) for i in range(len(ws) - k + 1))
    for lang, own in counts.items():
        n = sum(c for p, c in own.items() if len(p) == 1)
        wide = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        made = []
        for p, a in wide.items():
            if len(p) == 2 and any(p in (q[:2], q[1:]) and 100 * b >= share * a for q, b in wide.items() if len(q) == 3):
                continue
            score, k = min((1_000_000 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            made.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right) in enumerate(sorted(made)[:top])]
    return sorted(out)


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["of", "the", "The", "new", "york", "é", "É", "a\x00b", "x\x85y", "zz"]
    text = lambda: "".join(rng.choice(words) + rng.choice((" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\x0b")) for _ in range(rng.randint(0, 30)))
    return [(i, text(), rng.choice(("en", "en", "de", None, "und"))) for i in range(n)] + [(1, None, "en"), (2, "", None), (3, "new york " * 200, "en"), (3, "new york " * 200, "en"), (None, "w " * 3000, "x y\nz")]


@pytest.mark.parametrize("sizes", [{}, {"burst": 3, "entries": 40, "step": 30}, {"burst": 2, "entries": 25, "words": 5, "step": 7}])
def test_collocations_like_the_plain_ones(spark, sizes):
    """With tries that burst and spill all the time, too."""
    rows = phrase_rows(1, 120)
    for top in (2000, 7):
        out = collocations.collocations(table(spark, rows), 4, 50, top, **sizes)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(map(tuple, out.collect())) == plain_collocations(rows, 4, 50, top)


def test_runs_that_are_made_one_while_they_arrive(spark, monkeypatch):
    rows = phrase_rows(2, 80)
    counter = collocations.Counter(1, burst=3, entries=30, step=20)
    runs = [r for _, t, lang in rows if lang == "en" for *_, r in counter.add("en", t or "")] + [r for *_, r in counter.finish()]
    whole, twice = collocations.merged(runs), collocations.merged([collocations.merged(runs[:9]).packed(), *runs[9:]])
    assert len(runs) > 9 and whole.names == twice.names and all((x == y).all() for x, y in zip((*whole.columns, whole.n), (*twice.columns, twice.n), strict=True))
    monkeypatch.setattr(collocations, "HELD", 200)
    assert sorted(map(tuple, collocations.collocations(table(spark, rows), 4, entries=30, step=20).collect())) == plain_collocations(rows, 4, 50, 2000)


def test_trie_bursts_and_keeps_counts():
    trie, rng, want = collocations.HatTrie(4), random.Random(1), Counter()
    for _ in range(60):
        pieces = [[rng.randint(1, 6) for _ in range(rng.randint(0, 6))] for _ in range(5)]
        trie.add(np.array([x for p in pieces for x in (*p, 0)], np.int64))
        want.update((a << 42 | b << 21 | c) for p in pieces for a, b, c in zip(p, [*p[1:], 0], [*p[2:], 0, 0], strict=False))
    assert trie.entries == len(want) and any(type(x) is collocations.Node for x in trie.root.values())
    keys, counts = trie.take(list(trie.root))
    assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == want and trie.entries == 0


def test_scores_are_exact(spark):
    """Products pass 64 bits."""
    a, left, right = 3_000_000_019, 4_000_000_007, 9_000_000_001
    row = spark.range(1).selectExpr(f"{a}L as a", f"{left}L as l", f"{right}L as r")
    assert row.select(collocations.score(row.a, row.l, row.r)).first()[0] == 1_000_000 * a * a // (left * right)


def test_empty_tables(spark):
    assert collocations.collocations(docs(spark).limit(0)).count() == 0
    assert collocations.collocations(docs(spark), 1).where("lang = 'und'").count() > 0
