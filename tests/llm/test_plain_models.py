"""The fitted operators against plain versions that loop over letters, rows and bins."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from kgspark.llm import language, quality


def plain_profile(text):
    """The sum of a text's trigram vectors, in integers: each letter's signs rotated by its place and multiplied."""
    runs = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not runs:
        return None
    line, total = f" {' '.join(runs)} ", [0] * language.DIM
    signs = {}
    for letter in set(line):
        seed = int.from_bytes(hashlib.sha256(letter.encode()).digest()[:8], "big")
        signs[letter] = [int(b) * 2 - 1 for b in np.random.default_rng(seed).integers(0, 2, language.DIM, dtype=np.int8)]
    for gram, n in Counter(line[i : i + 3] for i in range(len(line) - 2)).items():
        a, b, c = (signs[x] for x in gram)
        for i in range(language.DIM):
            total[i] += n * a[i - 2] * b[i - 1] * c[i]
    return total


def norm(v):
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def test_language_equals_the_plain_version(spark):
    rng = random.Random(4)
    pools = {"xx": ["kata", "poku", "tiki"], "yy": ["brun", "grad", "katr"], "zz": ["çela", "élu", "tikó"]}
    rows = [(i, " ".join(rng.choice(pools[lang]) + rng.choice("aeiou") for _ in range(1 + i % 9)), lang) for i in range(36) for lang in [("xx", "yy", "zz")[i % 3]]]
    rows += [(100, "katbru çel", "xx"), (101, "12 !", "yy"), (102, None, "zz"), (103, "Kata\nKATA brun", None), rows[0], (None, "grade tikia", "yy")]
    profiles = [plain_profile(t) for _, t, _ in rows]
    learn = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 4 != 2
    langs = sorted({lang for i, _, lang in rows if lang and learn(i)})
    sums = {lang: [0.0] * language.DIM for lang in langs}
    for (i, _, lang), p in zip(rows, profiles, strict=True):
        if lang and learn(i) and p:
            sums[lang] = [a + b for a, b in zip(sums[lang], norm(p), strict=True)]
    protos = {lang: norm(v) for lang, v in sums.items()}
    mean = [sum(x) / len(langs) for x in zip(*protos.values(), strict=True)]
    centred = {lang: norm([a - m for a, m in zip(v, mean, strict=True)]) for lang, v in protos.items()}
    want = []
    for (i, _, _), p in zip(rows, profiles, strict=True):
        if p is None:
            want.append((i, "und", 0.0))
            continue
        off = norm([a - m for a, m in zip(norm(p), mean, strict=True)])
        best = max((sum(a * b for a, b in zip(off, v, strict=True)), lang) for lang, v in centred.items())
        want.append((i, best[1], min(1, max(0, 0.5 + 0.5 * best[0]))))
    got = [(r.doc_id, r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()]
    key = lambda r: (str(r[0]), r[1], r[2])
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-4


def plain_tree(g, h, leaves):
    """Leaf values over bins: the part whose best cut gains most is cut, until there are so many leaves."""
    value = lambda a, b: sum(g[a:b]) / (sum(h[a:b]) + 1)
    worth = lambda a, b: sum(g[a:b]) ** 2 / (sum(h[a:b]) + 1)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        gain, a, c, b = max(((worth(a, c) + worth(c, b) - worth(a, b), a, c, b) for a, b in parts for c in range(a + 1, b)), default=(0, 0, 0, 0), key=lambda x: x[0])
        if gain <= 1e-9:
            break
        parts = [p for p in parts if p != (a, b)] + [(a, c), (c, b)]
    out = [0.0] * len(g)
    for a, b in parts:
        out[a:b] = [value(a, b)] * (b - a)
    return out


def plain_quadrants(g, h):
    best = (0.0, [[0.0] * len(g[0]) for _ in g])
    for i in range(1, len(g)):
        for j in range(1, len(g[0])):
            cells = [(range(*r), range(*c)) for r in ((0, i), (i, len(g))) for c in ((0, j), (j, len(g[0])))]
            total = lambda x, rs, cs: sum(x[r][c] for r in rs for c in cs)
            gain = sum(total(g, *q) ** 2 / (total(h, *q) + 1) for q in cells)
            if gain > best[0]:
                table = [[0.0] * len(g[0]) for _ in g]
                for rs, cs in cells:
                    for r in rs:
                        for c in cs:
                            table[r][c] = total(g, rs, cs) / (total(h, rs, cs) + 1)
                best = gain, table
    return best


def plain_scores(x, y, asked):
    """Scores of the rows asked by boosting with loops over rows."""
    cuts = lambda c, n: sorted(set(np.quantile(c, np.linspace(0, 1, n + 1)[1:-1]).tolist()))
    place = lambda cut, v: sum(e <= v for e in cut)
    columns = list(zip(*x, strict=True))
    fine, wide = [cuts(c, quality.BINS) for c in columns], [cuts(c, quality.COARSE) for c in columns]
    share = (sum(y) + 1) / (len(y) + 2)
    base = math.log(share / (1 - share))
    odds, tables = [base] * len(y), [[0.0] * (len(e) + 1) for e in fine]

    def slopes():
        p = [1 / (1 + math.exp(-o)) for o in odds]
        return [a - b for a, b in zip(y, p, strict=True)], [b * (1 - b) for b in p]

    for _ in range(quality.ROUNDS):
        for f, table in enumerate(tables):
            g, h, at = *slopes(), [place(fine[f], r[f]) for r in x]
            own = lambda w: [sum(v for v, b in zip(w, at, strict=True) if b == k) for k in range(len(table))]  # noqa: B023, E731
            for k, v in enumerate(plain_tree(own(g), own(h), 4)):
                table[k] += quality.RATE * v
                odds = [o + quality.RATE * v if b == k else o for o, b in zip(odds, at, strict=True)]

    def pair(i, j):
        g, h = slopes()
        made = [[[0.0] * (len(wide[j]) + 1) for _ in range(len(wide[i]) + 1)] for _ in range(2)]
        for r, a, b in zip(x, g, h, strict=True):
            for grid, v in zip(made, (a, b), strict=True):
                grid[place(wide[i], r[i])][place(wide[j], r[j])] += v
        return plain_quadrants(*made)

    ranked = sorted(((pair(i, j)[0], i, j) for i in range(len(columns)) for j in range(i)), reverse=True)[: quality.PAIRS]
    grids = {(i, j): [[0.0] * (len(wide[j]) + 1) for _ in range(len(wide[i]) + 1)] for _, i, j in ranked}
    for _ in range(quality.PAIR_ROUNDS):
        for (i, j), grid in grids.items():
            step = pair(i, j)[1]
            for a, line in enumerate(step):
                for b, v in enumerate(line):
                    grid[a][b] += quality.RATE * v
            odds = [o + quality.RATE * step[place(wide[i], r[i])][place(wide[j], r[j])] for o, r in zip(odds, x, strict=True)]
    out = []
    for r in asked:
        o = base + sum(t[place(e, v)] for t, e, v in zip(tables, fine, r, strict=True))
        o += sum(grid[place(wide[i], r[i])][place(wide[j], r[j])] for (i, j), grid in grids.items())
        out.append(1 / (1 + math.exp(-o)))
    return out


def test_quality_equals_plain_boosting(spark, monkeypatch):
    for name, n in (("BINS", 6), ("COARSE", 4), ("ROUNDS", 6), ("PAIR_ROUNDS", 3), ("PAIRS", 3)):
        monkeypatch.setattr(quality, name, n)
    rng = random.Random(6)
    rows = []
    for i in range(90):
        n = rng.randrange(1, 60)
        rows.append((i, " ".join(rng.choice(("Aa", "bb", "ccc", "dddd9", "e,", "f#")) + "x" * rng.randrange(9) for _ in range(n)) + "\n" * rng.randrange(3)))
    rows += [(200, ""), (201, None)]
    labels = [(i, int(len(t) % 7 > 2 or "#" not in t)) for i, t in rows[:80]]
    texts = dict(rows)
    taught = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    want = plain_scores([quality.features(texts[i]) for i, _ in taught], [q for _, q in taught], [quality.features(t) for _, t in rows])
    out = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    for (i, _), score in zip(rows, want, strict=True):
        assert abs(out[i].score - score) < 1e-6 and out[i].predicted == int(out[i].score >= 0.5)
