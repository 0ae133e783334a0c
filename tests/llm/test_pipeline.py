"""The pipeline against a plain version of its stages."""

import hashlib
import math
import random
import re

import pytest

import corpus_pipeline
from kgspark.llm import quality, sharding
from tests.llm.test_methods import plain_fingerprint, plain_groups, plain_windows


def corpus(spark, folder):
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(500)]
    text = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, text(30)) for i in range(5)]
    docs = []
    for i in range(160):
        body = text(rng.randrange(20, 90))
        if i % 9 == 0:
            body = " ".join(w + "###" for w in body.split())
        if i % 7 == 1:
            body = body + " " + items[i % 5][1]
        docs.append((i, body, "en", ("a", "b", "c", None)[min(i % 8, 3)], len(body)))
        if i % 5 == 2:
            docs.append((1000 + i, body.upper(), "en", "b", len(body)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 9 > 0), 0) for i in range(0, 160)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def plain_mix(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(d[1]) for d in docs if d[3] == s) for s in sources}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    target, open_ = {}, set(sources)
    left = 1.5 * sum(total.values())
    while open_:
        over = {s for s in open_ if left * weight[s] / sum(weight[x] for x in open_) > 2 * total[s]}
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(2 * total[s] for s in over)
        open_ -= over
    out, slope = [], {5: -0.5, 2: 0.0, 1: 0.5}
    for s in sources:
        budget, done = math.floor(target[s] + 0.5), 0
        ordered = sorted((d for d in docs if d[3] == s), key=lambda d: (hashlib.md5(f"{d[0]}/{hashlib.md5(d[1].encode()).hexdigest()}".encode()).hexdigest(), d[0]))
        while done < budget:
            for d in ordered:
                if done < budget:
                    share, rest = done / target[s], 1 - slope[weight[s]]
                    out.append((2 * share / (rest + math.sqrt(rest * rest + 4 * slope[weight[s]] * share)), d))
                    done += size(d[1])
    return [d for _, d in sorted(out, key=lambda x: x[0])]


def plain_shard(doc_id, levels):
    at = ""
    for level in levels:
        u = lambda c: (int(hashlib.md5(f"{doc_id}/{c}".encode()).hexdigest()[:12], 16) + 1) / (2.0**48 + 1)
        at = min((-math.log(u(c)) / w, c) for c, w in level[at].items())[1]
    return int(at.rsplit("/", 1)[1])


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    docs, items = corpus(spark, tmp_path)
    model = quality.fit(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    kept = sorted(d for d, good in zip(docs, model.score(quality.matrix([d[1] for d in docs])) >= 0.5, strict=True) if good)
    assert {d[0] for d in docs} - {d[0] for d in kept} == {i for i, *_ in docs if i % 1000 % 9 == 0}
    groups = plain_groups([plain_fingerprint(d[1]) for d in kept])
    kept = [d for i, d in enumerate(kept) if groups[i] == i]
    kept = [d for d in kept if not plain_windows(d[1], items)[4]]
    assert len(kept) < 140
    levels = sharding._children([sharding.even_tree()])
    want = [(*d, plain_shard(d[0], levels)) for d in plain_mix(kept)]
    out = corpus_pipeline.run(spark, str(tmp_path))
    got = [tuple(r)[1:] for r in out.select("position", "doc_id", "text", "lang", "source", "n_chars", "shard").orderBy("position").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert out.select("position").distinct().count() == len(want)
    # several documents may stand at the start, where each source's first one is; all else is in the order of the schedule
    assert [d[0] for d in got[4:]] == [d[0] for d in want[4:]]


@pytest.mark.parametrize("at", range(4))
def test_stages_return_the_columns_of_documents(spark, tmp_path, at):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.STAGES[at][1](spark, docs, str(tmp_path)).columns == docs.columns
