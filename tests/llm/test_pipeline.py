"""The pipeline's stages, each against a plain version on its own input."""

import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_mixing_packing import plain_mix
from tidemark.llm import toxicity, wide_simhash

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def classes_of(close):
    """The smallest id that each reaches."""
    label = {}
    for d in sorted(close):
        todo = [d]
        while todo:
            x = todo.pop()
            if x not in label:
                label[x] = d
                todo += close[x]
    return label


def test_near_copies_of_all_kinds(spark):
    """Copies with words replaced at random, a hot class of them, and texts that share little: recall, and nothing else goes."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    texts, family = [], []
    for k in range(120):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        copies = 1500 if k == 0 else rng.choice([0, 1, 1, 3])
        for c in range(copies + 1):
            text = list(base)
            for _ in range(len(base) // 60 if c else 0):
                text[rng.randrange(len(text))] = rng.choice(words)
            texts.append(" ".join(text))
            family.append(k)
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows + [(None, texts[5]), (len(texts), ""), (len(texts) + 1, None), (len(texts) + 2, "one two")], "doc_id long, text string").withColumn("fp", F.lit(1))
    kept = [r["doc_id"] for r in wide_simhash.near_dedup(docs).collect()]
    own = [shingles(t) for t in texts]
    assert len(kept) == len(set(kept)) and len(texts) + 2 in kept and (len(texts) in kept) != (len(texts) + 1 in kept)
    stay = [k for k in kept if k is not None and k < len(texts)]
    assert {family[k] for k in stay} == set(family) and None not in kept
    # of copies that share 0.8 with the first of their family, at least 0.9 go
    first = {f: family.index(f) for f in family}
    alike = [k for k, f in enumerate(family) if k != first[f] and len(own[k] & own[first[f]]) >= 0.8 * len(own[k] | own[first[f]])]
    assert len(alike) > 300 and sum(k in stay for k in alike) <= 0.1 * len(alike)


def test_bucket_forests_connect_what_is_close():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, (6, wide_simhash.BITS // 64), np.uint64)
    prints = base[rng.integers(0, 6, 400)]
    for row in prints:
        for bit in rng.integers(0, wide_simhash.BITS, rng.integers(0, 60)):
            row[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    a, b = wide_simhash.bucket_forest(prints, len(prints))
    apart = np.bitwise_count(prints[:, None] ^ prints[None, :]).sum(axis=2)
    want = classes_of({i: np.flatnonzero(apart[i] <= wide_simhash.MAX_BITS).tolist() for i in range(400)})
    links = defaultdict(list)
    for x, y in zip(a.tolist(), b.tolist()):
        links[x].append(y), links[y].append(x)
    assert classes_of({i: links[i] for i in range(400)}) == want and len(a) == 400 - len(set(want.values()))


def test_stages_in_order(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, FOLDER)
        made.write.parquet(f"file://{tmp_path}/{k}")
        docs = spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == COLUMNS, name
        held.append(docs.collect())
    given = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    clean, distinct, near, mixed, packed = held

    model = toxicity.train(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(spark.read.parquet(f"{FOLDER}/documents.parquet"), model, keep=["doc_id"]).collect()}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in given if scores[r["doc_id"]] < 0.3}

    last = {}
    for r in clean:
        last[r["text"]] = max(last.get(r["text"], -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in distinct) == sorted(last.values())

    own = {r["doc_id"]: shingles(r["text"]) for r in distinct}
    bits = dict(zip(own, np.unpackbits(wide_simhash.wide_prints([r["text"] for r in distinct])[0], axis=1).astype(bool)))
    near_ids = {r["doc_id"] for r in near}
    close = {d: [e for e in own if e != d and (bits[d] != bits[e]).sum() <= wide_simhash.MAX_BITS] for d in own}
    # none goes without one that stays in its place, one of each class stays, and near-copies are found
    classes = classes_of(close)
    assert all(close[d] for d in own if d not in near_ids)
    assert {classes[d] for d in own} == {classes[d] for d in near_ids}
    alike = [(d, e) for d in own for e in own if d < e and len(own[d] & own[e]) >= 0.8 * len(own[d] | own[e])]
    assert all(d not in near_ids or e not in near_ids for d, e in alike)

    rows = [(r["doc_id"], r["text"], r["source"]) for r in near]
    taken = defaultdict(int)
    for r in mixed:
        taken[r["doc_id"]] += len(r["text"].split())
    want, _ = plain_mix(rows)
    assert {d: n for d, _, _, _, n in want if n} == {d: n for d, n in taken.items() if n}

    assert sum(r["length"] for r in packed) == sum(taken.values())

    run = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(map(tuple, run), key=str) == sorted(map(tuple, packed), key=str)
