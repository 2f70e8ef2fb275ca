"""Decontamination, source divergence and hard negatives against plain versions."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontamination, divergence, hard_negatives
from tidemark.llm.fm_index import PhraseIndex

# --- decontamination


def plain_hits(docs, items, window):
    """Per document: number of words, places that are hit, items."""
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    phrases = {}
    for key, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[i : i + n]), set()).add(str(key) if key is not None else "")
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(p) for p in phrases}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in phrases:
                    hit |= set(range(i, i + n))
                    found |= phrases[tuple(w[i : i + n])]
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["A", "b", "ñÑ", "c3", "日", "d"])
    sep = lambda: rng.choice([" ", ", ", "\n", "-", "\x00", "_ "])
    text = lambda n: "".join(word() + sep() for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 4, 5, 9, 30]))) for i in range(12)] + [(3, text(6)), (None, text(5)), (99, None), (98, ""), (97, "...")]
    docs = [(i, text(rng.randrange(0, 40))) for i in range(60)] + [(5, text(20)), (None, text(30)), (200, None), (201, ""), (202, items[11][1] * 30), (202, items[11][1] * 30)]
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 20])
def test_hits_as_by_hand(spark, block):
    docs, items = corpus(block)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.contamination(d, b, window=4, block=block)
    rows = [(r["doc_id"], r["n_words"], r["hit"], r["items"]) for r in got.withColumn("hit", decontamination.n_hit("spans")).collect()]
    assert sorted(rows, key=repr) == plain_hits(docs, items, 4)


def test_spans_are_removed(spark):
    d = spark.createDataFrame([(1, "Kéep this. One TWO three-four five, one two three four five! And this"), (2, "one two"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(7, "one two three four five")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in decontamination.decontaminated(d, b, window=5).collect()}
    assert got == {1: ("Kéep this. ! And this", 10), 2: ("one two", 0), 3: (None, 0)}
    spans = decontamination.contamination(d, b, window=5).filter("doc_id = 1").first()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(2, 12)]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.contamination(d.limit(0), b).collect() == []
    got = decontamination.contamination(d, b.limit(0)).collect()
    assert [(r["n_words"], r["spans"], r["items"]) for r in got] == [(2, [], [])]
    assert decontamination.contamination(d, b.withColumn("text", F.lit(None).cast("string"))).first()["items"] == []


def test_index_finds_every_place():
    rng = np.random.default_rng(3)
    sizes = np.array([1, 500, 40, 3, 2000, 7])
    symbols = rng.integers(5, 9, int(sizes.sum()))
    symbols[600:1800] = 6  # one word over and over
    index = PhraseIndex(symbols, sizes)
    begins = np.cumsum(sizes) - sizes
    for n in (1, 3, 11):
        phrases = np.array(sorted({tuple(symbols[i : i + n]) for i in range(0, 2000, 7)} | {(4,) * n, (9,) * n}))
        want = sorted((k, i) for b, s in zip(begins, sizes) for i in range(b, b + s - n + 1) for k in [next((j for j, p in enumerate(phrases) if (p == symbols[i : i + n]).all()), None)] if k is not None)
        got = sorted(zip(*(x.tolist() for x in index.find(phrases)), strict=True))
        assert got == want
    assert index.nbytes < 6 * len(symbols) + 4096  # no text, no suffix array


# --- divergence


def plain_divergence(rows, min_docs, top):
    """As the definition has it, in whole numbers of any size."""
    of, df, groups = Counter(), Counter(), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in terms]
        for t in terms:
            of[lang, source, t] += 1
        for t in set(terms):
            df[lang, t] += 1
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in df.items() if x == lang and n >= min_docs]
        sources = [s for x, s in groups if x == lang]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts.values()) + 5 * len(kept)) for t in kept}
        counts = {s: {t: of[lang, s, t] for t in kept} for s in sources}
        q = share({t: sum(counts[s][t] for s in sources) for t in kept})
        p = {s: share(counts[s]) for s in sources}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)}
    return out


@pytest.mark.parametrize("cells", [1 << 20, 7])
def test_divergence_as_by_hand(spark, cells):
    rng = random.Random(cells)
    words = ["A", "a", "bÉ", "bé", "c", "日本", "zz", "x9y", "d_e"]
    rows = [(" ".join(rng.choices(words, k=rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "é", "", None])) for _ in range(80)]
    rows += [(None, "fr", "s1"), ("once", "fr", "s2"), ("", "fr", None), ("alone", "it", "s")] + [("hot hot", "en", "s1")] * 40
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("term", F.lit(1)).repartition(4)
    got = divergence.divergence(docs, min_docs=6, top=3, cells=cells)
    assert {tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()} == plain_divergence(rows, 6, 3)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_shares_are_exact_at_any_size():
    count, total, kept = 8 * 10**15, 9 * 10**15, 1000
    assert divergence.share(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 5) // (total + 5 * kept)


def test_chunks_count_texts_once():
    part = pa.RecordBatch.from_pydict({"lang": ["en", "en", "de"], "source": ["a", "a", "a"], "text": ["x X y", "1 x,", ""]})
    got = divergence.chunk_counts(part).to_pylist()
    assert sorted((r["term"], r["n"], r["docs"]) for r in got) == [("x", 3, 2), ("y", 1, 1)]


# --- hard negatives


def plain_negatives(rows, is_anchor):
    used = [(i, k, lab, [np.floor(256 * np.float64(x)) for x in v]) for i, (k, lab, v) in enumerate(rows) if k is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for i, key, label, v in used:
        if not is_anchor(key):
            continue
        scored = sorted(((-dot(v, w), k, j, lab) for j, k, lab, w in used if j != i))
        for s, k, _, _ in [x for x in scored if x[3] == label][:5]:
            near = [x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            out += [(key, k, n + 1, x[1], -s, -x[0]) for n, x in enumerate(near[:5])]
    return sorted(out)


def mined(spark, rows, **how):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("row", F.lit(0)).withColumn("a.b", F.lit(0))
    got = hard_negatives.hard_negatives(df, F.col("id") % 10 == 0, **how)
    return sorted(tuple(r) for r in got.collect())


@pytest.mark.parametrize("block", [1 << 24, 40])
def test_negatives_as_by_hand(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, int(rng.integers(3)), [float(np.float32(x)) for x in rng.integers(-3, 6, 4) / 4]) for i in range(150)]
    rows += [(10, 1, rows[0][2]), (10, 1, rows[0][2]), (None, 1, rows[0][2]), (160, None, rows[0][2]), (170, 1, None), (180, 1, [1.0, None]), (190, 1, [float("nan")]), (191, 1, [float("inf")])]
    rows += [(200, 1, []), (201, 2, [1.0]), (-20, 0, [0.5, 0.5, 0.5, 0.5, 9.0])] + [(210 + i, 2, [1.0, 1.0, 1.0, 1.0]) for i in range(30)]
    assert mined(spark, rows, block=block) == plain_negatives(rows, lambda k: k % 10 == 0)


def test_no_rows_and_no_partners(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 1, [-1.0]), (2, 2, [-1.0])]) == []  # below 0 no score is at least 80 and at most 100 per cent


def test_scores_beyond_doubles():
    a, b = np.array([[2.0**40, 3.0]]), np.array([[2.0**20, 1.0]])
    assert hard_negatives.scores(a, b)[0, 0] == 2**60 + 3
    with pytest.raises(OverflowError):
        hard_negatives.scores(np.array([[2.0**40]]), np.array([[2.0**40]]))


def test_keys_sort_as_pairs_do():
    rng = random.Random(1)
    big = (1 << 63) - 1
    pick = lambda: rng.choice([-big, -5, 0, 5, big])
    pairs = [(pick(), 1, pick(), rng.randrange(2), pick(), 2) for _ in range(200)]
    packed = sorted(hard_negatives.packed_key(*p) for p in pairs)
    assert packed == [hard_negatives.packed_key(*p) for p in sorted(pairs, key=lambda p: (p[0], p[1], -p[2], *p[3:]))]


def test_a_walk_holds_windows_alone():
    """A million negatives of one anchor pass by as a generator."""
    keys = itertools.chain([hard_negatives.packed_key(0, 0, 1000, 0, 1, 1)], (hard_negatives.packed_key(0, 0, 999 - i // 2000, 1, i, i) for i in range(1_000_000)))
    assert list(hard_negatives.walked(keys)) == [(0, 1, k + 1, k, 1000, 999) for k in range(5)]
