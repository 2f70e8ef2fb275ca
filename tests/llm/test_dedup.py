"""Exact, substring and SimHash deduplication against plain versions."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, fm_index, simhash, substring_dedup
from tidemark.llm.words import LOWER, split_words, xxh64_ranges

DOCS = "doc_id long, text string, kept string, source string, __salt int"


def docs(spark, rows):
    """With further columns whose names clash with those of the operators."""
    return spark.createDataFrame([(d, t, "x", None, 1) for d, t in rows], DOCS)


def found(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


# --- exact


@pytest.mark.parametrize("salts", [1, 3, 32])
def test_exact_groups(spark, salts):
    rng = random.Random(salts)
    rows = [(i, rng.choice(["a", "b", "A", "", None, "a ", "é" * 50_000])) for i in range(400)] + [(None, "a"), (None, "only null")]
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    want = [(d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    got = exact_dedup.exact_groups(docs(spark, rows), salts=salts)
    assert found(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    kept = exact_dedup.exact_dedup(docs(spark, rows), salts=salts)
    assert kept.columns == ["doc_id", "text", "kept", "source", "__salt"]
    assert sorted((r["text"] or "" for r in kept.collect())) == sorted(groups)


def test_texts_with_one_address_stay_apart(spark):
    few = lambda text: {"__sha": F.substr(F.sha2(text, 256), F.lit(1), F.lit(1)), "__xx": F.lit(0).cast("long"), "__length": F.lit(0)}
    rng = random.Random(9)
    rows = [(i, f"text {rng.randint(0, 60)}") for i in range(300)]
    columns = ("doc_id", "keep_id", "group_size", "kept")
    got = exact_dedup.exact_groups(docs(spark, rows), address=few)
    assert found(got, *columns) == found(exact_dedup.exact_groups(docs(spark, rows)), *columns)
    with pytest.raises(ValueError):
        exact_dedup.exact_groups(docs(spark, rows), salts=64)


def test_columns_of_any_name_and_type(spark):
    df = spark.sql("SELECT id AS doc_id, concat('t', id % 3) AS text, map('k', id) AS `a.b`, array(map(1, id)) AS __row, id AS __text FROM range(9)")
    kept = exact_dedup.exact_dedup(df)
    assert kept.schema == df.schema or kept.columns == df.columns
    assert sorted((r["doc_id"], r["text"], r["a.b"]["k"], r["__text"]) for r in kept.collect()) == [(6, "t0", 6, 6), (7, "t1", 7, 7), (8, "t2", 8, 8)]


def test_of_rows_that_repeat_an_id_one_stays(spark):
    rows = [(5, "a"), (5, "a"), (4, "a")]
    assert sum(r["kept"] for r in exact_dedup.exact_groups(docs(spark, rows)).collect()) == 1
    assert found(exact_dedup.exact_dedup(docs(spark, rows)), "doc_id") == [(5,)]
    for f in (exact_dedup.exact_groups, exact_dedup.exact_dedup):
        assert f(docs(spark, [])).count() == 0


# --- words


def test_words_and_hashes_in_one_buffer():
    rng = random.Random(1)
    parts = [" ", "\n", "\t\x0b", "a", "B", "é", "漢", "xyz", "longer-word" * 4, "　", "\x1f"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 6))]
        words = split_words(texts, LOWER)
        for i, text in enumerate(texts):
            own = slice(words.first[i], words.first[i + 1])
            assert [bytes(words.buffer[s:e]) for s, e in zip(words.starts[own], words.ends[own])] == (text or "").encode().translate(LOWER).split()
        hashed = xxh64_ranges(words.buffer, words.starts, words.ends)
        assert hashed.tolist() == [xxhash.xxh64_intdigest(bytes(words.buffer[s:e]), 42) for s, e in zip(words.starts, words.ends)]


# --- substrings


def plain_removal(rows, window):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1 if d is not None else 0):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1 if d is not None else 0):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("vocabulary, crowd", [(3, 4096), (3, 2), (40, 4096), (40, 0)])
def test_words_of_repeated_windows_go(spark, vocabulary, crowd):
    rng = random.Random(vocabulary + crowd)
    words = [f"w{i}é" for i in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 25))] for _ in range(6)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            text += rng.choice(passages) if rng.random() < 0.6 else [rng.choice(words) for _ in range(rng.randint(0, 12))]
        rows.append((rng.choice([d, d, d, None]), rng.choice([" ", "\n\t "]).join(text)))
    rows += rows[:5] + [(3, None), (4, ""), (7, rows[9][1]), (70, "one " * 3000), (71, "one " * 2000)]
    got = substring_dedup.without_repeats(docs(spark, rows), window=8, grams=(3, 5, 8), crowd=crowd, shard=40, keep_text=True)
    assert found(got, "doc_id", "n_words", "n_removed", "kept_sha256") == plain_removal(rows, 8)
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in got.collect())


def test_no_documents_have_no_repeats(spark):
    assert substring_dedup.without_repeats(docs(spark, [])).count() == 0


def test_matching_statistics():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sigma, cap = int(rng.integers(2, 6)), int(rng.choice([3, 8, 300]))
        texts = [rng.integers(1, sigma + 1, rng.integers(1, 30)) for _ in range(rng.integers(1, 12))]
        owners = rng.integers(0, 5, len(texts))
        index = fm_index.FMIndex(texts, owners, cap)
        queries = [rng.integers(0, sigma + 3, rng.integers(1, 25)) for _ in range(5)] + texts[:2]
        own = np.concatenate([rng.integers(0, 7, 5), owners[:2]])
        length, at = index.statistics(queries, own), 0
        least = int(rng.integers(1, cap + 1))
        ended = index.statistics(queries, own, least)
        assert (ended[length >= least] == length[length >= least]).all() and (ended <= length).all()
        for q, o in zip(map(np.ndarray.tolist, queries), own):
            earlier = [t.tolist() for t, owner in zip(texts, owners) if owner < o]
            known = {tuple(t[i:j]) for t in earlier for i in range(len(t)) for j in range(i + 1, min(len(t), i + cap) + 1)}
            for i in range(len(q)):
                n = 0
                while n < cap and i + n < len(q) and tuple(q[i : i + n + 1]) in known:
                    n += 1
                assert length[at] == n
                at += 1


def test_an_index_is_smaller_than_its_suffix_array():
    rng = np.random.default_rng(1)
    texts = [rng.integers(1, 5000, 70) for _ in range(2000)]
    index = fm_index.FMIndex(texts, np.arange(2000), 50)
    assert index.nbytes < 8 * index.rows + index.minima.nbytes


def test_the_search_decides(spark, monkeypatch):
    """Windows that no smaller document has stay because their statistic is less than a window."""
    shared = [f"p{i}" for i in range(30)]
    rows = [(d, " ".join([f"a{d}_{i}" for i in range(10)] + shared + [f"b{d}_{i}" for i in range(10)])) for d in range(6)]
    run = lambda: found(substring_dedup.without_repeats(docs(spark, rows), window=12, grams=(4, 12)), "doc_id", "n_removed")
    assert run() == [(0, 0)] + [(d, 30) for d in range(1, 6)]
    segments = [r[1].encode() for r in rows]
    assert [x.tolist() for x in substring_dedup.shard_spans(segments, np.arange(6), 12)] == [[1, 2, 3, 4, 5], [10] * 5, [29] * 5]
    for constant in (0, 12):
        monkeypatch.setattr(fm_index.FMIndex, "statistics", lambda self, queries, owners, least, n=constant: np.full(sum(map(len, queries)), n))
        assert [x.tolist() for x in substring_dedup.shard_spans(segments, np.arange(6), 12)] != [[1, 2, 3, 4, 5], [10] * 5, [29] * 5]


def test_ids_that_are_no_integers_are_refused(spark):
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


# --- SimHash


def plain_print(text):
    words = (text or "").encode().translate(LOWER).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_bit_by_bit():
    rng = random.Random(3)
    texts = [None, "", " \n", "one", "One two", "a b c", " ".join(rng.choice("abcdefgh") for _ in range(5000))]
    texts += [" ".join(rng.choice(["The", "cat", "É", "漢字", "x" * 40]) for _ in range(rng.randint(1, 600))) for _ in range(40)]
    assert [int(x) & (2**64 - 1) for x in simhash.fingerprints_of(texts)] == [plain_print(t) for t in texts]


def test_components_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [[rng.choice(words) for _ in range(400)] for _ in range(12)]
    rows = []
    for d in range(240):
        text = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
        rows.append((d, " ".join(text)))
    rows += [(500, None), (501, ""), (502, "single"), (None, rows[3][1]), (7, rows[7][1])]
    prints = [plain_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(least.get(top(i), d), d)
    want = [(d, f"{p:016x}", least.get(top(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]
    got = simhash.near_components(docs(spark, rows))
    assert found(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=str)
    kept = simhash.near_dedup(docs(spark, rows))
    assert kept.columns == ["doc_id", "text", "kept", "source", "__salt"]
    assert {r["doc_id"] for r in kept.collect()} == set(least.values())
    assert simhash.near_components(docs(spark, [])).count() == 0


def test_each_component_keeps_one_row_whatever_its_id(spark):
    rng = random.Random(6)
    alone, shared, other, nulls = (" ".join(rng.choice("abcdefghijklm") for _ in range(400)) for _ in range(4))
    near = shared + " a"  # one word more
    assert (plain_print(near) ^ plain_print(shared)).bit_count() <= 3
    far = [plain_print(t) for t in (alone, shared, other, nulls)]
    assert all((a ^ b).bit_count() > 3 for a in far for b in far if a is not b)
    # a unique text without an id; an id that wins one component and repeats on a copy in another; only null ids; whole rows that repeat
    rows = [(None, alone), (1, shared), (2, near), (2, other), (None, nulls), (None, nulls), (None, other), (2, other)]
    kept = simhash.near_dedup(docs(spark, rows))
    assert found(kept, "doc_id", "text") == sorted([(None, alone), (1, shared), (2, other), (None, nulls)], key=str)
    again = simhash.near_dedup(docs(spark, rows[::-1]))
    assert found(again, "doc_id", "text") == found(kept, "doc_id", "text")
    assert simhash.near_dedup(docs(spark, [])).count() == 0


def linked_classes(links):
    label = {}

    def top(x):
        while label.setdefault(x, x) != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in links:
        label[top(a)] = top(b)
    return top


@pytest.mark.parametrize("part", [1, 8, 2048])
def test_split_buckets_give_the_same_links(spark, part):
    rng = np.random.default_rng(part)
    prints = np.unique(np.concatenate([rng.integers(0, 1 << 11, 300) | (7 << 40), rng.integers(0, 1 << 11, 60) | (5 << 40), rng.integers(-(1 << 62), 1 << 62, 50)]).astype(np.int64))
    links = [tuple(r) for r in simhash.near_links(spark.createDataFrame([(x,) for x in prints.tolist()], "fp long"), part).collect()]
    top = linked_classes(links)
    want = linked_classes((a, b) for a in prints.tolist() for b in prints.tolist() if ((a ^ b) & (2**64 - 1)).bit_count() <= 3)
    for a, b in zip(prints.tolist(), prints.tolist()[1:]):
        assert (top(a) == top(b)) == (want(a) == want(b))
    assert len({(top(x), want(x)) for x in prints.tolist()}) == len({want(x) for x in prints.tolist()})


def test_a_segment_that_300000_fingerprints_share(spark):
    low = F.pmod(F.xxhash64("id"), F.lit(1 << 32))
    prints = spark.range(300_000).select(low.bitwiseOR(F.lit(9 << 32)).alias("fp")).distinct()
    top = linked_classes(tuple(r) for r in simhash.near_links(prints).collect())
    every = np.array([r["fp"] for r in prints.collect()])
    for x in every[:200]:
        near = every[np.bitwise_count((every ^ x).view(np.uint64)) <= 3]
        assert {top(y) for y in near.tolist()} == {top(int(x))}
