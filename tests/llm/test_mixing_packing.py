"""Source mixing and sequence packing against plain versions."""

import hashlib
import random
from fractions import Fraction

import pytest

from tidemark.llm import mixing, packing

SCHEMA = "doc_id long, text string, source string, size long, target string"


def docs(spark, rows):
    return spark.createDataFrame([(d, t, s, -1, "x") for d, t, s in rows], SCHEMA)


def plain_mix(rows, weights=(1, 2, 3)):
    sizes = [len((t or "").split()) for _, t, _ in rows]
    sources = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    capped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in capped)
        shared = sum(weight[s] for s in sources if s not in capped) or 1
        target = {s: Fraction(3 * total[s]) if s in capped else Fraction(rest * weight[s], shared) for s in sources}
        more = {s for s in sources if s not in capped and target[s] > 3 * total[s]}
        if not more:
            break
        capped |= more
    key = lambda d: int(hashlib.md5(("" if d is None else str(d)).encode()).hexdigest()[:15], 16)
    out = []
    for (d, _, s), n in zip(rows, sizes):
        rounds = min(int(target[s] / total[s]), 3) if total[s] else 0
        budget = target[s] - rounds * total[s]
        upto = sum(m for m, r in zip(sizes, rows) if r[2] == s and key(r[0]) <= key(d))
        held = sum(m for m, r in zip(sizes, rows) if r[2] == s and key(r[0]) == key(d))
        out.append((d, n, total[s], round(float(target[s]), 6), n * (rounds + (2 * upto - held <= 2 * budget))))
    return sorted(out, key=str), target


@pytest.mark.parametrize("seed", [1, 2])
def test_mixture(spark, seed):
    rng = random.Random(seed)
    rows = [(i, " ".join("w" * rng.randint(0, 60)), rng.choice(["b", "a", "é", None, "hot", "hot", "hot", "z"])) for i in range(300)]
    rows += [(900, None, "null text only"), (901, "", "a"), (None, "x y", "a"), (None, "x y z", "a"), (5, rows[5][1], rows[5][2]), (902, "one", "tiny")]
    want, target = plain_mix(rows)
    got = mixing.mixture(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got), key=str) == want
    for s, t in target.items():
        taken = sum(r["taken"] for r in got if r["source"] == s)
        assert abs(taken - t) <= 60
        assert all(r["taken"] <= 3 * r["size"] for r in got)
    mixed = mixing.mixed(docs(spark, rows), mixing.mixing_plan(docs(spark, rows))[1])
    assert mixed.columns == ["doc_id", "text", "source", "size", "target"]
    assert sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r[4] for r in want)


def test_no_document_comes_more_often_than_it_may(spark):
    rows = [(i, "a " * 50, "large") for i in range(40)] + [(100 + i, "b" if i < 3 else "", "small") for i in range(60)]
    df = spark.createDataFrame([(d, t, s, 7, 8) for d, t, s in rows], "doc_id long, text string, source string, __copies int, `a.b` int")
    mixed = mixing.mixed(df, mixing.mixing_plan(df)[1])
    assert mixed.columns == df.columns
    times = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(times.values()) <= 3 and times[100] == 3
    named = df.withColumnsRenamed({"doc_id": "the.id", "source": "the.source", "text": "the.text"})
    assert mixing.mixed(named, mixing.mixing_plan(named, id_col="the.id", text_col="the.text", source_col="the.source")[1], "the.id", "the.source").count() == mixed.count()


def test_mixing_nothing(spark):
    assert mixing.mixture(docs(spark, [])).count() == 0
    only = mixing.mixture(docs(spark, [(1, None, None), (2, " ", "a")])).collect()
    assert [r["taken"] for r in only] == [0, 0] and [r["target"] for r in only] == [0.0, 0.0]


def plain_best_fit(rests, lengths):
    """Bins by scanning all open ones; sizes are opened as the operator documents it."""
    used, capacity, bins, since = [], [], [], []
    for n, r in enumerate(rests):
        fits = [b for b in range(len(used)) if capacity[b] - used[b] >= r]
        if fits:
            b = min(fits, key=lambda b: (capacity[b] - used[b], -since[b]))
        else:
            prices = []
            for length in lengths:
                if length >= r:
                    holds = r
                    for x in rests[n + 1 :]:  # longest first
                        if holds + x <= length:
                            holds += x
                    prices.append((min(packing.sequence_cost(x) for x in lengths if x >= holds) / holds, length))
            b = len(used)
            used.append(0)
            since.append(n)
            capacity.append(min(prices)[1])
        used[b] += r
        since[b] = n
        bins.append(b)
    return [min(x for x in lengths if x >= u) for u in used], used


def test_best_fit_opens_the_cheapest_length():
    rng = random.Random(4)
    for _ in range(60):
        lengths = sorted(rng.sample([4, 8, 16, 32, 64], rng.randint(1, 4)))
        rests = sorted((rng.randint(1, lengths[-1]) for _ in range(rng.randint(0, 60))), reverse=True)
        bins, ends = packing.best_fit(rests, lengths, [packing.sequence_cost(x) for x in lengths])
        used = [0] * len(ends)
        for r, b in zip(rests, bins):
            used[b] += r
        assert (sorted(zip(ends, used))) == sorted(zip(*plain_best_fit(rests, lengths)))


def test_packing(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.choice([0, 1, 7, 63, 64, 65, 300, 1000])), "s") for i in range(150)]
    rows += [(None, "a b", "s"), (None, "a b", "s"), (3, rows[3][1], "s"), (200, None, None)]
    got = packing.packed(docs(spark, rows), lengths=(16, 64, 32), group=40).collect()
    bins, pieces = {}, {}
    for r in got:
        if r["length"]:
            bins.setdefault(r["bin_id"], []).append(r)
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        else:
            assert r["bin_id"] is None
    for members in bins.values():
        members.sort(key=lambda r: r["bin_start"])
        at = 0
        for r in members:
            assert r["bin_start"] == at
            at += r["length"]
        assert {(r["bin_length"], r["bin_used"]) for r in members} == {(min(x for x in (16, 32, 64) if x >= at), at)}
    words = sum(len((t or "").split()) for _, t, _ in rows)
    assert sum(n for p in pieces.values() for _, n in p) == words
    for d, t, _ in rows:
        n = len((t or "").split())
        if n and d not in (None, 3):
            assert sorted(pieces[d]) == [(a, min(64, n - a)) for a in range(0, n, 64)]
    assert sum(1 for r in got if not r["length"]) == sum(1 for _, t, _ in rows if not (t or "").split())
    assert packing.packed(docs(spark, [])).count() == 0


def test_rows_that_repeat_id_and_text_are_dealt_over_groups(spark):
    rows = [(None, "a b c", "s")] * 700 + [(5, "d " * 70, "s")] * 3 + [(i, "e f", "s") for i in range(300)]
    got = packing.packed(docs(spark, rows), lengths=(16, 64, 32), group=40).collect()
    assert sorted((r["doc_id"], r["start"], r["length"]) for r in got if r["doc_id"] == 5) == sorted([(5, 0, 2)] + [(5, 0, 64), (5, 64, 6)] * 3)
    assert sum(1 for r in got if r["doc_id"] is None and r["length"] == 3) == 700
    in_group, bins = {}, {}
    for r in got:
        name = r["bin_id"].split(":")[0]
        in_group[name] = in_group.get(name, 0) + 1
        bins.setdefault(r["bin_id"], []).append((r["bin_start"], r["length"], r["bin_used"]))
    assert max(in_group.values()) < 120
    for members in bins.values():
        assert sum(n for _, n, _ in members) == members[0][2] and len({at for at, _, _ in members}) == len(members)
