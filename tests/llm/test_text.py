"""Token counts, toxicity scores and secret scans against plain versions and held-out labels."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemark.llm import queries, secrets, token_counts, toxicity

PATH = str(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda t: len(tokenizer.encode(t or "", add_special_tokens=False))


def test_counts_are_the_librarys_for_any_chunks(library):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "z", "漢", "\x0b", "\xa0", "　", "'s", "'", "12", "!?", "<|endoftext|>", "<|endof", "text|>", "hello", "​", "\x1c", "🙂", "é", "\x85", "\r\n"]
    counter = token_counts.Counter(PATH)
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 200)))
        counter.chunk, counter.overlap = rng.choice([20, 60, 100, 100_000]), rng.choice([4, 16])
        assert counter.counts([text, None, ""]) == [library(text), 0, 0]


def test_overlaps_grow_where_nothing_aligns(library):
    counter = token_counts.Counter(PATH, chunk=100, overlap=8)
    for text in ("x" * 3000 + " y" * 2000 + "z" * 3000, " " * 4000, "!" * 999 + "a", "<|endoftext|>" * 300):
        assert counter.counts([text]) == [library(text)]


def test_units_beyond_what_is_remembered(library, monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 3)
    counter = token_counts.Counter(PATH)
    texts = ["one two three", "four five six seven", "one nine"]
    assert [counter.counts([t])[0] for t in texts] == [library(t) for t in texts]
    assert len(counter.known) <= 3


def test_token_counts_of_documents(spark, library):
    texts = [None, "", "héllo <|endoftext|> wörld", "word " * 20_000]
    df = spark.createDataFrame([(i, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens long")
    got = sorted(tuple(r) for r in token_counts.token_counts(df, PATH).collect())
    assert got == [(i, len((t or "").encode()), library(t), library(t) > 1024) for i, t in enumerate(texts)]
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0


def test_tokenizers_without_proven_boundaries_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(str(public_tokenizers.path("word_bpe_49k.json")))


# --- toxicity


def plain_score(text, model):
    i = sorted({p for _, p in zip(*toxicity.terms_of([text]))})
    pairs = sum(model.v[a] @ model.v[b] for n, a in enumerate(i) for b in i[:n])
    z = model.w0 + model.w[i].sum() + pairs / max((model.support[i] ** 2).sum(), 1e-9)
    return 1 / (1 + np.exp(-z))


def pair_texts(rule, n=4000):
    rng = random.Random(1)
    fill = [f"w{i}" for i in range(50)]
    texts, labels = [], []
    for _ in range(n):
        words = rng.sample(fill, 8)
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(words + ["rude"] * insult + ["folk"] * group))
        labels.append(float(rule(insult, group)))
    return texts, np.array(labels)


@pytest.mark.parametrize("rule", [lambda a, b: a and b, lambda a, b: a != b])
def test_pairs_of_words_are_learned(rule):
    """Also where neither word tells anything by itself."""
    texts, y = pair_texts(rule)
    text, place = toxicity.terms_of(texts[:3000])
    model = toxicity.fit(y[:3000], np.searchsorted(text, np.arange(3001)), place)
    scores = toxicity.scores_of(texts[3000:], model)
    assert ((scores >= 0.5) == (y[3000:] == 1)).mean() > 0.9
    some = ["w1 rude folk", "w1 rude", "w1 folk", "", None]
    assert toxicity.scores_of(some, model) == pytest.approx([plain_score(t, model) for t in some], abs=1e-5)
    without = model._replace(v=np.zeros_like(model.v))
    if y[:10].sum() > 4:
        assert ((toxicity.scores_of(texts[3000:], without) >= 0.5) == (y[3000:] == 1)).mean() < 0.8


def test_the_sample_has_a_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a{i} b{i}") for i in range(100)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda y, start, place: seen.append((len(y), len(place))))
    toxicity.train(docs, labels)
    toxicity.train(docs, labels, rows=30)
    toxicity.train(docs, labels, terms=41)
    assert seen[0][0] > 60 and seen[1] == (30, 60) and seen[2] == (20, 40)


def test_scores_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, folder).toPandas().merge(spark.read.parquet(f"{folder}/labels.parquet").toPandas(), on="doc_id")
    assert (got.held_out == got.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    test = got[got.held_out]
    rank = test.score.rank()
    toxic = test.toxic == 1
    auc = (rank[toxic].mean() - (toxic.sum() + 1) / 2) / (~toxic).sum()
    assert auc > 0.95 and test.predicted[~toxic].mean() < 0.01 and test.predicted[toxic].mean() > 0.85


def test_labels_that_cannot_be_used(spark):
    docs = spark.createDataFrame([(i, t, 0.0) for i, t in enumerate(["a rude one", "fine", None, ""])], "doc_id long, text string, score double")
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    for labels in (empty, spark.createDataFrame([(None, 1), (99, 1), (0, None)], "doc_id long, toxic int")):
        model = toxicity.train(docs, labels)
        assert {r["s"] for r in toxicity.toxicity(docs, model, score_col="s").collect()} == {0.0}
    assert toxicity.clean(docs, empty).columns == docs.columns
    assert toxicity.clean(docs.limit(0), empty).count() == 0


# --- secrets


def test_queries_of_expressions():
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))
    assert secrets.trigram_query("[0-9a-f]{32,}") is None
    assert secrets.trigrams_of(secrets.trigram_query("ab?c(de|fg)h")) == {b"abc", b"bcd", b"cde", b"deh", b"bcf", b"cfg", b"fgh", b"acd", b"acf"}
    assert secrets.trigram_query("(foo|.)bar") == b"bar" and secrets.trigram_query("(foo)*x") is None


def plain_spans(text):
    kinds = [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 8),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 16),
        ("hex", re.compile("[0-9a-f]+"), 0, 32),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, g, n) in enumerate(kinds) for m in p.finditer(text or "") if m.end(g) - m.start(g) >= n]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def test_spans_are_those_of_a_full_scan():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "ToKen", "api", "_", "key", '"', "'", " ", " : ", "=", "abcdefgh12", "x", "AKIA", "ABCDEFGHIJKLMNOP", "0123456789abcdef", "deadbeef" * 3, "é", "ſecret", "K", "\n", "ghp_", "a" * 40, "-----BEGIN RSA PRIVATE KEY-----", "sk_live_", "eyJhbGciOi.", "AIza"]
    scanner = secrets.Scanner(secrets.BASE + secrets.ADDED)
    for _ in range(1500):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 5))]
        for text, spans in zip(texts, scanner.spans(texts)):
            assert [s for s in spans if s[0] in ("assign", "access", "hex")] == plain_spans(text)
            added = [(r.kind, *m.span()) for r in secrets.ADDED for m in r.compiled().finditer(text or "")]
            assert sorted(s for s in spans if s[0] not in ("assign", "access", "hex")) == sorted(added)


def test_secrets_of_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in queries.op9_secrets(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for d, text in rows:
        spans = plain_spans(text)
        listed = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert got[d]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        assert [got[d][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x")], "doc_id long, text string, spans string")
    assert [r["spans"] for r in secrets.find_secrets(df).collect()] == [[], []] and secrets.find_secrets(df.limit(0)).count() == 0
