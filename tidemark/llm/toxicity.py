"""Toxicity scores by a factorization machine over hashed terms.

A text's terms are its words (A-Z lower-cased, ASCII punctuation counted as space) and,
as further terms of their own, the first 4 and the first 5 bytes of longer words, so that inflected
forms share evidence. Terms are hashed to 2^18 places, all of which the model knows; a place
counts once per text. The score is the logistic function of

    w0 + sum w_i + (sum_{i<j} <v_i, v_j>) / sum s_i^2

over the places that the text holds: the second sum learns pairs, which weights that only
add up miss. s_i, the support of a place, is n / (n + SUPPORT) for one that n texts of the
sample hold; dividing by it keeps the pairs of long texts in proportion to those of short ones.

Most terms are rare, and each would remember its own text. So a weight counts in
proportion to the place's evidence (z^2 / (z^2 + EVIDENCE), z the standardised surplus of
toxic texts), and factors in proportion to its support alone, as terms that only matter together
have no evidence by themselves. No place is left out. Weights are fitted alone in the first
ALONE epochs, then factors too.

The model is fitted on a bounded sample of the labelled rows: those with the smallest
hash of their id, TRAIN_ROWS and TRAIN_TERMS at most. The fitted model (a few numbers
for each of 2^18 places) goes to all tasks. Every whole text is scored.

Null and empty texts score like a text without terms; labels that are null, that
contradict each other (the higher one counts) or that have no document are harmless, and
without any usable label of both classes all scores are the rate of the label seen (0 if
none). Repeated rows get equal scores. The fit is deterministic.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unused
from .common import map_texts, stored
from .words import LOWER, split_words, xxh64_ranges

#: Labelled rows that the model is fitted on, and their terms in total, at most.
TRAIN_ROWS, TRAIN_TERMS = 20_000, 8_000_000
PLACES, FACTORS, SUPPORT, EVIDENCE = 1 << 18, 4, 50.0, 20.0
EPOCHS, ALONE, BATCH, RATE, DECAY = 16, 5, 128, 0.3, 1e-4
#: Share of a text's terms that a step of the fit sees, drawn anew each time: one telling term has to do without the others.
HELD = 0.8

_PUNCTUATION = re.sub(rb"[^!-/:-@\[-`{-~]", b"", bytes(range(128)))
_TABLE = bytes(32 if c in _PUNCTUATION else LOWER[c] for c in range(256))


class Model(NamedTuple):
    """Of each place: weight, factors and support."""

    w0: float
    w: np.ndarray
    v: np.ndarray
    support: np.ndarray


def terms_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, place) of every place that a text holds, once each, sorted."""
    words = split_words(texts, _TABLE)
    text = np.repeat(np.arange(len(texts)), np.diff(words.first))
    size = words.ends - words.starts
    found = []
    for seed, cut in ((1, None), (2, 4), (3, 5)):
        rows = slice(None) if cut is None else np.flatnonzero(size > cut)
        starts = words.starts[rows]
        ends = words.ends[rows] if cut is None else starts + cut
        found.append(text[rows] * PLACES + (xxh64_ranges(words.buffer, starts, ends, seed) % PLACES).astype(np.int64))
    return np.divmod(np.unique(np.concatenate(found)), PLACES)


class _Batch(NamedTuple):
    """Texts of a step: their terms as indices into `places`, sorted by text; by_place sorts them by place, whose terms start at cuts."""

    rows: np.ndarray
    own: np.ndarray
    places: np.ndarray
    index: np.ndarray
    by_place: np.ndarray
    cuts: np.ndarray
    unit: np.ndarray


def _batches(start: np.ndarray, place: np.ndarray, support: np.ndarray, order: np.ndarray) -> list[_Batch]:
    made = []
    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        size = start[rows + 1] - start[rows]
        take = np.repeat(start[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        own = np.repeat(np.arange(len(rows)), size).astype(np.uint8)
        places, index = np.unique(place[take], return_inverse=True)
        by_place = np.argsort(index, kind="stable")
        cuts = np.searchsorted(index[by_place], np.arange(len(places)))
        unit = 1 / np.sqrt(np.maximum(np.bincount(own, support[place[take]] ** 2, len(rows)), 1e-9))
        made.append(_Batch(rows, own, places, index.astype(np.int32), by_place.astype(np.int32), cuts, unit))
    return made


def fit(y: np.ndarray, start: np.ndarray, place: np.ndarray, factors: int = FACTORS) -> Model:
    """Text i has label y[i] and the places place[start[i]:start[i + 1]]."""
    rate = float(y.mean()) if len(y) else 0.0
    if not 0 < rate < 1:
        return Model(30.0 if rate else -30.0, np.zeros(PLACES), np.zeros((PLACES, factors)), np.zeros(PLACES))
    n, surplus = np.zeros(PLACES), np.zeros(PLACES)
    for at in range(0, len(y), 1024):  # by blocks, as weights and places become longer numbers here
        cuts = start[at : at + 1025]
        own = place[cuts[0] : cuts[-1]]
        seen = np.bincount(own, minlength=PLACES)
        n += seen
        surplus += np.bincount(own, np.repeat(y[at : at + 1024], np.diff(cuts)), PLACES) - seen * rate
    z2 = surplus**2 / (n * rate * (1 - rate) * (1 - n / len(y)) + 2)
    evidence, support = z2 / (z2 + EVIDENCE), n / (n + SUPPORT)
    rng = np.random.default_rng(7)
    w0, w, v = float(np.log(rate / (1 - rate))), np.zeros(PLACES), rng.normal(0, 0.05, (PLACES, factors))
    g0, gw, gv = 1e-8, np.full(PLACES, 1e-8), np.full((PLACES, factors), 1e-8)
    batches = _batches(start, place, support, rng.permutation(len(y)))
    pull = DECAY / len(batches)
    for epoch in range(EPOCHS):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            own, texts, held = b.own, len(b.rows), rng.random(len(b.index)) < HELD
            weight = evidence[b.places][b.index] * held
            z = w0 + np.bincount(own, w[b.places][b.index] * weight, texts)
            if epoch >= ALONE:
                scale = support[b.places][b.index] * held * b.unit[own]
                x = v[b.places][b.index] * scale[:, None]
                sums = np.stack([np.bincount(own, x[:, f], texts) for f in range(factors)], axis=1)
                z += 0.5 * ((sums**2).sum(1) - np.bincount(own, (x**2).sum(1), texts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[b.rows]) / texts
            e = error[own]
            dw = np.add.reduceat((e * weight)[b.by_place], b.cuts) if len(e) else np.zeros(0)
            dw += pull * w[b.places]
            g0 += error.sum() ** 2
            w0 -= RATE * error.sum() / np.sqrt(g0)
            gw[b.places] += dw**2
            w[b.places] -= RATE * dw / np.sqrt(gw[b.places])
            if epoch >= ALONE and len(e):
                dv = np.add.reduceat(((e * scale)[:, None] * (sums[own] - x))[b.by_place], b.cuts, axis=0) + pull * v[b.places]
                gv[b.places] += dv**2
                v[b.places] -= RATE * dv / np.sqrt(gv[b.places])
    return Model(w0, (w * evidence).astype(np.float32), (v * support[:, None]).astype(np.float32), support.astype(np.float32))


def scores_of(texts: list[str | None], model: Model) -> np.ndarray:
    text, place = terms_of(texts)
    n, total = len(texts), lambda x: np.bincount(text, x, len(texts))
    v = model.v[place]
    sums = np.stack([total(v[:, f]) for f in range(v.shape[1])], axis=1).reshape(n, -1)
    pairs = 0.5 * ((sums**2).sum(1) - total((v.astype(float) ** 2).sum(1))) / np.maximum(total(model.support[place] ** 2), 1e-9)
    z = model.w0 + total(model.w[place]) + pairs
    return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether a row's label must not be learned; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS, terms: int = TRAIN_TERMS) -> Model:
    """Fits the model on the labelled documents with the smallest hash of their id: `rows` at most, with `terms` places at most in total."""
    ids = F.col(f"`{id_col}`")
    usable = labels.filter(ids.isNotNull() & F.col(f"`{label_col}`").isNotNull() & ~held_out(ids))
    sample = usable.groupBy(ids.alias("__id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("__label"))
    sample = sample.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(rows)
    # at most TRAIN_ROWS pairs of numbers, so it can go to every task
    chosen = docs.select(ids.alias("__id"), F.col(f"`{text_col}`").alias("__text")).join(F.broadcast(sample), "__id")
    fields = T.StructType([T.StructField("places", T.ArrayType(T.IntegerType()))])

    def run(texts: list[str | None]) -> dict[str, pa.Array]:
        text, place = terms_of(texts)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
        return {"places": pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))}

    held = map_texts(chosen, ["__id", "__label"], "__text", fields, run)
    # of rows that repeat an id, the one with the smallest terms
    held = stored(held.groupBy("__id").agg(F.min(F.struct("__label", "places")).alias("t")).select("__id", F.md5(F.col("__id").cast("string")).alias("__hash"), "t.*"), "terms")
    upto = F.sum(F.size("places")).over(Window.orderBy("__hash", "__id"))  # at most TRAIN_ROWS rows
    first = held.select("__id", "__hash", upto.alias("upto")).filter(F.col("upto") <= terms)
    # at most `terms` numbers
    got = held.join(F.broadcast(first.select("__id")), "__id", "left_semi").orderBy("__hash", "__id").select("__label", "places").toArrow()
    y = got["__label"].to_numpy().astype(float)
    start = np.concatenate([[0], np.cumsum(pc.list_value_length(got["places"]).to_numpy())]).astype(np.int64)
    place = np.concatenate([np.zeros(0, np.int32), *[pc.list_flatten(c).to_numpy(zero_copy_only=False) for c in got["places"].chunks]])
    del got  # the places are held once
    return fit(y, start, place)


def toxicity(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, score_col: str = "score") -> DataFrame:
    """Columns keep of docs (all if None) and the score of the whole text."""
    fields = T.StructType([T.StructField(score_col, T.DoubleType())])
    return map_texts(docs, docs.columns if keep is None else keep, text_col, fields, lambda texts: {score_col: pa.array(scores_of(texts, model))})


#: The score from which a text counts as toxic.
THRESHOLD = 0.3


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose score is below threshold, with all their columns."""
    score = unused(docs.columns, "score")
    scored = toxicity(docs, train(docs, labels, id_col, text_col), text_col, score_col=score)
    return scored.filter(F.col(score) < threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
