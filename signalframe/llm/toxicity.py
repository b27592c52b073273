"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its own vector (words of the sample's vocabulary) beside the scaled sum of its letter n-grams' vectors,
so unseen forms of a known stem are read too. Windows of WINDOW words, every STRIDE words, run through one recurrent
network per direction; attention weighs the steps of both and a logistic unit scores the window. A document's score is
that of its highest window, whatever its length, and learning follows it: each pass scores all windows of all sampled
documents and learns from the highest of each (and one drawn window of those that are not toxic).

The first component of every vector begins at the log-odds of documents that hold it, from the sample; the rest at random.
The sample is bounded: about TOXIC toxic and CLEAN other labelled training documents, drawn by a hash of the text, and about
SAMPLE_BYTES of text in all. Everything else covers every document.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed, pieces

FOLDS, HELD = 4, 2
TOXIC, CLEAN, SAMPLE_BYTES = 1024, 2048, 24 << 20
VOCAB, LEAST_DOCS = 1 << 14, 4  # words with a vector of their own
GRAMS, SIZES = 1 << 16, (3, 4, 5)  # buckets of letter n-grams, and their lengths
WORD_DIM, GRAM_DIM, HIDDEN, ATTEND = 6, 6, 12, 8
WINDOW, STRIDE, LANES, BATCH = 48, 24, 512, 128
PASSES, RATE = 6, 0.02
KNOWN = 1 << 17  # words whose input a task remembers
THRESHOLD = 0.3
SHRINK = 8.0  # documents' worth of no evidence in the first log-odds
Params = dict[str, np.ndarray]
_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    """Runs of letters and digits, lower-cased."""
    return _WORD.findall(text.lower())


def gram_buckets(found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, owners) of the letter n-grams of each word, edges marked."""
    points = [np.frombuffer(f"<{w}>".encode("utf-32-le", "surrogatepass"), "<u4") for w in found]
    sizes = np.fromiter(map(len, points), np.int64, len(points))
    flat, owner = np.concatenate(points) if points else np.zeros(0, np.uint32), np.repeat(np.arange(len(points)), sizes)
    buckets, owners = [], []
    mixed = flat.copy()
    for n in range(2, max(SIZES) + 1):
        if len(flat) < n:
            break
        mixed = mixed[:-1] * np.uint32(0x9E3779B1) ^ flat[n - 1 :] * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        if n in SIZES:
            whole = owner[: len(mixed)] == owner[n - 1 :]
            buckets.append((mixed[whole] * np.uint32(0xC2B2AE35) >> np.uint32(16)) % GRAMS)
            owners.append(owner[: len(mixed)][whole])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


class Model(NamedTuple):
    vocabulary: dict[str, int]
    params: Params


def word_inputs(model: Model, found: list[str]) -> tuple[np.ndarray, tuple]:
    """Input vectors (words, WORD_DIM + GRAM_DIM), and what their gradient needs."""
    p = model.params
    own = np.fromiter((model.vocabulary.get(w, VOCAB) for w in found), np.int64, len(found))
    buckets, owner = gram_buckets(found)
    scale = (1 / np.sqrt(np.maximum(1, np.bincount(owner, minlength=len(found))))).astype(np.float32)
    grams = np.stack([np.bincount(owner, p["grams"][buckets, k], len(found)) for k in range(GRAM_DIM)], axis=1).astype(np.float32)
    return np.concatenate([p["words"][own], grams * scale[:, None]], axis=1), (own, buckets, owner, scale)


def windows(n: int) -> np.ndarray:
    """Starts of the overlapping windows of n words; one, empty, of a text without words."""
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def laid_out(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(WINDOW, windows) of word numbers, -1 beyond the end."""
    at = np.arange(WINDOW)[:, None] + starts
    return np.where(at < len(ids), ids[np.minimum(at, max(0, len(ids) - 1))] if len(ids) else -1, -1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_direction(p: Params, name: str, x: np.ndarray, live: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Input terms (steps, 3 HIDDEN, lanes) -> states (steps, HIDDEN, lanes); a step that is not live keeps the state."""
    state, bias = np.ascontiguousarray(p[f"{name}_state"].T), p[f"{name}_bias"][:, None]
    out, h, whole = np.empty((len(x), HIDDEN, x.shape[2]), x.dtype), np.zeros((HIDDEN, x.shape[2]), x.dtype), live.all(axis=1).tolist()
    for t in range(len(x)):
        u = state @ h
        zr, inner = u[: 2 * HIDDEN], u[2 * HIDDEN :]
        zr += x[t, : 2 * HIDDEN]
        np.tanh(np.multiply(zr, 0.5, out=zr), out=zr)  # the logistic function, which can't overflow so
        zr += 1
        zr *= 0.5
        inner += bias
        n = zr[HIDDEN:] * inner
        n += x[t, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if keep is not None:
            keep.append((h, zr, inner, n))
        now = np.subtract(h, n, out=out[t])
        now *= zr[:HIDDEN]
        now += n
        if not whole[t]:
            np.copyto(now, h, where=~live[t])
        h = now
    return out


def back_direction(p: Params, grads: Params, name: str, keep: list, live: np.ndarray, d_out: np.ndarray) -> np.ndarray:
    """The gradient of the input terms."""
    state = p[f"{name}_state"]
    dx, dh = np.zeros((len(d_out), 3 * HIDDEN, d_out.shape[2]), d_out.dtype), np.zeros(d_out.shape[1:], d_out.dtype)
    for t in range(len(d_out) - 1, -1, -1):
        h, zr, inner, n = keep[t]
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        dh = dh + d_out[t]
        now = np.where(live[t], dh, 0)
        dn = now * (1 - z) * (1 - n * n)
        dr = dn * inner * r * (1 - r)
        dz = now * (h - n) * z * (1 - z)
        dx[t] = np.concatenate([dz, dr, dn])
        du = np.concatenate([dz, dr, dn * r])
        grads[f"{name}_state"] += h @ du.T
        grads[f"{name}_bias"] += (dn * r).sum(axis=1)
        dh = np.where(live[t], now * z + state @ du, dh)
    return dx


def input_terms(p: Params, vectors: np.ndarray) -> np.ndarray:
    """What each word adds to the gates, forward then backward (words, 6 HIDDEN), and a last row for no word."""
    out = np.concatenate([vectors @ p["ahead_in"] + p["ahead_gates"], vectors @ p["back_in"] + p["back_gates"]], axis=1)
    return np.concatenate([out, np.zeros((1, 6 * HIDDEN), out.dtype)])


def logits(p: Params, terms: np.ndarray, at: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """The logit of each window of ``at`` (steps, windows), word numbers into ``terms``, -1 for none."""
    live, kept = at >= 0, ([], [])
    x = np.ascontiguousarray(terms[at].transpose(0, 2, 1))
    ahead = run_direction(p, "ahead", x[:, : 3 * HIDDEN], live, kept[0] if keep is not None else None)
    back = run_direction(p, "back", x[::-1, 3 * HIDDEN :], live[::-1], kept[1] if keep is not None else None)[::-1]
    both = np.concatenate([ahead, back], axis=1)
    look = p["look"] @ both
    look += p["look_bias"][:, None]
    np.tanh(look, out=look)
    weight = np.where(live, p["attend"] @ look, -np.inf)
    weight = np.exp(weight - np.maximum(weight.max(axis=0), -1e30))
    weight = weight / np.maximum(weight.sum(axis=0), 1e-30)
    pooled = (weight[:, None, :] * both).sum(axis=0)
    if keep is not None:
        keep.update(live=live, kept=kept, both=both, look=look, weight=weight, pooled=pooled)
    return p["out"] @ pooled + p["out_bias"][0]


def backward(p: Params, grads: Params, at: np.ndarray, keep: dict, d: np.ndarray, n_words: int) -> np.ndarray:
    """From the gradient of the logits to that of the input terms (n_words, 6 HIDDEN); others are added to ``grads``."""
    live, both, look, weight, pooled = (keep[k] for k in ("live", "both", "look", "weight", "pooled"))
    grads["out"] += pooled @ d
    grads["out_bias"] += d.sum()
    d_pooled = p["out"][:, None] * d
    d_both = weight[:, None, :] * d_pooled
    d_weight = (both * d_pooled).sum(axis=1)
    d_logit = weight * (d_weight - (weight * d_weight).sum(axis=0))
    grads["attend"] += (look * d_logit[:, None, :]).sum(axis=(0, 2))
    d_look = p["attend"][:, None] * d_logit[:, None, :] * (1 - look * look)
    grads["look"] += (d_look @ both.transpose(0, 2, 1)).sum(axis=0)
    grads["look_bias"] += d_look.sum(axis=(0, 2))
    d_both += p["look"].T @ d_look
    ahead = back_direction(p, grads, "ahead", keep["kept"][0], live, d_both[:, :HIDDEN])
    back = back_direction(p, grads, "back", keep["kept"][1], live[::-1], d_both[::-1, HIDDEN:])[::-1]
    dx, out = np.concatenate([ahead, back], axis=1), np.empty((n_words, 6 * HIDDEN), d_both.dtype)
    seen = at[live]
    for k in range(6 * HIDDEN):
        out[:, k] = np.bincount(seen, dx[:, k][live], n_words)
    return out


def back_inputs(model: Model, grads: Params, vectors: np.ndarray, source: tuple, d_terms: np.ndarray) -> None:
    p, (own, buckets, owner, scale) = model.params, source
    d_vectors = 0
    for name, d in (("ahead", d_terms[:, : 3 * HIDDEN]), ("back", d_terms[:, 3 * HIDDEN :])):
        grads[f"{name}_in"] += vectors.T @ d
        grads[f"{name}_gates"] += d.sum(axis=0)
        d_vectors = d_vectors + d @ p[f"{name}_in"].T
    for k in range(WORD_DIM):
        grads["words"][:, k] += np.bincount(own, d_vectors[:, k], VOCAB + 1)
    each = d_vectors[:, WORD_DIM:] * scale[:, None]
    for k in range(GRAM_DIM):
        grads["grams"][:, k] += np.bincount(buckets, each[owner, k], GRAMS)
    grads["words"][VOCAB] = 0  # words without a vector of their own stay at zero


def odds(holding: np.ndarray, toxic: np.ndarray, n: tuple[int, int]) -> np.ndarray:
    """Log-odds of toxic documents per feature, from documents that hold it, drawn to zero by SHRINK documents."""
    clean, seen = holding - toxic, holding
    return (np.log((toxic + 0.5) / (n[1] + 1)) - np.log((clean + 0.5) / (n[0] + 1))) * seen / (seen + SHRINK)


def first_model(texts: list[list[str]], labels: np.ndarray) -> Model:
    """The vocabulary, and parameters before training; the first components from the sample's counts of documents."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())
    for found, y in zip(texts, labels):
        counts[int(y)].update(set(found))
    both, n = counts[0] + counts[1], (int((labels == 0).sum()), int(labels.sum()))
    chosen = sorted((w for w, c in both.items() if c >= LEAST_DOCS), key=lambda w: (-both[w], w))[:VOCAB]
    vocabulary = {w: i for i, w in enumerate(chosen)}
    rng = np.random.default_rng(12)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    p = {"words": small(VOCAB + 1, WORD_DIM), "grams": small(GRAMS, GRAM_DIM)}
    p["words"][VOCAB] = 0
    p["words"][: len(chosen), 0] = odds(np.array([both[w] for w in chosen], float), np.array([counts[1][w] for w in chosen], float), n)
    number = {w: i for i, w in enumerate(both)}
    buckets, owner = gram_buckets(list(number))
    ends = np.searchsorted(owner[np.argsort(owner, kind="stable")], np.arange(len(number) + 1))
    buckets = buckets[np.argsort(owner, kind="stable")]
    holding, toxic = np.zeros(GRAMS), np.zeros(GRAMS)
    for found, y in zip(texts, labels):
        mine = {number[w] for w in found}
        held = np.unique(np.concatenate([buckets[ends[k] : ends[k + 1]] for k in mine])) if mine else np.zeros(0, np.int64)
        holding[held] += 1
        toxic[held] += y
    p["grams"][:, 0] = odds(holding, toxic, n)
    width = WORD_DIM + GRAM_DIM
    for name in ("ahead", "back"):
        p |= {f"{name}_in": small(width, 3 * HIDDEN) * 3, f"{name}_gates": np.zeros(3 * HIDDEN, np.float32), f"{name}_state": small(HIDDEN, 3 * HIDDEN) * 2, f"{name}_bias": np.zeros(HIDDEN, np.float32)}
    p |= {"look": small(ATTEND, 2 * HIDDEN) * 3, "look_bias": np.zeros(ATTEND, np.float32), "attend": small(ATTEND) * 3, "out": small(2 * HIDDEN) * 3, "out_bias": np.full(1, -1, np.float32)}
    return Model(vocabulary, p)


def step(p: Params, grads: Params, moments: Params, rate: float) -> None:
    """RMS steps; a row of a table that no word touched stays as it is."""
    for k, g in grads.items():
        v = moments[k]
        rows = np.flatnonzero(g.any(axis=1)) if k in ("words", "grams") else slice(None)
        v[rows] = 0.9 * v[rows] + 0.1 * g[rows] ** 2
        p[k][rows] -= (rate * g[rows] / (np.sqrt(v[rows]) + 1e-4)).astype(np.float32)


def highest(p: Params, terms: np.ndarray, ids: list[np.ndarray], starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(logit, start) of the highest window of each text, the first of equals. LANES windows at a time, whosever they are."""
    owner = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
    flat = np.concatenate([np.append(i, -1) for i in ids])
    base = np.cumsum([0, *[len(i) + 1 for i in ids[:-1]]])
    first, last = np.concatenate(starts) + base[owner], (base + [len(i) for i in ids])[owner]
    got = np.empty(len(first))
    for k in range(0, len(first), LANES):
        at = np.arange(WINDOW)[:, None] + first[k : k + LANES]
        got[k : k + LANES] = logits(p, terms, np.where(at < last[k : k + LANES], flat[np.minimum(at, len(flat) - 1)], -1))
    order = np.lexsort((first, -got, owner))
    top = order[np.searchsorted(owner[order], np.arange(len(ids)))]
    return got[top], first[top] - base


def train(texts: list[str], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """``weights`` of clean and toxic documents undo the sample's own proportions."""
    found = [words(t) for t in texts]
    model = first_model(found, labels)
    if not texts:
        return model
    p, number = model.params, {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)) for ws in found]
    del found
    every, starts = list(number), [windows(len(i)) for i in ids]
    rng, moments = np.random.default_rng(13), {k: np.zeros_like(v) for k, v in p.items()}
    vectors, _ = word_inputs(model, every)
    evidence = np.append(np.maximum(vectors[:, 0] + vectors[:, WORD_DIM], 0), 0)
    best = [s[np.argmax(evidence[laid_out(i, s)].max(axis=0))] for i, s in zip(ids, starts)]
    for passed in range(PASSES):
        if passed:
            best = highest(p, input_terms(p, word_inputs(model, every)[0]), ids, starts)[1]
        rows = [*enumerate(best), *[(i, rng.choice(starts[i])) for i in np.flatnonzero(labels == 0).tolist() if len(starts[i]) > 1]]
        order = rng.permutation(len(rows)).tolist()
        for k in range(0, len(rows), BATCH):
            mine = [rows[j] for j in order[k : k + BATCH]]
            learn(model, moments, ids, every, mine, labels, weights, RATE * (1 - 0.8 * passed / PASSES))
    return model


def learn(model: Model, moments: Params, ids: list[np.ndarray], every: list[str], rows: list[tuple], labels: np.ndarray, weights: tuple[float, float], rate: float) -> None:
    """One update from windows (text, start)."""
    at = np.concatenate([laid_out(ids[i], np.array([s])) for i, s in rows], axis=1)
    y = labels[[i for i, _ in rows]]
    here = np.unique(at[at >= 0])
    local = np.where(at >= 0, np.searchsorted(here, at), -1)
    w = np.where(y == 1, weights[1], weights[0])
    grads, _ = gradients(model, [every[j] for j in here.tolist()], local, y, w)
    step(model.params, grads, moments, rate)


def gradients(model: Model, here: list[str], at: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[Params, float]:
    """Of the weighted mean log loss of windows ``at``, and that loss."""
    vectors, source = word_inputs(model, here)
    keep: dict = {}
    got = logits(model.params, input_terms(model.params, vectors), at, keep)
    d = ((sigmoid(got) - y) * w / w.sum()).astype(vectors.dtype)
    grads = {k: np.zeros_like(v) for k, v in model.params.items()}
    back_inputs(model, grads, vectors, source, backward(model.params, grads, at, keep, d, len(here)))
    return grads, float((np.logaddexp(0, np.where(y == 1, -got, got)) * w).sum() / w.sum())


class Reader:
    """Scores texts; remembers the input terms of words it has met."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.terms = np.zeros((1, 6 * HIDDEN), np.float32)

    def numbers(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.known) > KNOWN:
            self.__init__(self.model)
        known, before, out = self.known, len(self.known), []
        for found in texts:
            out.append(np.fromiter([known.setdefault(w, len(known)) for w in found], np.int32, len(found)))
        if len(known) > before:
            more = input_terms(self.model.params, word_inputs(self.model, list(known)[before:])[0])
            self.terms = np.concatenate([self.terms[:before], more])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Each text's highest window, as a probability."""
        ids = self.numbers([words(t) for t in texts])
        return sigmoid(highest(self.model.params, self.terms, ids, [windows(len(i)) for i in ids])[0]) if ids else np.zeros(0)


def sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """(text, toxic) of about TOXIC toxic and CLEAN other training texts, SAMPLE_BYTES in all, and the weights of both.

    Drawn by a hash of the text, so copies of one text come together, and count once.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.select("doc_id", F.when(F.col("toxic") == 1, 1).otherwise(0).alias("toxic"))
    texts = narrowed(docs).where(rest != HELD).select("doc_id", "text", F.xxhash64("text").alias("hash"))
    sizes = texts.select("doc_id", "hash", F.octet_length("text").alias("bytes")).join(known, "doc_id").groupBy("hash", "toxic").agg(F.max("bytes").alias("bytes"), F.count("*").alias("rows"))
    totals = {r["toxic"]: r for r in sizes.groupBy("toxic").agg(F.count("*").alias("texts"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")).collect()}
    share = {k: min(1.0, most / totals[k]["texts"], SAMPLE_BYTES / 2 / max(1, totals[k]["bytes"])) if k in totals else 0.0 for k, most in ((0, CLEAN), (1, TOXIC))}
    cut = [int(share[k] * (1 << 20)) for k in (0, 1)]
    draw = F.pmod("hash", F.lit(1 << 20))
    drawn = texts.where(draw < max(cut)).join(known, "doc_id").where(draw < F.when(F.col("toxic") == 1, cut[1]).otherwise(cut[0]))
    each = [totals[k]["rows"] / max(1.0, share[k] * totals[k]["texts"]) if k in totals else 1.0 for k in (0, 1)]
    return drawn.select("text", "toxic").distinct(), (each[0] / max(each), each[1] / max(each))


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of a bounded sample, trained in one task."""
    rows, weights = sample(docs, labels)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
        model = train([t for t, _ in got], np.array([y for _, y in got], np.int64), weights)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    trained = rows.repartition(1).mapInArrow(fit, "model binary").collect()  # one model, of a fixed size
    return pickle.loads(trained[0]["model"]) if trained else train([], np.zeros(0, np.int64))


OUT = "doc_id long, held_out boolean, score double, predicted int"


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score of at least THRESHOLD) of every document, from its text alone.

    Learns from labels of documents whose crc32(doc_id) mod 4 is not 2; a null doc_id has no label and is not held out.
    Null and empty texts are one empty window. Documents with several labels count once for each; without any label every
    score is that of the untrained network's bias. Texts are read whole at any length; repeated rows each come back;
    other columns are ignored; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in pieces(batches, 2 << 20):
            ids = batch.column(0).to_pylist()
            score = reader.scores(batch.column(1).to_pylist())
            held = [d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD for d in ids]
            columns = [batch.column(0), pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return narrowed(docs).select("doc_id", "text").mapInArrow(run, OUT)
