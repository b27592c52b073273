"""A gated recurrent language model in numpy, trained and applied inside Spark tasks.

Symbols: the VOCAB commonest training words, one symbol per spelling class for all other words, and the end of a text.
The output is class-factored: a softmax over word classes, spelling classes and the end, then a softmax within a word
class, or for a spelling class the add-one distribution of the training counts of its words (plus one for all unseen
words). So every text has a proper probability, and the counts behind it cover the whole training corpus.

Texts are turned into symbols once, in a written table that training and scoring both read. Training goes over every
word of every training text once, by truncated backpropagation over windows of WINDOW steps with the state carried from
window to window. Texts (cut every SEGMENT words, so that no text is one task) are dealt by hash to replicas, whose
number follows the corpus alone; a replica packs its texts into LANES side by side. The WARM-th part of the texts makes
a first round, the rest the second; after each the replicas are averaged by weight, in levels of FAN. So the model does
not depend on how the input is partitioned. Scoring packs whole documents into lanes too and carries the state across
all windows of a document.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, groupby, repeat
from types import SimpleNamespace
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import Memory, narrowed, pieces
from signalframe.scratch import written

FOLDS, HELD = 7, 2
VOCAB, PER_CLASS = 4096, 64
SPELLINGS = 32
WORD_CLASSES = VOCAB // PER_CLASS
END = VOCAB + SPELLINGS
CLASSES = WORD_CLASSES + SPELLINGS + 1
HIDDEN, WINDOW, LANES, RATE = 16, 32, 256, 0.02
SCORE_LANES = 512
STEPS = 1024  # of a lane that are laid out at once
BLOCK = 1024  # states that go through a softmax at once
LARGEST = 4.0  # bound of every output weight, so that no logit leaves what exp can hold
REPLICA_WORDS, SEGMENT = 1 << 22, 1 << 12
WARM, FAN = 4, 16
KEPT = 1 << 18  # words whose counts every task holds; rarer ones are joined
LN10 = float(np.log(10))
Params = dict[str, np.ndarray]


def tokens(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def spelling(word: bytes) -> int:
    """A word's spelling class, from its first two characters."""
    return zlib.crc32(word.decode("utf-8", "surrogatepass")[:2].encode("utf-8", "surrogatepass")) % SPELLINGS


def is_training():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD, F.lit(True))


class Known(NamedTuple):
    """What the counts give: KEPT words with counts, and per spelling class tokens and words beyond the vocabulary."""

    words: list[bytes]
    counts: np.ndarray
    total: int
    distinct: int
    texts: int
    class_tokens: np.ndarray
    class_words: np.ndarray


def gather(docs: DataFrame) -> DataFrame:
    """From training documents: kind 0 word counts (partial sums), 2 numbers of texts. Written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, words: list[str], n: list[int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(n), pa.int32()), pa.array(words, pa.string()), pa.array(n, pa.int64())], ["kind", "word", "n"])

        counted: Counter = Counter()
        for batch in pieces(batches, 8 << 20):
            if batch.num_rows:
                yield rows(2, [""], [batch.num_rows])
            for text in batch.column(0).to_pylist():
                counted.update(tokens(text))
            if len(counted) > 200_000:
                yield rows(0, [w.decode("utf-8", "surrogatepass") for w in counted], list(counted.values()))
                counted = Counter()
        if counted:
            yield rows(0, [w.decode("utf-8", "surrogatepass") for w in counted], list(counted.values()))

    return written(narrowed(docs).where(is_training()).select("text").mapInArrow(run, "kind int, word string, n long"), "lm-gathered")


def word_counts(gathered: DataFrame) -> DataFrame:
    spelled = (F.crc32(F.substring("word", 1, 2)) % SPELLINGS).cast("int")
    return written(gathered.where("kind = 0").groupBy("word").agg(F.sum("n").alias("n")).withColumn("spelling", spelled), "lm-counts")


def common_words(counts: DataFrame, most: int) -> DataFrame:
    """The commonest words, at most ``most``: all whose count reaches the lowest step that keeps them so few.

    Steps are 1/64 octaves of the count, so the histogram stays small whatever the corpus, and no task ranks all words.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")
    sizes = {r["step"]: r["v"] for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("v")).collect()}
    kept, least = 0, None
    for at in sorted(sizes, reverse=True):
        kept += sizes[at]
        if kept > most:
            break
        least = at
    return counts.where(step >= least if least is not None else F.lit(False)).select("word", "n")


def known_of(gathered: DataFrame, counts: DataFrame) -> Known:
    top = sorted(common_words(counts, KEPT).collect(), key=lambda r: (-r["n"], r["word"]))
    words, n = [r["word"].encode("utf-8", "surrogatepass") for r in top], np.array([r["n"] for r in top], np.int64)
    texts = gathered.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    class_tokens, class_words = np.zeros(SPELLINGS, np.int64), np.zeros(SPELLINGS, np.int64)
    for r in counts.groupBy("spelling").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        class_tokens[r["spelling"]], class_words[r["spelling"]] = r["n"], r["v"]
    total, distinct = int(class_tokens.sum()) + texts, int(class_words.sum()) + (texts > 0)
    for w, c in zip(words[:VOCAB], n[:VOCAB]):
        class_tokens[spelling(w)] -= c
        class_words[spelling(w)] -= 1
    return Known(words, n, total, distinct, texts, class_tokens, class_words)


def first_params(known: Known) -> Params:
    """Weights near zero; biases at the unigram model."""
    rng = np.random.default_rng(5)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    c = np.full(VOCAB, 1e-3)
    c[: min(VOCAB, len(known.counts))] += known.counts[:VOCAB]
    inner = c.reshape(WORD_CLASSES, PER_CLASS)
    outer = np.concatenate([inner.sum(axis=1), known.class_tokens + 0.5, [known.texts + 0.5]])
    return {
        "gates": small(END + 1, 3 * HIDDEN), "state": small(HIDDEN, 3 * HIDDEN), "bias": np.zeros(HIDDEN, np.float32),
        "outer": small(HIDDEN, CLASSES), "outer_bias": np.log(outer / outer.sum()).astype(np.float32),
        "inner": small(WORD_CLASSES, HIDDEN, PER_CLASS), "inner_bias": np.log(inner / inner.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def packed(sequences: Iterable[np.ndarray], lanes: int) -> Iterator[tuple]:
    """Sequences one after another in lanes: blocks of (inputs, targets, owners, lanes kept of the block before).

    Arrays are (steps, lanes), steps at most STEPS; targets are -1 where a lane has nothing left, owners number the
    sequences. The input before a sequence's first symbol is END. A lane takes the next sequence when its own ends; lanes
    left without any are dropped.
    """
    source, dry = enumerate(sequences), False
    rest: list = [None] * lanes
    last = np.full(lanes, END, np.int32)
    while True:
        y, owner = np.full((len(rest), STEPS), -1, np.int32), np.zeros((len(rest), STEPS), np.int32)
        for lane, held in enumerate(rest):
            at = 0
            while at < STEPS:
                if held is None:
                    held = None if dry else next(source, None)
                    if held is None:
                        dry = True
                        break
                number, symbols = held
                now = symbols[: STEPS - at]
                y[lane, at : at + len(now)], owner[lane, at : at + len(now)] = now, number
                at += len(now)
                held = (number, symbols[len(now) :]) if len(now) < len(symbols) else None
            rest[lane] = held
        keep = y[:, 0] >= 0
        if not keep.any():
            return
        y, owner, last, rest = y[keep], owner[keep], last[keep], [r for r, k in zip(rest, keep) if k]
        steps = int((y >= 0).sum(axis=1).max())
        x = np.concatenate([last[:, None], y[:, :-1]], axis=1)
        x[x < 0] = END
        last = np.where(y[:, -1] < 0, END, y[:, -1])
        yield (*(np.ascontiguousarray(a.T[:steps]) for a in (x, y, owner)), keep)


def by_row(a: np.ndarray) -> np.ndarray:
    """(steps, features, lanes) -> (steps x lanes, features)."""
    return np.ascontiguousarray(a.transpose(0, 2, 1)).reshape(-1, a.shape[1])


def run_window(p: Params, x: np.ndarray, h: np.ndarray, kept: SimpleNamespace | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (steps, lanes) and the state before (HIDDEN, lanes) -> states (steps, HIDDEN, lanes) and the last.

    An END input resets the state. ``kept`` gets what backpropagation needs.
    """
    gates = np.ascontiguousarray(p["gates"].take(x, axis=0).transpose(0, 2, 1))
    fresh, state, bias = x == END, np.ascontiguousarray(p["state"].T), p["bias"][:, None]
    state[: 2 * HIDDEN] *= -1
    resets, out = fresh.any(axis=1).tolist(), np.empty((len(x), HIDDEN, x.shape[1]), gates.dtype)
    if kept is not None:
        kept.h, kept.inner, kept.n, kept.zr = np.empty_like(out), np.empty_like(out), np.empty_like(out), gates
    for t in range(len(x)):
        if resets[t]:
            h = h * ~fresh[t]
        u, zr = state @ h, gates[t, : 2 * HIDDEN]
        np.subtract(u[: 2 * HIDDEN], zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        inner = u[2 * HIDDEN :]
        inner += bias
        n = zr[HIDDEN:] * inner
        n += gates[t, 2 * HIDDEN :]
        np.tanh(n, out=n)
        if kept is not None:
            kept.h[t], kept.inner[t], kept.n[t] = h, inner, n
        now = np.subtract(h, n, out=out[t])
        now *= zr[:HIDDEN]
        now += n
        h = now
    return out, h


def class_of(y: np.ndarray) -> np.ndarray:
    return np.where(y < VOCAB, y // PER_CLASS, y - VOCAB + WORD_CLASSES).astype(np.int16)


def log_probs(p: Params, h: np.ndarray, y: np.ndarray, grads: Params | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """ln P(target) of states (n, HIDDEN) and targets; with ``grads``, adds the loss's gradients and returns the states'.

    Rows go by class, so each word class is one small matrix product. A column of ones carries the biases.
    """
    n = len(y)
    cls = class_of(y)
    order = np.argsort(cls, kind="stable")
    cls, word = cls[order], y[order] % PER_CLASS
    h = np.concatenate([h[order], np.ones((n, 1), h.dtype)], axis=1)
    got, whole, at = np.empty(n, h.dtype), np.ones(n, h.dtype), np.arange(BLOCK)
    outer, ones = np.concatenate([p["outer"], p["outer_bias"][None]]), np.ones(max(CLASSES, PER_CLASS), h.dtype)
    back, d_outer = (np.empty_like(h), np.zeros_like(outer)) if grads is not None else (None, None)
    for i in range(0, n, BLOCK):
        rows = h[i : i + BLOCK]
        o = rows @ outer
        got[i : i + BLOCK] = o[at[: len(o)], cls[i : i + BLOCK]]
        np.exp(o, out=o)
        total = o @ ones[:CLASSES]
        whole[i : i + BLOCK] = total
        if grads is not None:
            share = (1 / total)[:, None]
            d_outer += (rows * share).T @ o
            back[i : i + BLOCK] = (o @ outer.T) * share
    ends = np.searchsorted(cls, np.arange(CLASSES + 1)).tolist()
    if grads is not None:
        back -= outer.T[cls]
        filled = np.flatnonzero(np.diff(ends))
        d_outer[:, filled] -= np.add.reduceat(h, np.array(ends)[filled], axis=0).T
        grads["outer"] += d_outer[:-1]
        grads["outer_bias"] += d_outer[-1]
    inners = np.concatenate([p["inner"], p["inner_bias"][:, None]], axis=1)
    d_inners = np.zeros_like(inners) if grads is not None else None
    for c in range(WORD_CLASSES):
        if ends[c] == ends[c + 1]:
            continue
        inner = inners[c]
        for i in range(ends[c], ends[c + 1], BLOCK):
            j = min(ends[c + 1], i + BLOCK)
            q, row = h[i:j] @ inner, at[: j - i]
            got[i:j] += q[row, word[i:j]]
            np.exp(q, out=q)
            total = q @ ones[:PER_CLASS]
            whole[i:j] *= total
            if grads is not None:
                q[row, word[i:j]] -= total
                share = (1 / total)[:, None]
                d_inners[c] += (h[i:j] * share).T @ q
                back[i:j] += (q @ inner.T) * share
    if grads is not None:
        grads["inner"] += d_inners[:, :-1]
        grads["inner_bias"] += d_inners[:, -1]
    out = np.empty(n)
    out[order] = got - np.log(whole)
    if back is None:
        return out, None
    states = np.empty((n, HIDDEN), h.dtype)
    states[order] = back[:, :-1]
    return out, states


def backward(p: Params, grads: Params, x: np.ndarray, kept: SimpleNamespace, dh_out: np.ndarray) -> None:
    """Backpropagation through one window; the gradient stops at the window's start."""
    steps, lanes = x.shape
    live, state = x != END, np.ascontiguousarray(p["state"])
    resets = (~live).any(axis=1).tolist()
    dgates, du = np.empty((steps, 3 * HIDDEN, lanes), dh_out.dtype), np.empty((3 * HIDDEN, lanes), dh_out.dtype)
    dh, d_state, d_bias = np.zeros((HIDDEN, lanes), dh_out.dtype), np.zeros((3 * HIDDEN, HIDDEN), dh_out.dtype), np.zeros(HIDDEN, dh_out.dtype)
    for t in range(steps - 1, -1, -1):
        h, inner, n = kept.h[t], kept.inner[t], kept.n[t]
        z, r = kept.zr[t, :HIDDEN], kept.zr[t, HIDDEN : 2 * HIDDEN]
        dz, dr, dn = dgates[t, :HIDDEN], dgates[t, HIDDEN : 2 * HIDDEN], dgates[t, 2 * HIDDEN :]
        dh += dh_out[t]
        other = 1 - z
        np.multiply(n, n, out=dn)
        np.subtract(1, dn, out=dn)
        dn *= dh
        dn *= other
        np.subtract(h, n, out=dz)
        for factor in (dh, z, other):
            dz *= factor
        np.subtract(1, r, out=dr)
        for factor in (r, inner, dn):
            dr *= factor
        du[: 2 * HIDDEN] = dgates[t, : 2 * HIDDEN]
        np.multiply(dn, r, out=du[2 * HIDDEN :])
        d_state += du @ h.T
        d_bias += du[2 * HIDDEN :].sum(axis=1)
        dh *= z
        dh += state @ du
        if resets[t]:
            dh *= live[t]
    grads["state"] += d_state.T
    grads["bias"] += d_bias
    seen = x.ravel().astype(np.int16)
    order = np.argsort(seen, kind="stable")
    begins = np.flatnonzero(np.diff(seen[order], prepend=-1))
    grads["gates"][seen[order[begins]]] += np.add.reduceat(by_row(dgates)[order], begins, axis=0)


class Adam:
    def __init__(self, p: Params):
        self.m, self.v, self.t = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0

    def step(self, p: Params, grads: Params, rate: float) -> None:
        """Uses up ``grads``."""
        self.t += 1
        scale = np.float32(rate * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t))
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += np.float32(0.1) * (g - m)
            g *= g
            g -= v
            g *= np.float32(0.01)
            v += g
            np.sqrt(v, out=g)
            g += np.float32(1e-6)
            np.divide(m, g, out=g)
            g *= scale
            p[k] -= g
        for k in ("outer", "inner"):
            np.clip(p[k], -LARGEST, LARGEST, out=p[k])


def learn(p: Params, sequences: Iterable[np.ndarray], expected: float) -> int:
    """One pass; returns the number of symbols. The rate rises over the first updates and falls as ``expected`` comes near."""
    adam, seen, h = Adam(p), 0, np.zeros((HIDDEN, LANES), np.float32)
    for xs, ys, _, keep in packed(sequences, LANES):
        h = np.ascontiguousarray(h[:, keep])
        for at in range(0, len(xs), WINDOW):
            x, y, kept = xs[at : at + WINDOW], ys[at : at + WINDOW], SimpleNamespace()
            states, h = run_window(p, x, h, kept)
            flat, target = by_row(states), y.ravel()
            live = target >= 0
            grads = {k: np.zeros_like(a) for k, a in p.items()}
            dh = np.zeros_like(flat)
            dh[live] = log_probs(p, flat[live], target[live], grads)[1]
            backward(p, grads, x, kept, np.ascontiguousarray(dh.reshape(*x.shape, HIDDEN).transpose(0, 2, 1)))
            count = int(live.sum())
            for g in grads.values():
                g /= np.float32(count)
            adam.step(p, grads, RATE * min(1.0, (adam.t + 1) / 20) * max(0.1, 1 - seen / max(1.0, expected)))
            seen += count
    return seen


def _packed(p: Params) -> bytes:
    return b"".join(np.ascontiguousarray(p[k], np.float32).tobytes() for k in sorted(p))


def _unpacked(raw: np.ndarray, like: Params) -> Params:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = raw[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


ENCODED = "row long, doc_id long, key long, n_tokens long, n_known long, base_score double, score double, ids binary, word string, spelling int, n long"
KINDS = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
SCORED = "row long, doc_id long, n_tokens long, n_known long, base_score double, score double"


def _batch(ddl: str, columns: dict[str, object], n: int) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in ddl.split(", ")))
    given = [columns.get(name) for name in names]
    return pa.RecordBatch.from_arrays([pa.nulls(n, KINDS[k]) if c is None else c if isinstance(c, pa.Array) else pa.array(c, KINDS[k]) for c, k in zip(given, kinds)], list(names))


def encode(docs: DataFrame, known: Known) -> DataFrame:
    """Every document as symbols (ids, 16 bits each, END last) with its counts; a row per (row, word) outside KEPT.

    base_score is without those words; score is so far that of words within their spelling classes. Written once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)  # KEPT words, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spelled_as = shared.value, Memory(spelling, 200_000)
        index = {w: i for i, w in enumerate(known.words)}
        spelled = np.array([spelling(w) for w in known.words], np.int32)
        symbol = np.append(np.where(np.arange(len(known.words)) < VOCAB, np.arange(len(known.words)), VOCAB + spelled), END).astype("<u2")
        base = np.append(np.log10((known.counts + 1) / (known.total + known.distinct + 1)), 0)
        within = np.append(np.log10((known.counts + 1) / (known.class_tokens + known.class_words + 1)[spelled]), 0)
        within[: min(VOCAB, len(known.words))] = 0
        base_end = float(np.log10((known.texts + 1) / (known.total + known.distinct + 1)))
        for batch in pieces(batches, 6 << 20):
            n = batch.num_rows
            if not n:
                continue
            found = [tokens(t) for t in batch.column(2).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, n)
            flat, owner = list(chain.from_iterable(found)), np.repeat(np.arange(n), sizes)
            code = np.fromiter(map(index.get, flat, repeat(-1)), np.int32, len(flat))
            ids, place = np.full(len(flat) + n, END, "<u2"), np.arange(len(flat)) + owner
            ids[place] = symbol[code]
            gone = np.flatnonzero(code < 0)
            words = [flat[i] for i in gone.tolist()]
            ids[place[gone]] = VOCAB + np.fromiter(map(spelled_as.__getitem__, words), np.int64, len(words))
            sums = lambda values: np.bincount(owner, values, n)
            ends = np.concatenate([[0], np.cumsum(sizes + 1)]).astype(np.int32) * 2
            yield _batch(ENCODED, {
                "row": batch.column(0), "doc_id": batch.column(1), "key": batch.column(3), "n_tokens": sizes + 1,
                "n_known": sums(code >= 0).astype(np.int64) + (known.texts > 0), "base_score": sums(base[code]) + base_end, "score": sums(within[code]),
                "ids": pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(ids.tobytes())]),
            }, n)
            if words:
                times = Counter(zip(owner[gone].tolist(), words))
                at, word = zip(*times)
                rows = batch.column(0).to_numpy()[list(at)]
                yield _batch(ENCODED, {"row": rows, "word": [w.decode("utf-8", "surrogatepass") for w in word], "spelling": [spelled_as[w] for w in word], "n": list(times.values())}, len(word))

    numbered = narrowed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return written(numbered.mapInArrow(run, ENCODED), "lm-encoded")


def training_parts(encoded: DataFrame, replicas: int) -> DataFrame:
    """A row per SEGMENT of each training text: round, replica, place (its order there) and ids.

    Rows that repeat are put apart by a number, so that they spread over replicas wherever they stand.
    """
    rows = encoded.where("word is null").where(is_training()).select("key", "n_tokens", "ids")
    repeats = written(rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1"), "lm-repeats")
    if repeats.isEmpty():
        rows = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        many = rows.join(repeats, "key").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n_tokens", "ids", "times")])
        many = many.select("key", "n_tokens", "ids", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("copy"))
        rows = rows.join(repeats, "key", "left_anti").withColumn("copy", F.lit(0).cast("long")).unionByName(many)
    parts = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_tokens") - 1) / SEGMENT))))
    drawn = lambda seed: F.xxhash64(F.lit(seed), "key", "copy", "part")
    return parts.select(
        F.when(F.pmod(drawn(1), F.lit(WARM)) == 0, 0).otherwise(1).alias("round"), F.pmod(drawn(2), F.lit(replicas)).cast("int").alias("replica"),
        drawn(3).alias("place"), F.expr(f"substring(ids, cast(part * {2 * SEGMENT} + 1 as int), {2 * SEGMENT})").alias("ids"),
    )


def averaged(trained: DataFrame, replicas: int, like: Params) -> Params:
    """The weighted mean of the replicas' parameters, summed in levels of FAN; FAN sums at most reach the driver."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("replica")
        total = sum(np.frombuffer(b, np.float64) for b in rows["params"])
        return pd.DataFrame({"replica": [int(rows["replica"].iloc[0]) // FAN], "n": [int(rows["n"].sum())], "params": [total.tobytes()]})

    while replicas > FAN:
        trained = trained.groupBy(F.floor(F.col("replica") / FAN)).applyInPandas(add, "replica int, n long, params binary")
        replicas = -(-replicas // FAN)
    sums = sorted(trained.collect(), key=lambda r: r["replica"])
    return _unpacked(sum(np.frombuffer(r["params"]) for r in sums) / sum(r["n"] for r in sums), like) if sums else like


def train(encoded: DataFrame, known: Known, replica_words: int = REPLICA_WORDS) -> Params:
    """Two rounds over every training word, once each; replicas as many as the corpus holds ``replica_words``."""
    replicas, p = max(1, -(-known.total // replica_words)), first_params(known)
    parts = training_parts(encoded, replicas)
    for number, share in ((0, 1 / WARM), (1, 1 - 1 / WARM)):
        start, expected = encoded.sparkSession.sparkContext.broadcast(p), known.total * share / replicas  # one model

        def replica(batches: Iterator[pa.RecordBatch], start=start, expected: float = expected) -> Iterator[pa.RecordBatch]:
            rows = ((r, ids) for batch in batches for r, ids in zip(batch.column(0).to_pylist(), batch.column(1)))
            for r, mine in groupby(rows, key=lambda row: row[0]):
                p = {k: a.copy() for k, a in start.value.items()}
                n = learn(p, (np.frombuffer(ids.as_buffer(), "<u2") for _, ids in mine), expected)
                params = (np.frombuffer(_packed(p), np.float32).astype(np.float64) * n).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([n], pa.int64()), pa.array([params], pa.binary())], ["replica", "n", "params"])

        mine = parts.where(F.col("round") == number).repartitionByRange(replicas, "replica").sortWithinPartitions("replica", "place", "ids")
        trained = written(mine.select("replica", "ids").mapInArrow(replica, "replica int, n long, params binary"), "lm-trained")
        p = averaged(trained, replicas, p)
    return p


def sequence_scores(p: Params, sequences: Iterable[np.ndarray], lanes: int = SCORE_LANES) -> Iterator[tuple[int, float]]:
    """(number, ln probability) of each whole sequence, as it ends. The state passes from window to window."""
    h, sums = np.zeros((HIDDEN, lanes), np.float32), Counter()
    for xs, ys, owners, keep in packed(sequences, lanes):
        h, got = np.ascontiguousarray(h[:, keep]), np.zeros(ys.shape)
        for at in range(0, len(xs), WINDOW):
            y = ys[at : at + WINDOW]
            states, h = run_window(p, xs[at : at + WINDOW], h)
            live = y >= 0
            got[at : at + WINDOW][live] = log_probs(p, by_row(states)[live.ravel()], y[live])[0]
        live, least = (ys >= 0).T, int(owners.min())
        owner, ended = owners.T[live], owners.T[(ys == END).T].tolist()
        more = np.bincount(owner - least, got.T[live])
        for number in np.unique(owner).tolist():
            sums[number] += more[number - least]
        for number in ended:
            yield number, float(sums.pop(number))


def document_scores(p: Params, sequences: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(sequences))
    for number, score in sequence_scores(p, sequences):
        out[number] = score
    return out


def score(encoded: DataFrame, params: Params) -> DataFrame:
    """The documents of ``encoded`` with the model's score (log10) added. Written once."""
    shared = encoded.sparkSession.sparkContext.broadcast(params)  # one model, whatever the input
    names = [x.split()[0] for x in SCORED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple] = {}

        def sequences() -> Iterator[np.ndarray]:
            number = 0
            for batch in batches:
                for *row, ids in zip(*[c.to_pylist() for c in batch.columns]):
                    waiting[number] = row
                    number += 1
                    yield np.frombuffer(ids, "<u2")

        done = []
        for number, got in sequence_scores(shared.value, sequences()):
            row = waiting.pop(number)
            done.append((*row[:-1], row[-1] + got / LN10))
            if len(done) == 4096:
                yield _batch(SCORED, dict(zip(names, zip(*done))), len(done))
                done = []
        if done:
            yield _batch(SCORED, dict(zip(names, zip(*done))), len(done))

    return written(encoded.where("word is null").select(*names, "ids").mapInArrow(run, SCORED), "lm-scored")


def scored(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10), whole texts.

    Held out: crc32(doc_id) mod 7 is 2; the rest is learned from, null doc_ids too. Null and empty texts are one end
    token. Without training texts every count is zero and both scores are still defined. Repeated rows each come back;
    an empty table gives an empty result.
    """
    gathered = gather(docs)
    counts = word_counts(gathered)
    known = known_of(gathered, counts)
    encoded = encode(docs, known)
    rows = score(encoded, train(encoded, known))
    spark = docs.sparkSession
    classes = spark.createDataFrame([(i, float(a + b + 1)) for i, (a, b) in enumerate(zip(known.class_tokens.tolist(), known.class_words.tolist()))], "spelling int, class_size double")
    rare = encoded.where("word is not null").select("row", "word", "spelling", F.col("n").alias("times"))
    c = F.coalesce(F.col("n"), F.lit(0))
    more = (
        rare.join(counts.select("word", "n"), "word", "left").join(F.broadcast(classes), "spelling")  # SPELLINGS rows
        .groupBy("row").agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(known.total + known.distinct + 1)))).alias("more_base"),
            F.sum(F.col("times") * F.log10((c + 1) / F.col("class_size"))).alias("more_score"),
        )
    )
    return rows.join(more, "row", "left").select(
        "doc_id", (~is_training()).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(known.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
