"""Language ID by a mixture over languages, per document.

Letter trigrams (words padded with a space) are hashed into BUCKETS; each language has a smoothed trigram distribution
from every labelled training text. A document's trigrams are drawn from a mixture of languages; expectation-maximisation
finds its proportions. The language set grows from the best single one: the language with the steepest gain joins while
the refitted likelihood rises by more than the penalty (half a log of the number of trigrams per proportion, times three
as each letter is in three trigrams).
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed, pieces

BUCKETS = 1 << 15
FOLDS, HELD = 4, 2
ALPHA = 0.5
SETTLED = 1e-4  # nats by which a step must still raise a document's likelihood
PENALTY = 3.0
MOST_LANGUAGES = 512
PIECE = 3 << 20  # bytes of text worked on at once
MOST_CHARS = 1 << 22  # of a text at once; counts of its pieces add up


@cache
def _folded() -> np.ndarray:
    """Lower-case code point of each letter, 32 for all else."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c))[0] == "L":
            table[c] = ord(low) if len(low := chr(c).lower()) == 1 else c
    return table


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the text's letter trigrams; empty without a letter."""
    total, ahead = np.zeros(BUCKETS, np.int64), np.array([32], np.uint32)
    for at in range(0, max(1, len(text)), MOST_CHARS):
        points = np.frombuffer(text[at : at + MOST_CHARS].encode("utf-32-le", "surrogatepass"), "<u4")
        end = [np.array([32], np.uint32)] if at + MOST_CHARS >= len(text) else []
        low = np.concatenate([ahead, _folded()[points], *end])
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
        low = low[keep]
        ahead = low[-2:]  # the next piece's trigrams begin with these
        if len(low) < 3:
            continue
        mixed = low[:-2] * np.uint32(0x9E3779B1) ^ low[1:-1] * np.uint32(0x85EBCA6B) ^ low[2:] * np.uint32(0xC2B2AE35)
        mixed = (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x27D4EB2F) >> np.uint32(17)
        if len(mixed) < 4096 and len(text) <= MOST_CHARS:
            return np.unique(mixed, return_counts=True)
        total += np.bincount(mixed, minlength=BUCKETS)
    found = np.flatnonzero(total)
    return found, total[found]


def fit_mixture(p: np.ndarray, count: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """EM for the proportions of p's rows (languages) over trigrams with counts; (proportions, log-likelihood)."""
    share, n, before = start, count.sum(), -np.inf
    while True:
        part = share[:, None] * p
        whole = part.sum(axis=0)
        reached = float(np.log(whole) @ count)
        if reached - before < SETTLED:
            return share, reached
        share, before = (part / whole) @ count / n, reached


def mixture(logp: np.ndarray, buckets: np.ndarray, count: np.ndarray) -> tuple[dict[int, float], float]:
    """(language number -> proportion for the chosen set, log-likelihood per trigram). The penalty alone ends the set."""
    lp = logp[:, buckets]
    top = lp.max(axis=0)
    p, count = np.exp(lp - top).astype(np.float64), count.astype(np.float64)
    n = count.sum()
    single = np.log(p) @ count
    chosen = [int(np.argmax(single))]
    share, best = np.ones(1), float(single[chosen[0]])
    while len(chosen) < len(p):
        gain = (p / (share @ p[chosen])) @ count / n
        gain[chosen] = 0
        new = int(np.argmax(gain))
        if gain[new] <= 1:
            break
        start = np.append(share * 0.8, 0.2)
        refit, reached = fit_mixture(p[[*chosen, new]], count, start)
        if reached - best <= PENALTY * 0.5 * np.log(n + 1) * (1 + np.log(len(p))):
            break
        chosen, share, best = [*chosen, new], refit, reached
    return dict(zip(chosen, share.tolist())), (best + float(top.astype(np.float64) @ count)) / n


def train(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities (languages, BUCKETS)) from the whole text of every labelled training document.

    Counts per language and bucket add up in the shuffle; the driver receives at most MOST_LANGUAGES x BUCKETS sums.
    """
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS))
    labelled = narrowed(docs, F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.coalesce(rest != HELD, F.lit(True)))
    known = labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()
    if len(known) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in pieces(batches, PIECE):
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                buckets, n = trigrams(text)
                held.setdefault(lang, np.zeros(BUCKETS, np.int64))[buckets] += n
        for lang, sums in held.items():
            found = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(sums[found])], ["lang", "bucket", "n"])

    sums = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(r["lang"] for r in known)
    table = np.zeros((len(languages), BUCKETS))
    if sums.num_rows:
        row = {x: i for i, x in enumerate(languages)}
        table[[row[x] for x in sums.column(0).to_pylist()], sums.column(1).to_numpy()] = sums.column(2).to_numpy()
    return languages, np.log((table + ALPHA) / (table.sum(axis=1, keepdims=True) + ALPHA * BUCKETS)).astype(np.float32)


OUT = "doc_id long, held_out boolean, lang_pred string, score double, mixture string, fit double"


def judged(texts: list[str | None], languages: list[str], logp: np.ndarray) -> list[tuple[str, float, str, float | None]]:
    """(language, its proportion, mixture such as "en:0.81,fr:0.19", log-likelihood per trigram) of each text."""
    out = []
    for text in texts:
        buckets, count = trigrams(text or "")
        if not len(count) or not languages:
            out.append(("und", 0.0, "", None))
            continue
        shares, fit = mixture(logp, buckets, count)
        found = sorted(shares.items(), key=lambda kv: (-kv[1], kv[0]))
        share = min(1.0, max(0.0, found[0][1]))
        out.append((languages[found[0][0]], share, ",".join(f"{languages[k]}:{v:.2f}" for k, v in found), fit))
    return out


def predict(rows: DataFrame, languages: list[str], logp: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score, mixture, fit; predictions see the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            pred, score, mix, fit = zip(*judged(batch.column(1).to_pylist(), languages, logp)) if batch.num_rows else ((), (), (), ())
            held = [d is not None and zlib.crc32(str(d).encode()) % FOLDS == HELD for d in batch.column(0).to_pylist()]
            columns = [batch.column(0), pa.array(held, pa.bool_()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string()), pa.array(fit, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])

    return rows.mapInArrow(run, OUT)


def language_of(docs: DataFrame) -> DataFrame:
    """One row per document. Learns from lang where crc32(doc_id) mod 4 is not 2 and lang is not null.

    ``und`` with score 0 for texts that are null or hold no letter, and for all if nothing is labelled. A null doc_id is
    in training. Ties go to the first language by name. Repeated rows each come back; other columns are ignored.
    """
    return predict(narrowed(docs), *train(docs))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents whose text has letters that some mixture of the languages explains better than chance does, that is,
    than trigrams drawn evenly from all buckets. All columns, all repeats.

    Null and empty texts go; a text of many languages stays. If nothing is labelled, every text goes.
    """
    languages, logp = train(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([fit is not None and fit > -np.log(BUCKETS) for *_, fit in judged(texts, languages, logp)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
