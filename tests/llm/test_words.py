"""Spelling variants, toxicity and source divergence against plain versions, with nulls, ties, repeats, long texts."""

import math
import random
import re
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from signalframe.llm import divergence, recurrent, spelling, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, word string, n long, term string, p long, rank int, block int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2, 3, 4) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    stems = ["tionen", "heitung", "çaéouon", "straßen", "mentions", "ÀBCDEFé", "aaaaaaa", "aaaaaaaa"]
    alphabet = "abcdeéßÀ"

    def edited(w):
        at = r.randrange(len(w))
        return r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice(alphabet) + w[at:], w[:at] + r.choice(alphabet) + w[at + 1 :]])

    words = [w for w in stems for _ in range(30)] + [edited(w) for w in stems for _ in range(40)]
    chain = ["chainede"] * 6 + ["chainedx"] * 60 + ["chainexx"] * 600 + ["chaixxxx"] + ["tiedword"] * 5 + ["tiedworda"] * 25 + ["tiedwordb"] * 25
    words += chain
    r.shuffle(words)
    parts = [" ".join(words[i : i + 12]) for i in range(0, len(words), 12)]
    langs, sources = ["en", "de", None], ["a", "b", "é", None, "lone"]
    out = [(i, t, langs[i % 3], r.choice(sources[:4])) for i, t in enumerate(parts)]
    out += [(1000, None, "en", "a"), (1001, "", "fr", "a"), (1002, "", "fr", "b"), (1003, "... 123 é漢字×÷", "en", "b"), (None, parts[0], "en", "a"), (None, parts[0], "en", "a"),
            (5, parts[5], "de", "b"), (5, parts[5], "de", "b"), (1004, "Straßen-MENTIONS " * 3000, "en", "lone"), (1005, "z" * 4000, "xx", "only"), (1006, parts[1], None, None)]
    return out


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(rows):
    n = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    words = [w for w, k in n.items() if len(w) >= 6 and k >= 5]
    near = {w: [v for v in words if one_edit(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= 5 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w, ""), root(w), n[w], len(near[w]), n[form[w]] if w in form else 0) for w in words)


def test_variants(spark, rows):
    got = sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(frame(spark, rows)).collect())
    assert got == plain_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in got), "a chain of forms is needed"
    assert spelling.variants(frame(spark, [])).count() == 0


def test_crowded_blocks_lose_no_pair(spark):
    r = random.Random(9)
    made = sorted({"".join(r.choice("ab") for _ in range(r.choice([8, 9]))) for _ in range(600)})
    words = spark.createDataFrame([(w, i + 5) for i, w in enumerate(made)], "word string, n long").repartition(5)
    got = sorted((x.word, x.other, x.other_n) for x in spelling.near_words(words).collect())
    n = {w: i + 5 for i, w in enumerate(made)}
    assert got == sorted((a, b, n[b]) for a in made for b in made if one_edit(a, b))


def plain_divergence(rows):
    docs = [(lang or "", source or "", [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        held = Counter(t for d in mine for t in set(d[2]))
        kept = [t for t in held if held[t] >= 10]
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2]) for s in {d[1] for d in mine}}
        whole = sum(counts.values(), Counter())

        def p(c, t):
            return 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept))

        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s, c in counts.items():
            pairs = [(-sum(f(p(c, t), p(d, t)) for t in kept), o.encode(), o) for o, d in counts.items() if o != s]
            terms = [(-f(p(c, t), p(whole, t)), t.encode(), t) for t in kept if c[t] and p(c, t) > p(whole, t)]
            for part, got, most in (("pair", pairs, None), ("term", terms, 10)):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(got)[:most])]
    return sorted(out)


def test_divergence(spark, rows, monkeypatch):
    docs = frame(spark, rows)
    want = plain_divergence(rows)
    got = sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergences(docs).collect())
    assert got == want and {r[2] for r in got} == {"pair", "term"}
    assert any(r[0] == "fr" and r[4] == 0 for r in got), "a lang without kept terms has pairs of value 0"
    assert divergence.divergences(frame(spark, [])).count() == 0
    monkeypatch.setattr(divergence, "ROWS", 2)
    monkeypatch.setattr(divergence, "STRIPE", 3)
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in divergence.divergences(docs).collect()) == want


def test_quadtree_prices_every_pair():
    rng = np.random.default_rng(4)
    for rows, columns, width in ((1, 1, 1), (5, 3, 9), (9, 70, 400), (33, 8, 8)):
        dense = rng.integers(50, 10**9, (2, rows, width)) * (rng.random((2, rows, width)) < 0.1)
        dense[:, :, columns:] = 0
        empty = rng.integers(1, 40, (2, rows))
        trees = []
        for m, e in zip(dense, empty):
            r, c = np.nonzero(m)
            trees.append(divergence.Tree(r, c, m[r, c], e))
        p, q = (np.where(m, m, e[:, None]) for m, e in zip(dense, empty))
        want = ((p[:, None] - q[None]) ** 2 // (p[:, None] + q[None])).sum(axis=2)
        assert (divergence.priced(*trees, columns, width, False)[:rows, :rows] == want).all()


def test_shares_are_exact_beyond_longs(spark):
    from pyspark.sql import functions as F

    made = [(0, 0, 0), (0, 0, 7), (10**15, 3 * 10**15, 10**6), (5, 17, 3)]
    got = [r.p for r in spark.createDataFrame(made, "c long, w long, v long").coalesce(1).select(divergence.share(F.col("c"), F.col("w"), F.col("v")).alias("p")).collect()]
    assert got == [None if w + 2 * v == 0 else 1 + 10**9 * (c + 2) // (w + 2 * v) for c, w, v in made]


def toxic_rows(n, seed):
    r = random.Random(seed)
    syllables = "tion and the er in ou re ha ment ly ble st".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    out = []
    for i in range(n):
        body = [word() for _ in range(r.choice([5, 40, 200]))]
        toxic = i % 5 == 0
        if toxic:
            body[r.randrange(len(body))] = r.choice(["vermin", "grukk" + word(), "grukk" + word()])
        out.append((i, " ".join(body), int(toxic)))
    return out


def test_toxicity_on_held_out_documents(spark):
    made = toxic_rows(700, 1)
    extra = [(9000, None, None), (9001, "", None), (None, "the and grukkly", None), (9002, "the and " * 3000 + "grukkand " + "the and " * 3000, None), (9003, "the and " * 6000, None), (3, made[3][1], None)]
    docs = frame(spark, [(i, t, "clash", "clash") for i, t, _ in [*made, *extra]])
    labels = spark.createDataFrame([(i, y, 1, "clash") for i, _, y in made] + [(None, 1, 1, ""), (77777, 1, 1, "")], "doc_id long, toxic int, quality int, text string")
    got = toxicity.scored(docs, labels).collect()
    assert len(got) == len(made) + len(extra) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    by = {r.doc_id: r.predicted for r in got}
    held = [(y, by[i]) for i, _, y in made if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(p for y, p in held if y) >= 0.9 * sum(y for y, _ in held)
    assert sum(p for y, p in held if not y) <= 0.03 * sum(1 - y for y, _ in held)
    assert by[None] == 1 and by[9002] == 1 and by[9003] == 0 and by[9000] == by[9001] == 0
    scores = {r.doc_id: r.score for r in got}
    assert scores[9000] == scores[9001] and len({r.score for r in got if r.doc_id == 3}) == 1
    nothing = labels.limit(0)
    assert len({r.score for r in toxicity.scored(docs.where("text = ''"), nothing).collect()}) == 1
    assert toxicity.scored(docs.limit(0), labels).count() == 0


def tiny_model():
    texts = [["abc", "stupid", "fox", "ran"] * 3, ["the", "fox", "ran"] * 4, ["stupid"] * 4 + ["x"], ["fox", "the"] * 3, []] * 2
    model = toxicity.first_model(texts, np.array([1, 0, 1, 0, 0] * 2))
    return texts[:5], toxicity.Model(model.vocabulary, {k: v.astype(np.float64) for k, v in model.params.items()})


def test_toxicity_gradients(monkeypatch):
    texts, model = tiny_model()
    monkeypatch.setattr(np, "float32", np.float64)
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    at = np.concatenate([toxicity.laid_out(np.array([number[w] for w in t], int), np.array([0])) for t in texts], axis=1)
    y, w = np.array([1, 0, 1, 0, 0]), np.array([1, 0.5, 1, 0.5, 0.7])
    grads, _ = toxicity.gradients(model, list(number), at, y, w)
    for name, value in model.params.items():
        for flat in np.argsort(-np.abs(grads[name]).ravel())[:3]:
            i = np.unravel_index(flat, value.shape)
            losses = []
            for step in (1e-5, -2e-5):
                value[i] += step
                losses.append(toxicity.gradients(model, list(number), at, y, w)[1])
            value[i] += 1e-5
            assert math.isclose((losses[0] - losses[1]) / 2e-5, grads[name][i], rel_tol=1e-3, abs_tol=1e-7), name


def test_windows_cover_every_word_and_the_highest_counts():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        starts = toxicity.windows(n)
        covered = set().union(*[range(s, min(n, s + toxicity.WINDOW)) for s in starts.tolist()])
        assert covered == set(range(n)) and len(starts) >= 1
        assert all(b - a < toxicity.WINDOW for a, b in zip(starts, starts[1:]))
    texts, model = tiny_model()
    long = [" ".join(w for t in texts for w in t * 5), "", "fox " * 300]
    model = toxicity.Model(model.vocabulary, {k: v.astype(np.float32) for k, v in model.params.items()})
    reader = toxicity.Reader(model)
    together = reader.scores(long)
    for text, got in zip(long, together):
        found = toxicity.words(text)
        number = {w: i for i, w in enumerate(dict.fromkeys(found))}
        terms = toxicity.input_terms(model.params, toxicity.word_inputs(model, list(number))[0])
        ids = np.array([number[w] for w in found], np.int64)
        each = [toxicity.logits(model.params, terms, toxicity.laid_out(ids, np.array([s])))[0] for s in toxicity.windows(len(ids))]
        assert math.isclose(got, toxicity.sigmoid(np.array(max(each))), rel_tol=1e-4)


def test_gradients_of_input_weights_are_summed_in_one_pass(monkeypatch):
    rng = np.random.default_rng(6)
    known = recurrent.Known([], np.zeros(0, np.int64), 1, 1, 1, np.ones(recurrent.SPELLINGS, np.int64), np.ones(recurrent.SPELLINGS, np.int64))
    p = recurrent.first_params(known)
    x = rng.choice([0, 3, 17, recurrent.END], (5, 8)).astype(np.int32)
    targets, kept = rng.standard_normal((5, recurrent.HIDDEN, 8)).astype(np.float32), SimpleNamespace()
    h0 = np.zeros((recurrent.HIDDEN, 8), np.float32)
    recurrent.run_window(p, x, h0, kept)
    grads = {k: np.zeros_like(a) for k, a in p.items()}
    monkeypatch.setattr(np, "bincount", lambda *a: pytest.fail("a pass a column"))
    recurrent.backward(p, grads, x, kept, targets)
    loss = lambda q: float((recurrent.run_window(q, x, h0)[0] * targets).sum(dtype=np.float64))
    for row in (3, recurrent.END):
        for column in (1, recurrent.HIDDEN + 2, 2 * recurrent.HIDDEN + 5):
            up, down = ({**p, "gates": p["gates"].copy()} for _ in range(2))
            up["gates"][row, column] += 0.01
            down["gates"][row, column] -= 0.01
            assert abs((loss(up) - loss(down)) / 0.02 - grads["gates"][row, column]) < 2e-2
    assert not grads["gates"][1].any()
