"""What steps move between tasks, beside their results."""

import random

from pyspark.sql import functions as F

from signalframe.operators import planning, similarity


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_display_diversity_shuffles_rows_once_and_counts_large_surfaces_apart(spark):
    made = [(i // 5, f"v{i % 3}" if i % 7 else None, [0.0, -0.0, float("nan"), 1.0][i % 4]) for i in range(400)]
    made += [(None, "n", 1.0), (None, "m", None)]
    schema, floors = "surface long, a string, b double", [(3, {"a": 2}), (5, {"a": 3, "b": 3})]
    small = spark.createDataFrame(made, schema)
    assert "Expand" not in plan_of(planning.display_diversity(small, "surface", ["a", "b"], floors))  # each row once for every dimension
    large = spark.range(2 * planning.MANY).select(F.lit(999).cast("long").alias("surface"), F.col("id").cast("string").alias("a"), (F.col("id") % 5).cast("double").alias("b"))
    for rows in (small, small.unionByName(large), small.unionByName(large.withColumn("surface", F.lit(None).cast("long")))):
        got = {r["surface"]: (r["size"], r["a"], r["b"]) for r in planning.display_diversity(rows, "surface", ["a", "b"], floors).collect()}
        want = rows.groupBy("surface").agg(F.count("*").alias("size"), F.count_distinct("a").alias("a"), F.count_distinct("b").alias("b")).collect()
        assert got == {r["surface"]: (r["size"], r["a"], r["b"]) for r in want}


def test_similar_prefixes_come_without_a_shuffle_of_all_shingles(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words[:58] + ["x", "y"]), " ".join(reversed(words)), " ".join(words), "", None, "one two"]
    sets = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select(similarity.shingles(F.col("text")).alias("shingles")).withColumn("sid", F.xxhash64("shingles"))
    plans, real = {}, similarity.written
    monkeypatch.setattr(similarity, "written", lambda df, tag, *more: plans.setdefault(tag, plan_of(df)) and None or real(df, tag, *more))
    got = similarity.similar_pairs(sets.select("sid", "shingles")).collect()
    a, b = (r["sid"] for r in sets.limit(2).collect())
    assert [(r["u"], r["v"]) for r in got] == [(min(a, b), max(a, b))]  # repeated sets meet once
    assert plans["similar-prefix"].count("Exchange") == 1  # of prefixes alone


def test_a_family_of_near_copies_costs_no_row_a_pair(spark, monkeypatch):
    """One text's many near copies, unlike in different words: rows met, linked and compared stay near the members, and no set is written."""
    r, texts = random.Random(7), []
    base = [f"w{r.randrange(9000)}" for _ in range(160)]
    for k in range(300):
        words = list(base)
        for at in r.sample(range(160), 1 + k % 4):
            words[at] = f"n{k} {at}"
        texts.append(" ".join(words))
    texts += [" ".join(f"x{r.randrange(9000)}" for _ in range(80)) for _ in range(100)] + texts[:50]
    rows, written, found = {}, similarity.written, similarity.connected_components
    monkeypatch.setattr(similarity, "written", lambda df, tag, *more: (got := written(df, tag, *more), rows.setdefault(tag, got))[0])
    edges = []
    monkeypatch.setattr(similarity, "connected_components", lambda e: edges.append(e.count()) or found(e))
    lines = {x.id: x.lineage_id for x in similarity.lineages(spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4), "id").collect()}
    sets = [frozenset(similarity.shingle_set(t).tolist()) for t in texts]
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if x == old else x for x in root]
    assert len({(root[i], lines[i]) for i in lines}) == len(set(root)) == len(set(lines.values()))
    assert 4 * sum(edges) < 300 * 299 // 2
    assert rows and not any(kind.startswith("array") for table in rows.values() for _, kind in table.dtypes)
