import hashlib
import math
import random
import re
import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from signalframe.functions.text import FUNCTION_HAN, SHORT_HAN, STOP_HAN, html_clean, time_parse, tokens_han
from signalframe.operators import closure, coverage, measures, planning, registers, rules, signals, temporal, trends
from signalframe.operators.components import connected_components
from signalframe.plans import catalog
from signalframe.sources import feeds
from signalframe.streaming import streams

SF = "/root/testdata/sf0.001"
ITEM = "item_key string, source_id string, source_name string, language string, region string, title string, summary string, source_url string, published_at timestamp, fetched_at timestamp"


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    sql = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in sql.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.collect(), df.columns) == rows_of(sql.fetchall(), columns)


def item(spark, rows):
    full = [(f"k{i}", s, s, lang, "R", title, "", f"u{i}", None, None) for i, (s, lang, title, _) in enumerate(rows)]
    df = spark.createDataFrame(full, ITEM)
    hours = spark.createDataFrame([(f"k{i}", h) for i, (*_, h) in enumerate(rows)], "item_key string, h double")
    return df.drop("published_at").join(hours, "item_key").withColumn("published_at", F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-03 00:00:00").cast("timestamp")) - F.col("h") * 3600)).drop("h")


END = "2024-01-03 00:00:00"


def test_rising_topic(spark):
    rows = [("a", "en", "quantum battery", 20.0), ("a", "en", "quantum battery", 1.0), ("b", "en", "quantum battery", 2.0), ("c", "en", "quantum battery", 3.0)]
    got = trends.with_growth(trends.with_state(trends.trend_aggregate(item(spark, rows), F.lit(END).cast("timestamp")))).where("topic = 'quantum battery'").first()
    assert (got.mention_count, got.recent_mention_count, got.prior_mention_count, got.source_count, got.signal_state, got.growth_text) == (4, 3, 1, 3, "rising", "+200.0%")


def test_topics_are_cut_once_and_sets_of_sources_agree(spark, monkeypatch):
    """Sources as bits and as a list give the same, null ones too; no plan cuts texts into topics twice."""
    made = [(s, "en", f"quantum battery number{i % 3}", 2.0 + 9 * (i % 5)) for i, s in enumerate(["a", "b", None, "c", "a", None, "d"] * 3 + [f"s{k}" for k in range(70)])]
    got = []
    for most in (512, 1):
        monkeypatch.setattr(trends, "MASKED", most)
        found = trends.trend_aggregate(item(spark, made), F.lit(END).cast("timestamp"))
        got.append(rows_of(found.collect(), found.columns))
        assert most == 1 or found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(") == 1
    whole = {r.topic: r for r in found.collect()}["quantum battery"]
    assert got[0] == got[1] and (whole.mention_count, whole.source_count) == (91, 74)


def test_single_source_is_no_trend(spark):
    assert trends.trend_aggregate(item(spark, [("a", "en", "solar flares", 1.0)] * 3), F.lit(END).cast("timestamp")).count() == 0


def test_tied_fragments(spark):
    rows = [("a", "zh-CN", "量子纠缠态", 1.0), ("b", "zh-CN", "量子纠缠态", 2.0)]
    got = trends.trend_aggregate(item(spark, rows), F.lit(END).cast("timestamp"))
    assert trends.fragment_consolidation(got).count() == 0
    assert trends.fragment_consolidation(got, "stable").count() == 1


def test_han_tokens_and_cleaning(spark):
    df = spark.createDataFrame([("量子计算",), ("台",), (None,), ("芯片 的记者",)], "t string")
    got = [set(r[0] or []) for r in df.select(tokens_han(F.col("t"))).collect()]
    assert got[0] == {"量子", "量子计", "子计算", "量子计算"} and got[1] == got[2] == set() and got[3] == {"芯片"}
    one = spark.createDataFrame([("<p>a &lt;b&gt;\n c</p>", "Tue, 02 Jan 2024 08:00:00 +0800")], "h string, t string").select(html_clean(F.col("h")), time_parse(F.col("t")).cast("string")).first()
    assert tuple(one) == ("a <b> c", "2024-01-02 00:00:00")


def test_han_tokens_are_those_of_the_plain_rule_and_few_expressions(spark):
    """Every n-gram tested one by one, as the rule is stated; stop words overlap, touch, repeat and stand at the ends."""
    bad = [*STOP_HAN, *FUNCTION_HAN]
    near = ["".join(rng.choice("中国方我记者网杭州新联合主办台风地震人工智能的了世界\U00020000a ") for _ in range(60)) for rng in map(random.Random, range(60))]
    texts = ["网杭州网杭州西湖", "中国方记者报道联合主办方", "气候变化的气候", *near]
    every = lambda run: {run[i : i + n] for n in (2, 3, 4) for i in range(len(run) - n + 1)}
    want = [{t for run in re.split("[a ]+", text) for t in every(run) if (len(t) > 2 or t in SHORT_HAN) and not any(b in t for b in bad)} for text in texts]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", tokens_han(F.col("t"))).orderBy("i").collect()
    assert [set(r[1]) for r in got] == want and all(len(set(r[1])) == len(r[1]) for r in got)
    assert str(tokens_han(F.col("t"))).count("rlike") == 0  # no test of each token against every stop word


def test_feeds(spark):
    rss = "<rss><channel><item><title>One</title><link>https://x/1</link><description>&lt;b&gt;s&lt;/b&gt;</description><pubDate>Tue, 02 Jan 2024 08:00:00 +0800</pubDate></item><item><title></title><link>https://x/2</link></item></channel></rss>"
    df = spark.createDataFrame([("a", rss, None, None), ("b", "not xml", None, None)], "source_id string, body string, language string, region string")
    got = {r.source_id: r for r in feeds.feed_parse(df).collect()}
    assert got["a"].title == "One" and got["a"].error is None and got["b"].error == "NO_ITEMS"
    log = spark.createDataFrame([("k", 1, "a", "x"), ("k", 2, "b", "y"), ("j", 3, "c", "z")], "k string, n int, first string, last string")
    assert {(r.k, r.first, r.last) for r in feeds.item_upsert(log, "n", "k", ["first"], ["last"]).collect()} == {("k", "a", "y"), ("j", "c", "z")}


def test_publish_moves_head(spark, tmp_path):
    one = spark.createDataFrame([("s1",)], "snapshot_id string")
    base = f"file://{tmp_path}"
    assert feeds.publish(one, one, one, base, "home", 0) == 1
    with pytest.raises(ValueError, match="STALE_REVISION"):
        feeds.publish(one, one, one, base, "home", 0)
    assert feeds.publish(one, one, one, base, "home", 1) == 2
    assert feeds.read_head(spark, base, "home")[1].count() == 1
    broken = spark.createDataFrame([("s3",)], "snapshot_id string").withColumn("oops", F.raise_error(F.lit("midway")))
    with pytest.raises(Exception, match="midway"):
        feeds.publish(one, one, broken, base, "home", 2)
    assert feeds.read_head(spark, base, "home")[0].first().revision == 2
    assert feeds.publish(one, one, one, base, "home", 2) == 3
    assert [x.count() for x in feeds.read_head(spark, base, "home")] == [1, 1, 1]


def test_one_of_many_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    base = f"file://{tmp_path}"
    named = lambda who: spark.createDataFrame([(who,)], "snapshot_id string")
    feeds.publish(named("first"), named("first"), named("first"), base, "home", 0)

    def attempt(who):
        try:
            return who, feeds.publish(named(who), named(who), named(who), base, "home", 1)
        except ValueError as e:
            assert "RADAR_HEAD_CAS_MISMATCH" in str(e)
            return who, None

    with ThreadPoolExecutor(6) as pool:
        tried = list(pool.map(attempt, [f"w{i}" for i in range(6)]))
    won = [who for who, revision in tried if revision is not None]
    assert len(won) == 1 and [r for _, r in tried if r] == [2]
    assert [x.first().snapshot_id for x in feeds.read_head(spark, base, "home")] == won * 3
    assert feeds.read_revision(spark, base, "home", 1)[0].first().snapshot_id == "first"
    assert feeds.publish(named("next"), named("next"), named("next"), base, "home", 2) == 3


def test_claims_on_other_file_systems(spark, tmp_path):
    from signalframe.scratch import claim, claimed, claims

    hadoop = spark._jsc.hadoopConfiguration()
    hadoop.set("fs.viewfs.mounttable.claims.link./shared", f"file://{tmp_path}")
    folder = "viewfs://claims/shared/map"
    assert claims(spark, folder) == []
    assert [claimed(spark, f"{folder}/1", t) for t in ("a", "b")] == [True, False]
    assert claims(spark, folder) == ["1"] and claim(spark, f"{folder}/1") == "a"


def plain_cycle_edges(edges):
    above = {}
    for child, parent in edges:
        above.setdefault(child, set()).add(parent)

    def ancestors(node):
        seen, todo = set(), [node]
        while todo:
            for p in above.get(todo.pop(), ()):
                if p not in seen:
                    seen.add(p)
                    todo.append(p)
        return seen

    return {(c, p) for c, p in edges if c == p or c in ancestors(p)}


def test_causal_cycle(spark):
    def found(edges):
        table = spark.createDataFrame(edges, "event_id long, parent_event_id long")
        return {(r.event_id, r.parent_event_id) for r in closure.causal_cycle(table).collect()}

    two = [(1, 2), (2, 1), (3, 4), (4, 3), (2, 3)]
    assert found(two) == {(1, 2), (2, 1), (3, 4), (4, 3)}
    chain = [(i + 1, i) for i in range(5000)]
    assert found(chain) == set()
    assert found(chain + [(4990, 5000), (7, 7)]) == {*[(i + 1, i) for i in range(4990, 5000)], (4990, 5000), (7, 7)}
    r = random.Random(3)
    for n in (12, 18):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(n + 6)]
        assert found(edges) == plain_cycle_edges(edges)


def test_causal_cycle_labels_nothing_where_only_plain_cycles_are_left(spark, monkeypatch):
    """Chains, trees on cycles and cycles without chords end with the peeling; a chord brings the labels back."""
    labelled = []
    highest = closure._highest
    monkeypatch.setattr(closure, "_highest", lambda *a: labelled.append(a) or highest(*a))
    found = lambda edges: {(r.event_id, r.parent_event_id) for r in closure.causal_cycle(spark.createDataFrame(edges, "event_id long, parent_event_id long")).collect()}
    cycles = [(i * 10 + j, i * 10 + (j + 1) % (i + 1)) for i in range(5) for j in range(i + 1)]
    assert found([*cycles, (100, 40), (101, 100), (41, 200), (200, 201), (300, 301)]) == set(cycles) and not labelled
    assert found([*cycles, (40, 42)]) == {*cycles, (40, 42)} and labelled


def test_window_assign_keeps_repeated_rows(spark):
    events = spark.createDataFrame([(1, 10), (1, 10), (2, 100_000), (3, 500_000), (4, 86_400)], "id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    windows = spark.createDataFrame([(1, 0, 86_400), (2, 86_400, 172_800), (3, 90_000, 180_000)], "id int, a long, b long").select("id", F.timestamp_seconds("a").alias("start"), F.timestamp_seconds("b").alias("end"))
    got = sorted((r.id, r.window_id, r.matches) for r in temporal.window_assign(events, windows).collect() if r.window_id)
    assert got == [(1, 1, 1), (1, 1, 1), (2, 2, 2), (4, 2, 1)]
    assert [(r.id, r.matches) for r in temporal.window_assign(events, windows).where("window_id is null").collect()] == [(3, 0)]


def test_fragments_against_all_pairs(spark):
    """Words within words, ends and starts of words, phrases of three words, short ones, names that differ or are many."""
    rng = random.Random(5)
    parts = ["port", "report", "reporter", "ports", "able", "table", "tables", "unable", "era", "opera", "term", "terms", "ab", "x'-y", "lesson"]
    topics = sorted({" ".join(rng.choice(parts) for _ in range(rng.choice([1, 1, 2, 2, 2, 3]))) for _ in range(260)} | {"tables term", "able ter", "port table ter", " able", "able "})
    rows = [(f"{lang}:{t}", t, lang, n, n, [f"s{k}" for k in rng.sample(range(90), n)] if rng.random() < 0.2 else ["s1", "s2", "s3"][:n]) for t in topics for lang in ("en", "zh-CN") for n in [rng.choice([1, 2, 3])]]
    df = spark.createDataFrame(rows, "topic_key string, topic string, topic_language string, source_count long, mention_count long, source_names array<string>")
    wanted = {a[0] for a in rows if not any(len(a[1]) >= 4 and len(b[1]) > len(a[1]) and a[1] in b[1] and a[2] == b[2] and set(a[5]) <= set(b[5]) for b in rows)}
    got = {r.topic_key for r in trends.fragment_consolidation(df).collect()}
    assert got == wanted and len(wanted) < len(rows)
    plan = trends.contained(spark.createDataFrame([], "topic_key string, topic string, topic_language string, len int, n int, names_set long"))
    assert plan.count() == 0


def test_fragment_goes_by_names_alone(spark):
    rows = [("en:solar", "solar", "en", "term", ["A"], 3, 5), ("en:solar flare", "solar flare", "en", "phrase", ["A", "B"], 2, 4), ("en:flares", "flares", "en", "term", ["C"], 2, 4), ("en:lar fla", "olar flar", "en", "phrase", ["B"], 2, 2)]
    table = spark.createDataFrame(rows, "topic_key string, topic string, topic_language string, topic_kind string, source_names array<string>, source_count long, mention_count long")
    assert {r.topic for r in trends.fragment_consolidation(table).collect()} == {"solar flare", "flares"}


def test_state_ties_do_not_depend_on_order(spark):
    rows = [("a", 1, "x"), ("a", 1, "y"), ("a", 0, "z"), ("b", 2, "x")]
    one, other = (spark.createDataFrame(r, "k string, n int, s string").coalesce(1) for r in (rows, rows[::-1]))
    state = lambda t: sorted((r.k, r.s) for r in closure.current_state(t, "k", "n").collect())
    assert state(one) == state(other)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 100), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 100: 50}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_nominal_windows_meet(spark):
    got = sorted((r.start, r.end, r.edition) for r in planning.nominal_windows("2024-01-02", "2024-01-04", spark).select(F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "edition").collect())
    assert got[0] == ("2024-01-01 11:00:00", "2024-01-02 00:00:00", "morning") and got[1] == ("2024-01-02 00:00:00", "2024-01-02 11:00:00", "evening")
    assert all(a[1] == b[0] for a, b in zip(got, got[1:]))


def test_windows_that_start_together_go_by_id(spark):
    """In either order of rows: by id, the windows of series 1 meet or overlap in one way only; a null start comes last."""
    rows = [(1, 1, 0, 9), (1, 2, 0, 2), (1, 3, 2, 4), (2, 1, None, 9), (2, 2, 5, 6)]
    for given in (rows, rows[::-1]):
        windows = spark.createDataFrame(given, "series int, id int, start int, end int").coalesce(1)
        for contiguous in (False, True):
            got = sorted((r.series, r.id, r.error) for r in temporal.windows_validate(windows, contiguous).collect())
            assert got == [(1, 1, "WINDOWS_OVERLAP")], given


def test_first_supplier_of_lines_that_share_a_number(spark, tmp_path):
    """Ties go to the first row of the table, whatever the order of tasks; lines without a supplier are passed over."""
    rows = [(i % 50, 1000 + i, 5, 1, i) for i in range(5000)] + [(7, None, 1, 1, -1), (99, None, 1, 1, -2)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_orderkey long, l_linenumber int, i int").coalesce(1).write.option("parquet.block.size", 4096).parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = {r.l_partkey: r.first_supplier for r in catalog.QUERIES["dedup_union"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {**{i: 1000 + i for i in range(50)}, 99: None}


def test_keys_of_one_side_alone_are_found_without_a_join(spark):
    df = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k int")
    found = closure.closure_anti(df(1, 1, 2, None), df(2, 3, 3, None), "k")
    assert sorted(map(str, found.collect())) == sorted(map(str, df(1).selectExpr("k", "'undecided' as side").collect() + df(3).selectExpr("k", "'unexpected' as side").collect() + spark.sql("select cast(null as int) as k, explode(array('undecided', 'unexpected')) as side").collect()))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_fronts_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (2, 3.0, 1.0), (3, 1.0, 3.0), (4, 1.0, 1.0), (5, None, 9.0), (6, 3.0, 0.0), (7, 0.0, 3.0)], "k int, a double, b double")
    got = {r.k: r.front for r in planning.pareto_fronts(df, "k", "a", "b", 2).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 2, 4: 2, 7: 2}
    assert planning.pareto_fronts(df.where("k > 9"), "k", "a", "b", 2).count() == 0


MEMBERS = [(f"u{i}", f"m{i}", i, None, None, i == 1) for i in (1, 2, 3)]
DOC = "set_id string, expected_count int, members array<struct<unit_id:string,member_key:string,ordinal:int,page_key:string,shard_key:string,continuation_expected:boolean>>, decisions array<struct<decision_id:string,unit_id:string,outcome:string,reason_code:string,continuation_closed:boolean>>, receipts array<struct<receipt_id:string,decision_id:string,unit_id:string>>, outputs array<struct<artifact_id:string,decision_id:string,receipt_id:string>>"


def closed_set():
    return [3, MEMBERS, [(f"d{i}", f"u{i}", "success", None, True) for i in (1, 2, 3)], [(f"r{i}", f"d{i}", f"u{i}") for i in (1, 2, 3)], [(f"a{i}", f"d{i}", f"r{i}") for i in (1, 2, 3)]]


def test_response_set_mutations(spark):
    """A whole set holds in any order of its arrays; each row left out in turn breaks it."""
    rows = [("whole", *closed_set()), ("turned", *[x[::-1] if isinstance(x, list) else x for x in closed_set()])]
    for at in range(1, 5):
        for i in range(3):
            parts = closed_set()
            parts[at] = parts[at][:i] + parts[at][i + 1:]
            rows.append((f"drop-{at}-{i}", *parts))
    df = spark.createDataFrame(rows, DOC)
    stated = df.where("set_id = 'whole'").select(registers.member_set_hash(F.col("members"))).first()[0]
    broken = {r.set_id for r in registers.response_set_closure(df.withColumn("member_set_hash", F.lit(stated))).collect()}
    assert broken == {f"drop-{a}-{i}" for a in range(1, 5) for i in range(3)}


def test_purposes(spark):
    df = spark.createDataFrame([("O_model:acme", "allow", ["rights_grant", "authorized_scope", "purpose_authorization", "provider_identity"]), ("O_model:local", "allow", None), ("O_train:a,b", "deny", []), ("O_none", "allow", [])], "purpose string, authorization string, claims array<string>")
    got = {r.purpose: (r.decision, r.reason_code, len(r.missing_claims)) for r in rules.purpose_eligibility(df).collect()}
    assert got == {"O_model:acme": ("allow", None, 0), "O_model:local": ("deny", "PURPOSE_MODEL_DENIED", 4), "O_train:a,b": ("deny", "PURPOSE_TRAIN_DENIED", 6), "O_none": ("deny", "PURPOSE_UNKNOWN", 0)}


def test_catalog_closes(spark):
    definitions = spark.createDataFrame([(1, t, r, t * 10 + r, 1, "P0", "p") for t in (1, 2) for r in (1, 2)], "catalogue_id int, test_id int, revision int, definition_id int, phase int, severity string, policy string")
    members = spark.createDataFrame([(1, 12, "applicable"), (1, 22, "applicable")], "catalogue_id int, definition_id int, membership string")
    stated = hashlib.sha256(b"12|applicable\n22|applicable").hexdigest()
    one = spark.createDataFrame([(1, 1, "p", stated)], "catalogue_id int, target_phase int, policy string, stated_hash string")
    assert registers.catalog_closure(one, definitions, members).first().closed
    assert not registers.catalog_closure(one, definitions, members.where("definition_id = 12")).first().closed


def test_streams(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, 10), (1, 1, 20), (1, 2, 30), (2, 1, 40)], "item_id int, version_id int, s long").withColumn("ts", F.timestamp_seconds("s"))
    rows = [(f"k{i}", s, s, "en", "R", "quantum battery", "", f"u{i}", None, None) for i, s in enumerate("aabc")]
    rows.append(("later", "z", "z", "en", "R", "something else", "", "u", None, None))  # closes the windows
    at = F.when(F.col("item_key") == "later", "2024-01-09 10:00:00").otherwise("2024-01-02 10:00:00")
    topics = spark.createDataFrame(rows, ITEM).withColumn("published_at", at.cast("timestamp"))
    for name, df, query in (("events", events, streams.replay_dedup_stream), ("topics", topics, streams.trend_stream)):
        df.write.parquet(f"file://{tmp_path}/{name}")
        out = query(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/{name}"))
        out.writeStream.format("memory").queryName(f"s_{name}").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/c_{name}").trigger(availableNow=True).start().awaitTermination(120)
    assert {(r.item_id, r.version_id) for r in spark.table("s_events").collect()} == {(1, 1), (1, 2), (2, 1)} and spark.table("s_events").count() == 3
    got = [(r.mention_count, r.recent_mention_count, r.prior_mention_count, r.source_count, r.signal_state) for r in spark.table("s_topics").where("topic_key = 'en:quantum battery'").collect()]
    assert got == [(4, 4, 0, 3, "new")]  # recent in one of the four windows


def run_by_file(spark, query, rows, tmp_path, name, mode="append"):
    """Each of ``rows`` (tables in order of time) as a file and a batch; the query's progress per batch."""
    for i, df in enumerate(rows):
        df.coalesce(1).write.parquet(f"file://{tmp_path}/{name}/part={i:03d}")
    source = spark.readStream.schema(rows[0].schema).option("maxFilesPerTrigger", 1).parquet(*[f"file://{tmp_path}/{name}/part=*"])
    done = query(source).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/c_{name}").start()
    done.processAllAvailable()
    progress = [p for p in done.recentProgress]
    done.stop()
    return progress


def test_replay_status_stream_keeps_gaps_and_forgets_keys(spark, tmp_path):
    schema = "ts timestamp, source string, item_id string, version_id string, sequence long, cursor_gap boolean, arrival_order long"
    made = [("2024-01-01 00:00:00", "a", "i1", "v1", 5, False), ("2024-01-01 00:10:00", "a", "i1", "v1", 4, None), ("2024-01-01 00:20:00", "b", "i1", "v1", 1, False),
            ("2024-01-01 00:30:00", "a", "i2", "v1", 9, True), ("2024-01-01 05:00:00", "a", "i3", "v1", 10, False), ("2024-01-01 10:00:00", "b", "i9", "v1", 2, False), ("2024-01-01 15:00:00", "b", "i9", "v2", 2, False)]
    every = spark.createDataFrame([(*r, i) for i, r in enumerate(made)], schema.replace("ts timestamp", "ts string")).withColumn("ts", F.col("ts").cast("timestamp"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKSDB)
    try:
        progress = run_by_file(spark, lambda df: streams.replay_status_stream(df, "source"), [every.where(F.col("arrival_order") == i) for i in range(len(made))], tmp_path, "replayed", "update")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    rows = spark.table("replayed").collect()
    last = {g: max((r for r in rows if r.group == g), key=lambda r: r.events) for g in "ab"}
    batch = {r.source: r for r in temporal.replay_dedup(every, "source").collect()}
    for g in "ab":
        assert (last[g].arrivals, last[g].suppressed, last[g].watermark_reason, last[g].out_of_order) == (batch[g].arrivals, batch[g].suppressed, batch[g].watermark_reason, batch[g].out_of_order)
    assert last["a"].watermark_reason == "COLLECTION_MISSING" and last["a"].watermark_status == "healthy" and last["b"].watermark_reason is None
    assert any(r.group == "a" and r.watermark_status == "COLLECTION_MISSING" for r in rows)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert held[-1] < max(held), held


def test_replay_state_is_called_a_few_times_a_group():
    """However many pairs a batch holds: one read, one addition and one timer; repeats renew the list, expiry drops pairs."""
    calls, held = [], []

    class Held:
        def __init__(self, name):
            self.name = name

        def __getattr__(self, what):
            def call(*a):
                calls.append(f"{self.name}.{what}")
                if self.name == "seen":
                    if what == "get":
                        return iter(list(held))
                    held[:] = {"put": lambda: list(a[0]), "appendList": lambda: [*held, *a[0]], "clear": list}[what]()
                elif what == "get":
                    return totals[-1] if totals else None
                elif what == "update":
                    totals.append(a[0])
            return call

    class Handle:
        getValueState = lambda self, *a: Held("totals")
        getListState = getMapState = lambda self, *a: Held("seen")
        registerTimer = lambda self, at: timers.append(at)

    totals, timers, replay = [], [], streams._Replay(100)
    replay.init(Handle())
    rows = lambda ms: iter([streams.pd.DataFrame({"item_id": [f"i{k}" for k in range(50)], "version_id": "v", "sequence": range(50), "sequence_order": range(50), "cursor_gap": False, "at_ms": [ms + k for k in range(50)]})])
    counts = [next(iter(replay.handleInputRows(("a",), rows(ms), None))) for ms in (0, 10, 20, 30)]
    assert [c["arrivals"][0] for c in counts] == [50] * 4 and [c["suppressed"][0] for c in counts] == [0, 50, 100, 150]
    assert len(calls) <= 16 and len(timers) == 4 and len(held) <= 100 and timers[-1] == 130
    expired = type("E", (), {"getExpiryTimeInMs": lambda self: 154})()
    assert not list(replay.handleExpiredTimer(("a",), None, expired)) and len(held) == 25 and timers[-1] == 155


def test_trend_stream_tells_each_window_once_and_drops_it(spark, tmp_path):
    at = lambda h: spark.createDataFrame([(f"k{h}{s}", s, s, "en", "R", f"quantum battery number{h}", "", f"u{h}{s}", h) for s in "ab"], ITEM.replace("published_at timestamp, fetched_at timestamp", "h int")).withColumn("published_at", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600)).withColumn("fetched_at", F.col("published_at")).drop("h")
    progress = run_by_file(spark, streams.trend_stream, [at(h) for h in range(0, 120, 6)], tmp_path, "topics_by_file")
    rows = spark.table("topics_by_file").where("topic_key = 'en:quantum battery'").collect()
    starts = [r.window.start for r in rows]
    assert len(starts) == len(set(starts)) and len(starts) >= 4
    assert {r.mention_count for r in rows} == {4, 8, 12, 16}
    held = [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress if p["stateOperators"]]
    assert max(held[len(held) // 2 :]) <= 1.2 * max(held[: len(held) // 2]) and sum(o["numRowsRemoved"] for p in progress for o in p["stateOperators"]) > 0


def test_windows_open_at_the_end_of_a_stream_are_told(spark):
    """Panes of two batches, the second late, add up; an item at hour 47 opens windows that no later item closes."""
    made = [("a", "en", "quantum battery", 47.0), ("b", "en", "quantum battery", 1.0), ("b", "en", "quantum battery", 30.0), ("a", "en", "lonely topic", 2.0), (None, "en", "lonely topic", 3.0)]
    panes = streams.trend_panes(item(spark, made[:2])).unionByName(streams.trend_panes(item(spark, made[2:])))
    got = sorted((str(r.window_start), r.recent_mention_count, r.prior_mention_count, r.source_count, r.signal_state) for r in streams.trend_windows(panes).where("topic_key = 'en:quantum battery'").collect())
    assert got == [("2023-12-31 00:00:00", 1, 1, 2, "watching"), ("2024-01-01 00:00:00", 1, 2, 2, "watching")]
    assert streams.trend_windows(panes).where("topic_key like '%lonely%'").count() == 0
    assert "max(published_at)" not in catalog.ORACLES["trend_stream"]


def test_source_registry(spark, tmp_path):
    path = tmp_path / "sources.json"
    path.write_text('{"sources": [{"id": "a", "url": "u1"}, {"id": "b", "url": "u2", "enabled": false}, {"id": "c", "url": "u3", "enabled": true}]}')
    ids = lambda wanted=None: sorted(r.id for r in feeds.read_sources(spark, f"file://{path}", wanted).collect())
    assert ids() == ["a", "c"] and ids(["b"]) == ["b"] and ids(["x"]) == []


def test_fdr_branches(spark):
    rows = [("p", 0.01, False, None), ("p", 0.5, True, None), ("range", 1.5, True, None), ("alarm", None, None, True), ("alarm", 0.2, None, False), ("silent", None, None, None)]
    got = {r.scan_id: r for r in signals.fdr_scan(spark.createDataFrame(rows, "scan_id string, p_value double, gold_anomaly boolean, false_alarm boolean"), 0.5).collect()}
    assert (got["p"].q_value, got["p"].discoveries, got["p"].false_discoveries, got["p"].rate, got["p"].decision) == (0.02, 1, 1, 1.0, False)
    assert got["range"].error == "P_RANGE" and got["range"].decision is None and got["silent"].error == "FALSE_ALARM_MISSING"
    assert (got["alarm"].detector_type, got["alarm"].rate, got["alarm"].decision, got["alarm"].q_value) == ("non_probability", 0.5, True, None)


def test_membership_of_nothing(spark):
    frames = [spark.createDataFrame([], s) for s in (
        "unit_id int, snapshot_id int, member_role string, subject_kind string, subject_key string", "unit_id int, decision string, member_kind string", "unit_id int, member_kind string, member_key string",
        "snapshot_id int, member_role string, subject_kind string, member_kind string, member_key string", "profile_id int, member_role string, subject_kind string, member_kind string")]
    row = closure.membership_closure(spark.createDataFrame([(1, None)], "snapshot_id int, profile_id int"), *frames).first()
    assert not row.closed and sum(row[c] for c in closure.MEMBERSHIP_COUNTERS) == 0


def test_lineage_origins(spark):
    items = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (3, "a"), (4, None), (5, None)], "doc_id int, source string")
    lineages = spark.createDataFrame([(1, 1), (2, 1), (4, 9)], "doc_id int, lineage_id int")
    got = {r.source: (r["items"], r.origins, r.largest) for r in coverage.lineage_origins(items, lineages, "doc_id", "source").collect()}
    assert got == {"a": (4, 2, 2), None: (2, 2, 1)}


def test_medians_against_python(spark):
    rows = [(s, float(random.Random(s * 100 + i).randrange(9))) for s in range(5) for i in range(s + 1)] + [(9, None)]
    got = {r.s: r.m for r in measures.medians(spark.createDataFrame(rows, "s int, v double"), "s", "v", "m").collect()}
    assert got == {s: statistics.median(v for k, v in rows if k == s) for s in range(5)}


def test_two_sided_cusum_against_the_recursion(spark):
    r = random.Random(4)
    series = {"flat": [5] * 12, "rise": [3 + r.random() for _ in range(10)] + [8 + r.random() for _ in range(10)], "fall": [9 + r.random() for _ in range(8)] + [2 + r.random() for _ in range(8)], "one": [7]}
    rows = [(k, 10 * i, float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    got = {(x.s, x.b): x for x in measures.cusum(spark.createDataFrame(rows, "s string, b int, n double").repartition(3), "s", "b", "n", 0.5, 2.0).collect()}
    for k, xs in series.items():
        mean, sd = statistics.mean(xs), statistics.pstdev(xs)
        up = down = 0.0
        since = {"UP": 0, "DOWN": 0}
        for i, x in enumerate(xs):
            z = round((x - mean) / sd, 9) if sd else 0.0
            up, down = max(0.0, up + z - 0.5), max(0.0, down - z - 0.5)
            for side, value in (("UP", up), ("DOWN", down)):
                since[side] = 10 * (i + 1) if round(value, 6) == 0 else since[side]
            row = got[k, 10 * i]
            alarm = "UP" if round(up, 6) > 2 else "DOWN" if round(down, 6) > 2 else None
            assert math.isclose(row.up, up, abs_tol=2e-6) and math.isclose(row.down, down, abs_tol=2e-6) and row.alarm == alarm
            assert row.change_start == (since[alarm] if alarm else None)
    assert {got["rise", 190].alarm, got["fall", 150].alarm} == {"UP", "DOWN"} and got["rise", 190].change_start == 100


def test_scales_and_slots_on_a_made_series(spark):
    end, first = 490_000, 490_000 - 24 * 40
    hours = [(h, 6 if h % 24 == 3 else 1) for h in range(first, end)] + [(end - 1, 50)]
    rows = [("s", 3600 * h, n) for h, n in hours]
    events = spark.createDataFrame(rows, "k string, t long, n int").select("k", F.explode(F.array_repeat(F.timestamp_seconds("t"), F.col("n"))).alias("ts"))
    counts = measures.hourly(events, "k", "ts")
    got = {r.hours: r for r in measures.multi_scale(counts, "k", F.timestamp_seconds(F.lit(3600 * end))).collect()}
    assert (got[1].current, got[1].baselines, got[1].median, got[1].robust_z) == (51, 14, 1.0, None)
    assert got[24].current == 24 + 5 + 50 and got[24].baselines == 4 and got[24].median == 29.0
    assert got[168].baselines == 4 and got[168].status == "warming" and got[672].baselines == 0 and got[672].median is None
    slots = {r.hour: r for r in measures.spike_robust(counts, "k").collect()}
    usual = next(h for h in range(first + 24 * 20, end) if h % 24 == 3)
    assert slots[usual].median == 6.0 and slots[usual].baselines == 14 and slots[first].baselines == 0 and slots[first].median is None
    assert slots[end - 1].median == 1.0


def test_sweep_against_all_pairs(spark):
    r = random.Random(6)
    spans = [(i, *sorted((r.randint(0, 300), r.randint(0, 300)))) for i in range(60)] + [(100, None, 40), (101, 250, None), (102, None, None), (103, 90, 80), (104, 77, 77)]
    marks = [(i, r.randint(-20, 320)) for i in range(300)] + [(900, None), (5, 77), (5, 77)]
    at = lambda c: F.timestamp_seconds(F.col(c))
    windows = spark.createDataFrame(spans, "id int, a long, b long").select("id", at("a").alias("start"), at("b").alias("end"))
    events = spark.createDataFrame(marks, "event int, s long").withColumn("ts", at("s")).repartition(3)
    got = sorted((x.event, str(x.s), str(x.window_id), str(x.e), x.matches) for x in temporal.window_assign(events, windows).withColumn("e", F.unix_timestamp("window_end")).collect())
    want = []
    for event, t in marks:
        held = [(i, b) for i, a, b in spans if t is not None and (a is None or a <= t) and (b is None or t < b)]
        ends = [b for _, b in held]
        want.append((event, str(t), str(min((i for i, _ in held), default=None)), str(None if not ends or None in ends else max(ends)), len(held)))
    assert got == sorted(want)
    assert temporal.window_assign(events.limit(0), windows).count() == 0 and {x.matches for x in temporal.window_assign(events, windows.limit(0)).collect()} == {0}


def test_relation_breaks_where_two_series_part(spark):
    r = random.Random(8)
    rows = []
    for week in range(40):
        for _ in range(30):
            x = r.random()
            rows.append(("k", week, x, x + 0.1 * r.random() if week < 30 else -x + 0.1 * r.random()))
    rows += [("k", 3, None, 1.0), ("still", 1, 2.0, 3.0), ("still", 2, 2.0, 4.0)]
    got = {(x.k, x.w): x for x in measures.relation_break(spark.createDataFrame(rows, "k string, w int, a double, b double").repartition(3), "k", "w", "a", "b", 4).collect()}
    assert got["k", 20].status == "holds" and got["k", 35].status == "broken" and got["k", 5].status == "warming" and got["still", 2].now is None
    mine = [(a, b) for _, w, a, b in rows[:1200] if 17 <= w <= 20]
    assert math.isclose(got["k", 20].now, statistics.correlation(*zip(*mine)), rel_tol=1e-9)


def test_canonical_json_goes_by_keys_alone(spark):
    import json

    from signalframe.functions.canonical import canonical_json

    kind = "s struct<zz:int,b:array<struct<y:string,x:double>>,a:map<string,array<long>>,t:string,f:boolean>"
    value = {"zz": None, "b": [{"y": 'q"é\\\n', "x": 1.5}, None], "a": {"k2": [3, None], "é": [], "k": None, "k10": [1]}, "t": "漢/", "f": True}
    df = spark.createDataFrame([(value,), (None,)], kind)
    one, none = df.select(canonical_json(F.col("s"), df.schema["s"].dataType).alias("j"), canonical_json(F.col("s"), df.schema["s"].dataType, jsonb=True).alias("b")).collect()
    assert one.j == json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":")) and none.j == none.b == "null"
    assert one.b == '{"a": {"k": null, "k2": [3, null], "é": [], "k10": [1]}, "b": [{"x": 1.5, "y": "q\\"é\\\\\\n"}, null], "f": true, "t": "漢/", "zz": null}'


def test_set_hash_vector_and_missing_domain(spark):
    rows = spark.createDataFrame([({"b": 1, "a": [2]}, "x", None, {"rights": 2, "global": 1})], "p struct<b:int,a:array<int>>, g string, r string, e map<string,int>")
    got = rows.select(rules.revocation_set_hash(rows, {"personal": "p", "global": "g", "rights": "r"}, "e").alias("h")).first().h
    assert got == hashlib.sha256(b'{"global":"x","personal":{"a":[2],"b":1},"rights":null,"epochs":{"global":1,"rights":2}}').hexdigest()
    with pytest.raises(ValueError, match="domains missing"):
        rules.revocation_set_hash(rows, {"personal": "p", "global": "g"}, "e")


def test_rules_of_tables_that_are_not_given_are_left_out(spark):
    t = spark.createDataFrame([(1, None, None), (2, "selected", "card")], "id int, decision string, selected_member_kind string").withColumn("selected_member_key", F.lit(None).cast("string"))
    assert [tuple(r) for r in closure.broken_rules({"decision": (t, "id")}).collect()] == [("decision", "2", "member_of_selected")]
    with pytest.raises(ValueError):
        closure.broken_rules({"unknown": (t, "id")})


def test_similar_sets_lose_no_pair(spark, monkeypatch):
    from signalframe.operators import similarity

    r = random.Random(12)
    made = []
    for k in range(12):
        base = [f"w{r.randrange(60)}" for _ in range([3, 6, 20, 150][k % 4])]
        for _ in range(8):  # crowded: all of a family share most of their shingles
            words = list(base)
            for _ in range(r.randrange(0, 3)):
                words[r.randrange(len(words))] = f"n{r.randrange(10)}"
            made.append(" ".join(words) + " tail" * r.randrange(0, 2))
    made += [None, "", " \t", "One two", "one TWO", "É one two three four five", "é one two three four five"]
    lower = str.maketrans(similarity.UPPER, similarity.LOWER)

    def plain(text):
        w = (text or "").translate(lower).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()

    sets = {i: plain(t) for i, t in enumerate(made)}
    df = spark.createDataFrame(list(enumerate(made)), "id int, text string").repartition(5)
    for chunk in (1024, 3):
        monkeypatch.setattr(similarity, "CHUNK", chunk)
        hashed = df.select("id", similarity.shingles(F.col("text")).alias("shingles")).withColumn("sid", F.xxhash64("shingles")).cache()
        sid = {x.id: x.sid for x in hashed.collect()}
        assert len(set(sid.values())) == len(set(sets.values()))
        got = {(x.u, x.v) for x in similarity.similar_pairs(hashed.select("sid", "shingles").dropDuplicates(["sid"])).collect()}
        want = {(min(sid[i], sid[j]), max(sid[i], sid[j])) for i in sets for j in sets if sid[i] != sid[j] and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
        assert got == want and len(want) > 50
    lines = {x.id: x.lineage_id for x in similarity.lineages(df, "id").collect()}
    assert len(lines) == len(made) and lines[96] == lines[97] == lines[98] and lines[99] == lines[100] and lines[101] != lines[102]
    assert similarity.lineages(df.limit(0), "id").count() == 0
