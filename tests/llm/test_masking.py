"""Masking against the spans that the scan reports: nothing of a span stays, nothing else goes."""

import random

from signalframe.llm import secrets


def union_masked(text, spans):
    inside = [False] * len(text)
    for span in filter(None, spans.split(",")):
        _, start, end = span.split(":")
        inside[int(start) : int(end)] = [True] * (int(end) - int(start))
    return "".join(secrets.MASK if m and not b else "" if m else c for c, m, b in zip(text, inside, [False, *inside]))


def test_no_character_of_a_span_stays(spark):
    r = random.Random(17)
    key = lambda n, chars="0123456789abcdef": "".join(r.choice(chars) for _ in range(n))
    full = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pieces = [
        lambda: "AKIAABCDEFGHIJTOKEN=abcdefghijklmnop", lambda: f"AKIA{key(16, full[:26])}", lambda: f"token={key(32)}", lambda: f'password: "{key(14, full)}"', lambda: key(24), lambda: key(40, full),
        lambda: f"secret=AKIA{key(20, full[:26])}{key(20)}", lambda: key(16) + "AKIA" + key(18, "0123456789"), lambda: "é漢\U0001f600", lambda: "word and other words", lambda: "token=short", lambda: "\n", lambda: "|", lambda: "01",
    ]
    made = [(i, "".join(r.choice(pieces)() + r.choice(["", " ", "."]) for _ in range(r.randint(1, 9)))) for i in range(300)]
    made += [(900, "AKIAABCDEFGHIJTOKEN=abcdefghijklmnop"), (901, None), (902, ""), (903, "x " * 40000 + f"token={key(32)}" + " y" * 40000), (904, f"token={key(32)}" * 300), (905, "plain"), (905, "plain")]
    docs = spark.createDataFrame([(i, t, "kept", 1, 2) for i, t in made], "doc_id long, text string, found string, len int, doc int").repartition(3)
    spans = {(x.doc_id): x.spans for x in secrets.secrets(docs).collect()}
    got = secrets.masked(docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert len(rows) == len(made) and all((x.found, x.len, x.doc) == ("kept", 1, 2) for x in rows)
    by = {x.doc_id: x.text for x in rows}
    for i, text in made:
        assert by[i] == (None if text is None else union_masked(text, spans[i])), (i, text[:200], spans[i][:200])
    assert by[900] == secrets.MASK and "random" in ",".join(spans.values())
    assert secrets.masked(docs.limit(0)).count() == 0
