"""Secret scans in DataFrame expressions only.

Base spans come from three patterns. The method adds tokens that a randomness battery tells from prose. For each
token of 20 or more key characters (shorter mixed ones, such as dates and numbered names, are beyond what these tests can
tell from keys) the narrowest encoding that holds it is inferred; then, per encoding,

* chi-squared uniformity of its alphabet: X2 as low as the token's would be rare for text of that length,
* a runs test on character classes: as many changes of class would be rare for text of that length (Chernoff bound),
* lag-1 serial correlation and runs about the alphabet's middle: neither may contradict a uniform source.

The first two are p-values under "this is prose", joined by Fisher's method. Benjamini-Hochberg control runs within
bands of token length (tokens of digits alone count there but are never accepted, since numbers are as even), over counts of p-values on a fixed grid, so corpora of any size need only the counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalframe.llm.common import narrowed
from signalframe.scratch import written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
MIN_VALUE, MIN_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "random")
FDR = 0.001
GRID = 0.5  # of -ln p
DEEPEST = 200
PROSE_COINCIDENCE = 0.065  # chance that two letters of European prose agree
PROSE_CHANGES = 0.05  # share of neighbours in prose tokens whose class differs
VETO = 3.5
MASK = "[SECRET]"
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Narrowest first: pattern, alphabet in order.
ENCODINGS = (
    ("[0-9]+", DIGITS),
    ("[0-9a-f]+", DIGITS + LOWER[:6]),
    ("[0-9A-F]+", DIGITS + UPPER[:6]),
    ("[a-z]+", LOWER),
    ("[A-Z]+", UPPER),
    ("[A-Z2-7]+", UPPER + DIGITS[2:8]),
    ("[0-9a-z]+", DIGITS + LOWER),
    ("[0-9A-Z]+", DIGITS + UPPER),
    ("[A-Za-z]+", UPPER + LOWER),
    ("[0-9A-Za-z]+", DIGITS + UPPER + LOWER),
    ("[0-9A-Za-z+/]+", UPPER + LOWER + DIGITS + "+/"),
    (".*", UPPER + LOWER + DIGITS + "-_+/"),
)


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once."""
    return F.transform(F.array(value), body)[0]


def _sum(values: Column, of=lambda x: x) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + of(x).cast("double"))


def _numbers(token: Column, alphabet: Column) -> Column:
    """Struct of the token's test figures."""

    def figures(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        size = F.length(alphabet).cast("double")
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.length(token) - F.length(F.replace(token, c, F.lit(""))), F.lit(2.0))
        )
        index = F.transform(chars, lambda c: F.instr(alphabet, c))
        classes = F.transform(chars, lambda c: F.when(c.between("0", "9"), 0).when(c.between("a", "z"), 1).when(c.between("A", "Z"), 2).otherwise(3))
        return F.struct(n.alias("n"), size.alias("a"), squares.alias("sq"), index.alias("x"), classes.alias("k"))

    return let(F.split(token, ""), figures)


def _neighbours(values: Column, what) -> Column:
    """Sum of ``what(left, right)`` over neighbours."""
    n = F.size(values)
    return _sum(F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: what(a, b).cast("double")))


def _encoding(token: Column) -> Column:
    picked = F.when(token.rlike(f"^{ENCODINGS[0][0]}$"), ENCODINGS[0][1])
    for pattern, alphabet in ENCODINGS[1:]:
        picked = picked.when(token.rlike(f"^(?:{pattern})$"), alphabet)
    return picked


def evidence(token: Column) -> Column:
    """-ln of the token's p-value under "prose of this length"; 0 where the battery contradicts a uniform source."""

    def judged(f: Column) -> Column:
        n, a, x = f["n"], f["a"], f["x"]
        chi = a / n * f["sq"] - n
        uniform_z = (chi - (a - 1)) / F.sqrt(2 * (a - 1))
        extra = n * F.greatest(a * PROSE_COINCIDENCE - 1, F.lit(0.0))
        prose_z = (chi - (a - 1) - extra) / F.sqrt(2 * (a - 1) + 4 * extra)
        chi_log = F.when(prose_z < 0, prose_z * prose_z / 2 + 0.6931471805599453).otherwise(0.0)
        changes = _neighbours(f["k"], lambda p, q: p != q)
        share = F.least(changes / (n - 1), F.lit(0.999999))
        bound = (n - 1) * (share * F.ln(share / PROSE_CHANGES) + (1 - share) * F.ln((1 - share) / (1 - PROSE_CHANGES)))
        runs_log = F.when(share > PROSE_CHANGES, bound).otherwise(0.0)
        joint = chi_log + runs_log
        fisher = joint - F.log1p(joint)
        mean = _sum(x) / n
        spread = _sum(x, lambda v: (v - mean) * (v - mean))
        serial_z = F.when(spread > 0, _neighbours(x, lambda p, q: (p - mean) * (q - mean)) / spread).otherwise(1.0) * F.sqrt(n)
        middle = (a + 1) / 2
        crossings_z = (_neighbours(x, lambda p, q: (p > middle) != (q > middle)) - (n - 1) / 2) / F.sqrt((n - 1) / 4)
        random_like = (F.abs(uniform_z) < VETO) & (F.abs(serial_z) < VETO) & (F.abs(crossings_z) < VETO)
        return F.when(random_like & (a > 10), F.greatest(fisher, F.lit(0.0))).otherwise(0.0)

    return let(_encoding(token), lambda alphabet: let(_numbers(token, alphabet), judged))


def band(token: Column) -> Column:
    return F.floor(F.log2(F.length(token).cast("double"))).cast("int")


def _parts(text: Column, pattern: str, group: int = 0) -> Column:
    """The pattern's matches with the gap before each: (gap, token, value); null without a match."""
    every = F.transform(
        F.arrays_zip(F.split(text, pattern).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("token"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")),
        lambda p: F.struct(p["gap"].alias("gap"), p["token"].alias("token"), p["value"].alias("value")),
    )
    return F.when(text.rlike(pattern), every)


PATTERNS = ((ASSIGN, 1), (ACCESS, 0), (HEX, 0), (TOKEN, 0))


MATCH = "array<struct<kind:int,at:int,gap:int,len:int,vlen:int,token:string>>"


def _tagged(parts: Column, kind: int) -> Column:
    def one(m: Column, i: Column) -> Column:
        sizes = [F.length(m[x]).alias(y) for x, y in (("gap", "gap"), ("token", "len"), ("value", "vlen"))]
        return F.struct(F.lit(kind).alias("kind"), i.alias("at"), *sizes, F.when(F.lit(kind == 3), m["token"]).alias("token"))

    return F.coalesce(F.transform(parts, one).cast(MATCH), F.array().cast(MATCH))


def _found(docs: DataFrame) -> DataFrame:
    """A row per match and kind, with code-point offsets (failing ones too), and one bare row per document without any."""
    text = F.col("text")
    tagged = [_tagged(_parts(text, pattern, group), k) for k, (pattern, group) in enumerate(PATTERNS)]
    numbered = narrowed(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    rows = numbered.select("row", "doc_id", F.explode_outer(F.concat(*tagged)).alias("m"))
    rows = written(rows.select("row", "doc_id", "m.*").where("kind is null or len is not null"), "secret-parts")
    upto = Window.partitionBy("row", "kind").orderBy("at")
    return rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))


def thresholds(tokens: DataFrame) -> dict[int, float]:
    """Per length band the least -ln p to accept: Benjamini-Hochberg at level FDR on the grid. A band is a power of two."""
    cell = F.least(F.floor(evidence(F.col("token")) / GRID), F.lit(int(DEEPEST / GRID))).cast("int")
    counts = tokens.select(band(F.col("token")).alias("band"), cell.alias("cell")).groupBy("band", "cell").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("band")
    deep = counts.withColumn("all", F.sum("n").over(whole)).withColumn("passed", F.sum("n").over(whole.orderBy(F.col("cell").desc())))
    good = deep.where(F.exp(-F.col("cell") * GRID) * F.col("all") <= FDR * F.col("passed"))
    return {r["band"]: r["cell"] * GRID for r in good.groupBy("band").agg(F.min("cell").alias("cell")).collect()}


def accepted(token: Column, limits: dict[int, float]) -> Column:
    at_least = reduce(lambda c, kv: c.when(band(token) == kv[0], F.lit(kv[1])), sorted(limits.items()), F.when(F.lit(False), 0.0))
    return F.coalesce(F.floor(evidence(token) / GRID) * GRID >= at_least, F.lit(False))


def secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Spans are kind:start:end in code points, end exclusive, by start and then kind as listed. Null and empty texts have
    none (sha256 of nothing, empty spans). Texts are read whole at any length; repeated rows each come back; an empty
    table gives no rows; other columns are ignored.
    """
    found = _found(docs)
    limits = thresholds(found.where("kind = 3"))
    k = F.col("kind")
    valid = F.when(k == 0, F.col("vlen") >= MIN_VALUE).when(k == 1, F.col("len") >= MIN_ACCESS).when(k == 2, F.lit(True)).when(k == 3, accepted(F.col("token"), limits))
    span = F.when(F.coalesce(valid, F.lit(False)), F.struct("start", "kind", "end"))
    each = found.select("row", "doc_id", span.alias("s")).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list("s")).alias("s"))
    names = F.array(*map(F.lit, KINDS))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    count = lambda i: F.size(F.filter("s", lambda s: s["kind"] == i)).cast("long")
    return each.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(write(F.filter("s", lambda s: s["kind"] < 3)), 256).alias("base_sha256"), write(F.col("s")).alias("spans"), count(3).alias("n_random"),
    )


def masked(docs: DataFrame) -> DataFrame:
    """The documents with the union of their secrets' spans, as ``secrets`` reports them, replaced by MASK.

    Rows and columns stay, repeated rows too, and no character of any span is left; spans that overlap or touch become one
    MASK. Null and empty texts stay as they are; texts of any length are scanned whole, once: what was found is written
    beside the document. An empty table stays empty.
    """
    text = F.col("text").cast("string")
    tagged = F.concat(*[_tagged(_parts(text, pattern, group), k) for k, (pattern, group) in enumerate(PATTERNS)])
    scanned = written(docs.select(F.struct(*docs.columns).alias("doc"), F.filter(tagged, lambda m: m["len"].isNotNull()).alias("found")), "secret-scanned", "zstd")
    limits = thresholds(scanned.where(F.exists("found", lambda m: m["kind"] == 3)).select(F.explode("found").alias("m")).where("m.kind = 3").select("m.token"))
    valid = lambda m: F.when(m["kind"] == 0, m["vlen"] >= MIN_VALUE).when(m["kind"] == 1, m["len"] >= MIN_ACCESS).when(m["kind"] == 2, F.lit(True)).otherwise(accepted(m["token"], limits))
    judged = scanned.withColumn("found", F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), m["gap"].alias("gap"), m["len"].alias("len"), F.coalesce(valid(m), F.lit(False)).alias("hit"))))
    out = F.when(F.exists("found", lambda m: m["hit"]), _without_spans(F.col("doc.text"), F.col("found"))).otherwise(F.col("doc.text"))
    return judged.select(*[out.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def _without_spans(text: Column, found: Column) -> Column:
    """The text by characters: those in no span, and MASK where one is first in a run of spans."""
    size = F.length(text)

    def marks(kind: int) -> Column:
        runs = F.transform(F.filter(found, lambda m: m["kind"] == kind), lambda m: F.concat(F.repeat(F.lit("0"), m["gap"]), F.repeat(F.when(m["hit"], "1").otherwise("0"), m["len"])))
        return F.split(F.rpad(F.array_join(runs, ""), size, F.lit("0")), "")

    either = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y)), [marks(k) for k in range(len(PATTERNS))])

    def cut(mark: Column) -> Column:
        with_mark = F.zip_with(F.split(text, ""), mark, lambda c, m: F.struct(c.alias("c"), m.alias("m")))
        before = F.concat(F.array(F.lit("0")), F.slice(mark, F.lit(1), size - 1))
        return F.array_join(F.zip_with(with_mark, before, lambda x, b: F.when(x["m"] == "0", x["c"]).when(b == "0", MASK).otherwise("")), "")

    return let(either, cut)
