"""Column functions: tokens, cleaning, times, keys, intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and characters that are never topics, and the two-character topics that are.
STOP_EN = """
about after again against being between could first from have into more most other
over said says should than that their there these they this those through under were
what when where which while with would world news latest report reports people
killed fire police president shooting article articles story stories government
before office return update updates call calls days year years time times
child three four near amid been home authorities major live takes
start started died death kill attack
department announced provide assistance administration plans security
school himself
""".split()
STOP_HAN = """
中国 中方 我国 记者 报道 消息 表示 指出 相关 有关 今天 近日 日前 目前
此外 同时 以及 这是 进行 工作 发布 新闻 世界 国际 方面 现场 可能
北京 举行 联合 项目 国家 推动 大学 协会 参加 政府 登陆 发展 会议
市场 公司 企业 事件 经济 社会 期间 地方 班牙 计划 活动 组织
文章 中新网 新网 网杭州 今年 微信公众 微信 公众 合主办 联合主办 主办
""".split()
FUNCTION_HAN = "的 了 和 与 在 是 有 要 将 为 对 从 等 及 被 让 号".split()
SHORT_HAN = "台风 地震 战争 选举 制裁 关税 通胀 疫情 芯片 能源 气候 量子 人工 智能".split()
WORD_EN = "[a-z][a-z'-]{3,}"


def words_en(text: Column) -> Column:
    """Distinct words of four or more letters in first order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(WORD_EN), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOP_EN)))


def tokens_en(text: Column) -> Column:
    """Words and the pairs of neighbours in the distinct list."""
    def joined(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(F.size(w) > 1, F.concat(w, pairs)).otherwise(w)

    return F.transform(F.array(words_en(text)), joined)[0]


def tokens_han(text: Column) -> Column:
    """Character n-grams (2 to 4) of runs of Han characters, without stop words and function characters.

    Runs are cut where a token would hold one of those, so what is left needs no test: a function character is a gap, and a
    stop word "AB" becomes "A B", "ABC" becomes "AB BC". Of pairs only SHORT_HAN count, which are looked up.
    """
    bad = [*STOP_HAN, *FUNCTION_HAN]
    runs = F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FEF}\p{IsHan}]{2,}"), F.lit(0))  # the range is Han and quicker to tell
    left = F.translate(F.array_join(F.array_distinct(runs), " "), "".join(FUNCTION_HAN), " " * len(FUNCTION_HAN))
    stops = sorted({w for w in STOP_HAN if not any(b in w for b in bad if b != w)})
    for stop in (w for w in stops if len(w) > 2):
        left = F.replace(left, F.lit(stop), F.lit(f"{stop[:-1]} {stop[1:]}"))
    pairs = [w for w in stops if len(w) == 2]
    few = [pairs[i : i + 8] for i in range(0, len(pairs), 8)]  # a character is compared with those of its own range alone
    left = F.regexp_replace(left, f"(?={'|'.join(f'(?=[{w[0][0]}-{w[-1][0]}])(?:{'|'.join(w)})' for w in few)})[^ ]", "$0 ")
    short = [w for w in SHORT_HAN if not any(b in w for b in bad)]

    def grams(cut: Column) -> Column:
        found = F.array_compact(F.array(*[F.when(F.contains(cut, F.lit(w)), w) for w in short]))
        return F.array_distinct(F.concat(found, *[F.regexp_extract_all(cut, F.lit(f"(?=([^ ]{{{n}}}))[^ ]"), F.lit(1)) for n in (3, 4)]))

    return F.transform(F.array(left), grams)[0]  # so that a text is cut once


ENTITY = "&(apos|amp|quot|gt|lt|#[0-9]+|#[xX][0-9A-Fa-f]+);"
# The named references.
NAMED = {"apos": "'", "amp": "&", "quot": '"', "gt": ">", "lt": "<"}


def unescaped(text: Column) -> Column:
    """Named and numeric character references undone once, from left to right. One that names no character stays."""

    def character(name: Column) -> Column:
        hexa = F.upper(F.when(name.rlike("^#[xX]"), F.substring(name, 3, 1 << 20)).otherwise(F.conv(F.substring(name, 2, 1 << 20), 10, 16)))
        bare = F.regexp_replace(hexa, "^0+(?=.)", "")
        point = F.when(F.length(bare) <= 6, F.conv(bare, 16, 10).cast("long"))
        real = (point <= 0x10FFFF) & ~point.between(0xD800, 0xDFFF)
        known = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
        return F.coalesce(known[name], F.when(real, F.decode(F.unhex(F.lpad(bare, 8, "0")), "UTF-32")), F.concat(F.lit("&"), name, F.lit(";")))

    names = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(1)), character)
    whole = F.zip_with(F.split(text, ENTITY), names, lambda gap, c: F.concat(gap, F.coalesce(c, F.lit(""))))
    return F.when(text.rlike(ENTITY), F.array_join(whole, "")).otherwise(text)


def html_clean(text: Column) -> Column:
    """Tags become spaces, white space collapses, then character references are undone, in this order."""
    return unescaped(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " ")))


# Month names, and minutes east of Greenwich of the zone names that feeds use.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ZONES = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "hst": -600,
    "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180, "ist": 330, "hkt": 480, "sgt": 480, "jst": 540, "kst": 540, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}


def time_parse(text: Column) -> Column:
    """A date text as a timestamp, null when blank, without a date, or with one that does not exist.

    Dates: 2024-01-31, 2024/1/31, 20240131, 31 Jan 2024 (or 24), January 31, 2024. Times: with or without seconds and
    fractions (dropped), 12 or 24 hours. Zones: offsets and ZONES; UTC where none is named. No time of day is midnight.
    """
    low, month = F.lower(F.trim(text)), "(" + "|".join(MONTHS) + ")[a-z]*"
    shapes = (
        (r"(?<!\d)(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", (1, 2, 3)), (r"(?<!\d)(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)", (1, 2, 3)),
        (r"(?<!\d)(\d{1,2})(?:st|nd|rd|th)?[\s-]+" + month + r"\.?[\s,-]+'?(\d{4}|\d{2})(?![\d:])", (3, 2, 1)),
        (month + r"\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})(?!\d)", (3, 1, 2)), (r"(?<!\d)(\d{4})(\d{2})(\d{2})(?=t|\b)", (1, 2, 3)),
    )
    clock = r"(?<!\d)(\d{1,2}):(\d{2})(?::(\d{2}))?"
    zone = r"(?::\d{2}|t\d{4,6})(?:[.,]\d+)?\s*(?:[ap]\.?m\.?\s*)?(?:(?:gmt|utc)?([+-])(\d{2}):?(\d{2})?|([a-z]{1,4})\b)"

    def number(pattern: str, group: int) -> Column:
        found = F.regexp_extract(low, pattern, group)
        return F.when(found != "", found)

    def part(k: int) -> Column:
        """Year, month or day, by the first shape that is there."""
        out = F.lit(None).cast("string")
        for pattern, order in reversed(shapes):
            out = F.when(low.rlike(pattern), number(pattern, order[k])).otherwise(out)
        return out

    named = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    year = part(0).cast("int") + F.when(F.length(part(0)) > 2, 0).when(part(0).cast("int") >= 69, 1900).otherwise(2000)
    packed = lambda k: number(r"\d{8}t(\d{2})(\d{2})(\d{2})?", k)
    hour, minute, second = (F.coalesce(number(clock, k), packed(k), F.lit("0")).cast("int") for k in (1, 2, 3))
    half = F.regexp_extract(low, r"\d\s*([ap])\.?m\b", 1)
    hour = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "p", 12).otherwise(0))
    sign = F.when(number(zone, 1) == "-", -1).otherwise(1)
    minutes = F.coalesce(sign * (number(zone, 2).cast("int") * 60 + F.coalesce(number(zone, 3).cast("int"), F.lit(0))), F.create_map(*[F.lit(x) for pair in ZONES.items() for x in pair])[number(zone, 4)], F.lit(0))
    at = F.try_make_timestamp(year, F.coalesce(named[part(1)], part(1)).cast("int"), part(2).cast("int"), hour, minute, second.cast("decimal(8,6)"), F.lit("UTC"))
    return F.timestamp_seconds(F.unix_timestamp(at) - minutes * 60)


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Wilson interval at z = 1.96, trials at least 1, within [0, 1]."""
    n = F.greatest(trials, F.lit(1)).cast("double")
    p, zz = successes / n, 1.96 * 1.96
    centre, margin = p + zz / (2 * n), 1.96 * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    return F.greatest((centre - margin) / (1 + zz / n), F.lit(0.0)), F.least((centre + margin) / (1 + zz / n), F.lit(1.0))


def hyphened(hexa: Column) -> Column:
    return F.concat_ws("-", *[F.substring(hexa, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def uuid5(namespace_hex: str, name: Column) -> Column:
    h = F.sha1(F.concat(F.unhex(F.lit(namespace_hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return hyphened(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15)))
