r"""Column expressions of the ticket domain. White space is ``[\s\p{Z}]``, as Unicode has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the domain: kinds, priorities with their rank, statuses.
KINDS = ("Bug", "需求", "建议", "支持", "任务")
PRIORITIES = {"紧急": 0, "高": 1, "普通": 2}
STATUSES = ("新建", "处理中", "待反馈", "待测试", "已完成")
NO_VERSION, NO_PROJECT = "未指定", "未分类项目"
NO_DESCRIPTION = "知识库列表未提供描述，打开原工单可查看完整内容。"
#: Stages after which a work item no longer counts as active.
ENDED = ("completed", "cancelled", "failed")
APPROVAL = ("awaitingPlanApproval", "awaitingApproval")
RECOVERABLE = ("analyzing", "runningAI", "reviewing")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def blank_to(c: Column, value) -> Column:
    t = trim_all(c)
    return F.when(t.isNull() | (t == ""), value).otherwise(c)


def _has(c: Column, *words: str) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def kind(c: Column) -> Column:
    low = F.lower(trim_all(c))
    return (
        F.when(low.contains("bug") | _has(c, "错误", "缺陷"), "Bug").when(_has(c, "建议") | _has(low, "suggest", "proposal"), "建议")
        .when(_has(c, "支持") | _has(low, "support"), "支持").when(_has(c, "任务") | _has(low, "task"), "任务").otherwise("需求")
    )


def priority(c: Column) -> Column:
    return F.when(c.contains("紧急"), "紧急").when(c.contains("高"), "高").otherwise("普通")


def status(c: Column) -> Column:
    return F.when(c.contains("测试"), "待测试").when(_has(c, "完成", "关闭"), "已完成").when(c.contains("反馈"), "待反馈").when(_has(c, "处理", "进行"), "处理中").otherwise("新建")


def rank(c: Column) -> Column:
    return F.when(c == "紧急", 0).when(c == "高", 1).otherwise(2)


def symbol(name: Column) -> Column:
    return F.when(name.contains("移动"), "iphone").when(name.contains("数据"), "chart.bar").when(name.contains("云"), "cloud").otherwise("shippingbox")


def normalise(raw: DataFrame) -> DataFrame:
    """Typed tickets from tracker rows; rows without id are dropped."""
    return raw.filter(F.col("id").isNotNull() & (F.col("id") != 0)).select(
        "id", blank_to(F.col("project"), F.lit(NO_PROJECT)).alias("project"), kind(F.col("tracker")).alias("kind"), priority(F.col("priority")).alias("priority"),
        status(F.col("status")).alias("status"), blank_to(F.col("version"), F.lit(NO_VERSION)).alias("version"), "updated_at", "assignee", blank_to(F.col("author"), F.lit(None)).alias("author"),
        "title", blank_to(F.col("description"), F.lit(NO_DESCRIPTION)).alias("description"), "source_url",
    )


def delivery_assignee(kind_: Column, author: Column, manual: Column) -> Column:
    needs = kind_.isin("Bug", "支持")
    return F.when(kind_ == "需求", "").when(needs, F.coalesce(trim_all(author), F.lit(""))).otherwise(F.coalesce(trim_all(manual), F.lit("")))


def delivery_error(kind_: Column, author: Column, source_url: Column) -> Column:
    """An author is missing only where the ticket has a source to reassign it in."""
    return F.when(source_url.isNotNull() & kind_.isin("Bug", "支持") & (F.coalesce(trim_all(author), F.lit("")) == ""), "missingTicketAuthor")


def without_page(url: Column) -> Column:
    """The URL without its ``page`` query parameters; unchanged where there is none."""
    kept = F.array_join(F.filter(F.split(F.regexp_extract(url, r"\?([^#]*)", 1), "&"), lambda p: ~p.rlike(r"^page(=|$)")), "&")
    head, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    return F.when(url.rlike(r"[?&]page(=|&|#|$)"), F.concat(head, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)), tail)).otherwise(url)


def section(text: Column, start: str, end: str) -> Column:
    """The trimmed text between two markers: to the end if the second is missing, '' if the first is."""
    at = F.instr(text, start)
    rest = F.substring(text, at + len(start), F.lit(2**31 - 1))
    to = F.instr(rest, end)
    return F.when(at == 0, "").otherwise(trim_all(F.when(to > 0, F.substring(rest, F.lit(1), to - 1)).otherwise(rest)))


def list_items(text: Column) -> Column:
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: trim_all(F.regexp_replace(trim_all(x), "^-", "")))
    return F.filter(lines, lambda x: x != "")


def parse_date(text: Column, fallback: Column) -> Column:
    """A tracker's date in any of its shapes, else ``fallback``."""
    t = trim_all(text)
    shapes = ("yyyy-M-d H:mm:ss", "yyyy-M-d H:mm", "yyyy/M/d H:mm:ss", "yyyy/M/d H:mm", "yyyy年M月d日 H:mm:ss", "yyyy年M月d日 H:mm")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}T.*(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(t))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(s)) for s in shapes], fallback)


def updated_text(at: Column, now: Column) -> Column:
    """Hours ago on the same day (``刚刚`` below one), else the date and time."""
    hours = F.greatest(F.floor((F.unix_seconds(now) - F.unix_seconds(at)) / 3600), F.lit(0))
    return F.when(F.to_date(at) == F.to_date(now), F.when(hours == 0, "刚刚").otherwise(F.concat(hours, F.lit(" 小时前")))).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm"))
