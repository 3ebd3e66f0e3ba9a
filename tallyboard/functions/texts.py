r"""Texts of tickets: labels that a page puts before a description, and delivery messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import NO_DESCRIPTION, trim_all

# The two labels and the delivery messages.
QUOTE, DESCRIPTION = "引用", "描述"
KEPT = "工单已转为待测试，负责人保持不变"
KEPT_NO_AUTHOR = "工单已转为待测试，未获取到创建人，负责人保持不变"
TO_AUTHOR = "工单已转为待测试并转交给创建人 "
TO_ASSIGNEE = "工单已转为待测试并转交给 "


def _line(label: str) -> str:
    """A label alone on its line, with the white space around it."""
    return rf"[\s\p{{Z}}]*{label}[\s\p{{Z}}]*\n[\s\p{{Z}}]*"


def strip_labels(text: Column) -> Column:
    """Without the leading label lines: both, else one of them; trimmed. Null stays null."""
    out = text
    for labels in ([QUOTE], [DESCRIPTION], [QUOTE, DESCRIPTION]):
        lines = "^" + "".join(map(_line, labels))
        out = F.when(text.rlike(lines), F.regexp_replace(text, lines, "")).otherwise(out)
    return trim_all(out)


def strip_landed_labels(text: Column) -> Column:
    """The cleaning of a landed page: both labels if both lead, and then one label more."""
    both = trim_all(F.regexp_replace(text, "^" + _line(QUOTE) + _line(DESCRIPTION), ""))
    return trim_all(F.regexp_replace(both, f"^{_line(f'(?:{QUOTE}|{DESCRIPTION})')}", ""))


def description(landed: Column) -> Column:
    """A ticket's description from its page; a fixed text where nothing is left."""
    clean = F.coalesce(strip_labels(strip_landed_labels(landed)), F.lit(""))
    return F.when(clean == "", NO_DESCRIPTION).otherwise(clean)


def delivery_message(kind: Column, assignee: Column) -> Column:
    """What the log says of a delivery to ``assignee`` ('' or null: nobody)."""
    to = F.coalesce(assignee, F.lit(""))
    by_author = F.when(to == "", KEPT_NO_AUTHOR).otherwise(F.concat(F.lit(TO_AUTHOR), to))
    by_hand = F.when(to == "", KEPT).otherwise(F.concat(F.lit(TO_ASSIGNEE), to))
    return F.when(kind == "需求", KEPT).when(kind.isin("Bug", "支持"), by_author).otherwise(by_hand)
