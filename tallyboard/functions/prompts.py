"""The two texts with which a job asks a coding tool for work: an analysis, then the changes of a confirmed plan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts, line by line. In braces: fields of the ticket, what the user wrote, and two names
# that the caller gives, the workbench's own and the prefix of the marks that its report parser looks for.
HEAD = """工单编号：{number}
项目：{project}
类型：{kind}
优先级：{priority}
标题：{title}
描述：
{description}

用户提供的辅助定位信息：
{helper}
"""
ANALYSIS = (
    "你正在通过 {workbench} 工作台分析公司工单。当前处于只读分析阶段，绝对不要修改、创建或删除任何文件，也不要执行会写入仓库的命令。\n\n"
    + HEAD
    + """
工作要求：
1. 阅读仓库规则和相关实现，定位问题根因。
2. 给出聚焦的修改方案，明确涉及的文件、修改步骤和验证方式。
3. 说明潜在影响和需要人工关注的风险。
4. 不要执行 git commit、git pull、git push，也不要修改知识库工单。
5. 最终回复必须使用以下固定段落：

{prefix}ROOT_CAUSE:
说明问题根因。

{prefix}PLAN:
1. 列出建议的修改步骤、涉及文件和验证方式。

{prefix}RISKS:
- 列出潜在影响和人工检查项；没有时写“未发现明显额外风险”。"""
)
CHANGES = (
    "你正在通过 {workbench} 工作台解决公司工单。用户已确认修改方案，请按方案在当前 Git 仓库中修改代码。\n\n"
    + HEAD
    + """
用户已确认的分析与修改方案：
{plan}

工作要求：
1. 先检查仓库规则和相关实现，定位根因后再修改。
2. 保持改动聚焦，不修改无关文件，不做格式化清理。
3. 在合理范围内运行测试或静态检查。
4. 不要执行 git commit、git pull、git push，也不要修改知识库工单；这些步骤由 {workbench} 在人工审批后执行。
5. 不要覆盖用户原有未提交改动。
6. 最终回复必须使用以下固定段落，方便工作台生成报告：

{prefix}SUMMARY:
简要说明修改了什么。

{prefix}REASONING:
说明根因以及为什么这样修改。

{prefix}TESTS:
- 列出实际执行的测试及结果；未执行时说明原因。

{prefix}RISKS:
- 列出可能影响的其他区域和建议人工检查项；没有时写“未发现明显额外风险”。"""
)
NO_HELPER, NO_PLAN = "未提供，请自行在仓库中定位。", "未提供，请基于工单重新确认最小修改范围。"


def _filled(template: str, fields: dict[str, Column]) -> Column:
    """The template with its fields in place; a null field is empty. Fields are not searched for braces."""
    parts, rest = [], template
    while "{" in rest:
        text, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(text), F.coalesce(fields[name].cast("string"), F.lit(""))]
    return F.concat(*parts, F.lit(rest))


def _or(text: Column, other: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(other))


def prompt(ticket: dict[str, Column], helper: Column, workbench: str, prefix: str, plan: Column | None = None) -> Column:
    """The text for a ticket (id, project, kind, priority, title, description): an analysis, with ``plan`` the changes.

    An empty or null helper text or plan is replaced by a fixed one.
    """
    fields = {**ticket, "number": F.concat(F.lit("#"), ticket["id"].cast("string")), "helper": _or(helper, NO_HELPER), "workbench": F.lit(workbench), "prefix": F.lit(prefix)}
    if plan is None:
        return _filled(ANALYSIS, fields)
    return _filled(CHANGES, {**fields, "plan": _or(plan, NO_PLAN)})
