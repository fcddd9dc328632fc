"""Rules over query texts, as data: each rule is a pattern, each match a finding; and the classification of findings."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sql_rules import SQL_RULES, parse_failed, placed_sql_findings, safe_to_explain, sql_findings

__all__ = ["SQL_RULES", "parse_failed", "placed_sql_findings", "safe_to_explain", "sql_findings"]

# Rule, severity, patterns in both languages of the platform's query language.
QUERY_RULES = [
    ("comma_join_implicit", "critical", [r"(?ims)ИЗ\s+\S+\s+КАК\s+\S+\s*,\s*\S+\s+КАК\s+\S+", r"(?ims)FROM\s+\S+\s+(?:AS\s+)?\S+\s*,\s*\S+\s+(?:AS\s+)?\S+"]),
    ("function_in_where", "warning", [
        r"(?ims)ГДЕ\b[^;]{0,400}?(ПОДСТРОКА|ЛЕВ|ПРАВ|ВРЕГ|НРЕГ|СТРДЛИНА|ГОД|МЕСЯЦ|ДЕНЬ|НАЧАЛОПЕРИОДА|КОНЕЦПЕРИОДА)\s*\(",
        r"(?ims)WHERE\b[^;]{0,400}?(SUBSTRING|LEFT|RIGHT|UPPER|LOWER|LENGTH|YEAR|MONTH|DAY)\s*\(",
    ]),
    ("in_with_subquery", "warning", [r"(?im)\bВ\s*\(\s*ВЫБРАТЬ\b", r"(?im)\bIN\s*\(\s*SELECT\b"]),
    ("not_in_with_subquery", "critical", [r"(?im)\bНЕ\s+В\s*\(\s*ВЫБРАТЬ\b", r"(?im)\bNOT\s+IN\s*\(\s*SELECT\b"]),
    ("or_in_where", "info", [r"(?ims)ГДЕ\b[^;]{0,800}?\bИЛИ\b", r"(?ims)WHERE\b[^;]{0,800}?\bOR\b"]),
    ("pervye_without_order", "warning", [r"(?ims)ВЫБРАТЬ\s+ПЕРВЫЕ\s+\d+(?![^;]*?УПОРЯДОЧИТЬ\s+ПО)", r"(?ims)SELECT\s+TOP\s+\d+(?![^;]*?ORDER\s+BY)"]),
    ("select_distinct", "info", [r"(?im)ВЫБРАТЬ\s+РАЗЛИЧНЫЕ\b", r"(?im)SELECT\s+DISTINCT\b"]),
    ("select_star", "warning", [r"(?im)ВЫБРАТЬ\s+\*", r"(?im)SELECT\s+\*"]),
    ("subquery_in_join", "warning", [r"(?ims)СОЕДИНЕНИЕ\s*\(\s*ВЫБРАТЬ", r"(?ims)JOIN\s*\(\s*SELECT"]),
    ("temp_table_without_index", "info", [r"(?ims)ПОМЕСТИТЬ\s+\S+(?:(?!ИНДЕКСИРОВАТЬ\s+ПО)[^;])*;"]),
    ("union_without_all", "warning", [r"(?im)ОБЪЕДИНИТЬ\s+(?!ВСЕ\b)", r"(?im)UNION\s+(?!ALL\b)"]),
    ("virtual_table_in_join", "warning", [
        r"(?im)СОЕДИНЕНИЕ\s+\S+(?:\.\S+)*\.(Остатки|Обороты|ОстаткиИОбороты|СрезПоследних|СрезПервых)\s*\(",
        r"(?im)JOIN\s+\S+(?:\.\S+)*\.(Balance|Turnovers|BalanceAndTurnovers|SliceLast|SliceFirst)\s*\(",
    ]),
    ("vyrazit_in_where", "warning", [r"(?ims)ГДЕ\b[^;]{0,400}?ВЫРАЗИТЬ\s*\("]),
]

# Severities from worst to least.
SEVERITIES = ("Critical", "Blocker", "Major", "Warning", "Minor", "Info")


def query_findings(queries: DataFrame, text: str = "text", rules=QUERY_RULES) -> DataFrame:
    """id, rule, severity, n: how often each rule's patterns match a text. Every rule is tested in one pass over the rows."""
    cells = [F.struct(F.lit(r).alias("rule"), F.lit(s).alias("severity"), sum((F.regexp_count(text, F.lit("(?U)" + p)) for p in patterns), F.lit(0)).alias("n")) for r, s, patterns in rules]
    return queries.select("id", F.explode(F.array(*cells)).alias("f")).where("f.n > 0").select("id", "f.*")


PLACE = "start int, end int, line int, column int, end_line int, end_column int"


def _place(text: str, offset: int) -> tuple[int, int]:
    """Line and column of an offset, from 1; CR LF is one line end."""
    before = text[:offset].replace("\r\n", "\n").replace("\r", "\n")
    return before.count("\n") + 1, len(before) - before.rfind("\n")


def matches(queries: DataFrame, patterns: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """id, name, groups, and where: every match of every pattern in the texts. Offsets are from 0, the end excluded."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(name, re.compile(p)) for name, p in patterns]
        for batch in batches:
            rows = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                for name, p in compiled if t is not None else ():
                    rows += [(i, name, [g or "" for g in m.groups()], *m.span(), *_place(t, m.start()), *_place(t, m.end())) for m in p.finditer(t)]
            yield pd.DataFrame(rows, columns=["id", "name", "groups", "start", "end", "line", "column", "end_line", "end_column"])

    return queries.select(F.col("id").cast("long").alias("id"), F.col(text).alias("text")).mapInPandas(step, f"id long, name string, groups array<string>, {PLACE}")


def placed_findings(queries: DataFrame, text: str = "text", rules=QUERY_RULES) -> DataFrame:
    """id, rule, severity and range of every match of every rule."""
    found = matches(queries, [(r, p) for r, _, patterns in rules for p in patterns], text).drop("groups").withColumnRenamed("name", "rule")
    severity = F.create_map(*(F.lit(x) for r, s, _ in rules for x in (r, s)))
    return found.withColumn("severity", severity[F.col("rule")])


def report_of(findings: DataFrame, sources: tuple[str, ...] = ("native", "server")) -> DataFrame:
    """Findings (id, source, rule, severity, range) as a report: of those with one range and rule the first by source stays; ``place``
    is the order by line, column and severity."""
    by_source = F.array_position(F.array(*map(F.lit, sources)), F.col("source"))
    one = first_of_each(findings, ["id", "line", "column", "end_line", "end_column", "rule"], [by_source, "severity"])
    rank = F.array_position(F.array(*map(F.lit, ("critical", "warning", "info"))), F.lower("severity"))
    return one.withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("line", "column", rank, "rule")))


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("id").agg(*(F.count_if(F.lower("severity") == s).alias(s) for s in ("critical", "warning", "info")))


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


def first_of_each(findings: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of the findings with one key the first."""
    return findings.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def blanked(c: Column) -> Column:
    """A statement of the same length, with blanks for comments and for what stands in literals."""
    parts = F.regexp_extract_all(c, F.lit(r"(?s)/\*.*?\*/|--[^\n]*+|'(?:[^']++|'')*+'|[^'/-]++|."), F.lit(0))
    blank = lambda x: F.repeat(F.lit(" "), F.length(x))
    quoted = lambda x: F.concat(F.lit("'"), F.repeat(F.lit(" "), F.length(x) - 2), F.lit("'"))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith("/*") | x.startswith("--"), blank(x)).when(x.startswith("'") & (F.length(x) > 1), quoted(x)).otherwise(x)), "")


# How bad what a language server reports is, by its rule, and else by its number or word.
SERVER_RULES = {
    "QueryParseError": "Blocker", "QueryToMissingMetadata": "Blocker", "VirtualTableCallWithoutParameters": "Critical", "FieldsFromJoinsWithoutIsNull": "Critical", "JoinWithSubQuery": "Major", "JoinWithVirtualTable": "Major",
    "RefOveruse": "Major", "QueryNestedFieldsByDot": "Major", "FullOuterJoinQuery": "Major", "UnionAll": "Major", "SelectTopWithoutOrderBy": "Major", "IncorrectUseLikeInQuery": "Major", "LogicalOrInJoinQuerySection": "Major",
    "LogicalOrInTheWhereSectionOfQuery": "Major", "SameMetadataObjectAndChildNames": "Major", "ForbiddenMetadataName": "Major", "AssignAliasFieldsInQuery": "Minor", "UsingLikeInQuery": "Minor", "MultilineStringInQuery": "Minor",
}
SERVER_NUMBERS = {"1": "Critical", "2": "Major", "3": "Minor", "4": "Info"}


def diagnostics(rows: DataFrame) -> DataFrame:
    """id, code, message, severity, range and snippet of what a language server says in ``raw`` (JSON) about ``text``. Lines and columns
    are from 0, as the server counts; the snippet is null beyond the text."""
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    at = lambda path: F.get_json_object("raw", f"$.{path}")
    place = {f"{e}_{c}": at(f"range.{e}.{c}").try_cast("int") for e in ("start", "end") for c in ("line", "character")}
    words = F.when(F.initcap(at("severity")).isin(*SEVERITIES), F.initcap(at("severity")))
    severity = F.coalesce(F.try_element_at(table(SERVER_RULES), F.col("code")), words, F.try_element_at(table(SERVER_NUMBERS), at("severity")), F.lit("Major"))
    lines, a, z = F.split("text", r"\r\n|\r|\n"), F.col("start_line"), F.col("end_line")
    first, last = F.get(lines, a), F.substring(F.get(lines, z), F.lit(1), F.col("end_character"))
    one = F.substring(first, F.col("start_character") + 1, F.col("end_character") - F.col("start_character"))
    many = F.array_compact(F.concat(F.array(F.substring(first, F.col("start_character") + 1, F.length(first))), F.slice(lines, a + 2, F.greatest(z - a - 1, F.lit(0))), F.array(last)))
    snippet = F.when(a < F.size(lines), F.when(a == z, one).otherwise(F.array_join(many, "\n")))
    out = rows.withColumns({"code": at("code"), "message": F.coalesce(at("message"), F.lit("")), **place})
    return out.select("id", "code", "message", severity.alias("severity"), *place, snippet.alias("snippet"))


def rules_from(texts: list[str]) -> list[tuple]:
    """Explanations from rule files that begin with a block of ``key: value`` lines between ``---``: id, applies_to, priority, and a list of
    patterns, each with field, operator (``==`` if there is none) and value."""
    out = []
    for text in texts:
        block = re.match(r"---\s*\n(.*?)\n---", text.lstrip("\ufeff"), re.S)
        head, patterns = {}, []
        for line in block[1].splitlines() if block else ():
            m = re.match(r"(\s*)(-\s+)?(\w+):\s*(.*?)\s*$", line)
            if not m or not m[4] and m[3] == "patterns":
                continue
            if m[2]:
                patterns.append({})
            (patterns[-1] if m[1] and patterns else head)[m[3]] = _scalar(m[4])
        if "id" in head:
            out.append((head["id"], head.get("applies_to", ""), int(head.get("priority", 0)), [(p["field"], p.get("operator", "=="), p.get("value")) for p in patterns if "field" in p]))
    return out


def _scalar(word: str):
    if word[:1] in "\"'" and word[-1:] == word[:1] and len(word) > 1:
        return word[1:-1]
    if word.startswith("[") and word.endswith("]"):
        return [_scalar(x.strip()) for x in word[1:-1].split(",") if x.strip()]
    word = word.split(" #")[0].strip()
    return {"true": True, "false": False}.get(word.lower(), int(word) if re.fullmatch(r"-?\d+", word) else float(word) if re.fullmatch(r"-?\d+\.\d+", word) else word)


# What the figures of an operation, a deadlock, a lock or an exception mean: explanation, what it applies to,
# priority, and the field, comparison and value of each condition.
EXPLANATIONS = [
    ("deadlock_different_order", "deadlock", 90, [("event_type", "==", "TDEADLOCK"), ("regions_count", ">=", 2), ("participants_count", ">=", 2)]),
    ("deadlock_lock_escalation", "deadlock", 100, [("event_type", "==", "TDEADLOCK"), ("regions_count", "==", 1), ("participants_count", ">=", 2)]),
    ("deadlock_single_resource", "deadlock", 50, [("event_type", "==", "TDEADLOCK")]),
    ("exception_deadlock_victim", "exception", 100, [("event_type", "==", "EXCP"), ("descr", "matches", "(?i)deadlock|deadlocked|взаимоблок")]),
    ("exception_timeout", "exception", 90, [("event_type", "==", "EXCP"), ("descr", "matches", "(?i)timeout|таймаут|превышено время")]),
    ("lock_timeout", "lock", 100, [("event_type", "==", "TLOCK")]),
    ("operation_heavy", "operation", 50, [("total_duration_ms", ">=", 60000)]),
    ("slow_op_call_cascade", "slow_op", 80, [("calls", ">=", 1000), ("avg_duration_ms", "<=", 50)]),
    ("slow_op_heavy_sql", "slow_op", 100, [("sql_share", ">=", 0.5)]),
    ("slow_op_locks", "slow_op", 95, [("lock_share", ">=", 0.3)]),
]
COMPARISONS = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v,
    "in": lambda c, v: c.isin(*v), "contains": lambda c, v: c.contains(v), "matches": lambda c, v: c.rlike(v),
}


def explained(figures: DataFrame, applies_to: tuple[str, ...] = ("operation", "slow_op"), rules=EXPLANATIONS) -> DataFrame:
    """The rows with ``explanation``: the first rule by priority and name whose conditions all hold, or null. A field that the rows
    haven't, or that is null, fulfils nothing."""
    out = F.when(F.lit(False), F.lit(""))
    for name, kind, _, conditions in sorted(rules, key=lambda r: (-r[2], r[0])):
        if kind in applies_to and all(f in figures.columns for f, *_ in conditions):
            out = out.when(F.coalesce(reduce(lambda a, b: a & b, (COMPARISONS[op](F.col(f), v) for f, op, v in conditions)), F.lit(False)), name)
    return figures.withColumn("explanation", out)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A text with ``{{name}}`` places filled in: lists joined by commas, what is missing as a dash."""
    parts = re.split(r"\{\{\s*([\w.]+)\s*\}\}", template)
    cells = [F.lit(p) if i % 2 == 0 else F.coalesce(F.nullif(fields[p].cast("string"), F.lit("")), F.lit("—")) if p in fields else F.lit("—") for i, p in enumerate(parts)]
    return F.concat(*cells)


def one_of(value: Column, known: dict[str, str], default: str) -> Column:
    """What a word means, whatever its case and the spaces around it; ``default`` for words that aren't known."""
    table = F.create_map(*(F.lit(x) for k, v in known.items() for x in (k, v)))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(value))), F.lit(default))
