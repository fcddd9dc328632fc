"""Normal forms of SQL texts, contexts, execution plans and cache keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a literal or parameter in SQL, in this order.
SQL_LITERALS = [
    (r"[Nn]?'[^']*+(?:''[^']*+(?='))*+'", "?"),  # possessive: a long literal takes no stack
    (r"(?U)\b0[xX][0-9a-fA-F]+\b", "?"),
    (r"(?U)\b\d+(?:\.\d+)?\b", "?"),
    (r"@P\d+|@PN\d*", "?"),
]

# What varies between runs of one operation, in this order.
RUN_VALUES = [
    (r"(?U)\b\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "[TS]"),
    (r"(?U)\b\d{2}\.\d{2}\.\d{4}\s+\d{2}:\d{2}:\d{2}\b", "[TS]"),
    (r"(?U)\b\d{2}:\d{2}:\d{2}(?:\.\d+)?\b", "[T]"),
    (r"(?U)\bПользователь\s*=\s*[\w.\-\s]+?(?=[,;]|$)", "Пользователь=[U]"),
    (r"(?U)\bСеанс\s*=\s*\d+\b", "Сеанс=[S]"),
    (r"(?U)\bСоединение\s*=\s*\d+\b", "Соединение=[C]"),
    (r"(?Ui)\b[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}\b", "[UUID]"),
    (r"(?U)№\s*[\w-]+", "№[N]"),
    (r"(?U)\bId=\d+\b", "Id=[N]"),
]
SIGNATURE_LENGTH = 200

# Lines and groups of a textual PostgreSQL plan that differ from run to run.
PG_RUN_LINES = [
    r"\(actual\s+time=[\d.]+\.\.[\d.]+\s+rows=[\d.]+\s+loops=\d+\)",
    r"(?m)^\s*Buffers:.*$",
    r"(?m)^\s*(Planning|Execution|JIT|Functions|Inlining|Optimization|Emission|Generation|Settings|Trigger|Timing)\s*[:\s].*$",
    r"(?m)^\s*I/O Timings:.*$",
]


def squash(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def replaced(c: Column, pairs) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def normalize_sql(c: Column) -> Column:
    """SQL with literals and parameters as ``?`` and single spaces."""
    return squash(replaced(c, SQL_LITERALS))


#: What Python strips.
BLANKS = "".join(map(chr, (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def normalize_context(c: Column) -> Column:
    """The part of a context before its first colon; all of it where that part is empty. Null without one."""
    whole = F.btrim(c, F.lit(BLANKS))
    head = F.btrim(F.substring_index(whole, ":", 1), F.lit(BLANKS))
    any_ = F.when(whole == "", None).otherwise(F.when(head == "", whole).otherwise(head))
    # Most contexts have spaces at their ends at most, which is told by two characters.
    plain = F.trim(F.substring_index(c, ":", 1))
    ends = [F.ascii(plain), F.ascii(F.substring(plain, -1, 1))]
    return F.when((plain == "") | ends[0].isin(*map(ord, BLANKS)) | ends[1].isin(*map(ord, BLANKS)), any_).otherwise(plain)


def context_signature(c: Column) -> Column:
    """The first line of a context without what varies between runs, at most 200 characters."""
    first = F.split(F.coalesce(c, F.lit("")), r"\n|\\n", 2)[0]
    return F.substring(squash(replaced(first, RUN_VALUES)), 1, SIGNATURE_LENGTH)


def sql_hash(normalized: Column) -> Column:
    return F.md5(normalized)


def canonical_pg_text(c: Column) -> Column:
    """A textual PostgreSQL plan without run times, buffers and I/O."""
    return squash(replaced(c, [(p, "") for p in PG_RUN_LINES]))


def canonical_query(c: Column) -> Column:
    """A query text without comments to the end of a line (//) and in /* */."""
    return squash(F.regexp_replace(c, r"//[^\n]*|(?s:/\*.*?\*/)", ""))


# Punctuation that doesn't count in a description.
PUNCTUATION = ".,!?;:()[]{}\"'«»-—"


def canonical_description(c: Column) -> Column:
    return squash(F.translate(F.lower(c), PUNCTUATION, " " * len(PUNCTUATION)))


def cache_key(text: Column, kind: str, prompt: str, model: str) -> Column:
    return F.sha2(F.concat(text, F.lit(f"|type_{kind}|prompt_{prompt}|model_{model}")), 256)


def short_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def unwrap_executesql(c: Column) -> Column:
    """The statement that a call of sp_executesql wraps, as ``exec sp_executesql N'...'`` or ``{call sp_executesql(N'...'``, where the
    text is such a call as a whole; other texts as they are."""
    head = r"(?is)^\s*(?:\{\s*call\s+sp_executesql\s*\(|(?:exec(?:ute)?\s+)?sp_executesql\b)\s*"
    inner = F.regexp_extract(c, head + r"N'((?:[^']++|'')*+)'\s*(?:[,)].*)?$", 1)
    return F.when(inner == "", c).otherwise(F.replace(inner, F.lit("''"), F.lit("'")))


# Beginnings of table names and the types that only the business platform makes.
PLATFORM_TABLES = "reference document accumrg accumrgt inforg enum const seq chrc node fld pkg task bp crrd crab crref accrg accrged".split()
PLATFORM_TYPES = ("mchar", "mvarchar", "fulleq")


def is_platform_sql(c: Column) -> Column:
    """Whether a statement names tables or types that only the business platform makes."""
    tables = rf"(?i)(?<!\w)_(?:{'|'.join(PLATFORM_TABLES)})\d+"
    return F.coalesce(c.rlike(tables) | c.rlike(rf"(?i)(?:::\s*|\bAS\s+)(?:{'|'.join(PLATFORM_TYPES)})\b"), F.lit(False))


# Names that tell whose execution plan a text is.
MSSQL_PLAN = ("|--", "Clustered Index Seek", "Clustered Index Scan", "NonClustered Index", "Hash Match", "Stream Aggregate", "Compute Scalar", "Nested Loops", "Bitmap()", "Constant Scan", "Merge Join (")
MSSQL_TAGS = ("ShowPlanXML", "StmtSimple", "StmtBlock", "QueryPlan", "RelOp")
POSTGRES_PLAN = (
    "Seq Scan", "Index Scan", "Index Only Scan", "Bitmap Heap Scan", "Bitmap Index Scan", "Hash Join", "Merge Join", "Nested Loop", "Aggregate", "HashAggregate", "GroupAggregate", "Sort", "Limit", "Append",
    "Gather", "Materialize", "Memoize", "Unique", "WindowAgg", "CTE Scan", "Subquery Scan", "Result", "ProjectSet",
)
POSTGRES_FIGURES = r"\b(?:Planning Time:|Execution Time:|Planning:|Execution:|cost=\d|actual time=)"


def plan_engine(c: Column) -> Column:
    """mssql, postgres or unknown, by the look of an execution plan: its XML, its JSON, or the names in its lines."""
    bare = F.trim(F.regexp_replace(c, r"^\s+", ""))
    xml = bare.rlike(rf"^(?:<\?xml|<(?i:{'|'.join(MSSQL_TAGS)})\b)")
    plan = F.coalesce(F.get_json_object(bare, "$[0].Plan"), F.get_json_object(bare, "$.Plan"))
    theirs = F.lit(False)
    for name in MSSQL_PLAN:
        theirs = theirs | F.lower(bare).contains(name.lower())
    node, figure = bare.rlike(rf"\b(?:{'|'.join(POSTGRES_PLAN)})\b"), bare.rlike(POSTGRES_FIGURES)
    return (
        F.when(xml, "mssql").when(plan.isNotNull(), "postgres").when(node & figure, "postgres").when(theirs, "mssql").when(node | figure, "postgres").otherwise("unknown")
    )


def file_hour(name: Column) -> Column:
    """The hour that a log file's name ``YYMMDDHH.log`` stands for; null for other names."""
    part = [F.regexp_extract(name, r"(?i)(\d{2})(\d{2})(\d{2})(\d{2})\.log$", i) for i in (1, 2, 3, 4)]
    ints = [x.try_cast("int") for x in part]
    return F.try_make_timestamp_ntz(ints[0] + 2000, ints[1], ints[2], ints[3], F.lit(0), F.lit(0).cast("decimal(8,6)"))
