"""Guards for user SQL: one statement, bound named parameters, reading only."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession

_TOKEN = re.compile(
    r"""'(?:[^']|'')*'?|"(?:[^"]|"")*"?|`(?:[^`]|``)*`?|--[^\n]*|/\*.*?(?:\*/|\Z)|::|[$:@][A-Za-z_]\w*|.""",
    re.DOTALL,
)


def tokens(sql: str) -> Iterator[tuple[str, bool]]:
    """Pieces of a statement and whether they are code, not a string, a quoted name or a comment."""
    for m in _TOKEN.finditer(sql):
        t = m[0]
        yield t, not (t[0] in "'\"`" or t.startswith(("--", "/*")))


def single_statement(sql: str) -> str:
    """The statement without its final semicolon; more text after it is refused."""
    done, out = False, []
    for t, code in tokens(sql):
        if code and t == ";" and not done:
            done = True
        elif done and (code or t[0] in "'\"`") and t.strip():
            raise ValueError("one statement only")
        elif not done:
            out.append(t)
    return "".join(out)


def named_parameters(sql: str) -> list[str]:
    """Names after $, : or @, in order of first use; one name under two prefixes is refused."""
    seen: dict[str, str] = {}
    for t, code in tokens(sql):
        if code and len(t) > 1 and t[0] in "$:@" and t != "::":
            if seen.setdefault(t[1:], t[0]) != t[0]:
                raise ValueError(f"{t[1:]} has two prefixes")
    return list(seen)


def parse_assignment(text: str) -> tuple[str, object]:
    """name=value is a string, name:=value is JSON."""
    import json

    m = re.fullmatch(r"(\w+)(:?=)(.*)", text, re.DOTALL)
    if not m:
        raise ValueError("name=value or name:=json is needed")
    return m[1], json.loads(m[3]) if m[2] == ":=" else m[3]


def run(spark: SparkSession, sql: str, params: Mapping[str, object] | None = None) -> DataFrame:
    """A guarded query: one reading statement whose parameters are all bound."""
    sql, params = single_statement(sql), dict(params or {})
    names = named_parameters(sql)
    if missing := [n for n in names if n not in params]:
        raise ValueError(f"unbound: {', '.join(missing)}")
    if unused := [n for n in params if n not in names]:
        raise ValueError(f"not in the statement: {', '.join(unused)}")
    text = "".join(":" + t[1:] if code and len(t) > 1 and t[0] in "$@" else t for t, code in tokens(sql))
    reading(spark, spark._jsparkSession.sessionState().sqlParser().parsePlan(text))  # before analysis, which runs commands
    df = spark.sql(text, args=params)
    reading(spark, df._jdf.queryExecution().analyzed())
    return df


#: Functions that run code or read what isn't a table.
FORBIDDEN = {"java_method", "reflect", "try_reflect", "callmethodviareflection", "trycallmethodviareflection", "input_file_name", "assert_true"}
#: Functions that stand for tables and read nothing but their arguments; the last two are those of docloom.functions.tables.
TABLES = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "json_tuple", "stack", "variant_explode", "variant_explode_outer", "split_body", "line_sections"}
#: Words in the names of plan nodes that do something.
DOES = re.compile("Command|Insert|Delete|Update|Merge|Create|Drop|Alter|^Set|Cache|Truncate|^Use|Show|Describe|Replace|Transform|CompoundBody|Exec(?!ut)")


def _known(spark: SparkSession, parts: list[str], defined: set[str]) -> bool:
    """Whether a relation is one of the statement's own or a temporary view; never a path or a file behind a catalog's name."""
    return len(parts) == 1 and (parts[0].lower() in defined or spark._jsparkSession.sessionState().catalog().isTempView(spark._jvm.org.apache.spark.sql.catalyst.TableIdentifier(parts[0])))


def reading(spark: SparkSession, plan) -> None:
    """Refuses a plan with any node that isn't reading, at any depth, with functions that run code or make tables, or with relations other than temporary views and the statement's own."""
    todo = [(plan, set())]
    while todo:
        node, defined = todo.pop()
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedWith":
            own = [node.cteRelations().apply(i)._1() for i in range(node.cteRelations().size())]
            defined = defined | {n.lower() for n in own}
            todo += [(node.cteRelations().apply(i)._2(), defined) for i in range(len(own))]
        if kind == "UnresolvedRelation":
            parts = [node.multipartIdentifier().apply(i) for i in range(node.multipartIdentifier().size())]
            if not _known(spark, parts, defined):
                raise ValueError(f"only known views are allowed, not {'.'.join(parts)}")
        if kind == "UnresolvedTableValuedFunction" and str(node.name().last()).lower() not in TABLES:
            raise ValueError(f"only table functions of TABLES are allowed, not {node.name().last()}")
        if DOES.search(kind):
            raise ValueError(f"only reading statements are allowed, not {kind}")
        for i in range(node.expressions().size()):
            exprs = [node.expressions().apply(i)]
            while exprs:
                x = exprs.pop()
                names = {x.getClass().getSimpleName().lower(), x.prettyName().lower()}
                if names & {"unresolvedfunction"}:
                    names |= {str(x.nameParts().last()).lower()}
                if names & FORBIDDEN:
                    raise ValueError(f"{sorted(names & FORBIDDEN)[0]} isn't allowed")
                if x.getClass().getSuperclass().getSimpleName() == "SubqueryExpression":
                    todo.append((x.plan(), defined))
                exprs += [x.children().apply(j) for j in range(x.children().size())]
        for group in (node.children(), node.innerChildren()):
            for i in range(group.size()):
                if hasattr(group.apply(i), "expressions"):
                    todo.append((group.apply(i), defined))


def check(df: DataFrame) -> int:
    """0 without rows, 1 with any."""
    return 0 if df.limit(1).isEmpty() else 1
