"""Read-only SQL over named views, optionally scoped to people."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words that a statement may start with, after comments.
READS = ("select", "with", "values", "table", "from")
#: Functions that reach beyond the rows of a statement: any Java method, files, other sessions' names.
REFUSED = ("java_method", "reflect", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "raise_error", "assert_true")
#: Table functions that only make rows.
TABLE_FUNCTIONS = ("range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack", "json_tuple", "variant_explode", "variant_explode_outer")


#: Postgres' names of types that Spark calls otherwise.
TYPES = {"text": "string", "citext": "string", "uuid": "string", "json": "string", "jsonb": "string", "int2": "smallint", "int4": "int", "int8": "bigint", "float4": "float", "float8": "double", "timestamptz": "timestamp", "numeric": "decimal(38, 18)", "bool": "boolean"}


class NotReadOnly(ValueError):
    """The text is not one statement that only reads what it may."""


def checked(text: str) -> str:
    """The statement without trailing semicolons; an error unless it is a single one that reads."""
    bare = re.sub(r"^(?:\s|--[^\n]*(?:\n|$)|/\*.*?\*/)*", "", text, flags=re.S).strip()
    bare = re.sub(r"[;\s]+$", "", bare)
    if not bare.lower().startswith(READS):
        raise NotReadOnly("only statements that read are run")
    return bare


def postgres(text: str) -> str:
    """A statement in Postgres' words as Spark reads it: %s parameters become ?, and -> or ->> with a key or a place
    become paths into JSON text, types behind :: get Spark's names. ILIKE and ILIKE ANY need nothing; DISTINCT ON is not
    rewritten. Quoted text stays as it is."""
    pieces = re.split(r"('(?:[^']|'')*')", text)
    out, i = [], 0
    while i < len(pieces):
        piece = pieces[i]
        if i % 2 == 0:
            piece = re.sub(r"::\s*(\w+)", lambda m: "::" + TYPES.get(m[1].lower(), m[1]), re.sub(r"%s", "?", piece))
            while (arrow := re.search(r"->>?\s*$", piece)) and i + 1 < len(pieces):
                piece = _path(piece[: arrow.start()], f".{pieces[i + 1][1:-1]}")
                i += 2
                piece += re.sub(r"%s", "?", pieces[i])
            while place := re.search(r"->>?\s*(\d+)", piece):
                piece = _path(piece[: place.start()], f"[{place[1]}]") + piece[place.end() :]
        out.append(piece)
        i += 1
    return "".join(out)


def _path(before: str, step: str) -> str:
    """What stands before an arrow, with its last operand wrapped into a step of a JSON path."""
    inner = re.search(r"get_json_object\(([^()]*), '(\$[^']*)'\)\s*$", before)
    if inner:
        return f"{before[: inner.start()]}get_json_object({inner[1]}, '{inner[2]}{step}')"
    operand = re.search(r"[\w.\"`]+\s*$", before)
    if not operand:
        raise NotReadOnly("an arrow needs a column before it")
    return f"{before[: operand.start()]}get_json_object({operand[0].strip()}, '${step}')"


def _all(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _nodes(plan) -> Iterator:
    """All nodes of a parsed plan: children, named subqueries, and the plans inside expressions."""
    yield plan
    for part in (plan.children(), plan.innerChildren(), plan.subqueries()):
        for child in _all(part):
            if hasattr(child, "subqueries"):
                yield from _nodes(child)


def _expressions(expression) -> Iterator:
    yield expression
    for child in _all(expression.children()):
        yield from _expressions(child)


def _inspect(plan, allowed: set[str]) -> None:
    nodes = list(_nodes(plan))
    names = {plan.alias().lower() for plan in nodes if plan.getClass().getSimpleName() == "SubqueryAlias"}
    for node in nodes:
        kind = node.getClass().getSimpleName()
        if re.search(r"Command|Insert|Update|Delete|Merge|Create|Drop|Alter|Truncate|Set|Transform|Script", kind) and kind not in ("SetOperation",):
            raise NotReadOnly("only statements that read are run")
        if kind == "UnresolvedRelation":
            parts = [str(p).lower() for p in _all(node.multipartIdentifier())]
            if len(parts) != 1 or parts[0] not in allowed | names:
                raise NotReadOnly(f"no such view: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction" and str(node.name().last()).lower() not in TABLE_FUNCTIONS:
            raise NotReadOnly(f"no such table function: {node.name().last()}")
        for e in (x for root in _all(node.expressions()) for x in _expressions(root)):
            if e.getClass().getSimpleName() == "UnresolvedFunction" and str(e.nameParts().last()).lower() in REFUSED:
                raise NotReadOnly(f"no such function: {e.nameParts().last()}")


def run(spark: SparkSession, text: str, views: dict[str, DataFrame] | None = None, args: dict | list | None = None, scope: list | None = None, scope_column: str = "primary_email") -> DataFrame:
    """The result of a read-only statement over temporary views; with a scope only rows whose address is in it.

    The parsed plan is walked, named subqueries and subqueries in expressions included: its relations must be the given
    views (without any, the session's temporary ones), so no file and no catalogue table is read; commands, writes,
    scripts and functions that reach beyond the rows are refused however they are spelt. A scope needs its column in the
    result. The scope's filter is part of the plan and is pushed to the scan.
    """
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    allowed = set(views) if views else {t.name for t in spark.catalog.listTables() if t.isTemporary}
    statement = checked(text)
    _inspect(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), {a.lower() for a in allowed})
    df = spark.sql(statement, args=args) if args else spark.sql(statement)
    if not scope:
        return df
    if scope_column not in df.columns:
        raise KeyError(f"a scoped statement must return {scope_column}")
    wanted = [(s["email"] if isinstance(s, dict) else s).lower() for s in scope]
    return df.where(F.lower(F.col(scope_column)).isin(wanted))
