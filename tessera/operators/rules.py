"""Declarative numeric rules: a checked expression tree, compiled to a column.

Nodes: {op: literal, value}, {op: fact, concept_id} or {op: fact, fact_id, source_file_id}, arithmetic
{op, args}, comparison {op, left, right, tolerance?}. add, subtract, multiply and divide use their first
two arguments; sum takes all. What can't be worked out (a missing fact, division by zero) is null and
becomes REVIEW_REQUIRED, never FAILED.
"""

from __future__ import annotations

from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ARITHMETIC = {"add", "subtract", "multiply", "divide", "sum"}
COMPARISONS = {"equals", "not_equals", "less_than", "less_or_equal", "greater_than", "greater_or_equal"}
NODES, DEPTH = 24, 6
NUMBER = "decimal(38,10)"
#: Sums of these keep ten decimals.
SUMMAND = "decimal(37,10)"


class RuleError(ValueError):
    """The expression isn't a rule."""


def check(node: Any) -> None:
    """Raises RuleError unless the expression is a comparison within the limits."""
    seen = 0

    def walk(x: Any, depth: int, root: bool) -> None:
        nonlocal seen
        seen += 1
        if seen > NODES or depth > DEPTH:
            raise RuleError("the expression is too large")
        if not isinstance(x, dict):
            raise RuleError("a node must be an object")
        op, keys = x.get("op"), set(x) - {"op"}
        if op == "literal":
            _number(x.get("value"))
            allowed = {"value"}
        elif op == "fact":
            allowed = {"fact_id", "source_file_id"} if "fact_id" in x else {"concept_id"}
            if keys != allowed or not all(isinstance(x[k], str) and x[k] for k in allowed):
                raise RuleError("a fact must be named")
        elif op in ARITHMETIC:
            allowed, args = {"args"}, x.get("args")
            if not isinstance(args, list) or len(args) < (1 if op == "sum" else 2):
                raise RuleError("arithmetic needs arguments")
            for a in args:
                walk(a, depth + 1, False)
        elif op in COMPARISONS:
            if not root:
                raise RuleError("a comparison must be the root")
            allowed = {"left", "right"} | ({"tolerance"} if op == "equals" else set())
            if "tolerance" in x and _number(x["tolerance"]) < 0:
                raise RuleError("a tolerance can't be negative")
            walk(x.get("left"), depth + 1, False)
            walk(x.get("right"), depth + 1, False)
        else:
            raise RuleError(f"operator {op!r} isn't allowed")
        if keys - allowed:
            raise RuleError("unknown keys")

    walk(node, 1, True)
    if node["op"] not in COMPARISONS:
        raise RuleError("the root must be a comparison")


def _number(text: Any) -> Decimal:
    try:
        if isinstance(text, str) and (d := Decimal(text)).is_finite():
            return d
    except InvalidOperation:
        pass
    raise RuleError("a literal must be a decimal text")


def references(node: dict) -> set[tuple[str, str | None]]:
    """(fact or concept, file or None) of each fact that the expression names."""
    if node.get("op") == "fact":
        return {(node["fact_id"], node["source_file_id"]) if "fact_id" in node else (node["concept_id"], None)}
    children = [*node.get("args", []), *(node[k] for k in ("left", "right") if k in node)]
    return set().union(*map(references, children)) if children else set()


def compile_rule(node: dict, fact: Any) -> Column:
    """The expression as a column; fact((name, file)) gives the column of a fact."""
    op = node["op"]
    if op == "literal":
        return F.lit(node["value"]).cast(NUMBER)
    if op == "fact":
        return fact((node["fact_id"], node["source_file_id"]) if "fact_id" in node else (node["concept_id"], None)).cast(NUMBER)
    if op in ARITHMETIC:
        args = [compile_rule(a, fact) for a in node["args"]]
        if op == "sum":
            total = args[0]
            for a in args[1:]:
                total = _arithmetic("add", total, a).cast(NUMBER)
            return total
        return _arithmetic(op, *args[:2]).cast(NUMBER)
    a, b = compile_rule(node["left"], fact), compile_rule(node["right"], fact)
    if op == "equals":
        return F.abs(a - b) <= F.lit(node.get("tolerance", "0")).cast(NUMBER)
    return {"not_equals": a != b, "less_than": a < b, "less_or_equal": a <= b, "greater_than": a > b, "greater_or_equal": a >= b}[op]


def _arithmetic(op: str, a: Column, b: Column) -> Column:
    """Two numbers of NUMBER's ten decimals put together, none of them cut; null beyond 18 digits before the point (27 for sums)."""
    if op in ("add", "subtract"):
        a, b = a.try_cast(SUMMAND), b.try_cast(SUMMAND)
        return a + b if op == "add" else a - b
    a, b = a.try_cast("decimal(28,10)"), b.try_cast("decimal(28,10)")
    if op == "divide":
        return F.try_divide(a, b)
    # whole and broken parts are multiplied apart, as one product of 20 decimals has no room
    whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("decimal(18,0)")
    broken = lambda x: (x - whole(x)).cast("decimal(10,10)")
    parts = [(whole(a), whole(b)), (whole(a), broken(b)), (broken(a), whole(b)), (broken(a), broken(b))]
    exact = [(x * y).cast("decimal(38,0)" if i == 0 else "decimal(38,20)") for i, (x, y) in enumerate(parts)]
    fraction = (exact[1].cast("decimal(37,18)") + exact[2].cast("decimal(37,18)") + exact[3].cast("decimal(37,18)")).cast(NUMBER)
    return F.try_add(exact[0].try_cast(SUMMAND), fraction.try_cast(SUMMAND))


def verdicts(facts: DataFrame, rules: list[dict], group: str = "review", name: str = "name", file: str = "file", value: str = "value") -> DataFrame:
    """(group, validation_id, status, reason) of each rule for each group of facts (group, name, file, value).

    A plain name with several distinct values in the group is ambiguous. All rules are worked out in one pass:
    one aggregate of the facts that they name, then columns.
    """
    for r in rules:
        check(r["expression"])
    names = sorted({ref for r in rules for ref in references(r["expression"])}, key=str)
    at = {ref: i for i, ref in enumerate(names)}

    def mine(ref: tuple[str, str | None]) -> Column:
        same = F.col(name) == ref[0]
        return F.when(same if ref[1] is None else same & (F.col(file) == ref[1]), F.col(value))

    wanted = facts.groupBy(group).agg(*[c for ref, i in at.items() for c in (F.min(mine(ref)).alias(f"v{i}"), F.countDistinct(mine(ref)).alias(f"n{i}"))])
    out = []
    for r in rules:
        refs = references(r["expression"])
        ambiguous = F.lit(False)
        for ref in refs:
            ambiguous = ambiguous | (F.col(f"n{at[ref]}") > 1)
        result = compile_rule(r["expression"], lambda ref: F.col(f"v{at[ref]}"))
        status = F.when(ambiguous | result.isNull(), "REVIEW_REQUIRED").when(result, "PASSED").otherwise("FAILED")
        reason = F.when(ambiguous, "NUMERIC_RULE_AMBIGUOUS_INPUT").when(result.isNull(), "NUMERIC_RULE_UNCERTAIN").when(~result, "NUMERIC_RULE_FAILED")
        out.append(F.struct(F.lit(r["validation_id"]).alias("validation_id"), status.alias("status"), reason.alias("reason")))
    return wanted.select(group, F.explode(F.array(*out)).alias("r")).select(group, "r.*")
