"""Judges a SQL statement by the tree it parses to, before anything of it is resolved or run."""

from __future__ import annotations

from collections.abc import Collection

from py4j.java_gateway import JavaObject, is_instance_of
from pyspark.sql import SparkSession

# Parts of a query. Whatever else a statement parses to is refused: commands, scripts, files, time
# travel, table functions, names put together at run time.
_RELATIONS = frozenset(
    "Project Filter Aggregate Join LateralJoin Union Except Intersect Distinct Sort GlobalLimit LocalLimit Limit Offset "
    "Tail SubqueryAlias UnresolvedRelation UnresolvedWith OneRowRelation UnresolvedInlineTable LocalRelation "
    "UnresolvedHaving UnresolvedHint WithWindowDefinition Window Generate Pivot Unpivot UnresolvedSubqueryColumnAliases "
    "Sample RepartitionByExpression ResolvedHint".split()
)
# Unresolved expressions; resolved ones are what the parser makes of operators and literals.
_UNRESOLVED = frozenset(
    "UnresolvedAlias UnresolvedAttribute UnresolvedFunction UnresolvedGenerator UnresolvedStar UnresolvedStarExcept "
    "UnresolvedExtractValue UnresolvedOrdinal UnresolvedWindowExpression UnresolvedRegex MultiAlias "
    "UnresolvedSubqueryColumnAliases".split()
)
# Groups of built-in functions that compute from their arguments alone, and single ones of the others.
_GROUPS = frozenset(
    f"{kind}_funcs" for kind in (
        "agg array bitwise collection conditional conversion csv datetime generator hash json lambda map math predicate string "
        "struct url variant window xml"
    ).split()
)
_SINGLE = frozenset(("typeof", "raise_error", "assert_true"))


def _items(seq: JavaObject) -> list[JavaObject]:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node: JavaObject) -> str:
    return node.getClass().getSimpleName()


class _Judge:
    def __init__(self, spark: SparkSession, relations: Collection[str]):
        session = spark._jsparkSession.sessionState()
        self.gateway = spark.sparkContext._gateway
        self.exact = session.conf().caseSensitiveAnalysis()
        self.own = session.functionRegistry()
        self.built_in = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.builtin()
        self.identifier = spark._jvm.org.apache.spark.sql.catalyst.FunctionIdentifier
        self.allowed = frozenset(map(self.name, relations))
        self.functions: dict[str, bool] = {}

    def name(self, text: str) -> str:
        return text if self.exact else text.lower()

    def function(self, parts: list[str]) -> None:
        """Built-in functions of the allowed groups, under their own names, not replaced in the session."""
        name = parts[-1].lower()
        if name not in self.functions:
            given, registered = (r.lookupFunction(self.identifier(name)) for r in (self.built_in, self.own))
            fine = given.isDefined() and registered.isDefined()
            if fine:
                fine = given.get().getClassName() == registered.get().getClassName()
                fine = fine and (given.get().getGroup() in _GROUPS or name in _SINGLE)
            self.functions[name] = fine
        if len(parts) > 1 or not self.functions[name]:
            raise ValueError(f"function is not allowed: {'.'.join(parts)}")

    def expression(self, e: JavaObject, scope: frozenset) -> None:
        kind = _kind(e)
        if ".analysis." in e.getClass().getName() and kind not in _UNRESOLVED:
            raise ValueError(f"expression is not allowed: {kind}")
        if kind == "UnresolvedFunction":
            self.function(_items(e.nameParts()))
        elif kind == "UnresolvedGenerator":
            self.function([e.name().funcName()])
        if is_instance_of(self.gateway, e, "org.apache.spark.sql.catalyst.expressions.PlanExpression"):
            self.relation(e.plan(), scope)
        for child in _items(e.children()):
            self.expression(child, scope)

    def relation(self, plan: JavaObject, scope: frozenset) -> None:
        """``scope`` has the common tables that can be seen here."""
        kind = _kind(plan)
        if kind not in _RELATIONS:
            raise ValueError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedRelation":
            parts = _items(plan.multipartIdentifier())
            if len(parts) != 1 or self.name(parts[0]) not in scope | self.allowed:
                raise ValueError(f"relation is not allowed: {'.'.join(parts)}")
        if kind == "UnresolvedWith":
            # A common table sees those stated before it, and itself if it is recursive.
            for entry in _items(plan.cteRelations()):
                table = self.name(entry.productElement(0))
                self.relation(entry.productElement(1), scope | {table} if plan.allowRecursion() else scope)
                scope |= {table}
        if kind == "WithWindowDefinition":
            for spec in _items(plan.windowDefinitions().values().toSeq()):
                self.expression(spec, scope)
        for e in _items(plan.expressions()):
            self.expression(e, scope)
        for child in _items(plan.children()):
            self.relation(child, scope)


def check_statement(spark: SparkSession, text: str, relations: Collection[str]) -> None:
    """Raise ``ValueError`` unless ``text`` is a query over ``relations`` and its own common tables alone.

    Every part of the tree is looked at, subqueries and named windows included. Relations are named
    by one word; a common table hides a relation only where it can be seen. Functions must be built
    in and compute from their arguments alone. Texts with ``${`` would be filled in from the
    machine's settings ahead of parsing, so they are refused.
    """
    if "${" in text:
        raise ValueError("variables are not allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    _Judge(spark, relations).relation(plan, frozenset())
