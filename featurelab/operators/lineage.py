"""Lineage of columns from Catalyst's analysed plan: which columns of the scanned tables a column is computed from."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _ids(expression) -> set[int]:
    """Ids of the attributes that an expression reads, also inside its subqueries."""
    return {a.exprId().id() for a in _items(expression.references().toSeq())}


class Plan:
    """The expression ids of an analysed plan: what each is computed from, and the columns of the tables at its ends."""

    def __init__(self, df: DataFrame) -> None:
        self.reads: dict[int, set[int]] = {}
        self.columns: dict[int, str] = {}
        root = df._jdf.queryExecution().analyzed()
        self.output = {a.name(): a.exprId().id() for a in _items(root.output())}
        self._walk(root)

    def _walk(self, node) -> None:
        children = _items(node.children())
        for c in children:
            self._walk(c)
        below = [[a.exprId().id() for a in _items(c.output())] for c in children]
        known = {i for own in below for i in own}
        if not children:
            self.columns |= {a.exprId().id(): a.name() for a in _items(node.output())}
            return
        made = [a for e in _items(node.expressions()) for a in self._named(e)]
        for alias in made:
            self.reads.setdefault(alias.exprId().id(), set()).update(_ids(alias))
        kind = node.getClass().getSimpleName()
        for place, a in enumerate(_items(node.output())):
            i = a.exprId().id()
            if kind in ("Union", "Intersect", "Except"):
                self.reads.setdefault(i, set()).update(own[place] for own in below if own[place] != i)
            elif i not in known and i not in self.reads and i not in self.columns:
                # made by the node itself: a generator or a Python function, from what it reads or else from all that it gets
                self.reads[i] = {x for e in _items(node.expressions()) for x in _ids(e)} & known or known

    def _named(self, e) -> list:
        if e.getClass().getSimpleName() == "Alias":
            return [e]
        return [a for c in _items(e.children()) for a in self._named(c)]

    def inputs(self, column: str) -> set[str]:
        seen, ends, todo = set(), set(), [self.output[column]]
        while todo:
            i = todo.pop()
            if i in seen:
                continue
            seen.add(i)
            if i in self.columns:
                ends.add(self.columns[i])
            todo += self.reads.get(i, ())
        return ends


def inputs(df: DataFrame, columns: list[str] | None = None) -> dict[str, list[str]]:
    """For each column of df the sorted columns of the scanned tables that its values come from. Conditions of filters and joins choose rows
    and are no inputs; renaming, nesting, windows and aggregation are followed."""
    plan = Plan(df)
    return {c: sorted(plan.inputs(c)) for c in columns or df.columns}


def undeclared(df: DataFrame, declared: dict[str, list[str]]) -> dict[str, list[str]]:
    """Inputs that a column has by the plan and not by declaration."""
    got = inputs(df, list(declared))
    return {c: rest for c, own in declared.items() if (rest := sorted(set(got[c]) - set(own)))}


def check(df: DataFrame, declared: dict[str, list[str]]) -> None:
    if rest := undeclared(df, declared):
        raise ValueError(f"columns with undeclared inputs: {rest}")
