"""Batches of edits to graphs as an ordered fold, with references to nodes that are added later and errors as rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An action of a graph: its number; type (add, connect, disconnect, remove); for add an id, a ref that others may name as "@ref",
#: a kind, whether it may overwrite, and wires into and out of the node; for the others their ends.
ACTION = (
    "graph long, n int, type string, id string, ref string, kind string, overwrite boolean, "
    "inputs array<struct<input:string,from:string,output:int>>, outputs array<struct<to:string,input:string,output:int>>, "
    "to string, input string, from string, output int"
)
FOLDED = "graph long, item string, id string, kind string, to_id string, input string, from_id string, output int, n int, message string"
#: Fixed value: what an id looks like.
_ID = re.compile(r"[0-9]+(:[0-9]+)?")


class EditError(ValueError):
    pass


class Graph:
    """Nodes (id -> kind) and edges ((to, input) -> (from, output)) that actions change one after the other."""

    def __init__(self, nodes: dict[str, str | None], edges: dict[tuple[str, str], tuple[str, int]]):
        self.nodes, self.edges = nodes, edges
        self.refs: dict[str, str] = {}

    def assign(self, actions: list) -> Iterator[tuple[object, str | None, str | None]]:
        """(action, id, error): ids of all nodes to be added are known before the first action, so that a reference may point ahead."""
        taken = set(self.nodes)
        top = max((int(i) for i in taken if i.isdigit()), default=0)
        for a in actions:
            if a.type != "add":
                yield a, None, None
                continue
            i = a.id
            if i is None:
                top += 1
                while str(top) in taken:
                    top += 1
                i = str(top)
            elif not _ID.fullmatch(i):
                yield a, None, f"not a node id: {i}"
                continue
            elif i not in self.nodes and i in taken:
                yield a, None, f"id {i} is reserved"
                continue
            if a.ref is not None and self.refs.get(a.ref, i) != i:
                yield a, None, f"ref {a.ref} names two nodes"
                continue
            taken.add(i)
            if i.isdigit():
                top = max(top, int(i))
            if a.ref is not None:
                self.refs[a.ref] = i
            yield a, i, None

    def find(self, name: str | None, field: str) -> str:
        if name is None:
            raise EditError(f"{field} is required")
        if name.startswith("@"):
            if name[1:] not in self.refs:
                raise EditError(f"no such ref: {name[1:]}")
            return self.refs[name[1:]]
        if not _ID.fullmatch(name):
            raise EditError(f"not a node id: {name}")
        return name

    def there(self, name: str | None, field: str) -> str:
        i = self.find(name, field)
        if i not in self.nodes:
            raise EditError(f"no such node: {i} ({field})")
        return i

    def _wire(self, to: str, name: str | None, source: str, output: int | None) -> tuple[tuple[str, str], tuple[str, int]]:
        if not name:
            raise EditError("input is required")
        output = 0 if output is None else output
        if output < 0:
            raise EditError("output must not be negative")
        return (to, name), (source, output)

    def apply(self, a, assigned: str | None) -> None:
        """One action; it changes nothing where it raises."""
        if a.type == "add":
            if assigned in self.nodes and not a.overwrite:
                raise EditError(f"node {assigned} exists")
            coming = set(self.refs.values())
            wires = []
            for w in a.inputs:  # a source may be added later
                source = self.find(w["from"], "inputs.from")
                if source not in self.nodes and source not in coming:
                    raise EditError(f"no such node: {source} (inputs.from)")
                wires.append(self._wire(assigned, w["input"], source, w["output"]))
            wires += [self._wire(self.there(w["to"], "outputs.to"), w["input"], assigned, w["output"]) for w in a.outputs]
            for k in [k for k in self.edges if k[0] == assigned]:
                del self.edges[k]  # a node that is overwritten has its new inputs only
            self.nodes[assigned] = a.kind
            self.edges.update(wires)
        elif a.type == "connect":
            # of two ends that are not there, the error names the one given by a reference
            ends = sorted([("from", getattr(a, "from")), ("to", a.to)], key=lambda e: not (e[1] or "").startswith("@"))
            at = {field: self.there(name, field) for field, name in ends}
            source, to = at["from"], at["to"]
            self.edges.update([self._wire(to, a.input, source, a.output)])
        elif a.type == "disconnect":
            to = None if a.to is None else self.there(a.to, "to")
            source = None if getattr(a, "from") is None else self.find(getattr(a, "from"), "from")
            if to is None and source is None:
                raise EditError("disconnect needs a node on either side")
            fits = lambda k, v: (to is None or k[0] == to) and (a.input is None or k[1] == a.input) and (source is None or v[0] == source) and (a.output is None or v[1] == a.output)
            for k in [k for k, v in self.edges.items() if fits(k, v)]:
                del self.edges[k]
        elif a.type == "remove":
            i = self.there(a.id, "id")
            del self.nodes[i]
            for k in [k for k, v in self.edges.items() if i in (k[0], v[0])]:
                del self.edges[k]
        else:
            raise EditError(f"no such action: {a.type}")


class _Action:
    """An action's fields, null where a frame has none."""

    def __init__(self, row: dict):
        for k, v in row.items():
            missing = v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and pd.isna(v))
            setattr(self, k, None if missing else v)
        self.n, self.output = int(self.n), None if self.output is None else int(self.output)
        self.overwrite = bool(self.overwrite)
        self.inputs, self.outputs = ([dict(w) for w in v] if v is not None else [] for v in (self.inputs, self.outputs))


def graph_fold(nodes: DataFrame, edges: DataFrame, actions: DataFrame) -> DataFrame:
    """Rows as in ``FOLDED``: the nodes and edges after all actions, and an ``error`` for each action that could not be done.

    ``nodes`` are (graph, id, kind), ``edges`` (graph, to_id, input, from_id,
    output), ``actions`` rows as in ``ACTION``, done in the order of ``n``.
    Ids are given out before the first action is done: an ``add`` without one
    gets the next number of the graph. An action in error changes nothing and
    the others go on. A graph is one task, as an action depends on all before
    it; graphs are edited side by side. Graphs without actions stay as they are.
    """
    none = lambda kind: F.lit(None).cast(kind)
    cols = {"item": "string", "to_id": "string", "from_id": "string"} | {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in ACTION.split(", ") if not f.startswith("graph")}

    def side(df: DataFrame, item: str, names: dict[str, str]) -> DataFrame:
        return df.select("graph", *[(F.lit(item) if c == "item" else F.col(names[c]).cast(kind) if c in names else none(kind)).alias(c) for c, kind in cols.items()])

    def same(names: str) -> dict[str, str]:
        return {c: c for c in names.split()}

    every = side(nodes, "node", same("id kind")).unionByName(side(edges, "edge", same("to_id input from_id output")))
    every = every.unionByName(side(actions, "action", {c: c for c in cols if c in actions.columns}))

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        parts = {k: g.to_dict("records") for k, g in rows.groupby("item")}
        g = Graph({r["id"]: r["kind"] for r in parts.get("node", [])}, {(r["to_id"], r["input"]): (r["from_id"], int(r["output"])) for r in parts.get("edge", [])})
        todo = sorted((_Action(r) for r in parts.get("action", [])), key=lambda a: a.n)
        errors = []
        for a, assigned, error in list(g.assign(todo)):
            try:
                if error:
                    raise EditError(error)
                g.apply(a, assigned)
            except EditError as e:
                errors.append((key[0], "error", assigned if a.type == "add" else None, None, None, None, None, None, a.n, str(e)))
        out = [(key[0], "node", i, kind, None, None, None, None, None, None) for i, kind in g.nodes.items()]
        out += [(key[0], "edge", None, None, to, name, source, output, None, None) for (to, name), (source, output) in g.edges.items()]
        df = pd.DataFrame(out + errors, columns=[f.split(" ")[0] for f in FOLDED.split(", ")], dtype=object)
        return df.astype({"graph": "int64", "output": "Int32", "n": "Int32"})

    return every.groupBy("graph").applyInPandas(run, FOLDED)
