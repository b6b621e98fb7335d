"""What makes a pipeline graph sound (R2): rules over its nodes, edges and ports.

Each rule is a generator of issues over one ``Graph``; ``RULES`` lists them.  A rule only looks at
parts that earlier ones found well formed, so one mistake gives one issue.
"""

from __future__ import annotations

import graphlib
from collections import Counter

from ..sinks.files import output_filename

# Node type names and their table ports.
INPUT_TYPES = ("csv-input", "jsonl-input", "parquet-input")
OUTPUT_TYPES = ("csv-output", "jsonl-output", "parquet-output")
TRANSFORM_TYPES = ("select-columns", "rename-columns", "clean-text", "cast", "sort", "limit", "deduplicate",
                   "filter-rows", "null-handling", "group-by")
COMBINE_TYPES = ("join", "union")
NODE_TYPES = INPUT_TYPES + TRANSFORM_TYPES + COMBINE_TYPES + OUTPUT_TYPES
UNION_MIN, UNION_MAX = 2, 6
#: Port names of the nodes that are not plain (``in`` to ``out``): receiving ports, sending ports.
PORT_NAMES = {"join": (("left", "right"), ("out",)), **{t: ((), ("table",)) for t in INPUT_TYPES}, **{t: (("in",), ()) for t in OUTPUT_TYPES}}
#: The two ends of an edge and what a port must be there.
ENDS = (("source", "output"), ("target", "input"))


def union_input_count(node: dict) -> int:
    wanted = (node.get("data") or {}).get("inputCount", UNION_MIN)
    try:
        return min(max(int(wanted), UNION_MIN), UNION_MAX)
    except (TypeError, ValueError):
        return UNION_MIN


def ports(node: dict) -> list[dict]:
    """Ports of a node: id, direction, required, max connections (one per receiving port)."""
    if node.get("type") == "union":
        names = tuple(f"in{i}" for i in range(1, union_input_count(node) + 1)), ("out",)
    else:
        names = PORT_NAMES.get(node.get("type"), (("in",), ("out",)))
    return [{"id": p, "direction": "input", "required": True, "max": 1} for p in names[0]] + \
        [{"id": p, "direction": "output", "required": False, "max": None} for p in names[1]]


class Graph:
    """The well-formed parts of a graph, and what its rules find wrong."""

    def __init__(self, raw):
        self.raw = raw if isinstance(raw, dict) else {}
        listed = {kind: self.raw.get(kind) for kind in ("nodes", "edges")}
        self.no_list = [kind for kind, items in listed.items() if not isinstance(items, list)]
        every = {kind: items if isinstance(items, list) else [] for kind, items in listed.items()}
        self.nodes = [n for n in every["nodes"] if self._named(n)]
        self.odd_nodes = [i for i, n in enumerate(every["nodes"]) if not self._named(n)]
        self.by_id = {n["id"]: n for n in self.nodes}
        self.known = {i: n for i, n in self.by_id.items() if n["type"] in NODE_TYPES}
        self.edges = [e for e in every["edges"] if self._whole(e)]
        self.odd_edges = [i for i, e in enumerate(every["edges"]) if not self._whole(e)]

    @staticmethod
    def _named(node) -> bool:
        return isinstance(node, dict) and all(str(node.get(k) or "").strip() for k in ("id", "type"))

    @staticmethod
    def _whole(edge) -> bool:
        return isinstance(edge, dict) and "id" in edge and all(
            isinstance(edge.get(end), dict) and {"nodeId", "portId"} <= edge[end].keys() for end, _ in ENDS)

    def port(self, edge: dict, end: str) -> dict | None:
        """The port at one end of an edge, if its node has it."""
        return next((p for p in ports(self.known[edge[end]["nodeId"]]) if p["id"] == edge[end]["portId"]), None)


def issue(code: str, message: str, node=None, edge=None) -> dict:
    place = f"node {node}" if node is not None else f"edge {edge}" if edge is not None else "graph"
    return {"code": code, "path": place, "message": message, "nodeId": node, "edgeId": edge, "severity": "error"}


def shape(g: Graph):
    for kind in g.no_list:
        yield issue(f"INVALID_{kind.upper()}", f"A graph has a list of {kind}.")
    for i in g.odd_nodes:
        yield issue("INVALID_NODE", f"The node at place {i} lacks an id or a type.")
    for i in g.odd_edges:
        yield issue("INVALID_EDGE", f"The edge at place {i} lacks an id or one of its ends.")


def identity(g: Graph):
    for node_id, times in Counter(n["id"] for n in g.nodes).items():
        if times > 1:
            yield issue("DUPLICATE_NODE_ID", f"{times} nodes have the id {node_id}.", node=node_id)
    for edge_id, times in Counter(e["id"] for e in g.edges).items():
        if times > 1:
            yield issue("DUPLICATE_EDGE_ID", f"{times} edges have the id {edge_id}.", edge=edge_id)
    for node_id in g.by_id.keys() - g.known.keys():
        yield issue("UNKNOWN_NODE_TYPE", f"There is no node type {g.by_id[node_id]['type']}.", node=node_id)


def settings(g: Graph):
    for node_id, node in g.known.items():
        kind, data = node["type"], node.get("data") or {}
        columns = data.get("columns")
        if kind == "select-columns" and columns == []:
            yield issue("NO_COLUMNS", "No column is selected.", node=node_id)
        if kind == "clean-text" and not (isinstance(columns, list) and columns):
            yield issue("CLEAN_TEXT_COLUMNS", "No column to clean is selected.", node=node_id)
        if kind == "clean-text" and data.get("caseMode", "unchanged") not in ("unchanged", "lowercase", "uppercase"):
            yield issue("INVALID_CLEAN_TEXT", f"There is no case mode {data['caseMode']}.", node=node_id)


def file_names(g: Graph):
    taken: dict[str, str] = {}
    for node_id, node in g.known.items():
        if node["type"] not in OUTPUT_TYPES:
            continue
        name = (node.get("data") or {}).get("filename")
        if not str(name or "").strip():
            yield issue("OUTPUT_FILENAME", "The output has no file name.", node=node_id)
        if not node.get("disabled"):
            file = output_filename(name, node["type"].split("-")[0])
            if taken.setdefault(file.lower(), node_id) != node_id:  # also where file names ignore case
                yield issue("OUTPUT_NAME_COLLISION", f"Another output writes {file} too.", node=node_id)


def ends(g: Graph):
    for edge in g.edges:
        for end, direction in ENDS:
            node_id, port_id = edge[end]["nodeId"], edge[end]["portId"]
            if node_id not in g.by_id:
                yield issue(f"DANGLING_{end.upper()}_NODE", f"The edge's {end}, node {node_id}, is not in the graph.", edge=edge["id"])
            elif node_id in g.known:
                port = g.port(edge, end)
                if port is None:
                    yield issue(f"MISSING_{end.upper()}_PORT", f"Node {node_id} has no port {port_id}.", edge=edge["id"])
                elif port["direction"] != direction:
                    yield issue(f"INVALID_{end.upper()}_DIRECTION", f"Port {port_id} of node {node_id} is no {direction}.", edge=edge["id"])


def connections(g: Graph):
    arriving = Counter((e["target"]["nodeId"], e["target"]["portId"]) for e in g.edges)
    for node_id, node in g.known.items():
        for port in ports(node):
            here = arriving[node_id, port["id"]]
            if port["required"] and not here:
                yield issue("REQUIRED_TARGET_PORT", f"Nothing is connected to port {port['id']}.", node=node_id)
            if port["max"] is not None and here > port["max"]:
                yield issue("TARGET_CONNECTION_LIMIT", f"{here} edges lead to port {port['id']}, which takes {port['max']}.", node=node_id)


def order(g: Graph):
    before: dict = {n: set() for n in g.by_id}
    for edge in g.edges:
        a, b = edge["source"]["nodeId"], edge["target"]["nodeId"]
        if a in before and b in before:
            before[b].add(a)
    try:
        graphlib.TopologicalSorter(before).prepare()
    except graphlib.CycleError as exc:
        yield issue("CYCLE", "Nodes lead back to themselves: " + ", ".join(map(str, exc.args[1])) + ".")


RULES = (shape, identity, settings, file_names, ends, connections, order)


def validate_pipeline(raw) -> dict:
    """All issues of a graph, by node and by edge, and the first one."""
    graph = Graph(raw)
    found = [i for rule in RULES for i in rule(graph)]
    by = {end: {} for end in ("nodeId", "edgeId")}
    for i in found:
        for end, groups in by.items():
            if i[end]:
                groups.setdefault(i[end], []).append(i)
    return {"valid": not found, "issues": found, "byNode": by["nodeId"], "byEdge": by["edgeId"], "firstIssue": next(iter(found), None)}
