"""Pipelines as data (R1-R6): a JSON graph of nodes and edges, checked on the
driver (``graph``), then folded into lazy DataFrame plans, one per output node.

Nothing here schedules work: each node is one library operator applied to
its upstream ``Table``; Spark plans and runs the whole ancestor chain of an
output as one job (plus the deferred checks).  Only the ancestors of the
requested node are built, so an unbound input on another branch is fine.
"""

from __future__ import annotations

import copy
import json
import os
import time
from urllib.parse import unquote

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TableError
from ..operators.aggregate import group_by
from ..operators.columns import cast_columns, clean_text, rename_columns, select_columns
from ..operators.combine import HOT_ROWS, join_tables, union_tables
from ..operators.profile import preview, schema_list
from ..operators.rows import deduplicate_rows, filter_rows, handle_nulls, limit_rows, sort_rows
from ..sinks.files import output_filename, write_csv, write_jsonl, write_parquet
from ..sources.parquet import read_parquet
from ..sources.text import read_csv, read_jsonl
from ..session import scratch_path
from ..table import C, OrderKey, Table, as_table, hidden_name
from .graph import INPUT_TYPES, OUTPUT_TYPES, ports, union_input_count, validate_pipeline

#: Nodes that turn each row into at most one row by itself.
ROW_LOCAL = ("select-columns", "rename-columns", "clean-text", "cast", "filter-rows", "null-handling")
#: Nodes that move rows between tasks.
WIDE = ("join", "group-by", "deduplicate", "limit")
DOCUMENT_FORMAT = "tablewright-pipeline"
SCHEMA_VERSION = 1
INPUT_FILE_KEYS = ("file", "fileName", "filename", "path", "blobUrl", "preview", "result", "runtime")


class PipelineError(TableError):
    pass


# -- R5 / R6: documents and recipes ------------------------------------------------------------

class Document:
    """What is stored of a pipeline: per node the fields of ``NODE_FIELDS``, its settings without
    the file bound to an input, and per edge the fields of ``EDGE_FIELDS``."""

    NODE_FIELDS = ("id", "type", "position", "label", "data", "disabled", "size")
    EDGE_FIELDS = ("id", "source", "target")
    #: Settings of an input node that name a file rather than say how to read it.
    BINDING = frozenset(INPUT_FILE_KEYS)

    def __init__(self, graph):
        parts = [graph.get(k) if isinstance(graph, dict) else None for k in ("nodes", "edges")]
        if not all(isinstance(p, list) for p in parts):
            raise TypeError("A pipeline is an object with lists of nodes and edges.")
        self.extra = {k: copy.deepcopy(v) for k, v in graph.items() if k not in ("nodes", "edges")}
        self.nodes = [self._node(n) for n in parts[0]]
        self.edges = [{k: copy.deepcopy(e[k]) for k in self.EDGE_FIELDS if k in e} for e in parts[1]]

    def _node(self, node: dict) -> dict:
        kept = {k: copy.deepcopy(node[k]) for k in self.NODE_FIELDS if k in node}
        if kept.get("type") in INPUT_TYPES and isinstance(kept.get("data"), dict):
            kept["data"] = {k: v for k, v in kept["data"].items() if k not in self.BINDING}
        return kept

    @classmethod
    def read(cls, source) -> "Document":
        """From JSON text or its parsed form: a stored document (a ``graph`` with a ``schemaVersion``) or a bare graph."""
        if isinstance(source, str):
            try:
                source = json.loads(source)
            except json.JSONDecodeError as exc:
                raise ValueError("The text is not a JSON pipeline.") from exc
        stored = isinstance(source, dict) and "schemaVersion" in source and isinstance(source.get("graph"), dict)
        return cls(source["graph"] if stored else source)

    def graph(self) -> dict:
        return {"nodes": copy.deepcopy(self.nodes), "edges": copy.deepcopy(self.edges), **copy.deepcopy(self.extra)}

    def inputs(self) -> list[dict]:
        return [n for n in self.nodes if n.get("type") in INPUT_TYPES]

    def text(self, app_version: str = "") -> str:
        envelope = {"format": DOCUMENT_FORMAT, "schemaVersion": SCHEMA_VERSION, "appVersion": app_version or "", "graph": self.graph()}
        return json.dumps(envelope, ensure_ascii=False, indent=2)


def sanitize_graph(graph: dict) -> dict:
    """Copy of the graph with what a document stores only."""
    return Document(graph).graph()


def stringify_pipeline(graph: dict, app_version: str = "") -> str:
    return Document(graph).text(app_version)


def parse_pipeline(text) -> dict:
    return Document.read(text).graph()


def input_nodes(graph: dict) -> list[dict]:
    return Document(graph).inputs()


def make_recipe(name: str, graph: dict, recipe_id: str | None = None, now: int | None = None) -> dict:
    """A named pipeline with times in epoch milliseconds."""
    title = (name or "").strip()
    if not title:
        raise TypeError("A recipe needs a name.")
    stamp = time.time_ns() // 1_000_000 if now is None else int(now)
    return dict(id=recipe_id or f"recipe-{stamp}", name=title, graph=Document(graph).graph(), createdAt=stamp, updatedAt=stamp)


def normalize_recipes(value) -> list[dict]:
    """The usable recipes of a stored list."""
    def usable(item) -> dict | None:
        if not isinstance(item, dict) or not all(item.get(k) for k in ("id", "name", "graph")):
            return None
        try:
            recipe = make_recipe(str(item["name"]), item["graph"], str(item["id"]), item.get("createdAt") or 0)
            return recipe | {"updatedAt": int(item.get("updatedAt") or recipe["createdAt"])}
        except (TypeError, ValueError):
            return None
    return [r for r in map(usable, value if isinstance(value, list) else []) if r]


# -- R1 / R3: evaluation ----------------------------------------------------------------------------

class Evaluator:
    """Builds the lazy Table of any node from its ancestors only."""

    def __init__(self, spark: SparkSession, graph: dict, inputs: dict, keep_order: bool = True, target: str | None = None):
        self.spark = spark
        self.target = target
        self.read_limit: int | None = None
        self.graph = graph
        self.inputs = inputs or {}
        self.keep_order = keep_order
        self.nodes = {n["id"]: n for n in graph.get("nodes") or []}
        self.memo: dict[str, Table] = {}
        #: nodes whose rows are written once and read by all that use them
        self.staged: set = set()
        #: whether results are to be written, so that a look at the data is worth its job
        self.running = False
        #: where rows are counted: an observation per node
        self.counts: dict | None = None

    def upstream(self, node_id: str, port: str) -> str | None:
        for e in self.graph.get("edges") or []:
            if e["target"]["nodeId"] == node_id and e["target"]["portId"] == port:
                return e["source"]["nodeId"]
        return None

    def order_wanted(self, node_id: str) -> bool:
        """Whether the order of a node's rows can show in the target's result.

        It shows at the target itself, in limits and in which duplicate stays.  It ends at a sort
        that covers all group columns of the aggregate before it (no ties are left)."""
        if node_id == self.target:
            return True
        for e in self.graph.get("edges") or []:
            if e["source"]["nodeId"] != node_id:
                continue
            user = self.nodes[e["target"]["nodeId"]]
            kind, data = user["type"], user.get("data") or {}
            if not user.get("disabled"):
                if kind in OUTPUT_TYPES or kind in ("limit", "deduplicate"):
                    return True
                node = self.nodes[node_id]
                if kind == "sort" and node["type"] == "group-by" and not node.get("disabled"):
                    groups = (node.get("data") or {}).get("groups", (node.get("data") or {}).get("groupColumns")) or []
                    if set(groups) <= {(k or {}).get("column") for k in data.get("keys") or []}:
                        continue
            if self.order_wanted(user["id"]):
                return True
        return False

    def table(self, node_id: str) -> Table:
        if node_id not in self.memo:
            try:
                table = self._build(self.nodes[node_id])
                if self.counts is not None:
                    table = self._counted(node_id, table)
                if node_id in self.staged:
                    table = staged_table(table)
                self.memo[node_id] = table
            except TableError as exc:
                if getattr(exc, "nodeId", None) is None:
                    exc.nodeId = node_id
                    exc.details["nodeId"] = node_id
                raise
        return self.memo[node_id]

    def users(self, node_id: str) -> list[str]:
        return [e["target"]["nodeId"] for e in self.graph.get("edges") or [] if e["source"]["nodeId"] == node_id]

    def sources(self, node_id: str) -> list[str]:
        return [e["source"]["nodeId"] for e in self.graph.get("edges") or [] if e["target"]["nodeId"] == node_id]

    def share(self) -> None:
        """Marks the nodes to stage: the last ones that several uses have in common, where a shuffle
        (join, aggregate, deduplication, ordered limit) lies above that would run once per use."""
        leads: dict[str, bool] = {}

        def used(node_id: str) -> bool:  # some output gets its rows
            if node_id not in leads:
                leads[node_id] = self.nodes[node_id]["type"] in OUTPUT_TYPES or any([used(u) for u in self.users(node_id)])
            return leads[node_id]

        costly: dict[str, bool] = {}

        def wide(node_id: str) -> bool:  # a shuffle lies in or above it, and below the next staged node
            if node_id not in costly:
                node = self.nodes[node_id]
                above = any([wide(u) for u in self.sources(node_id)])
                here = (above or node["type"] in WIDE) and not (node.get("disabled") and not above)
                fans = sum(used(u) for u in self.users(node_id)) > 1
                if here and fans:
                    self.staged.add(node_id)
                costly[node_id] = here and not fans
            return costly[node_id]

        for node_id, node in self.nodes.items():
            if node["type"] in OUTPUT_TYPES:
                wide(node_id)

    def _counted(self, node_id: str, table: Table) -> Table:
        """The table with its rows counted by whatever computes them."""
        seen = Observation()
        self.counts[node_id] = seen
        return table.derive(table.df.observe(seen, F.count(F.lit(1)).alias("rows")))

    def node_rows(self) -> dict:
        """{node: {"in": rows of each input, "out": rows}} of the nodes computed; None where a node's rows were not needed."""
        out = {n: observed(seen) for n, seen in self.counts.items()}
        return {n: {"in": [out.get(u) for u in self.sources(n)], "out": rows} for n, rows in out.items()}

    def _in(self, node, port="in") -> Table:
        src = self.upstream(node["id"], port)
        if src is None:
            raise PipelineError("REQUIRED_TARGET_PORT", f"Nothing is connected to port {port}.", port=port)
        return self.table(src)

    def _read(self, node) -> Table:
        binding = self.inputs.get(node["id"])
        if binding is None:
            raise PipelineError("INPUT_NOT_BOUND", f"Input node {node['id']} has no file.")
        if isinstance(binding, (Table, DataFrame)):
            return as_table(binding)
        data, keep = node.get("data") or {}, self.keep_order and self.order_wanted(node["id"])
        if node["type"] == "csv-input":
            return read_csv(self.spark, binding, delimiter=data.get("delimiter", "auto"), header=data.get("header", True),
                            encoding=data.get("encoding", "utf-8"), multi_line=data.get("multiLine", False), keep_order=keep, carry=True)
        if node["type"] == "jsonl-input":
            return read_jsonl(self.spark, binding, keep_order=keep, limit=self.read_limit)
        return read_parquet(self.spark, binding, keep_order=keep)

    def _build(self, node) -> Table:
        kind, data = node["type"], node.get("data") or {}
        if kind in INPUT_TYPES:
            return self._read(node)
        if node.get("disabled"):
            first = next((p["id"] for p in ports(node) if p["direction"] == "input"), None)
            return self._in(node, first)
        if kind in OUTPUT_TYPES:
            return self._in(node)
        if kind == "join":
            return join_tables(self._in(node, "left"), self._in(node, "right"), data.get("type", "inner"), data.get("keys"),
                               HOT_ROWS if self.running else None)
        if kind == "union":
            tables = [self.table(s) for s in (self.upstream(node["id"], f"in{i + 1}") for i in range(union_input_count(node)))
                      if s is not None]
            return union_tables(tables, data.get("mode", "name"))
        t = self._in(node)
        if kind == "select-columns":
            return select_columns(t, data.get("columns"))
        if kind == "rename-columns":
            return rename_columns(t, data.get("mappings"))
        if kind == "clean-text":
            return clean_text(t, data.get("columns"), data.get("trim", True), data.get("caseMode", "unchanged"))
        if kind == "cast":
            return cast_columns(t, data.get("casts"), data.get("failureMode", "error"))
        if kind == "sort":
            return sort_rows(t, data.get("keys"))
        if kind == "limit":
            return limit_rows(t, data.get("limit", data.get("count")))
        if kind == "deduplicate":
            cols = data.get("columns") if data.get("mode", "all") == "selected" else None
            return deduplicate_rows(t, cols)
        if kind == "filter-rows":
            return filter_rows(t, data.get("conditions", data.get("rules")), data.get("combination", data.get("mode", "and")))
        if kind == "null-handling":
            return handle_nulls(t, data.get("mode"), data.get("columns"), data.get("replacement", ""))
        if kind == "group-by":
            return group_by(t, data.get("groups", data.get("groupColumns")), data.get("aggregates"))
        raise PipelineError("UNKNOWN_NODE_TYPE", f"There is no node type {kind}.")


def _checked(graph: dict) -> None:
    result = validate_pipeline(graph)
    if not result["valid"]:
        first = result["firstIssue"]
        raise PipelineError(first["code"], first["message"], nodeId=first["nodeId"], issues=result["issues"])


def evaluate_node(spark: SparkSession, graph: dict, node_id: str, inputs: dict, keep_order: bool = True) -> Table:
    """Lazy Table of one node (its ancestors only)."""
    _checked(graph)
    return Evaluator(spark, graph, inputs, keep_order, node_id).table(node_id)


def schema_issues(spark: SparkSession, graph: dict, inputs: dict) -> list[dict]:
    """Settings that don't fit the columns of the tables they meet (R2): one issue per node at fault.

    Builds the lazy tables of all outputs; only sources read (their schemas), no data job runs."""
    _checked(graph)
    ev, issues = Evaluator(spark, graph, inputs, keep_order=False), {}
    for node in graph.get("nodes") or []:
        if node["type"] in OUTPUT_TYPES:
            try:
                ev.table(node["id"])
            except TableError as exc:
                issues.setdefault(exc.nodeId, {"code": exc.code, "message": str(exc), "nodeId": exc.nodeId, "severity": "error"})
    return list(issues.values())


def preview_node(spark: SparkSession, graph: dict, node_id: str, inputs: dict, n: int = 100):
    """(preview rows as text, inferred schema of the previewed rows).

    Below a source and nodes that work row by row only, no more is read than the rows need: keys, types and
    checks are those of what was read.  CSV files are read in the order of their paths, the first alone, then
    more of them, until enough rows are left; columns are those of the files read, more of them if a node asks for others."""
    _checked(graph)
    first = Evaluator(spark, graph, inputs, target=node_id)
    path, kinds = node_id, []
    while first.nodes[path]["type"] in ROW_LOCAL + OUTPUT_TYPES and first.upstream(path, "in"):
        kinds.append(first.nodes[path]["type"])
        path = first.upstream(path, "in")
    source = first.nodes[path]["type"]
    # Only row-local nodes above one source: rows keep the scan's order, so a plain limit stops the scan early.
    local = source in INPUT_TYPES and isinstance((inputs or {}).get(path), (str, list, tuple))
    if local and source == "csv-input":
        return _preview_files(spark, graph, node_id, inputs, path, n)
    if local:
        first.keep_order = False
        if not {"filter-rows", "null-handling"} & set(kinds):
            first.read_limit = n  # no row is dropped on the way
    rows = limit_rows(first.table(node_id), n)
    if not local:
        rows.validate(carried=False)
    # the rows shown, computed once: text form and schema are taken of the same rows
    head = staged_head(rows)
    return preview(head, n), schema_list(head)


def _preview_files(spark: SparkSession, graph: dict, node_id: str, inputs: dict, source: str, n: int):
    """Preview of row-local nodes over CSV files: ever more files, in the order of their paths."""
    binding = inputs[source]
    files = sorted(unquote(f) for f in spark.read.text([binding] if isinstance(binding, str) else list(binding)).inputFiles())
    count = 1
    while True:
        some, whole = files[:count], count >= len(files)
        # one file is scanned in its order; of several the first rows are picked by their place
        ev = Evaluator(spark, graph, {**inputs, source: some or binding}, keep_order=len(some) > 1, target=node_id)
        try:
            rows = limit_rows(ev.table(node_id), n)
        except TableError as exc:
            if exc.code != "COLUMN_NOT_FOUND" or whole:
                raise
            rows = None
        if rows is not None:
            head = _first_rows(rows, n) if len(some) <= 1 else staged_head(rows)
            if whole or head.df.count() >= n:
                return preview(head, n), schema_list(head)
        count *= 4


def _first_rows(table: Table, n: int) -> Table:
    """The first ``n`` rows of an unordered table as a small table of its own.

    A collected limit runs on the first split, then on a few more, until it has its rows."""
    spark, place = table.df.sparkSession, hidden_name("place")
    with table.explained():
        found = table.to_df().limit(n).collect()
    rows = spark.createDataFrame([(i, *r) for i, r in enumerate(found)], T.StructType([T.StructField(place, T.LongType()), *table.schema.fields]))
    return Table(rows.select(*table.columns and [C(c) for c in table.columns], place), (OrderKey(place),))


def staged_head(table: Table) -> Table:
    """A small table written once to the shared folder and read back, in order."""
    spark, place = table.df.sparkSession, hidden_name("place")
    path = scratch_path(spark, "preview")
    with table.explained():
        table.to_df().withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    return Table(spark.read.parquet(path), (OrderKey(place),))


def staged_table(table: Table) -> Table:
    """The rows, order included, written once to the shared folder and read back; its checks are made by then."""
    spark = table.df.sparkSession
    path, fields = scratch_path(spark, "shared"), table.df.schema.fields
    table.validate(carried=False)
    kept = [(i, f) for i, f in enumerate(fields) if not isinstance(f.dataType, T.NullType)]
    with table.explained():
        # plain names: any name is allowed in a table
        table.df.select(*[C(f.name).alias(f"c{i}") for i, f in kept], F.lit(1).alias("row")).write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(T.StructType([*[T.StructField(f"c{i}", f.dataType) for i, f in kept], T.StructField("row", T.IntegerType())])).parquet(path)
    columns = [F.lit(None).alias(f.name) if isinstance(f.dataType, T.NullType) else C(f"c{i}").alias(f.name) for i, f in enumerate(fields)]
    return Table(stored.select(*columns), table.order, (), table.meta)


def observed(seen: Observation, wait: float = 5.0) -> int | None:
    """Rows of an observation whose action is over; None if Spark found that it need not compute them."""
    end = time.monotonic() + wait
    while not seen._jo.future().isCompleted():
        if time.monotonic() > end:
            return None
        time.sleep(0.05)
    return seen.get["rows"]


def run_pipeline(spark: SparkSession, graph: dict, inputs: dict, output_dir: str, keep_order: bool = True,
                 single_file: bool = False, node_counts: bool = False) -> list[dict]:
    """Write every output node; returns one result per output (file name,
    format, rows, columns).  A failure names its node.

    Nodes that several outputs have in common are computed once: below a join, an aggregate or another shuffle their
    rows are staged.  With ``node_counts`` each result also has ``nodeRows``, the rows in and out of every node, counted by the run's
    own jobs: rows are looked at in all nodes, so filters don't move into the sources, and an output in order is staged
    before it is sorted, as a sort reads its input twice."""
    _checked(graph)
    ev = Evaluator(spark, graph, inputs, keep_order)  # one memo: shared upstream nodes and their checks are built once
    ev.share()
    ev.running = True
    if node_counts:
        ev.counts = {}
    results = []
    for node in graph.get("nodes") or []:
        if node["type"] not in OUTPUT_TYPES:
            continue
        fmt = node["type"].split("-")[0]
        data = node.get("data") or {}
        try:
            table = ev.table(node["id"])
            if node_counts and table.order:
                table = staged_table(table)
            name = output_filename(data.get("filename"), fmt)
            path = os.path.join(output_dir, name)
            if fmt == "csv":
                rows = write_csv(table, path, delimiter=data.get("delimiter", ","), header=data.get("header", True),
                          single_file=single_file)
            elif fmt == "jsonl":
                rows = write_jsonl(table, path, single_file=single_file)
            else:
                rows = write_parquet(table, path, single_file=single_file)
        except TableError as exc:
            if getattr(exc, "nodeId", None) is None:
                exc.nodeId = node["id"]
            raise
        results.append({"nodeId": node["id"], "filename": name, "format": fmt.upper(), "path": path,
                        "rows": rows, "columns": len(table.columns)})
    if node_counts:
        counted = ev.node_rows()
        results = [r | {"nodeRows": counted} for r in results]
    return results
