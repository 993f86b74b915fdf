"""Control-flow graphs of files: basic blocks, edges, dominators, loops, paths.

Blocks come from expressions on a file's row; only its control lines and the first lines of its blocks are exploded
and numbered. Graph algorithms then see one file's graph as one row, so no two files' nodes ever meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import batched

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom import rules
from riskloom.functions.text import by_language

_TRIM = " \t\r\f\x0b"
#: rows that leave a task at once
ROWS = 1000
#: how far an else leads past the block that comes next
ELSE_STEP = 100


def _kind(text: Column) -> Column:
    is_ = lambda table: by_language("language", table, lambda r: text.rlike(r), None)
    return F.when(is_(rules.IFS), "if").when(is_(rules.ELSES), "else").when(is_(rules.LOOPS), "loop").when(text.rlike(rules.RETURNS), "return")


def condition_of(text: Column) -> Column:
    """What an if, while or for tests: in brackets, else up to a colon, else empty."""
    bare = F.regexp_extract(text, r"(?:if|while|for)\s+(.+):", 1)
    return F.coalesce(F.nullif(F.regexp_extract(text, r"(?:if|while|for)\s*\(([^)]+)\)", 1), F.lit("")), bare)


def _events(files: DataFrame) -> DataFrame:
    """The control lines of each file, first lines of blocks, and lines that leave a loop, in slim rows."""
    d = files.select("path", "language", F.split("content", "\n", -1).alias("ls"))
    d = d.select("path", "language", F.size("ls").alias("n_lines"), F.filter(F.transform("ls", lambda x, i: F.struct((i + 1).alias("line_no"), F.trim(x, F.lit(_TRIM)).alias("text"))), lambda x: x["text"] != "").alias("ls"))
    d = d.select("path", "n_lines", F.transform("ls", lambda x: F.struct(x["line_no"].alias("line_no"), _kind(x["text"]).alias("kind"), condition_of(x["text"]).alias("condition"), x["text"].rlike(r"\b(break|return|throw|raise)\b").alias("leaves"))).alias("ls"))

    def seen(x, i):
        before = F.get("ls", i - 1)
        return F.struct(x["line_no"].alias("line_no"), x["kind"].alias("kind"), x["condition"].alias("condition"), x["leaves"].alias("leaves"), (x["kind"].isNull() & ((i == 0) | before["kind"].isNotNull())).alias("opens"), ((i > 0) & before["kind"].isNull()).alias("after_block"))

    kept = F.filter(F.transform("ls", seen), lambda x: x["kind"].isNotNull() | x["opens"] | x["leaves"])
    return d.select("path", "n_lines", F.explode_outer(kept).alias("e")).select("path", "n_lines", "e.*")


def cfg_nodes(files: DataFrame) -> DataFrame:
    """(path, node, line_start, line_end, kind, condition, leaves, is_exit) of basic blocks, numbered as they come.

    Node 0 is the entry of every file. An if is a branch, a loop a loop, a return or throw an exit, each a block of one
    line; what stands between them is normal. An else ends a block and makes none. The last block is an exit too.
    """
    w = Window.partitionBy("path").orderBy("line_no")
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    starts = F.when(F.col("kind").isin("if", "loop", "return"), F.col("line_no") + 1).when((F.col("kind") == "else") & F.col("after_block"), F.col("line_no"))
    d = _events(files).withColumn("starts", starts).withColumn("begins", F.coalesce(F.col("opens") | F.col("kind").isin("if", "loop", "return"), F.lit(False)))
    d = d.withColumn("from", F.coalesce(F.last("starts", ignorenulls=True).over(before), F.lit(1)))
    d = d.withColumn("next", F.first(F.when(F.col("kind").isNotNull(), F.col("line_no")), ignorenulls=True).over(after))
    d = d.withColumn("node", F.sum(F.col("begins").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    entry = files.select("path", F.lit(0).alias("node"), F.lit(0).alias("line_start"), F.lit(0).alias("line_end"), F.lit("entry").alias("kind"), F.lit(None).cast("string").alias("condition"), F.lit(False).alias("leaves"), F.lit(False).alias("is_exit"))
    own = F.col("kind").isNotNull()
    n = d.where("line_no is not null and (kind is null or kind <> 'else')").groupBy("path", "node").agg(
        F.min(F.when(F.col("begins"), F.struct(F.when(own, F.col("line_no")).otherwise(F.col("from")).alias("line_start"), F.when(own, F.col("line_no")).otherwise(F.coalesce(F.col("next") - 1, F.col("n_lines"))).alias("line_end"), "kind", "condition", "next"))).alias("b"),
        F.max("leaves").alias("leaves"),
    )
    kind = F.coalesce(F.when(F.col("b.kind") == "if", "branch").when(F.col("b.kind") == "loop", "loop").when(F.col("b.kind") == "return", "exit"), F.lit("normal"))
    n = n.select("path", "node", "b.line_start", "b.line_end", kind.alias("kind"), F.when(F.col("b.kind").isin("if", "loop"), F.col("b.condition")).alias("condition"), "leaves", ((kind == "exit") | ((kind == "normal") & F.col("b.next").isNull())).alias("is_exit"))
    return entry.unionByName(n)


def cfg_edges(files: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(path, src, dst, edge_type, condition): each block leads to the next, an exit to none.

    The entry leads to the first block twice where a control line ends it. An else after any branch or loop leads from
    the block before it to one ELSE_STEP beyond the next, whether there is one or not.
    """
    nodes = cfg_nodes(files) if nodes is None else nodes
    w = Window.partitionBy("path").orderBy("node")
    test = F.col("kind").isin("branch", "loop")
    d = nodes.withColumn("dst", F.lead("node").over(w)).where("dst is not null and kind <> 'exit'")
    none = F.lit(None).cast("string")
    chain = d.select("path", F.col("node").alias("src"), "dst", F.when(test, "branch_true").otherwise("fall_through").alias("edge_type"), F.when(test, F.col("condition")).alias("condition"))
    twice = nodes.where("node = 1 and kind = 'normal' and not is_exit").select("path", F.lit(0).alias("src"), F.lit(1).alias("dst"), F.lit("fall_through").alias("edge_type"), none.alias("condition"))
    o = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    e = _events(files).where("line_no is not null").withColumn("done", F.sum(F.coalesce(F.col("opens") | F.col("kind").isin("if", "loop", "return"), F.lit(False)).cast("int")).over(o)).withColumn("open", F.max(F.coalesce(F.col("kind").isin("if", "loop"), F.lit(False))).over(o))
    e = e.where("kind = 'else' and open").select("path", F.col("done").cast("int").alias("src"), (F.col("done") + 1 + ELSE_STEP).cast("int").alias("dst"), F.lit("fall_through").alias("edge_type"), none.alias("condition"))
    return chain.unionByName(twice).unionByName(e)


def as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, nodes, edges): a file's graph in one row; edges to nodes that are not there are left out."""
    n = nodes.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("node", "is_exit", "leaves", "condition"))).alias("nodes"))
    e = edges.groupBy("path").agg(F.collect_list(F.struct("src", "dst")).alias("edges"))
    there = lambda x: F.array_contains("ids", x["src"]) & F.array_contains("ids", x["dst"])
    d = n.join(e, "path", "left").withColumn("ids", F.transform("nodes", lambda x: x["node"]))
    # nodes are 0, 1, 2, ...: only steps past the last one can miss
    far = F.exists("edges", lambda x: x["dst"] > F.element_at("ids", -1))
    return d.select("path", "nodes", F.coalesce(F.when(far, F.filter("edges", there)).otherwise(F.col("edges")), F.array().cast("array<struct<src:int,dst:int>>")).alias("edges"))


class Graph:
    """One file's graph."""

    def __init__(self, nodes: list[dict], edges: list[dict]):
        self.ids = [n["node"] for n in nodes]
        self.info = {n["node"]: n for n in nodes}
        self.edges = [(e["src"], e["dst"]) for e in edges]
        self.out: dict[int, list[int]] = {i: [] for i in self.ids}
        self.into: dict[int, list[int]] = {i: [] for i in self.ids}
        for a, b in self.edges:
            self.out[a].append(b)
            self.into[b].append(a)

    def reached(self, start: int) -> set[int]:
        seen, todo = {start}, [start]
        while todo:
            for b in self.out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    def dominator_tree(self) -> dict[int, tuple[int | None, int, int]]:
        """idom, enter, leave of each node that the entry reaches; a dominates b if b's enter lies from a's enter to a's leave."""
        return _numbered(self._immediate([0], self.out, self.into, ()))

    def post_dominator_tree(self) -> dict[int, tuple[int | None, int, int]]:
        """The same on ways to an exit, of each node that reaches one. Ways end at their first exit; exits have no idom."""
        exits = [n for n in self.ids if self.info[n]["is_exit"]]
        return _numbered(self._immediate(exits, self.into, self.out, exits))

    def dominators(self) -> dict[int, set[int]]:
        """On all ways from the entry; what it can't reach is dominated by everything."""
        return self._sets(self.dominator_tree())

    def post_dominators(self) -> dict[int, set[int]]:
        """On all ways to an exit; what reaches none is so by everything."""
        return self._sets(self.post_dominator_tree())

    def _sets(self, tree: dict[int, tuple[int | None, int, int]]) -> dict[int, set[int]]:
        found: dict[int, set[int]] = {}
        for n, (up, _, _) in sorted(tree.items(), key=lambda x: x[1][1]):  # a node after those above it
            found[n] = {n} | (found[up] if up is not None else set())
        return {n: found.get(n) or set(self.ids) for n in self.ids}

    def _immediate(self, roots: list[int], out: dict, into: dict, closed) -> dict[int, int]:
        """The node right above each in the dominator tree; -1 stands above all roots."""
        order: list[int] = []  # by depth-first search, a node after all that it leads to
        seen, closed = set(roots), set(closed)
        stack = [(r, iter(out[r])) for r in roots]
        while stack:
            at, rest = stack[-1]
            for b in rest:
                if b not in seen and b not in closed:
                    seen.add(b)
                    stack.append((b, iter(out[b])))
                    break
            else:
                order.append(at)
                stack.pop()
        rank = {n: i for i, n in enumerate(order)}
        top = len(order)
        rank[-1] = top
        up = {r: -1 for r in roots} | {-1: -1}

        def meet(a: int, b: int) -> int:
            while a != b:
                while rank[a] < rank[b]:
                    a = up[a]
                while rank[b] < rank[a]:
                    b = up[b]
            return a

        changed, root = True, set(roots)
        while changed:
            changed = False
            for n in reversed(order):
                if n in root:
                    continue
                new = None
                for p in into[n]:
                    if p in up:
                        new = p if new is None else meet(p, new)
                if new is not None and up.get(n) != new:
                    up[n] = new
                    changed = True
        del up[-1]
        return up

    def loops(self) -> Iterator[tuple[int, int, set[int], set[int]]]:
        """(header, tail, body, exits) of each edge to a dominator of its source."""
        tree = self.dominator_tree()
        for tail, header in self.edges:
            if not dominates(tree, header, tail):
                continue
            body, todo = {header, tail}, [tail]
            while todo:
                for p in self.into[todo.pop()]:
                    if p not in body:
                        body.add(p)
                        todo.append(p)
            yield header, tail, body, {a for a, b in self.edges if a in body and b not in body}

    def paths(self, target: int) -> Iterator[list[int]]:
        """All ways from the entry to a node that pass no node twice, without the node itself, one at a time.

        Nodes from which the target can't be reached are not entered.
        """
        if target == 0:
            yield []
            return
        useful, todo = {target}, [target]
        while todo:
            for p in self.into[todo.pop()]:
                if p not in useful:
                    useful.add(p)
                    todo.append(p)
        path, on, rest = [0], {0}, [iter(self.out[0])]
        while path:
            for b in rest[-1]:
                if b == target:
                    yield list(path)
                elif b not in on and b in useful:
                    path.append(b)
                    on.add(b)
                    rest.append(iter(self.out[b]))
                    break
            else:
                on.discard(path.pop())
                rest.pop()

    def components(self) -> dict[int, int]:
        """The strongly connected component of each node, by its least node; components come in the order of the condensation."""
        order: list[int] = []
        seen: set[int] = set()
        for root in self.ids:
            if root in seen:
                continue
            seen.add(root)
            stack = [(root, iter(self.out[root]))]
            while stack:
                at, rest = stack[-1]
                for b in rest:
                    if b not in seen:
                        seen.add(b)
                        stack.append((b, iter(self.out[b])))
                        break
                else:
                    order.append(at)
                    stack.pop()
        found: dict[int, int] = {}
        for root in reversed(order):
            if root in found:
                continue
            mine, todo = {root}, [root]
            while todo:
                for b in self.into[todo.pop()]:
                    if b not in found and b not in mine:
                        mine.add(b)
                        todo.append(b)
            found |= dict.fromkeys(mine, min(mine))
        return found

    def ways(self) -> dict[int, int]:
        """How many ways lead from the entry to each node that it reaches: to its component, by the edges between components.

        Without cycles these are the ways that pass no node twice. Counted along the condensation, never listed.
        """
        of = self.components()
        total = dict.fromkeys(dict.fromkeys(of.values()), 0)
        total[of[0]] = 1
        between: dict[int, list[int]] = {c: [] for c in total}
        for a, b in self.edges:
            if of[a] != of[b]:
                between[of[a]].append(of[b])
        for c in total:  # in the order of the condensation
            for d in between[c]:
                total[d] += total[c]
        return {n: total[of[n]] for n in self.ids if total[of[n]]}


def _numbered(up: dict[int, int]) -> dict[int, tuple[int | None, int, int]]:
    """Each node of a tree with the one above, the number at which a walk enters it, and the last number below it."""
    below: dict[int, list[int]] = {}
    for n in sorted(up, reverse=True):
        below.setdefault(up[n], []).append(n)
    enter, leave, stack = {}, {}, [(n, False) for n in below.get(-1, ())]
    while stack:
        n, done = stack.pop()
        if done:
            leave[n] = len(enter) - 1
            continue
        enter[n] = len(enter)
        stack.append((n, True))
        stack += [(c, False) for c in below.get(n, ())]
    return {n: (u if u != -1 else None, enter[n], leave[n]) for n, u in up.items()}


def dominates(tree: dict[int, tuple[int | None, int, int]], a: int, b: int) -> bool:
    """Whether a is on all ways to b; what no way reaches is dominated by everything."""
    return b not in tree or a in tree and tree[a][1] <= tree[b][1] <= tree[a][2]


def _each(graphs: DataFrame, schema: str, fn: Callable[[Graph], Iterator[tuple]]) -> DataFrame:
    kinds = _arrow(schema)

    def run(batches):
        for b in batches:
            for path, nodes, edges in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for rows in batched(fn(Graph(nodes, edges)), ROWS):
                    cols = [[path] * len(rows), *map(list, zip(*rows, strict=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)

    return graphs.select("path", "nodes", "edges").mapInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, types[t]) for n, t in (c.strip().split() for c in schema.split(","))])


def dominators(graphs: DataFrame) -> DataFrame:
    return _each(graphs, "path string, node int, dom int", lambda g: ((n, d) for n, ds in g.dominators().items() for d in ds))


def post_dominators(graphs: DataFrame) -> DataFrame:
    return _each(graphs, "path string, node int, pdom int", lambda g: ((n, d) for n, ds in g.post_dominators().items() for d in ds))


def dominator_trees(graphs: DataFrame) -> DataFrame:
    """(path, node, idom, enter, leave): a row for each node; all but path and node are null where the entry doesn't reach it, idom at the entry."""
    return _each(graphs, "path string, node int, idom int, enter int, leave int", lambda g: _of_tree(g, g.dominator_tree()))


def post_dominator_trees(graphs: DataFrame) -> DataFrame:
    return _each(graphs, "path string, node int, idom int, enter int, leave int", lambda g: _of_tree(g, g.post_dominator_tree()))


def _of_tree(g: Graph, tree: dict) -> Iterator[tuple]:
    return ((n, *tree.get(n, (None, None, None))) for n in g.ids)


def is_dominated(above: Column, by: Column) -> Column:
    """Whether a row of a tree (a struct of it) dominates another one of the same file: a test of two numbers."""
    return by["enter"].isNull() | F.coalesce(by["enter"].between(above["enter"], above["leave"]), F.lit(False))


def ways_to(graphs: DataFrame) -> DataFrame:
    """(path, node, ways): how many ways lead to each node that the entry reaches (see ``Graph.ways``); null beyond a long."""
    return _each(graphs, "path string, node int, ways long", lambda g: ((n, w if w < 2**63 else None) for n, w in g.ways().items()))


def unreachable(graphs: DataFrame) -> DataFrame:
    return _each(graphs, "path string, node int", lambda g: ((n,) for n in set(g.ids) - g.reached(0)))


def natural_loops(graphs: DataFrame) -> DataFrame:
    """(path, header, tail, body, exits, bound): bound is the variable that the header's condition limits, if any.

    infinite: nothing limits it, nothing in it leaves, and no edge does.
    """
    d = _each(graphs, "path string, header int, tail int, body array<int>, exits array<int>, condition string, leaves boolean", lambda g: ((h, t, sorted(b), sorted(x), g.info[h]["condition"], any(g.info[n]["leaves"] for n in b)) for h, t, b, x in g.loops()))
    bound = F.coalesce(*[F.nullif(F.regexp_extract("condition", r, 1), F.lit("")) for r in rules.BOUNDED])
    return d.select("path", "header", "tail", "body", "exits", bound.alias("bound"), (bound.isNull() & ~F.col("leaves") & (F.size("exits") == 0)).alias("infinite"))


def paths_to(graphs: DataFrame, target: Callable[[Graph], int]) -> DataFrame:
    """(path, target, nodes) of every way to a node of each graph that passes no node twice."""
    return _each(graphs, "path string, target int, way array<int>", lambda g: ((target(g), w) for w in g.paths(target(g))))
