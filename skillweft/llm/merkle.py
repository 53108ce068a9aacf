"""Merkle manifest of a table: a tree for each source, and a tree over the sources' roots.

A task holds a contiguous range of leaves. What it can't hash alone is a fragment: unresolved nodes by tree, level and index. Fragments form
a monoid: their union, in which every sibling run that is complete becomes its parent until none is. It is associative, so neighbours
are merged in rounds. The number of leaves of a tree says how many siblings a run has, the last one too.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, runs, small, staged

ARITY = 16
#: Leaves of a task's range, and fragments that are merged at once.
PART_ROWS, FAN_IN = 100_000, 32
#: The tree over the sources; a source's tree has its rank among the sources, from 0.
TOP = -1

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest_of(inputs: Iterable[str]) -> str:
    """Lowercase hex SHA-256 of the inputs one after the other."""
    return hashlib.sha256("".join(inputs).encode()).hexdigest()


def leaf(*values: Column) -> Column:
    """A row's leaf: each value as its UTF-8 byte count, ``:`` and the value; ``-`` if it is null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def width(n: int, level: int) -> int:
    """Nodes of a level of a tree of ``n`` leaves."""
    for _ in range(level):
        n = -(-n // ARITY)
    return n


class Forest:
    """Unresolved nodes ``{(tree, level): {index: digest}}`` of trees whose numbers of leaves are known.

    ``leaves`` gives a tree's number of leaves. With ``keep`` the children of every run that was completed are remembered, or given as ``runs``.
    """

    def __init__(self, leaves: dict[int, int], keep: bool = False) -> None:
        self.leaves, self.nodes, self.runs, self.keep = leaves, {}, {}, keep

    def add(self, tree: int, level: int, index: int, digest: str) -> None:
        self.nodes.setdefault((tree, level), {})[index] = digest

    def merge(self, other: Forest) -> Forest:
        """The monoid's operation: the union of two fragments of disjoint ranges, resolved."""
        out = Forest(self.leaves | other.leaves, self.keep or other.keep)
        out.runs = self.runs | other.runs
        for key in {*self.nodes, *other.nodes}:
            out.nodes[key] = self.nodes.get(key, {}) | other.nodes.get(key, {})
        return out.resolve()

    def resolve(self) -> Forest:
        """Hash every complete run, level by level; a source's root becomes a leaf of the tree over sources."""
        for tree in sorted({t for t, _ in self.nodes}, reverse=True):  # TOP is the last
            level, n = 0, self.leaves[tree]
            while n > 1:
                held = self.nodes.get((tree, level))
                if held:
                    self._complete(tree, level, n, held)
                level, n = level + 1, -(-n // ARITY)
            if tree != TOP and (root := self.nodes.pop((tree, level), None)):
                self.add(TOP, 0, tree, root[0])
        return self

    def _complete(self, tree: int, level: int, n: int, held: dict[int, str]) -> None:
        size: dict[int, int] = {}
        for i in held:
            size[i // ARITY] = size.get(i // ARITY, 0) + 1
        for p, k in size.items():
            first = p * ARITY
            if k == min(ARITY, n - first):
                children = [held.pop(i) for i in range(first, first + k)]
                self.add(tree, level + 1, p, digest_of(children))
                if self.keep:
                    self.runs[tree, level, p] = children
        if not held:
            del self.nodes[tree, level]

    def missing(self, tree: int, level: int, index: int) -> Iterator[tuple[int, int, int]]:
        """The runs from a node up to the root that aren't known here."""
        while True:
            n = width(self.leaves[tree], level)
            if n == 1:
                if tree == TOP:
                    return
                tree, level, index = TOP, 0, tree
                continue
            level, index = level + 1, index // ARITY
            if (tree, level - 1, index) not in self.runs:
                yield tree, level - 1, index


_NODE = {"part": pa.int64(), "kind": pa.string(), "tree": pa.int64(), "leaves": pa.int64(), "level": pa.int64(), "index": pa.int64(), "digests": pa.list_(pa.string())}
_NODE_SCHEMA = "part long, kind string, tree long, leaves long, level long, `index` long, digests array<string>"


def _ordered(rows: DataFrame, work: str) -> DataFrame:
    """``part, seq, source, order_id, leaf, tampered``: rows by source and id in ranges of about ``PART_ROWS``, numbered within the range and source.

    Rows with the same source and id follow their leaves; equal leaves are interchangeable and are dealt by a number of their own, so a
    repeated row is no large range. Null sources and ids come first.
    """
    held = staged(rows, f"{work}/leaves").withColumn("_tie", F.monotonically_increasing_id())
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("_tie")]
    parts = max(1, -(-held.count() // PART_ROWS))
    types = {"part": pa.int64(), "seq": pa.int64(), "source": pa.string(), "doc_id": pa.int64(), "leaf": pa.string(), "tampered": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seq = TaskContext.get().partitionId(), (), 0
        for b in batches:
            sources, numbers = b.column("source").to_pylist(), []
            for s in sources:
                seq = seq + 1 if (s,) == last else 0
                last = (s,)
                numbers.append(seq)
            yield batch({"part": [part] * len(sources), "seq": numbers, **{k: b.column(k) for k in ("source", "doc_id", "leaf", "tampered")}}, types)

    ranged = held.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return staged(arrow_map(ranged.select("source", "doc_id", "leaf", "tampered"), run, "part long, seq long, source string, doc_id long, leaf string, tampered string"), f"{work}/ordered")


def _pieces(ordered: DataFrame, work: str) -> DataFrame:
    """``part, source, first, leaves, tree, sources``: where each part's piece of a source begins, and the source's rank; a row for each.

    Ranges keep sources in order, so ranks are the numbers of sources that begin in the parts before, of which there is one number each.
    """
    counts = staged(ordered.groupBy("part", "source").agg(F.count("*").alias("n")), f"{work}/counts")
    own = Window.partitionBy("source").orderBy("part")  # at most a row for each part
    places = counts.withColumns({"first": F.sum("n").over(own) - F.col("n"), "leaves": F.sum("n").over(Window.partitionBy("source")), "begins": (F.row_number().over(own) == 1).cast("long")})
    places = staged(places.drop("n"), f"{work}/places")
    begun = places.groupBy("part").agg(F.sum("begins").alias("b"))  # a row for each part
    before = begun.select("part", (F.sum("b").over(Window.orderBy("part")) - F.col("b")).alias("before"), F.sum("b").over(Window.partitionBy()).alias("sources"))
    in_part = Window.partitionBy("part").orderBy(F.col("source").asc_nulls_first())
    ranked = places.join(F.broadcast(before), "part").withColumn("tree", F.col("before") + F.sum("begins").over(in_part) - 1)
    return staged(ranked.select("part", "source", "first", "leaves", "tree", "sources"), f"{work}/pieces")


def _local(table: pa.Table, keep: bool = True) -> tuple[Forest, list[tuple[int, int, int, int]]]:
    """The resolved forest of a part's rows (``tree, first, seq, leaves, sources, leaf``), and its pieces as ``(tree, first index, end, row)``."""
    trees, firsts, leaves = (table.column(k).to_pylist() for k in ("tree", "first", "leaves"))
    digests = table.column("leaf").to_pylist()
    forest = Forest({TOP: table.column("sources")[0].as_py()}, keep)
    pieces, at = [], 0
    for tree, group in itertools.groupby(trees):
        n = sum(1 for _ in group)
        forest.leaves[tree] = leaves[at]
        forest.nodes[tree, 0] = dict(enumerate(digests[at : at + n], firsts[at]))
        pieces.append((tree, firsts[at], firsts[at] + n, at))
        at += n
    return forest.resolve(), pieces


def _node_batch(part: int, forest: Forest, runs_: bool) -> pa.RecordBatch:
    rows = [(part, "node", t, forest.leaves[t], level, i, [d]) for (t, level), held in forest.nodes.items() for i, d in held.items()]
    if runs_:
        rows += [(part, "run", t, forest.leaves[t], level, p, children) for (t, level, p), children in forest.runs.items()]
    return batch(dict(zip(_NODE, map(list, zip(*rows, strict=True)), strict=True)) if rows else {k: [] for k in _NODE}, _NODE)


def _fragments(located: DataFrame) -> DataFrame:
    """Each part's unresolved nodes, and the runs (kind ``need``) that its rows' proofs lack."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            part = table.column("part")[0].as_py()
            forest, pieces = _local(table)
            yield _node_batch(part, forest, False)
            needs = sorted({r for tree, a, z, _ in (pieces[0], pieces[-1]) for i in (a, z - 1) for r in forest.missing(tree, 0, i)} | {r for (t, level), held in forest.nodes.items() for i in held for r in forest.missing(t, level, i)})
            yield batch({"part": [part] * len(needs), "kind": ["need"] * len(needs), "tree": [t for t, _, _ in needs], "leaves": [forest.leaves[t] for t, _, _ in needs], "level": [level for _, level, _ in needs], "index": [p for _, _, p in needs], "digests": [[]] * len(needs)}, _NODE)

    return arrow_map(located, run, _NODE_SCHEMA)


def tree_reduce(nodes: DataFrame, parts: int, sources: int, work: str) -> DataFrame:
    """Merges neighbouring fragments, ``FAN_IN`` at once, until one is left; returns the runs that were completed on the way and the root.

    ``RDD.treeReduce`` would merge fragments far apart, whose runs complete in the last step only, so that what is held grows with the
    parts. Between neighbours a fragment keeps at most 30 nodes a level of each tree at its ends.
    """
    fragments, done, k = nodes, None, 0
    while True:
        parts, k = -(-parts // FAN_IN), k + 1

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in runs(batches, "part"):
                forest = Forest({TOP: sources}, True)
                for _, group in itertools.groupby(table.select(["from", "tree", "leaves", "level", "index", "digests"]).to_pylist(), lambda r: r["from"]):
                    fragment = Forest({TOP: sources})
                    for r in group:
                        fragment.leaves[r["tree"]] = r["leaves"]
                        fragment.add(r["tree"], r["level"], r["index"], r["digests"][0])
                    forest = forest.merge(fragment)
                yield _node_batch(table.column("part")[0].as_py(), forest, True)

        dealt = fragments.withColumn("from", F.col("part")).withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long"))
        made = staged(arrow_map(dealt.repartition("part").sortWithinPartitions("part", "from", "tree", "level", "index"), run, _NODE_SCHEMA), f"{work}/round{k}")
        got = made.where("kind = 'run'")
        done = got if done is None else done.unionByName(got)
        fragments = made.where("kind = 'node'")
        if parts == 1:
            return done.unionByName(fragments.withColumn("kind", F.lit("root")))


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_OUT = {"doc_id": pa.int64(), "leaf": pa.string(), "subroot": pa.string(), "root": pa.string(), "proof_sha256": pa.string(), "folded_root": pa.string(), "verified": pa.bool_()}


def path_of(forest: Forest, tree: int, index: int) -> Iterator[tuple[int, list[str]]]:
    """A leaf's place in its run and the run's digests, level by level up to the root."""
    while True:
        level, n = 0, forest.leaves[tree]
        while n > 1:
            yield index % ARITY, forest.runs[tree, level, index // ARITY]
            level, n, index = level + 1, -(-n // ARITY), index // ARITY
        if tree == TOP:
            return
        tree, index = TOP, tree


def fold(digest: str, path: Iterable[tuple[int, list[str]]]) -> str:
    """The root that a leaf and its siblings give."""
    for at, run in path:
        digest = digest_of([*run[:at], digest, *run[at + 1 :]])
    return digest


def _proofs(rows: pa.Table, context: pa.Table, root: str) -> Iterator[pa.RecordBatch]:
    forest, pieces = _local(rows)
    for r in context.to_pylist():
        forest.leaves[r["tree"]] = r["leaves"]
        forest.runs[r["tree"], r["level"], r["index"]] = r["digests"]
    docs, leaves, tampered = (rows.column(k).to_pylist() for k in ("doc_id", "leaf", "tampered"))
    out: list[tuple] = []
    for tree, a, z, at in pieces:
        own = list(path_of(forest, TOP, tree))
        subroot = own[0][1][own[0][0]] if own else root
        above = "".join(d for place, run in own for k, d in enumerate(run) if k != place)
        for i in range(a, z):
            path = list(itertools.islice(path_of(forest, tree, i), forest_levels(forest.leaves[tree])))
            siblings = "".join(d for place, run in path for k, d in enumerate(run) if k != place) + above
            row = at + i - a
            folded = fold(tampered[row] or leaves[row], itertools.chain(path, own))
            out.append((docs[row], leaves[row], subroot, root, digest_of([siblings]), folded, folded == root))
            if len(out) >= 4096:
                yield batch(dict(zip(_OUT, map(list, zip(*out, strict=True)), strict=True)), _OUT)
                out = []
    if out:
        yield batch(dict(zip(_OUT, map(list, zip(*out, strict=True)), strict=True)), _OUT)


def forest_levels(n: int) -> int:
    """Levels of runs of a tree of ``n`` leaves."""
    k = 0
    while n > 1:
        n, k = -(-n // ARITY), k + 1
    return k


def manifest(rows: DataFrame, work: str) -> DataFrame:
    """Leaf, roots and proof of every row of ``rows``: ``source, doc_id, leaf, tampered``; ``tampered`` is another leaf to fold, or null.

    Leaves of a source ascend by ``doc_id``; while there are several nodes, every 16 consecutive ones become one; what remains is the source's
    ``subroot``, and the subroots in the order of their sources (null first) give ``root`` alike. ``proof_sha256`` is the hash of a leaf's siblings from
    its run up to the root; ``folded_root`` is what they give with ``tampered``, else ``leaf``; ``verified``: it is the root. Null ids come first, rows of equal ids are
    ordered by their leaves. No rows give no rows. Nodes that more than one part needs are few: a part takes 16 digests for each level and end of its range.
    """
    spark = rows.sparkSession
    ordered = _ordered(rows, work)
    if ordered.isEmpty():
        return spark.createDataFrame([], OUT)
    pieces = _pieces(ordered, work)
    on = (ordered["part"] == pieces["part"]) & ordered["source"].eqNullSafe(pieces["source"])
    located = staged(ordered.join(small(pieces), on).select(ordered["part"], "tree", "seq", "first", "leaves", "sources", "doc_id", "leaf", "tampered"), f"{work}/located")
    dealt = located.repartition("part").sortWithinPartitions("part", "tree", "seq")
    found = staged(_fragments(dealt), f"{work}/fragments")
    last, sources = pieces.agg(F.max("part"), F.max("sources")).first()
    solved = staged(tree_reduce(found.where("kind = 'node'"), last + 1, sources, work), f"{work}/solved")
    root = solved.where("kind = 'root'").select(F.col("digests")[0]).first()[0]
    needs = found.where("kind = 'need'").select("part", "tree", "level", "index")
    context = needs.join(small(solved.where("kind = 'run'").select("tree", "level", "index", "leaves", "digests")), ["tree", "level", "index"])
    none = lambda t: F.lit(None).cast(t)
    both = located.withColumns({"level": none("long"), "index": none("long"), "digests": none("array<string>")}).unionByName(context.withColumns({"seq": F.lit(-1).cast("long"), "first": none("long"), "sources": none("long"), "doc_id": none("long"), "leaf": none("string"), "tampered": none("string")}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, "part"):
            is_context = pa.compute.less(table.column("seq"), 0)
            yield from _proofs(table.filter(pa.compute.invert(is_context)), table.filter(is_context), root)

    return arrow_map(both.repartition("part").sortWithinPartitions("part", "tree", "seq"), run, OUT)


def document_leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, tampered`` of documents: leaves of id, source, language, length and text.

    Where 5 divides the unsigned crc32 of the decimal id, ``tampered`` is the leaf with the text's ``A-Z`` in lower case; it may equal the leaf. A null
    id isn't tampered with.
    """
    fields = lambda text: leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    text = F.col("text").cast("string")
    lowered = fields(F.translate(text, _UPPER, _LOWER))
    return docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), fields(text).alias("leaf"), F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, lowered).alias("tampered"))
