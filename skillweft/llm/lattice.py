"""Filter interaction audit: what each filter removes after every set of other filters.

A document's row of failed filters decides what happens to it in every order. Of the ``k * 2^(k-1)`` edges of the subset
lattice, (filters already applied, next filter), it counts on those whose filter it meets. An order is a path through the
lattice, so the steps of all orders are one join of the summed edges with a fixed table; documents aren't replayed.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skillweft.llm.common import small, staged

#: More filters than these have too many orders for a table of steps.
MOST_FILTERS = 7

_SPACE = r"[\x20\x09-\x0D]+"


def text_filters(text: Column) -> dict[str, Column]:
    """Whether a whole text (null: empty) fails each of the four filters on words and characters.

    ``A``: fewer than 200 words. ``B``: under half of the words are distinct. ``C``: over 2 % of the code points are ``A-Z``. ``D``: holds one
    of ``#$%&*|``. Words are maximal runs without ASCII white space, case-sensitive. An empty text fails ``A`` only.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(t, _SPACE), "")
    capitals = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
    return {"A": F.size(words) < 200, "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * 50, "C": capitals * 100 > F.length(t) * 2, "D": t.rlike(r"[#$%&*|]")}


def masks(docs: DataFrame, work: str) -> DataFrame:
    """``doc_id, part, mask``: bit i says that a document fails the i-th filter of ABCDE.

    ``E``: the same text, by its SHA-256, stands at a smaller ``doc_id``, in whatever part. Texts are read once; what is written
    has a digest a row. Only digests of several rows are joined back, with a row each, so the rows of a common
    text can be split or find that side broadcast. A null text is empty. A null ``doc_id`` is neither smaller nor larger than any;
    rows that repeat an id don't fail by each other. A null ``source`` is the part ``''``.
    """
    fails = text_filters(F.col("text"))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(fails.values())), F.lit(0))
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = staged(docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), digest.alias("digest"), bits.cast("int").alias("mask")), f"{work}/rows")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    first = small(staged(first, f"{work}/first"))
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return rows.join(first, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(copy, 1 << len(fails)).otherwise(0)).alias("mask"))


def marked(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``good`` and ``toxic``: whether ``labels`` has a row of the document with ``quality`` 1, with ``toxic`` 1. Repeated label rows count once."""
    known = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    no = F.lit(False)
    return rows.join(known, "doc_id", "left").withColumns({"good": F.coalesce("good", no), "toxic": F.coalesce("toxic", no)})


def edges(rows: DataFrame, filters: int) -> DataFrame:
    """Counts of every lattice edge of every part: ``part, applied, next, met, removed, redundant, unique_fails, good_lost, toxic_lost``.

    ``rows``: ``part, mask, good, toxic``. ``applied`` is the set of filters before (a mask), ``next`` the filter's number, ``met`` the
    documents that reach it. Rows are first summed by what can differ between them, at most ``4 * 2^filters`` sums a part, and
    these stand on the edges: both aggregations combine before their shuffle, and a large part is no large group.
    """
    kinds = rows.groupBy("part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    lattice = [(s, f) for f in range(filters) for s in range(1 << filters) if not s >> f & 1]
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("next")) for s, f in lattice]))
    on = kinds.withColumn("edge", each).select("part", "mask", "good", "toxic", "n", "edge.applied", "edge.next")
    bit = F.expr("shiftleft(1, next)")
    fails, alive = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return on.groupBy("part", "applied", "next").agg(
        total(alive).alias("met"),
        total(alive & fails).alias("removed"),
        total(~alive & fails).alias("redundant"),
        total(F.col("mask") == bit).alias("unique_fails"),
        total(alive & fails & F.col("good")).alias("good_lost"),
        total(alive & fails & F.col("toxic")).alias("toxic_lost"),
    )


def steps(spark: SparkSession, names: str) -> DataFrame:
    """The steps of all orders of the filters as lattice edges: ``filter_order, step, applied, next``."""
    rows = []
    for order in itertools.permutations(range(len(names))):
        path = "".join(names[f] for f in order)
        rows += [(path, k + 1, sum(1 << f for f in order[:k]), f) for k, f in enumerate(order)]
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, next int")


def audit(rows: DataFrame, names: str) -> DataFrame:
    """A row for each part, order of the filters and step; counts are of documents of the part.

    ``rows``: ``part, mask, good, toxic``, where bit i of ``mask`` is the i-th letter of ``names``. ``kept``: left after the step;
    ``removed`` by it; ``redundant``: failing its filter, but removed before; ``unique_fails``: failing no other filter; ``good_lost``,
    ``toxic_lost``: removed and so marked; ``shapley``: what its filter removes, summed over all orders. An edge lies on ``|applied|! * (filters - 1 - |applied|)!``
    orders, so that sum too is one over edges. The edges are summed over once and read for both; the table of steps has a fixed
    size. No rows give no rows.
    """
    k = len(names)
    if not 0 < k <= MOST_FILTERS or len(set(names)) < k:
        raise ValueError(f"1 to {MOST_FILTERS} filters with different letters")
    summed = edges(rows, k)
    orders = F.element_at(F.array(*[F.lit(math.factorial(i) * math.factorial(k - 1 - i)) for i in range(k)]), F.bit_count("applied") + 1)
    lattice = summed.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).alias("shapley"), F.collect_list(F.struct("applied", "met", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")).alias("e"))  # 2^(k-1) edges each
    flat = lattice.select("part", "next", "shapley", F.inline("e"))
    found = flat.join(F.broadcast(steps(rows.sparkSession, names)), ["applied", "next"])
    whole = lambda *cs: [F.col(c).cast("long").alias(c) for c in cs]
    return found.select("part", "filter_order", "step", (F.col("met") - F.col("removed")).cast("long").alias("kept"), *whole("removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))


def filter_audit(docs: DataFrame, labels: DataFrame, work: str) -> DataFrame:
    """The audit of the five filters ABCDE over whole texts, by ``source``."""
    return audit(marked(masks(docs, work), labels), "ABCDE")
