"""Seeds, full text and merged retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skillweft.functions import text as X
from skillweft.operators import substring
from skillweft.sources.staging import shared_path, small, staged


def match_seeds(names: DataFrame, seeds: DataFrame) -> DataFrame:
    """The first seed whose name or alias a position holds, or that holds it. ``seeds``: ``seed_order, seed, terms``.

    Case and outer white space don't count, and words need no spaces around them. Both directions are substring joins, so neither side is tried against all of the other.
    """
    folded = lambda c: F.lower(F.trim(c))
    terms = seeds.select("seed_order", "seed", F.explode("terms").alias("t")).select("seed_order", "seed", folded(F.col("t")).alias("term")).where("term <> ''")
    own = names.select("name", folded(F.col("name")).alias("key")).where("key <> ''").distinct()
    keys, words = own.select("key").distinct(), terms.select("term").distinct()
    inside = substring.holds(keys.select(F.col("key").alias("text")), words.select(F.col("term").alias("needle"))).select(F.col("text").alias("key"), F.col("needle").alias("term"))
    around = substring.holds(words.select(F.col("term").alias("text")), keys.select(F.col("key").alias("needle"))).select(F.col("needle").alias("key"), F.col("text").alias("term"))
    first = inside.unionByName(around).join(terms, "term").groupBy("key").agg(F.min_by("seed", "seed_order").alias("seed"))
    return own.join(first, "key").select("name", "seed")


def keyword_hits(vocabulary: DataFrame, query: str) -> DataFrame:
    """Entries whose name (1.0) or an alias (0.5) holds the query, in any case. ``vocabulary``: ``code, name, aliases``."""
    q = F.lit(query.lower())
    by_name, by_alias = F.lower("name").contains(q), F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a).contains(q))
    return vocabulary.where(by_name | by_alias).select("code", F.when(by_name, 1.0).otherwise(0.5).alias("score"))


def bm25(docs: DataFrame, key: str, text: str, query: str, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Documents with a query term, by BM25 over their own token table. Only query terms leave a row's task.

    Lengths and counts are aggregated over all documents; the query's words are a constant.
    """
    words = sorted({w for w in query.lower().split() if w})
    rows = docs.select(key, X.tokens(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    counted = rows.select(key, F.size("t").alias("len"), *[_count(F.col("t"), w).alias(f"f{i}") for i, w in enumerate(words)])
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(words))])  # one row
    whole = counted.join(F.broadcast(stats), how="cross")
    parts = [F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5)) * F.col(f"f{i}") * (k1 + 1) / (F.col(f"f{i}") + k1 * (1 - b + b * F.col("len") / F.col("avg"))) for i in range(len(words))]
    return whole.select(key, sum(parts, F.lit(0.0)).alias("score")).where("score > 0")


def search(indexes: dict[str, tuple[DataFrame, str, str]], query: str, n: int = 10) -> DataFrame:
    """``index, key, score``, the ``n`` best of each index; an index is a table with its key and text columns.

    Scores are of each index's own statistics, so indexes are not ranked against each other.
    """
    found = None
    for name, (docs, key, text) in indexes.items():
        best = bm25(docs, key, text, query).select(F.lit(name).alias("index"), F.col(key).cast("string").alias("key"), "score").orderBy(F.desc(F.round("score", 10)), "key").limit(n)
        found = best if found is None else found.unionByName(best)
    return found


def _count(tokens, word: str):
    return F.size(F.filter(tokens, lambda x: x == word))


def merge_hits(hits: DataFrame, key: str, n: int) -> DataFrame:
    """V7: the best score of each entry, the ``n`` best of them."""
    return hits.groupBy(key).agg(F.max("score").alias("score")).orderBy(F.desc("score"), key).limit(n)


def within_budget(hits: DataFrame, group: str, key: str, tokens: str, budget: int, k: int) -> DataFrame:
    """V8: of each group's hits by score, those that still fit a token budget, at most ``k``; one that doesn't fit is skipped.

    The next one kept is the best after the last that fits what is left, an aggregation that combines before its shuffle: ``k``
    of them, with a row a group between, and a group's hits are never together.
    """
    work = shared_path(hits.sparkSession, "budget")
    order = F.struct((-F.col("score")).alias("s"), F.col(key).alias("k"))
    best = staged(hits.groupBy(group, key).agg(F.max("score").alias("score"), F.max(tokens).cast("long").alias("tokens")).where(F.col("tokens") <= budget).select(group, order.alias("o"), "tokens"), f"{work}/best")
    state, out = None, None
    for rank in range(1, k + 1):
        open_ = best if state is None else best.join(small(state), group).where((F.col("o") > F.col("_o")) & (F.col("tokens") + F.col("_used") <= budget))
        used = F.lit(0).cast("long") if state is None else F.col("_used")
        step = staged(open_.groupBy(group).agg(F.min(F.struct("o", "tokens", used.alias("used"))).alias("x")).select(group, F.col("x.o").alias("_o"), F.col("x.tokens").alias("tokens"), (F.col("x.used") + F.col("x.tokens")).alias("_used")), f"{work}/{rank}")
        if step.isEmpty():
            break
        kept = step.select(group, F.col("_o.k").alias(key), (-F.col("_o.s")).alias("score"), "tokens", F.lit(rank).alias("rank"))
        out = kept if out is None else out.unionByName(kept)
        state = step.select(group, "_o", "_used")
    return out if out is not None else best.select(group, F.col("o.k").alias(key), (-F.col("o.s")).alias("score"), "tokens", F.lit(0).alias("rank"))


def ranked(hits: DataFrame, group: str, key: str, k: int) -> DataFrame:
    """The ``k`` best of each group; ties by key."""
    w = Window.partitionBy(group).orderBy(F.desc("score"), key)
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
