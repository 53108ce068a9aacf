"""New positions: candidates, their life cycle and grounding."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.functions import scores as S
from skillweft.functions import vocab as V
from skillweft.operators import retrieval, substring, trends
from skillweft.operators.nearest import nearest


def candidates(features: DataFrame) -> DataFrame:
    """M5, M6, M7: positions that pass the gate, with their confidence.

    ``features``: ``position_name, jd_count, sources, z, ma3, growth, history, successes, trials, arxiv, github``.
    """
    passes = S.passes_gate(F.col("z"), F.col("sources"), F.coalesce("ma3", F.lit(0.0)), F.col("history"), F.col("successes"), F.col("trials"))
    trust = S.discovery_confidence(F.col("jd_count"), F.col("sources"), F.coalesce("growth", F.lit(0.0)), F.col("arxiv"), F.col("github"))
    return features.where(passes).select("position_name", "jd_count", "sources", trust.alias("confidence"), F.lit("candidate").alias("state"))


def legal(changes: DataFrame) -> DataFrame:
    """M8: whether each change ``state -> target`` may be made; one by hand needs a reason."""
    table = changes.sparkSession.createDataFrame(list(V.TRANSITIONS), "state string, target string").withColumn("_ok", F.lit(True))
    by_hand = (F.coalesce("operator", F.lit("auto")) == "auto") | (F.trim(F.coalesce("reason", F.lit(""))) != "")
    return changes.join(F.broadcast(table), ["state", "target"], "left").withColumn("legal", F.coalesce("_ok", F.lit(False)) & by_hand).drop("_ok")


def transitions(rows: DataFrame, compat: bool = False) -> DataFrame:
    """M8, M9: adds ``next_state`` (null: stays) from ``state, confidence, sources, freqs, z`` of each position.

    With ``compat`` the windows are the earliest ones, as the reference reads them.
    """
    fall = trends.decline_rate(F.col("freqs"), 3, compat) > 0.4
    calm = (F.size("freqs") >= 2) & (trends.volatility(F.col("freqs"), 2, compat) < 0.25)
    nxt = (
        F.when((F.col("state") == "candidate") & (F.col("confidence") >= 0.6) & (F.col("sources") >= 2), "emerging")
        .when((F.col("state") == "emerging") & (F.col("confidence") >= 0.8) & calm & (F.col("sources") >= 2), "stable")
        .when(F.col("state").isin("emerging", "stable") & fall, "declining")
        .when((F.col("state") == "declining") & trends.recovery(F.col("z")), "stable")
    )
    return rows.withColumn("next_state", nxt)


def upserted(old: DataFrame, new: DataFrame) -> DataFrame:
    """New candidates replace old ones, but a position that has left the candidate state keeps it.

    Both: ``position_name, state, confidence, jd_freq_ma3``; a missing average is 0.
    """
    o = old.select("position_name", F.col("state").alias("os"), F.col("confidence").alias("oc"), F.col("jd_freq_ma3").alias("om"))
    keeps = F.col("os").isNotNull() & (F.col("os") != "candidate")
    rows = o.join(new, "position_name", "full")
    return rows.select("position_name", F.when(keeps | F.col("state").isNull(), F.col("os")).otherwise(F.col("state")).alias("state"), F.coalesce("confidence", "oc").alias("confidence"), F.coalesce("jd_freq_ma3", "om", F.lit(0.0)).alias("jd_freq_ma3"))


def authoritative(names: DataFrame, vocabulary: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """All entries that fit each name, ``name, code, score``: 1.0 if the entry's name holds it, 0.5 if only an alias does, and with ``vectors`` the cosine of the ten nearest.

    ``vocabulary``: ``code, name`` and maybe ``aliases``; ``vectors``: ``id, vector`` of names and codes. An entry's highest score counts. Case and outer white space
    don't matter; names under three characters are not looked up, and no name is found by words only. Entries are found by a substring join.
    """
    folded = lambda c: F.lower(F.trim(c))
    looked = names.select("name", folded(F.col("name")).alias("key")).where(F.length("key") >= 3).distinct()
    terms = vocabulary.select("code", folded(F.col("name")).alias("term"), F.lit(1.0).alias("score"))
    if "aliases" in vocabulary.columns:
        terms = terms.unionByName(vocabulary.select("code", F.explode("aliases").alias("a")).select("code", folded(F.col("a")).alias("term"), F.lit(0.5).alias("score")))
    pairs = substring.holds(terms.select(F.col("term").alias("text")), looked.select(F.col("key").alias("needle")))
    hits = pairs.join(terms, pairs["text"] == terms["term"]).join(looked, F.col("needle") == F.col("key")).select("name", "code", "score")
    if vectors is not None:
        left = looked.join(vectors, F.col("name") == F.col("id")).select("id", "vector")
        right = vocabulary.select("code").join(vectors, F.col("code") == F.col("id")).select("id", "vector")
        hits = hits.unionByName(nearest(left, right, -1.0, 10).select(F.col("a").alias("name"), F.col("b").cast(vocabulary.schema["code"].dataType).alias("code"), "score"))
    return hits.groupBy("name", "code").agg(F.max("score").alias("score"))


def grounded(names: DataFrame, seeds: DataFrame, vocabulary: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """The seed and the best authoritative entry of each name, and a draft: the entry's definition, else the seed's.

    ``seeds``: ``seed_order, seed, terms, description``; ``vocabulary``: ``code, name, definition`` and maybe ``aliases``. Of entries with one score the smallest
    code is taken.
    """
    seed = retrieval.match_seeds(names, seeds).join(seeds.select("seed", "description"), "seed", "left")
    best = authoritative(names, vocabulary, vectors).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "code")).alias("hit")).select("name", F.col("hit.code").alias("code"))
    entry = best.join(vocabulary.groupBy("code").agg(F.min("definition").alias("definition")), "code", "left")
    return names.select("name").distinct().join(seed, "name", "left").join(entry, "name", "left").select("name", "seed", "code", F.coalesce("definition", "description").alias("draft"))
