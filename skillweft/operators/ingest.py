"""Cleaning and upserts of raw records."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.functions import text as X
from skillweft.operators import running
from skillweft.sources.staging import shared_path, small, staged


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key; ``order`` has to be total."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(old: DataFrame, new: DataFrame, key: list[str], merge: str | None = None) -> DataFrame:
    """New rows replace old ones by key; the map column ``merge`` keeps old entries that the new row lacks."""
    if merge is None:
        return old.join(new.select(*key), key, "left_anti").unionByName(new)
    before = old.select(*key, F.col(merge).alias("_old"))
    with_old = F.coalesce(F.map_filter(F.col("_old"), lambda k, v: ~F.map_contains_key(F.coalesce(F.col(merge), F.create_map().cast("map<string,string>")), k)), F.create_map().cast("map<string,string>"))
    merged = new.join(before, key, "left").withColumn(merge, F.map_concat(F.coalesce(F.col(merge), F.create_map().cast("map<string,string>")), with_old)).drop("_old")
    return old.join(new.select(*key), key, "left_anti").unionByName(merged)


def unprocessed(rows: DataFrame, done: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Rows without an enrichment yet, in order of the key."""
    left = rows.join(done.select(key), key, "left_anti")
    return left if limit is None else left.orderBy(key).limit(limit)


def route(rows: DataFrame, column: str, tables: dict[str, str]) -> dict[str, DataFrame]:
    """S3: the rows of each target table by item type."""
    return {table: rows.where(F.col(column) == kind) for kind, table in tables.items()}


def accepted(items: DataFrame, shortest: int = 50) -> DataFrame:
    """Items that are regular jobs, name a position and have enough text."""
    reason = F.coalesce(X.employment_reason(F.col("title"), F.col("tags")), X.invalid_job_reason(F.col("title")))
    return items.where(reason.isNull() & (X.joined_length(F.col("title"), F.col("description"), F.col("requirements"), F.col("raw_text")) >= shortest))


def trimmed(rows: DataFrame, *fields: str) -> DataFrame:
    """Known text fields without white space at their ends."""
    return rows.withColumns({f: F.regexp_replace(f, r"^\s+|\s+$", "") for f in fields})


def extractable(rows: DataFrame, text: str, shortest: int = 10) -> DataFrame:
    """Rows whose trimmed text has at least ``shortest`` characters."""
    return rows.where(F.length(F.trim(F.coalesce(text, F.lit("")))) >= shortest)


def without_employment(rows: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored rows (``id, url, title, tags``) that C1 keeps, and the evidence that is left."""
    lost = rows.where(X.employment_reason(F.col("title"), F.col("tags")).isNotNull()).select("id", "url")
    return purge(rows, evidence, lost)


def purge(rows: DataFrame, evidence: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without those of ``lost`` (``id, url``), and evidence without their URLs."""
    return rows.join(lost.select("id"), "id", "left_anti"), evidence.join(lost.select("url").where("url is not null"), "url", "left_anti")


def rename_plan(names: DataFrame, column: str) -> DataFrame:
    """C17: names with a level word: their new name, and whether it is taken (null: nothing to do)."""
    new = F.trim(F.regexp_replace(F.col(column), "初级|中级|高级|资深|专家", ""))
    plan = names.select(F.col(column).alias("old"), new.alias("new")).where("old <> new")
    taken = names.select(F.col(column).alias("new"), F.lit(True).alias("conflict")).distinct()
    return plan.join(taken, "new", "left").select("old", "new", F.coalesce("conflict", F.lit(False)).alias("conflict"))


def _leaps(n: np.ndarray, keys: np.ndarray, size: int, most: int) -> np.ndarray:
    """Where the chunk that begins at each row ends: after ``size`` rows, before over ``most`` characters, or with its key."""
    at, total = np.arange(len(n)), np.concatenate([[0], np.cumsum(n)])
    by_chars = np.maximum(np.searchsorted(total, total[:-1] + most, "right") - 1, at + 1)
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(n))
    return np.minimum(np.minimum(at + size, by_chars), ends[np.searchsorted(ends, at, "right")])


def chunks(texts: DataFrame, key: str, order: str, text: str, size: int, most: int, block: int = 200_000) -> DataFrame:
    """C14: chunk number of each text of a key: a chunk closes at ``size`` texts or before it has over ``most`` characters.

    Where a chunk begins depends on all before it, but not where the one that begins at a row ends. Rows are numbered by key and
    ``order`` (distinct in a key) and cut into blocks, whatever the keys. Each block, with the first ``size`` lengths of the next, finds for
    every row at which it can be entered where it is left and how many chunks it holds. These functions compose, so neighbouring
    blocks' are merged in a tree and the way down it tells each block where it begins; then the blocks number their rows. Only lengths are held, of one block
    in a task, and nothing comes to the driver.
    """
    block = max(block, size)
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("_key"), F.col(order).alias("_order"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("_n"), F.xxhash64(key).alias("_k"), F.struct(key, order).alias("_o"))
    held = staged(running.numbered(rows, "_o", "_i").drop("_o").withColumn("_i", F.col("_i").cast("long") - 1).withColumn("_b", F.floor(F.col("_i") / block)), shared_path(spark, "chunks"))
    ahead = held.where((F.col("_b") > 0) & (F.col("_i") % block < size)).withColumn("_b", F.col("_b") - 1)
    seen = held.select("_b", "_i", "_n", "_k").unionByName(ahead.select("_b", "_i", "_n", "_k"))

    def enter(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        b, keys = int(pdf["_b"].iloc[0]), pdf["_k"].to_numpy()
        own, leap = min(block, len(pdf)), _leaps(pdf["_n"].to_numpy(), keys, size, most)
        out = []
        for e in range(min(size, own) + 1):
            i, n, new = e, 0, False
            last, fresh = -1, False  # of the chunk that reaches to the block's end; -1: none begins here
            while i < own:
                j, last, fresh = int(leap[i]), n, new
                if j >= len(keys) or keys[j] != keys[i]:
                    n, new = 0, True
                else:
                    n += 1
                i = j
            out.append((b, e, i - own, n, new, last, fresh))
        return pd.DataFrame(out, columns=["b", "e", "exit", "n", "new", "last", "fresh"])

    ways = staged(seen.groupBy("_b").applyInPandas(enter, _WAY), shared_path(spark, "ways"))
    begin = _begins(ways)

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_i")
        keys, leap = pdf["_k"].to_numpy(), _leaps(pdf["_n"].to_numpy(), pdf["_k"].to_numpy(), size, most)
        i, n = int(pdf["_e"].iloc[0]), int(pdf["_number"].iloc[0])
        out = np.full(len(pdf), int(pdf["_before"].iloc[0]), np.int64)
        while i < len(pdf):
            j = int(leap[i])
            out[i:j] = n
            n = n + 1 if j < len(keys) and keys[j] == keys[i] else 0
            i = j
        return pd.DataFrame({key: pdf["_key"], order: pdf["_order"], "chunk": out})

    fields = {f.name: f.dataType.simpleString() for f in texts.schema}
    return held.join(small(begin), "_b").groupBy("_b").applyInPandas(assign, f"`{key}` {fields[key]}, `{order}` {fields[order]}, chunk long")


#: What a block does to a walk that enters it at its row ``e``: it leaves at row ``exit`` of the next one, the number of its next chunk is ``n`` (``new``) or ``n`` more, and
#: so is that of the chunk that reaches to its end (``last``, ``fresh``; -1: none begins here).
_WAY = "b long, e long, exit long, n long, new boolean, last long, fresh boolean"
#: Neighbouring blocks that are merged at once.
FAN_IN = 64


def _begins(ways: DataFrame) -> DataFrame:
    """``_b, _e, _number, _before``: where the walk from row 0 enters each block, and the numbers of the next chunk and the one before."""
    spark = ways.sparkSession
    work = shared_path(spark, "walk")

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = {(r.b, r.e): r for r in pdf.itertuples()}
        blocks, out = sorted({b for b, _ in steps}), []
        for e in sorted(e for b, e in steps if b == blocks[0]):
            at, n, new, last, fresh = e, 0, False, -1, False
            for b in blocks:
                r = steps[b, at]
                if r.last >= 0:
                    last, fresh = (r.last, True) if r.fresh else (n + r.last, new)
                n, new = (r.n, True) if r.new else (n + r.n, new)
                at = r.exit
            out.append((blocks[0] // FAN_IN, e, at, n, new, last, fresh))
        return pd.DataFrame(out, columns=["b", "e", "exit", "n", "new", "last", "fresh"])

    top = ways.agg(F.max("b")).first()[0]
    levels = [ways]
    while top:
        top //= FAN_IN
        levels.append(staged(levels[-1].withColumn("up", F.floor(F.col("b") / FAN_IN)).groupBy("up").applyInPandas(lambda pdf: merged(pdf), _WAY), f"{work}/up{len(levels)}"))

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        steps = {(r.b, r.e): r for r in pdf.itertuples()}
        first = pdf.iloc[0]
        at, number, before, out = int(first["_e"]), int(first["_number"]), int(first["_before"]), []
        for b in sorted({b for b, _ in steps}):
            out.append((b, at, number, before))
            r = steps[b, at]
            if r.last >= 0:
                before = r.last if r.fresh else number + r.last
            number, at = (r.n if r.new else number + r.n), r.exit
        return pd.DataFrame(out, columns=["_b", "_e", "_number", "_before"])

    begin = spark.createDataFrame([(0, 0, 0, 0)], "_b long, _e long, _number long, _before long")
    for k, level in reversed(list(enumerate(levels[:-1]))):
        below = level.withColumn("_b", F.floor(F.col("b") / FAN_IN)).join(begin, "_b")
        begin = staged(below.groupBy("_b").applyInPandas(walked, "_b long, _e long, _number long, _before long"), f"{work}/down{k}")
    return begin


def post_processed(skills: DataFrame, key: str) -> DataFrame:
    """F8: cleaned valid skills of each key, the first of each lower-cased name. ``skills``: ``key, seq, name``."""
    cleaned = skills.withColumn("name", X.clean_skill(X.skill_alias(F.col("name")))).where(X.valid_skill(F.col("name")))
    w = Window.partitionBy(key, F.lower("name")).orderBy("seq")
    return cleaned.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
