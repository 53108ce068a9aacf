"""Agreement with labels, golden sets and parameter search."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skillweft.operators.running import numbered, running_sum
from skillweft.sources.staging import shared_path, staged


def f1(rows: DataFrame, shortest: int = 3) -> DataFrame:
    """Micro precision, recall and F1 of skill arrays ``pred`` and ``gold``; names shorter than ``shortest`` are noise."""
    keep = lambda c: F.filter(F.array_distinct(F.transform(c, F.lower)), lambda s: F.length(s) >= shortest)
    p, g = keep("pred"), keep("gold")
    n = rows.agg(F.sum(F.size(F.array_intersect(p, g))).alias("tp"), F.sum(F.size(F.array_except(p, g))).alias("fp"), F.sum(F.size(F.array_except(g, p))).alias("fn"))
    precision, recall = (F.coalesce(F.try_divide(F.col("tp"), F.col("tp") + F.col(x)), F.lit(0.0)) for x in ("fp", "fn"))
    return n.select("tp", "fp", "fn", precision.alias("precision"), recall.alias("recall"), F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)).alias("f1"))


def confusion(rows: DataFrame) -> DataFrame:
    """Counts of each pair of labels."""
    return rows.groupBy("gold", "pred").agg(F.count("*").alias("n"))


def recall_fpr(rows: DataFrame) -> DataFrame:
    """Recall and false-positive rate of a boolean ``pred`` against a boolean ``gold``."""
    tp, fn, fp, tn = (F.count_if(c) for c in (F.col("pred") & F.col("gold"), ~F.col("pred") & F.col("gold"), F.col("pred") & ~F.col("gold"), ~F.col("pred") & ~F.col("gold")))
    return rows.agg(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)).alias("fpr"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Rank correlation with average ranks on ties.

    The rank of a value follows from how many rows have each smaller one: values are counted first, and the running sum over
    distinct values is dealt by ranges.
    """

    def ranks(c: str) -> DataFrame:
        n = rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        return running_sum(n, "v", F.col("n"), "s").select("v", (F.col("s") - F.col("n") + (F.col("n") + 1) / 2).alias("r"))

    a, b = ranks(x).toDF(x, "rx"), ranks(y).toDF(y, "ry")
    return rows.join(a, x).join(b, y).agg(F.corr("rx", "ry").alias("rho"))


def accuracy_at(rows: DataFrame, at: float = 0.5) -> DataFrame:
    """Share of rows whose score falls on its label's side."""
    return rows.agg(F.avg(((F.col("score") >= at) == (F.col("label") == 1)).cast("int")).alias("accuracy"))


def top3(rows: DataFrame, k: int = 3) -> DataFrame:
    """Share of candidates with ``k`` pairs and a positive one that have a positive in their best ``k``."""
    w = Window.partitionBy("candidate").orderBy(F.desc("score"), "position_name")
    each = rows.withColumn("rn", F.row_number().over(w)).groupBy("candidate").agg(F.count("*").alias("n"), F.max("label").alias("any"), F.max(F.when(F.col("rn") <= k, F.col("label"))).alias("hit"))
    return each.where((F.col("n") >= k) & (F.col("any") == 1)).agg(F.count("*").alias("candidates"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy"))


def kappa(rows: DataFrame, a: str, b: str, at: float = 0.5) -> DataFrame:
    """Cohen's kappa of two scores cut at ``at``; 0 for fewer than two rows, 1 where chance alone agrees."""
    x, y = (F.col(a) >= at).cast("int"), (F.col(b) >= at).cast("int")
    s = rows.agg(F.count("*").alias("n"), F.avg((x == y).cast("int")).alias("po"), F.avg(x).alias("px"), F.avg(y).alias("py"))
    pe = F.col("px") * F.col("py") + (1 - F.col("px")) * (1 - F.col("py"))
    return s.select(F.when(F.col("n") < 2, 0.0).when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)).alias("kappa"))


def random_points(spark, ranges: dict[str, tuple[float, float]], n: int, seed: int = 42) -> DataFrame:
    """``n`` points of a search over continuous ranges, the same for the same seed."""
    rng = np.random.default_rng(seed)
    low, high = (np.array([r[i] for r in ranges.values()], float) for i in (0, 1))
    points = low + rng.random((n, len(ranges))) * (high - low)
    return spark.createDataFrame(pd.DataFrame(points, columns=list(ranges)))


def grid_search(rows: DataFrame, grid: DataFrame, pred, least_recall: float = 0.8) -> DataFrame:
    """For each point of a grid or of ``random_points`` (ten thousand at most) recall and false-positive rate; the best is the one with the lowest
    rate of those that reach ``least_recall``. ``pred``: a boolean column over rows and grid."""
    keys = grid.columns
    if grid.limit(10_001).count() > 10_000:
        raise ValueError("more than ten thousand points")
    both = rows.join(F.broadcast(grid), how="cross").withColumn("pred", pred)
    scored = _rates(both, keys)
    best = F.when(F.col("recall") >= least_recall, 0).otherwise(1)
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(best, "fpr", F.desc("recall"), *keys)))


def objective(recall: Column, fpr: Column, most: float = 0.15) -> Column:
    """What a search maximises: recall, less half of what the false-positive rate has over ``most``."""
    return recall - 0.5 * F.greatest(F.lit(0.0), fpr - most)


def successive_halving(rows: DataFrame, points: DataFrame, pred: Column, key: str, eta: int = 3) -> DataFrame:
    """A search that gives many points few rows and few points many: ``rung``, the point's columns, ``recall, fpr, objective, rank`` of every evaluation.

    Each rung keeps the best of ``eta`` points and takes ``eta`` times as many rows, drawn by the MD5 of their ``key``; a rung's rows are among the next one's. The last one is over all rows. So all rungs together
    compare about as many pairs of row and point for each rung as there are points on ``eta ** -rungs`` of the rows. ``points`` are ten thousand at most and distinct; ``rows`` has a boolean ``gold``, ``pred`` is over rows and points. Ties
    go to the lower rate, then the smaller point.
    """
    names, n = points.columns, points.limit(10_001).count()
    if n > 10_000:
        raise ValueError("more than ten thousand points")
    rungs, k = 0, n
    while k > 1:
        k, rungs = -(-k // eta), rungs + 1
    work, held, out = shared_path(rows.sparkSession, "halving"), points, None
    for r in range(rungs + 1):
        some = rows if r == rungs else rows.where(F.substring(F.md5(F.col(key).cast("string")), 1, 8) < format(2**32 // eta ** (rungs - r), "08x"))
        both = some.join(F.broadcast(held), how="cross").withColumn("pred", pred)  # points were counted
        scored = held.join(_rates(both, names), names, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("recall", "fpr")})
        best = Window.orderBy(F.desc("objective"), "fpr", *names)  # a row a point
        rung = scored.withColumn("objective", F.round(objective(F.col("recall"), F.col("fpr")), 9)).withColumn("rank", F.row_number().over(best)).withColumn("rung", F.lit(r))
        rung = staged(rung, f"{work}/{r}")
        n = -(-n // eta)
        held = rung.where(F.col("rank") <= n).select(*names)
        out = rung if out is None else out.unionByName(rung)
    return out


def _rates(both: DataFrame, keys: list[str]) -> DataFrame:
    tp, fn, fp, tn = (F.count_if(c) for c in (F.col("pred") & F.col("gold"), ~F.col("pred") & F.col("gold"), F.col("pred") & ~F.col("gold"), ~F.col("pred") & ~F.col("gold")))
    return both.groupBy(*keys).agg(F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0)).alias("recall"), F.coalesce(F.try_divide(fp, fp + tn), F.lit(0.0)).alias("fpr"))


def stratified_sample(rows: DataFrame, strata: list[str], order: list[str], quota: int, total: int) -> DataFrame:
    """``quota`` rows of each stratum in order, filled up in order to ``total``.

    A stratum's rows can't take more than ``total``, so only its first ``total`` are ranked on.
    """
    w = Window.partitionBy(*strata).orderBy(*order)
    held = rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= total)
    first = F.when(F.col("_k") <= quota, 0).otherwise(1)
    return held.orderBy(first, *order).limit(total).drop("_k")


#: Places of the ring that are looked through together.
STRETCH = 4096


def _next_on_ring(ring: DataFrame, n: int, width: int, enough: int, most: int) -> DataFrame:
    """``id, at, found``: of each row of a ring of ``n`` the first ``enough`` of the ``width`` rows after it that share ``most`` skills with it at most, as ``id, s``.

    A stretch of the ring is dealt with the ``width`` places after it, so a row is sent about once, not once for each row before it.
    """
    m = max(1, n // max(STRETCH, width))  # stretches are wider than what is looked at, so a row is seen from its own and one more
    before = (F.col("at") - width + n) % n  # the first row that sees this one
    of = lambda at: F.floor(at * m / n)
    home = F.struct(of(F.col("at")).alias("stretch"), F.col("at").alias("place"), F.lit(True).alias("home"))
    guest = F.struct(of(before).alias("stretch"), (before + width).alias("place"), F.lit(False).alias("home"))
    seen_before = (of(before) != of(F.col("at"))) | (before > F.col("at"))
    dealt = ring.select("id", "s", "at", F.inline(F.when(seen_before, F.array(home, guest)).otherwise(F.array(home))))
    after = Window.partitionBy("stretch").orderBy("place").rowsBetween(1, width)
    held = dealt.withColumn("next", F.collect_list(F.struct("id", "s")).over(after)).where("home")
    strange = F.filter("next", lambda x: F.size(F.array_intersect("s", x["s"])) <= most)
    return held.select("id", "at", F.slice(strange, 1, enough).alias("found"))


def golden_pairs(positions: DataFrame, key: str, skills: str, keep: float = 0.6, other_keep: float = 0.7, most: int = 1, negatives: int = 2, draws: int = 1024) -> DataFrame:
    """For each position a candidate with a ``keep`` of its skills (``label`` 1), and ``negatives`` with an ``other_keep`` of another position's that
    shares ``most`` skills with it at most (0): ``position, other, label, candidate_skills``, the skills sorted.

    Subsets are drawn by hash, one skill at least, alike every time. Others are drawn from the ring of all positions by hash, from the position's own
    place on, until there are enough or ``draws`` were looked at; so positions with a common skill are never listed, and what is shuffled grows with
    the positions. Each round looks at eight times as many for those that lack some. Positions without skills have no pairs; keys are distinct.
    """
    rows = positions.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), F.array_distinct(F.coalesce(skills, F.array().cast("array<string>"))).alias("s")).where(F.size("s") > 0)
    work = shared_path(positions.sparkSession, "pairs")
    rows = staged(rows, f"{work}/rows")  # ranges are drawn from it before it is dealt
    ring = numbered(rows.withColumn("_m", F.struct(F.md5(F.col("id").cast("string")).alias("h"), "id")), "_m", "at").select("id", "s", (F.col("at") - 1).alias("at"))
    ring = staged(ring, f"{work}/ring")
    n = ring.count()

    def subset(owner: Column, held: Column, share: float) -> Column:
        drawn = F.transform(F.array_sort(F.transform(held, lambda x: F.struct(F.md5(F.concat_ws(":", owner.cast("string"), x)).alias("h"), x.alias("x")))), lambda p: p["x"])
        return F.array_sort(F.slice(drawn, 1, F.greatest(F.lit(1), F.floor(F.size(held) * share)).cast("int")))

    none = F.lit(None).cast(ring.schema["id"].dataType)
    out = ring.select(F.col("id").alias("position"), none.alias("other"), F.lit(1).alias("label"), subset(F.col("id"), F.col("s"), keep).alias("candidate_skills"))
    def paired(got: DataFrame) -> DataFrame:
        return got.select(F.col("id").alias("position"), "other", F.lit(0).alias("label"), subset(F.col("other"), F.col("o"), other_keep).alias("candidate_skills"))

    first = min(16, draws, n - 1)
    if first < 1:
        return out
    seen = staged(_next_on_ring(ring, n, first, negatives, most), f"{work}/first")
    out = out.unionByName(paired(seen.select("id", F.explode("found").alias("f")).select("id", F.col("f.id").alias("other"), F.col("f.s").alias("o"))))
    lacking = seen.where(F.size("found") < negatives).select("id", "at", (F.lit(negatives) - F.size("found")).alias("lacks"))
    open_, looked, width = staged(lacking.join(ring.select("id", "s"), "id"), f"{work}/open"), first, first * 8
    others = ring.select(F.col("id").alias("other"), F.col("s").alias("o"), F.col("at").alias("to"))
    while looked < min(draws, n - 1) and not open_.isEmpty():
        upto = min(width, draws, n - 1)
        asked = open_.withColumn("d", F.explode(F.sequence(F.lit(looked + 1), F.lit(upto)))).withColumn("to", (F.col("at") + F.col("d")) % n)
        strange = asked.join(others, "to").where(F.size(F.array_intersect("s", "o")) <= most)
        nth = Window.partitionBy("id").orderBy("d")  # the rows of one round
        got = staged(strange.withColumn("k", F.row_number().over(nth)).where(F.col("k") <= F.col("lacks")).select("id", "other", "o"), f"{work}/{upto}")
        out = out.unionByName(paired(got))
        left = open_.join(got.groupBy("id").agg(F.count("*").alias("g")), "id", "left").withColumn("lacks", F.col("lacks") - F.coalesce("g", F.lit(0))).drop("g").where("lacks > 0")
        open_, looked, width = staged(left, f"{work}/open{upto}"), upto, width * 8
    return out


def weights_of(config: dict[str, object], defaults: dict[str, float]) -> dict[str, float]:
    """the configured weights if every one of the defaults' names has a number that isn't negative, else the defaults."""
    try:
        found = {k: float(config[k]) for k in defaults}  # type: ignore[arg-type]
    except (KeyError, TypeError, ValueError):
        return dict(defaults)
    return found if functools.reduce(lambda ok, v: ok and v >= 0, found.values(), True) else dict(defaults)


def configured_weights(config: Column, defaults: dict[str, float]) -> Column:
    """F38 for a column of JSON texts: a struct of the weights, or of the defaults unless every one of their names has a number, or a text of one, that isn't negative."""
    read = {k: F.get_json_object(config, f"$.{k}").try_cast("double") for k in defaults}
    fine = functools.reduce(lambda ok, k: ok & F.coalesce((read[k] >= 0) & ~F.isnan(read[k]), F.lit(False)), defaults, F.lit(True))
    return F.struct(*[F.when(fine, read[k]).otherwise(F.lit(float(v))).alias(k) for k, v in defaults.items()])


def report(frame: pd.DataFrame) -> dict[str, object]:
    """The one row of a small result as a dictionary."""
    return frame.iloc[0].to_dict() if len(frame) else {}
