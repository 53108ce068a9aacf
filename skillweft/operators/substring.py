"""Which texts hold which needles, without trying all pairs and without word boundaries."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.sources.staging import shared_path, staged

#: Needles up to this number and these bytes are counted first and become one automaton in every Python worker.
AUTOMATON_NEEDLES, AUTOMATON_BYTES = 50_000, 2 << 20

#: Characters of a key of the inverted index.
GRAM = 3


def holds(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """``text, needle``: every pair of a distinct ``text`` and a distinct ``needle`` that stands anywhere in it, once.

    Nulls and empty needles stand nowhere. The comparison is exact; callers fold case. Texts are names and titles: the index sends a text once for each needle's key that it
    holds.
    """
    t = texts.select(F.col("text").cast("string").alias("text")).where("text <> ''").distinct()
    n = needles.select(F.col("needle").cast("string").alias("needle")).where("needle <> ''").distinct()
    count, size = n.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("needle")), F.lit(0))).first()
    return scanned(t, n) if count <= AUTOMATON_NEEDLES and size <= AUTOMATON_BYTES else indexed(t, n)


def scanned(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """By an Aho-Corasick automaton of all needles, which were counted: every text is read once, whatever their number. Nothing is shuffled."""
    words = sorted(r["needle"] for r in needles.collect())
    shared = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, w in enumerate(shared.value):
            automaton.add_word(w, i)
        automaton.make_automaton()
        for b in batches:
            found = []
            for text in b.column("text").to_pylist():
                found += [(text, shared.value[i]) for i in sorted({i for _, i in automaton.iter(text)})]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.string()) for k in (0, 1)], names=["text", "needle"])

    if not words:
        return texts.select("text", F.col("text").alias("needle")).limit(0)
    return texts.select("text").mapInArrow(run, "text string, needle string")


def names_in(rows: DataFrame, key: str, text: str, terms: list[tuple[str, str]]) -> DataFrame:
    """F35 for long vocabularies: ``key, names``, the sorted distinct names of all ``terms`` (``term, name``) that stand in each row's text, in any case.

    One automaton finds all terms in one reading of a text, whatever their number; a fixed expression for each would read it as often as there are terms. Null texts hold
    none; every row stays.
    """
    if sum(len(t.encode()) for t, _ in terms) > AUTOMATON_BYTES:
        raise ValueError(f"a vocabulary of more than {AUTOMATON_BYTES} bytes: use holds")
    by: dict[str, set[str]] = {}
    for t, name in terms:
        if t:
            by.setdefault(t.lower(), set()).add(name)
    shared = rows.sparkSession.sparkContext.broadcast(by)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t, names in shared.value.items():
            automaton.add_word(t, names)
        if shared.value:
            automaton.make_automaton()
        for b in batches:
            found = [sorted(set().union(*(names for _, names in automaton.iter(t)))) if t and shared.value else [] for t in b.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(found, type=pa.list_(pa.string()))], names=[key, "names"])

    return rows.select(key, F.lower(text).alias("_t")).mapInArrow(run, f"`{key}` {kind}, names array<string>")


def grams(text: Column, shortest: int = 1) -> Column:
    """All distinct substrings of ``shortest`` to ``GRAM`` characters."""
    cut = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.array(*[cut(n) for n in range(shortest, GRAM + 1)])))


def indexed(texts: DataFrame, needles: DataFrame) -> DataFrame:
    """By an inverted index of trigrams: a needle waits at that one of its trigrams which the fewest texts hold, and is compared with those texts.

    A needle shorter than a trigram waits at itself. A needle with a trigram that no text holds meets none. Texts leave a row only for keys at which a needle waits.
    """
    work = shared_path(texts.sparkSession, "substring")
    own = F.when(F.length("needle") < GRAM, F.array("needle")).otherwise(grams(F.col("needle"), GRAM))
    wanted = staged(needles.select("needle", F.explode(own).alias("gram")), f"{work}/needles")
    posted = texts.select("text", F.explode(grams(F.col("text"))).alias("gram"))
    posted = staged(posted.join(wanted.select("gram").distinct(), "gram", "left_semi"), f"{work}/texts")
    held = posted.groupBy("gram").agg(F.count("*").alias("n"))
    rare = wanted.join(held, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("key"))
    rare = rare.where("key.n > 0").select("needle", F.col("key.gram").alias("gram"))
    return posted.join(rare, "gram").where(F.col("text").contains(F.col("needle"))).select("text", "needle")
