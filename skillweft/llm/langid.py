"""Language identification: averaged hashed subword embeddings with a linear softmax and calibrated rejection.

A text is the average of the embeddings of its hashed letter 2- to 4-grams (marked at word ends). Embeddings and the
softmax are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. On a part of that sample which
training doesn't see, a temperature is fitted to smoothed labels, and rejection to what isn't known: the same texts as seen without their own language,
and with their letters shuffled. For prediction the product of
embeddings and softmax weights is one small table, and the scores of a whole text are a mean of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch

ORDERS = (2, 3, 4)
#: Bits by which buckets are finer where only their being known counts.
FINER = 5
#: Share of texts in no known language that scores allow for.
STRANGERS = 0.01
#: Code points whose grams are looked up at once.
SLICE = 1 << 18
_lut: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Lower-case code point of each letter, 0 for all else."""
    global _lut
    if _lut is None:
        _lut = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            if (s := chr(c)).isalpha():
                low = s.lower()
                _lut[c] = ord(low) if len(low) == 1 else c
    return _lut


def codes(text: str) -> np.ndarray:
    """The letters of a text as lower-case code points, other characters as 0, between two 0."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(len(raw) + 2, np.uint32)
    out[1:-1] = _letters()[raw]
    return out


def grams(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all grams in a code sequence and where each begins. Only a gram's first or last character may be 0."""
    buckets, places = [], []
    word = x != 0
    for n in ORDERS:
        m = len(x) - n + 1
        if m <= 0:
            continue
        ok = word[1:m + 1].copy() if n > 2 else word[:m] | word[1 : m + 1]
        for j in range(2, n - 1):
            ok &= word[j : m + j]
        h = np.full(m, n, np.uint32)
        for j in range(n):
            h = (h ^ x[j : m + j]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        at = np.flatnonzero(ok)
        buckets.append((h[at] * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits))
        places.append(at)
    if not buckets:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    return np.concatenate(buckets), np.concatenate(places)


@dataclass
class Model:
    """``table`` has a row of class scores for each bucket, ``known`` has a bit for each language and finer bucket that it was seen with, ``accept`` are a logistic's weights."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int
    known: np.ndarray | None = None
    accept: np.ndarray | None = None

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Summed class scores, numbers of grams of whole texts, and how many of these training never saw in each language.

        Long texts are read in slices that reach as far into the next one as a gram does; each gram counts where it begins.
        """
        sums, counts, strange = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)), np.int64)
        held, total = [], 0

        def flush() -> None:
            x = np.concatenate([c for _, c, _ in held])
            ends = np.cumsum([len(c) for _, c, _ in held])
            fine, places = grams(x, self.bits + FINER)
            doc = np.searchsorted(ends, places, "right")
            if any(len(c) > own for _, c, own in held):
                mine = places - (ends - [len(c) for _, c, _ in held])[doc] < np.array([own for _, _, own in held])[doc]
                fine, doc = fine[mine], doc[mine]
            buckets = fine >> np.uint32(FINER)
            texts_of = [i for i, _, _ in held]
            for k in range(len(self.languages)):
                np.add.at(sums[:, k], texts_of, np.bincount(doc, self.table[:, k][buckets], len(held)))
                if self.known is not None:
                    np.add.at(strange[:, k], texts_of, np.bincount(doc[~seen(self.known[k], fine)], minlength=len(held)))
            np.add.at(counts, texts_of, np.bincount(doc, minlength=len(held)))
            held.clear()

        for i, t in enumerate(texts):
            if not t:
                continue
            c = codes(t)
            for a in range(0, len(c), SLICE):
                held.append((i, c[a : a + SLICE + max(ORDERS) - 1], SLICE))
                total += len(held[-1][1])
                if total >= SLICE:
                    flush()
                    total = 0
        if held:
            flush()
        return sums, counts, strange

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (``und`` without a letter), calibrated probability and whether it is rejected, for each text.

        The probability is the softmax's times that of being in a known language at all, if ``STRANGERS`` are not. By the latter texts are rejected.
        """
        sums, counts, strange = self.scores(texts)
        p = softmax((sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature)
        best = p.argmax(1)
        top = p[np.arange(len(texts)), best]
        fits = np.ones(len(texts)) if self.accept is None else accepted(self.accept, counts, strange[np.arange(len(texts)), best], top)
        score = np.where(counts > 0, top * fits * (1 - STRANGERS) / (fits * (1 - STRANGERS) + (1 - fits) * STRANGERS), 0.0)
        return [self.languages[k] if c else "und" for k, c in zip(best, counts, strict=True)], score, (counts == 0) | (fits < self.threshold)


def seen(known: np.ndarray, fine: np.ndarray) -> np.ndarray:
    """Bits of a packed row."""
    return (known[fine >> 3] >> (7 - (fine & 7)).astype(np.uint8)) & 1 == 1


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def _traits(counts: np.ndarray, strange: np.ndarray, top: np.ndarray) -> np.ndarray:
    """What acceptance is judged by: the share of grams that are new in the predicted language, eased for short texts, the length, and the softmax's certainty."""
    return np.stack([np.ones(len(counts)), (strange + 0.5) / (counts + 5.0), np.log1p(counts), np.log(np.clip(top, 1e-6, 1))], 1)


def accepted(weights: np.ndarray, counts: np.ndarray, strange: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Probability that a text is of a known language, if unknown ones were as frequent."""
    return 1 / (1 + np.exp(-np.clip(_traits(counts, strange, top) @ weights, -40, 40)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        g = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), g)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], noise: list[tuple[np.ndarray, np.ndarray]] = (), bits: int = 15, dim: int = 16, epochs: int = 6, rate: float = 0.5, keep: float = 0.998, seed: int = 7) -> Model:
    """Fit on ``(language, finer buckets, counts)`` rows of a sample; every fifth row is held back for calibration.

    ``noise`` has buckets and counts of texts in no language. ``keep`` is the least share of the calibration part that is accepted, mixed texts and wrong labels
    included, whatever else would be rejected.
    """
    rng = np.random.default_rng(seed)
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    n = len(languages)
    if not n:
        return Model(["und"], np.zeros((1 << bits, 1)), np.zeros(1), 1.0, 0.0, bits)
    label = {x: i for i, x in enumerate(languages)}
    e, w, b = rng.normal(0, 0.1, (1 << bits, dim)), rng.normal(0, 0.1, (dim, n)), np.zeros(n)
    order = rng.permutation(len(rows))
    fit, calibrate = (order[len(rows) // 5 :], order[: len(rows) // 5]) if len(rows) >= 10 * n else (order, order)
    coarse = [r[1] >> FINER for r in rows]
    weights = [(r[2] / r[2].sum()).astype(np.float32) for r in rows]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            at, c, y = coarse[i], weights[i], label[rows[i][0]]
            h = c @ e[at]
            z = h @ w + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = w @ p
            w -= step * np.outer(h, p)
            b -= step * p
            np.subtract.at(e, at, (step * 50) * c[:, None] * back)
    table = e @ w
    logits_of = lambda at, c: (c / c.sum()) @ table[at >> FINER] + b
    logits = np.array([logits_of(rows[i][1], rows[i][2]) for i in calibrate])
    truth = np.array([label[rows[i][0]] for i in calibrate])
    smoothed = 1 / (len(truth) + 2)  # as if one more were wrong: separable data have a temperature, too
    target = np.full(logits.shape, smoothed / n)
    target[np.arange(len(truth)), truth] += 1 - smoothed

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - (z * target).sum(1)))

    temperature = min(np.geomspace(1e-3, 1e3, 400).tolist(), key=loss)
    known = np.zeros((n, (1 << (bits + FINER)) // 8), np.uint8)
    for k in range(n):
        mine = np.zeros(1 << (bits + FINER), bool)
        for i in fit:
            if label[rows[i][0]] == k:
                mine[rows[i][1]] = True
        known[k] = np.packbits(mine)

    def trait(at: np.ndarray, c: np.ndarray, z: np.ndarray) -> tuple[int, int, float]:
        return int(c.sum()), int(c[~seen(known[z.argmax()], at)].sum()), float(softmax(z[None] / temperature).max())

    good, bad = [], [trait(at, c, logits_of(at, c)) for at, c in noise if len(at)]
    for i, z, y in zip(calibrate, logits, truth, strict=True):
        good.append(trait(rows[i][1], rows[i][2], z))
        if n > 1:  # the same text where its own language is left out
            other = z.copy()
            other[y] = -np.inf
            bad.append(trait(rows[i][1], rows[i][2], other))
    if not bad:
        return Model(languages, table, b, temperature, 0.0, bits, known)
    x = _traits(*(np.array(v) for v in zip(*good, *bad, strict=True)))
    y = np.arange(len(x)) < len(good)
    accept = logistic(x, y.astype(float), np.where(y, 0.5 / len(good), 0.5 / len(bad)) * len(x), 1.0)
    fits = np.sort(accepted(accept, *(np.array(v) for v in zip(*good, strict=True))))
    threshold = min(0.5, float(fits[int((1 - keep) * len(fits))]))
    return Model(languages, table, b, temperature, threshold, bits, known, accept)


def shuffled(x: np.ndarray) -> np.ndarray:
    """A code sequence with its letters in another order, the same for the same text; words keep their lengths."""
    out, at = x.copy(), np.flatnonzero(x)
    out[at] = x[np.random.default_rng(len(x)).permutation(at)]
    return out


def fit(labelled: DataFrame, per_language: int = 800, languages: int = 1000, bits: int = 15, sample: int = 40_000, **options: object) -> Model:
    """Train on a bounded sample of ``doc_id, text, lang``: about ``per_language`` rows of each label, and about ``sample`` together.

    Rows with a null label or text teach nothing. The rows are drawn by a hash of id and text, alike at every size. Only the
    sparse gram counts of the sample, at most ``2 ** (bits + FINER)`` a row, come to the driver. More than ``languages`` labels are an
    error: none is left out, and a column with so many is no language.
    """
    every = labelled.where("lang is not null").groupBy(F.col("lang").cast("string").alias("lang")).count().limit(languages + 1).collect()
    if len(every) > languages:
        raise ValueError(f"more than {languages} languages")
    rows = labelled.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in sorted(every)}
    if not sizes:
        return train([], bits=bits)
    most = min(per_language, max(1, sample // len(sizes)))
    limits = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, int((1 << 30) * min(1.0, most / n)))])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"lang": pa.string(), "at": pa.list_(pa.int32()), "n": pa.list_(pa.int32())}
        for b in batches:
            seen = [codes(t) for t in b.column("text").to_pylist()]
            names = b.column("lang").to_pylist()
            every = [(lang, x) for lang, x in zip(names, seen, strict=True)] + [(None, shuffled(x)) for x, h in zip(seen, b.column("h").to_pylist(), strict=True) if h % 8 == 0]
            found = [np.unique(grams(x, bits + FINER)[0], return_counts=True) for _, x in every]
            yield batch({"lang": [lang for lang, _ in every], "at": [x.astype(np.int32) for x, _ in found], "n": [n.astype(np.int32) for _, n in found]}, types)

    held = arrow_map(rows.where(F.col("h") < limits[F.col("lang")]), features, "lang string, at array<int>, n array<int>").toArrow()
    found, noise = [], []
    for b in held.to_batches():
        at, n = b.column("at"), b.column("n")
        ends, buckets, counts = at.offsets.to_numpy(), at.values.to_numpy(), n.values.to_numpy()
        for lang, a, z in zip(b.column("lang").to_pylist(), ends[:-1], ends[1:], strict=True):
            if lang is None:
                noise.append((buckets[a:z], counts[a:z]))
            else:
                found.append((lang, buckets[a:z], counts[a:z]))
    found.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes()))
    noise.sort(key=lambda r: (len(r[0]), r[0].tobytes()))
    return train(found, noise, bits=bits, **options)


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """Adds ``lang_pred``, ``lang_score`` and ``lang_rejected`` to every row, from the whole text alone.

    Null texts and texts without a letter are ``und`` with score 0 and rejected. All rows and all other columns stay,
    except older columns of those three names.
    """
    added = ("lang_pred", "lang_score", "lang_rejected")
    docs = documents.drop(*added)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # 2 ** bits rows of class scores, whatever the input

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, score, rejected = shared.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*b.schema.names, *added])

    return arrow_map(docs, predict, f"{fields}, lang_pred string, lang_score double, lang_rejected boolean")


def taught(documents: DataFrame) -> DataFrame:
    """The rows one may learn from: all whose crc32 of the id as text isn't 2 modulo 4."""
    return documents.where(~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
