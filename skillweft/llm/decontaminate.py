"""Benchmark decontamination with an FM-index for each training shard.

A shard is a bounded run of documents inside one task. Its words are mapped to the benchmark's vocabulary, and only
maximal runs of vocabulary words that are long enough to hold a window are indexed: no occurrence can lie elsewhere, so
nothing is lost. The index is a Burrows-Wheeler transform in a wavelet matrix with sampled suffix positions. All windows
are searched backwards together, their occurrences located, and overlapping ones merged into removal spans.

The benchmark is cut into blocks of a bounded number of windows. Tasks make them and write them to the shared folder; each task of
the scan holds one at a time. None of it passes through the driver.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skillweft.llm.common import arrow_map, batch, folded, runs, staged, words
from skillweft.llm.idfile import file_system

#: Windows of a block, about; a longer item is cut into pieces of at most a quarter.
BLOCK = 200_000
#: Symbols of a shard.
SHARD = 1 << 20
SAMPLE = 16
#: Words as they stand in a text, before A-Z become lower case.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class FMIndex:
    """Full-text index of an integer sequence whose values are 0 (separator) to ``top``."""

    def __init__(self, text: np.ndarray, top: int) -> None:
        self.n = n = len(text) + 1
        s = np.append(text.astype(np.int64) + 1, 0)  # the end is smallest
        sa = self._suffixes(s)
        bwt = s[sa - 1]
        counts = np.bincount(s, minlength=top + 2)
        self.first = np.cumsum(counts) - counts
        self.sampled = np.where(sa % SAMPLE == 0, sa, -1)
        self.levels = max(1, int(top + 1).bit_length())
        self.ranks, self.zeros = [], []  # ones before each position, by bit from the highest
        x = bwt
        for bit in range(self.levels - 1, -1, -1):
            b = (x >> bit) & 1
            self.ranks.append(np.concatenate([[0], np.cumsum(b)]))
            self.zeros.append(n - int(b.sum()))
            x = np.concatenate([x[b == 0], x[b == 1]])
        self.bwt = bwt

    @staticmethod
    def _suffixes(s: np.ndarray) -> np.ndarray:
        """Suffix array by prefix doubling."""
        n, rank, k = len(s), s.copy(), 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - k] = rank[k:] + 1 if k < n else 0
            key = rank * (max(int(rank.max()), n) + 2) + after
            order = np.argsort(key, kind="stable")
            new = np.empty(n, np.int64)
            new[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            if new[order[-1]] == n - 1:
                return order
            rank, k = new, 2 * k

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position of the transform."""
        lo, hi = np.zeros(len(at), np.int64), at.copy()
        for level in range(self.levels):
            ones = self.ranks[level]
            bit = (symbols >> (self.levels - 1 - level)) & 1
            lo, hi = (np.where(bit, self.zeros[level] + ones[x], x - ones[x]) for x in (lo, hi))
        return hi - lo

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of patterns, which stand at the end of the rows of ``patterns``; values from 1."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for back in range(1, patterns.shape[1] + 1):
            on = np.flatnonzero((lengths >= back) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, -back].astype(np.int64) + 1
            lo[on], hi[on] = self.first[c] + self.rank(c, lo[on]), self.first[c] + self.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: step backwards until one whose position was kept."""
        out, steps, rows = np.full(len(rows), -1, np.int64), np.zeros(len(rows), np.int64), rows.copy()
        open_ = np.arange(len(rows))
        while len(open_):
            known = self.sampled[rows[open_]]
            done = known >= 0
            out[open_[done]] = known[done] + steps[open_[done]]
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.first[c] + self.rank(c, rows[open_])
            steps[open_] += 1
        return out


class Windows:
    """Distinct windows of benchmark items: ``size`` consecutive words, or all words of a shorter item.

    ``items[at[k]:at[k + 1]]`` are the items of window ``k``, as numbers of ``names``, which are sorted.
    """

    def __init__(self, items: list[tuple[object, str | None]], size: int = 10) -> None:
        self.ids: dict[bytes, int] = {}
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {x: k for k, x in enumerate(self.names)}
        rows = [np.empty((0, size + 1), np.int64)]
        for item, text in items:
            w = [] if item is None else words(text)
            if not w:
                continue
            codes = np.fromiter((self.ids.setdefault(x, len(self.ids) + 1) for x in w), np.int64, len(w))
            n = min(size, len(w))
            part = np.zeros((len(w) - n + 1, size + 1), np.int64)
            part[:, size - n : size] = np.lib.stride_tricks.sliding_window_view(codes, n)
            part[:, size] = number[str(item)]
            rows.append(part)
        found = np.unique(np.concatenate(rows), axis=0)
        new = np.flatnonzero(np.concatenate([[True], (found[1:, :size] != found[:-1, :size]).any(1)])[: len(found)])
        self.patterns, self.items, self.at = found[new, :size], found[:, size], np.append(new, len(found))
        self.lengths = (self.patterns > 0).sum(1)
        self.shortest = int(self.lengths.min()) if len(new) else 0

    def names_of(self, windows: np.ndarray) -> list[str]:
        """Sorted items of some windows."""
        at = [self.items[self.at[k] : self.at[k + 1]] for k in np.unique(windows).tolist()]
        return [self.names[i] for i in np.unique(np.concatenate(at)).tolist()] if at else []


def _occurrences(docs: list[np.ndarray], windows: Windows) -> list[tuple[np.ndarray, np.ndarray]]:
    """Start words and window numbers of all occurrences in each document of a shard."""
    none = np.empty(0, np.int64)
    out = [(none, none)] * len(docs)
    if not len(windows.patterns) or not docs:
        return out
    lengths = np.array([len(d) + 1 for d in docs], np.int64)
    whole = np.concatenate([np.append(d, 0) for d in docs])
    bounds = np.flatnonzero(whole == 0)
    starts = np.concatenate([[0], bounds[:-1] + 1])
    long = bounds - starts >= windows.shortest
    starts, sizes = starts[long], (bounds - starts)[long] + 1  # with the separator
    if not len(starts):
        return out
    ends = np.cumsum(sizes)
    place = np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])  # of each indexed symbol in the shard
    index = FMIndex(whole[place], int(windows.patterns.max()))
    lo, hi = index.search(windows.patterns, windows.lengths)
    n = np.maximum(hi - lo, 0)
    if not n.sum():
        return out
    which = np.repeat(np.arange(len(n)), n)
    rows = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = place[index.locate(rows)]
    firsts = np.cumsum(lengths) - lengths
    doc = np.searchsorted(firsts, at, "right") - 1
    order = np.argsort(doc, kind="stable")
    cuts = np.flatnonzero(np.diff(doc[order])) + 1
    for part in np.split(order, cuts):
        d = doc[part[0]]
        out[d] = at[part] - firsts[d], which[part]
    return out


def merged(starts: np.ndarray, lengths: np.ndarray) -> list[tuple[int, int]]:
    """Union of word intervals as sorted disjoint ``(start, end)``; touching ones are one."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(zip(starts.tolist(), (starts + lengths).tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>"
_TYPES = {"doc_id": pa.int64(), "n_words": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "items": pa.list_(pa.string())}


def _union(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    if not a or not b:
        return a or b
    both = np.array([*a, *b])
    return merged(both[:, 0], both[:, 1] - both[:, 0])


def _pieces(piece: int, size: int):
    """Items cut into pieces of at most ``piece`` windows, which overlap by all but one word of a window; and their windows."""
    types = {"item": pa.string(), "text": pa.string(), "n": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = words(text)
                for a in range(0, max(len(w) - size + 1, min(1, len(w))), piece):
                    part = w[a : a + piece + size - 1]
                    yield batch({"item": [item], "text": [b" ".join(part).decode("utf-8", "surrogatepass")], "n": [max(1, len(part) - size + 1)]}, types)

    return run


def _blocks(folder: str, size: int):
    """Writes each block to a file of its own; the name is the attempt's, so a lost one is never read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(folder)
        for rows in runs(batches, "block"):
            windows = Windows(list(zip(rows.column("item").to_pylist(), rows.column("text").to_pylist(), strict=True)), size)
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{(name := uuid.uuid4().hex)}") as f:
                f.write(pickle.dumps(windows))
            yield batch({"name": [name]}, {"name": pa.string()})

    return run


def blocks(benchmark: DataFrame, work: str, size: int = 10, block: int = BLOCK) -> list[str]:
    """Names of the files below ``work``/blocks, one block each, which every task reads from the shared folder.

    Pieces are dealt to blocks by a hash, so a block has about ``block`` windows. The driver counts the windows and lists the files.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and text is not null")
    pieces = staged(arrow_map(items, _pieces(max(1, block // 4), size), "item string, text string, n long"), f"{work}/pieces")
    n = -(-(pieces.agg(F.sum("n")).first()[0] or 0) // block)
    if not n:
        return []
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    return sorted(r["name"] for r in arrow_map(dealt.repartition(n, "block").sortWithinPartitions("block"), _blocks(f"{work}/blocks", size), "name string").collect())


#: Bytes of a text whose words are a list at one time.
SLICE_BYTES = 1 << 20


def sliced(text: str | None) -> Iterator[list[bytes]]:
    """The words of a whole text, as ``words`` gives them, in lists of bounded size."""
    data, at = folded(text), 0
    while at < len(data):
        end = at + SLICE_BYTES
        if end < len(data) and (cut := data.rfind(b" ", at, end)) > at:
            end = cut
        elif end < len(data):  # one word is longer
            end = cut if (cut := data.find(b" ", end)) >= 0 else len(data)
        if part := data[at:end].split():
            yield part
        at = end


def _scanner(folder: str, files: list[str], size: int):
    held_block: dict[str, Windows] = {}

    def each() -> Iterator[Windows]:
        """The blocks, one in memory at a time; a single one stays."""
        fs, path = file_system(folder)
        for name in files:
            if name not in held_block:
                held_block.clear()
                with fs.open_input_file(f"{path}/{name}") as f:
                    held_block[name] = pickle.loads(f.read())  # noqa: S301
            yield held_block[name]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []  # documents that were begun: id, words, spans, items
        held: list[tuple[list, int, int, bytes]] = []  # document, first word, words, and these as bytes: a tenth of what a list takes
        total = 0

        def search() -> None:
            for windows in each() if held else ():
                known = windows.ids
                parts = [np.fromiter((known.get(w, 0) for w in joined.split()), np.int32, n) for _, _, n, joined in held]
                for (row, first, _, _), (s, w) in zip(held, _occurrences(parts, windows), strict=True):
                    if len(s):
                        row[2] = _union(row[2], merged(s + first, windows.lengths[w]))
                        row[3].update(windows.names_of(w))
            held.clear()

        def emit(done: list[list]) -> pa.RecordBatch:
            return batch({"doc_id": [r[0] for r in done], "n_words": [r[1] for r in done], "spans": [[{"start": a, "end": z} for a, z in r[2]] for r in done], "items": [sorted(r[3]) for r in done]}, _TYPES)

        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                rows.append(row := [doc, 0, [], set()])
                tail: list[bytes] = []
                for part in sliced(text):
                    first = row[1] - len(tail)
                    both = [*tail, *part]
                    held.append((row, first, len(both), b" ".join(both)))
                    row[1] += len(part)
                    tail = both[max(0, len(both) - size + 1) :]  # a window that goes on meets in the next part
                    total += len(both) + 1
                    if total >= SHARD:
                        search()
                        total = 0
                        if len(rows) > 1:
                            yield emit(rows[:-1])
                            del rows[:-1]
        search()
        if rows:
            yield emit(rows)

    return scan


def contamination(documents: DataFrame, benchmark: DataFrame, work: str, size: int = 10, block: int = BLOCK) -> DataFrame:
    """Removal spans and benchmark items of every document: ``doc_id, n_words, spans, items``.

    Spans are half-open intervals of word numbers, disjoint and sorted; items are ids as sorted strings. Null and empty
    texts have no words and no spans; benchmark items that are null or have no words have no windows; rows with equal
    ids each get their own row; other columns are ignored. A shard's words are searched for one block of about ``block`` windows
    after the other, and its spans are united. A text that is longer than a shard stands in several, which share ``size - 1`` words.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(docs, _scanner(f"{work}/blocks", blocks(benchmark, work, size, block), size), SCHEMA)


def report(spans: DataFrame) -> DataFrame:
    """Per document: words, hit words, items, their digest and whether any word was hit."""
    return spans.select(
        "doc_id",
        "n_words",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def without_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """A text without the words of its removal spans and what stands between them."""
    if not spans or text is None:
        return text
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for a, z in spans:
        out.append(text[last : at[a][0]])
        last = at[z - 1][1]
    return "".join([*out, text[last:]])


def items_digest(items: list[str]) -> str:
    """What ``report`` gives as ``items_sha256``."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
