"""Whole-text encoding with the tokenizers library, remembering the ids of words and of the runs between them."""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters for which Python's classes, letter cases and composition agree with the tokenizers': others are encoded with their whole text.
_OTHER = re.compile("[^\t\n\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ǃǍ-ǯǴ-ɏ]")
#: The letters among the others, and a letter run or a run of what is neither letter nor white space; an apostrophe keeps
#: the letters after it, since it may begin a contraction. Plain ranges match twice as fast as classes.
_L = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
_PIECES = rf"[{_L}]+|[^{_L}\t\n\r ]+(?:(?<=')[{_L}]+)?"
_DROPPED_SPACE = re.compile(_PIECES)
_KEPT_SPACE = re.compile(rf"[\t\n\r ]*(?:{_PIECES})|[\t\n\r ]+$")
_WORD = re.compile(rf" ?[{_L}]+\Z")


class _Index(dict):
    """Numbers of pieces; one that is asked for the first time gets the next number and waits to be learned."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class CachedEncoder:
    """Ids equal to ``Tokenizer.encode(text, add_special_tokens=False)`` of the whole text.

    Both public tokenizers split a text after every letter run and before every white space that follows a character
    which is none, whatever stands further away, so the ids of a text are those of its pieces. Pieces recur far more often
    than texts; up to ``limit`` of them are remembered in flat arrays, and then those that didn't recur are forgotten.
    """

    _loaded: dict[str, CachedEncoder] = {}

    def __init__(self, path: str, limit: int = 1_200_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task a core
        from tokenizers import Tokenizer

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.keeps_space = self._keeps_space()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _keeps_space(self) -> bool:
        return len(self.tokenizer.encode("a a", add_special_tokens=False).ids) != len(self.tokenizer.encode("a  a", add_special_tokens=False).ids) or self.tokenizer.encode("a a", add_special_tokens=False).ids[0] != self.tokenizer.encode("a a", add_special_tokens=False).ids[1]

    @classmethod
    def of(cls, path: str) -> CachedEncoder:
        """One encoder for each file in a Python worker."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _forget(self) -> None:
        self.index = _Index()
        self.flat, self.used = np.empty(1 << 20, np.uint32), 0
        self.starts, self.counts, self.recurred = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int64), np.zeros(1 << 18, bool)

    def _shrink(self) -> None:
        """Keep the pieces that came again after they were learned; none if those are most of them."""
        kept = np.flatnonzero(self.recurred[: len(self.index)])
        if len(kept) > 0.7 * self.limit:
            return self._forget()
        pieces = list(self.index)
        ids, counts = self._ids(kept), self.counts[kept]
        self._forget()
        for i in kept.tolist():
            self.index[pieces[i]] = len(self.index)
        self._room()
        self._add(np.arange(len(kept)), ids, counts)

    def _room(self) -> None:
        while len(self.index) > len(self.starts):
            self.starts, self.counts, self.recurred = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.counts, self.recurred))

    def _learn(self) -> None:
        new, self.index.new = self.index.new, []
        first = len(self.index) - len(new)
        self._room()
        is_plain = [bool(_WORD.match(p)) and (p[0] == " ") == self.keeps_space for p in new]
        plain = [i for i, x in enumerate(is_plain) if x]
        lots = [plain[i : i + 400] for i in range(0, len(plain), 400)]  # long inputs cost more a word
        between = "" if self.keeps_space else " "
        for lot, joined in zip(lots, self.tokenizer.encode_batch([between.join([new[i] for i in x]) for x in lots], add_special_tokens=False), strict=True):
            self._add(np.array(lot) + first, np.array(joined.ids, np.uint32), np.bincount(joined.word_ids, minlength=len(lot)))
        other = [i for i, x in enumerate(is_plain) if not x]
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast([new[i] for i in other], add_special_tokens=False)]
        self._add(np.array(other, np.int64) + first, np.fromiter((i for e in encoded for i in e), np.uint32), np.fromiter(map(len, encoded), np.int64, len(other)))

    def _add(self, at: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        if len(counts) != len(at) or counts.sum() != len(ids):
            raise ValueError("the tokenizer doesn't split between these pieces")
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.counts[at] = counts
        self.starts[at] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)

    def __call__(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as unsigned 32-bit integers; none for null."""
        return self.encode([text])[0]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each whole text. The pieces that are new in any of the texts are encoded together."""
        if len(self.index) > self.limit:
            self._shrink()
        number, known = self.index.__getitem__, len(self.index)
        # a text's pieces are looked up at once, while they are still in the processor's cache
        each = [None if (p := self._pieces(t) if t else []) is None else np.fromiter(map(number, p), np.int64, len(p)) for t in texts]
        at = np.concatenate([np.empty(0, np.int64), *(a for a in each if a is not None)])
        ends = np.cumsum([0, *(0 if a is None else len(a) for a in each)])
        if self.index.new:
            self._learn()
        self.recurred[at] = True
        self.recurred[known : len(self.index)] = False
        bounds = np.concatenate([[0], np.cumsum(self.counts[at])])[ends]
        ids = self._ids(at)
        return [ids[a:z] if p is not None else np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32) for a, z, p, t in zip(bounds[:-1], bounds[1:], each, texts, strict=True)]

    def _pieces(self, text: str) -> list[str] | None:
        if _OTHER.search(text) or any(s in text for s in self.special):
            return None
        return _KEPT_SPACE.findall(text) if self.keeps_space else _DROPPED_SPACE.findall(text.lower())

    def _ids(self, at: np.ndarray) -> np.ndarray:
        counts = self.counts[at]
        ends = np.cumsum(counts)
        if not len(ends) or not ends[-1]:
            return np.empty(0, np.uint32)
        return self.flat[np.repeat(self.starts[at] - ends + counts, counts) + np.arange(ends[-1])]
