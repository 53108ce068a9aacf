"""Each operator against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import html as htmllib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from skillweft.llm import decontaminate, idfile, jaccard, langid, licences, packing, queries, rollups, sharding, vectors
from skillweft.llm import html as html_
from skillweft.llm.common import WordHashes, runs, shingles, words, workspace

WORD_BPE, BYTE_BPE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
CLASH = "node long, unit long, part long, class int, shard int, slot long, host string, template string, lang_pred string, tokens long"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"


def frame(spark, rows):
    """``(doc_id, text, lang, source)`` with further columns that clash with working names."""
    return spark.createDataFrame([(*r, None, 1, 2, 3, 4, 5, 6, "h", "t", "xx", 7) for r in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "s"), (None, "a b c d e f", "en", "s"), (4, "one", "en", None), (4, "one", "en", None), (6, "\n \t ...", "en", "s"), (7, "word " * 230_000, "en", "s"), (8, "Ünïcödé 中文 \U0001f600 \x1c x y ́", "de", "s"), (9, "one", "fr", "s")]


def grams(text, n=5):
    w = words(text)
    n = min(n, len(w))
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else frozenset()


def jaccard_truth(rows):
    sets = [grams(t) if i is not None else frozenset() for i, t in rows]
    index = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            index[g].append(k)
    both = Counter((x, y) for at in index.values() for i, x in enumerate(at) for y in at[i + 1 :])
    links, parent = Counter(), list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (x, y), n in both.items():
        if 5 * n >= 4 * (len(sets[x]) + len(sets[y]) - n):
            links[x] += 1
            links[y] += 1
            parent[root(x)] = root(y)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[root(k)] = min(low.get(root(k), i), i)
    return sorted(((i, low[root(k)] if i is not None else None, links[k]) for k, (i, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("by", [None, "group", "bucket"])
def test_jaccard_against_brute_force(spark, sf, by):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = sorted(map(tuple, jaccard.jaccard_join(docs, workspace(spark, "t"), by=by).collect()), key=str)
    assert found == jaccard_truth([(r.doc_id, r.text) for r in docs.collect()])


def test_jaccard_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.integers(0, 120, rng.integers(0, 4)):
            w[k] = f"x{rng.integers(0, 9)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "CHUNK", 16)
    for by in ("group", "bucket"):
        found = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), workspace(spark, "t"), by=by)
        got, want = sorted(map(tuple, found.collect()), key=str), jaccard_truth(rows)
        assert [x[:2] for x in got] == [x[:2] for x in want]
        exact = sum(a[2] for a in want)
        assert (got == want) if by == "group" else exact * 0.99 <= sum(a[2] for a in got) <= exact


def test_jaccard_odd_rows(spark):
    found = sorted(map(tuple, jaccard.jaccard_join(frame(spark, ODD), workspace(spark, "t")).collect()), key=str)
    assert found == jaccard_truth([r[:2] for r in ODD])
    assert jaccard.jaccard_join(frame(spark, []), workspace(spark, "t")).collect() == []


def test_overlaps():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, 40).astype(np.uint64)) for _ in range(7)]
    assert (jaccard.overlaps(sets) == [[len(np.intersect1d(a, b)) if i != j or len(sets) == 2 else _self(a, sets) for j, b in enumerate(sets)] for i, a in enumerate(sets)]).all()


def _self(a, sets):
    """Of its own n-grams only those that another set shares count, and the diagonal is never asked for."""
    return sum(sum(x in s for s in sets) > 1 for x in a)


def test_shingles_are_sets_of_all_windows():
    h = WordHashes()
    assert len(shingles("a b c d e f g", h)) == 3
    assert len(shingles("a b", h)) == 1
    assert len(shingles(None, h)) == len(shingles("...", h)) == 0
    assert (shingles("A b C d E", h) == shingles("a, B c. D e", h)).all()


def test_runs_join_batches():
    import pyarrow as pa

    t = pa.table({"k": [1, 1, 2, 2, 2, 3], "v": list(range(6))})
    assert [[x["v"] for x in r.to_pylist()] for r in runs(iter(t.to_batches(max_chunksize=1)), "k")] == [[0, 1], [2, 3, 4], [5]]


def test_patience():
    assert licences.increasing([3, 1, 2, 5, 4]) in ([1, 2, 4], [1, 2, 3])
    assert licences.increasing([]) == []
    a, b = "x the a cat sat the b".split(), "the a dog sat the c".split()
    assert licences.align(a, b) == [(1, 0), (2, 1), (4, 3), (5, 4)]
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (list(rng.integers(0, 6, rng.integers(0, 12))) for _ in range(2))
        pairs = licences.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_licences(spark):
    rows = [(10, "Foo bar. Licensed under CC BY-NC 4.0. more\nAll rights reserved.", "en", "s"), (11, "Released under the   MIT license", "en", "s"), (12, "this work is licensed under the GNU General Public Licence, version 3", "en", "s"), (13, "the mit of under", "en", "s"), *ODD]
    found = sorted((r.doc_id, r.licence, r.start_word, r.end_word) for r in licences.licence_scan(frame(spark, rows)).collect())
    assert found == [(10, "CC-BY-NC-4.0", 2, 9), (10, "all-rights-reserved", 10, 13), (11, "MIT", 0, 5), (12, "GPL-3.0", 0, 12)]
    assert licences.licence_scan(frame(spark, [])).collect() == []


def test_repeated_licences():
    scan = lambda text: [(x[0], x[1], x[2]) for x in licences.Scanner(licences.TEMPLATES).scan(words(text))]
    mit = "Released under the MIT License. "
    assert scan("x y z " + 2 * mit + "q r s t u v w") == [("MIT", 3, 8), ("MIT", 8, 13)]
    assert scan("some prose here\n" + 5 * "All rights reserved.\n") == [("all-rights-reserved", k, k + 3) for k in range(3, 18, 3)]
    assert scan("Released under the MIT. " + mit) == [("MIT", 0, 4), ("MIT", 4, 9)]


def test_covered_licences_without_a_trigram():
    scan = lambda text: licences.Scanner(licences.TEMPLATES).scan(words(text))
    assert scan("x Released under MIT License y") == [("MIT", 1, 5, 0.8)]
    assert scan("x All rights are reserved y") == [("all-rights-reserved", 1, 5, 1.0)]
    assert scan("Released under License") == scan("reserved rights all") == scan("the license under which it is released") == []
    # a stretch that covers enough is found, wherever words are left out or put in
    rng = np.random.default_rng(5)
    for name, text in licences.TEMPLATES.items():
        ws = words(text)
        for _ in range(30):
            gone = set(rng.choice(len(ws), len(ws) // (5 if len(ws) < 25 else 10), replace=False).tolist())  # anchors may cost a long text some words
            cut = [w for i, w in enumerate(ws) if i not in gone]
            for at in sorted(rng.integers(1, len(cut), 2 + len(ws) // 4).tolist(), reverse=True):
                cut.insert(at, b"zzz")
            only = licences.Scanner({name: text}).scan([b"q"] * 3 + cut + [b"q"] * 3)
            assert [x[0] for x in only] == [name]
            assert len(ws) >= 25 or (only[0][1], only[0][2]) == (3, 3 + len(cut))


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_places_against_all_stretches():
    rng = np.random.default_rng(8)
    for name in ("all-rights-reserved", "MIT", "CC-BY-4.0"):
        scanner = licences.Scanner({name: licences.TEMPLATES[name]})
        template = words(licences.TEMPLATES[name])
        span, need = scanner.span[0], len(template) - scanner.miss[0]
        for _ in range(40):
            ws = []
            for _ in range(rng.integers(1, 5)):  # notices with edits, one after the other or with words between
                ws += [w for w in template if rng.random() > 0.12 for w in ([w, b"q"] if rng.random() < 0.1 else [w])]
                ws += [b"q"] * int(rng.choice([0, 0, 1, 5]))
            every = sorted((-n, j - i, i) for i in range(len(ws)) for j in range(i + 1, min(len(ws), i + span) + 1) if (n := common(ws[i:j], template)) >= need)
            taken, want = set(), []
            for _, n, i in every:
                if taken.isdisjoint(range(i, i + n)):
                    pairs = licences.align(ws, template, i, i + n)
                    if len(pairs) >= scanner.least * len(template):
                        begin, end = pairs[0][0], pairs[-1][0] + 1
                        taken.update(range(begin, end))
                        want.append((begin, end))
            assert sorted(want) == [(x[1], x[2]) for x in scanner.scan(ws)]


def test_ties_of_templates():
    same = licences.Scanner({"b": "one two three", "a": "one two three", "c": "one two"})
    assert same.scan(words("x one two three y one two z")) == [("a", 1, 4, 1.0), ("c", 5, 7, 1.0)]


def test_whole_texts_and_headers():
    scanner = licences.Scanner(licences.TEMPLATES)
    for name, text in licences.TEMPLATES.items():
        assert [(x[0], x[3]) for x in scanner.scan(words(f"some prose before {text} and after"))] == [(name, 1.0)]
    later = licences.TEMPLATES["GPL-2.0-header"].replace("This program", "Foo")
    assert [x[0] for x in scanner.scan(words(later))] == ["GPL-2.0-header"]


def test_long_texts_for_scans():
    text = "word " * 250_000 + "Released under the MIT License. " + "word " * 3
    assert [x[:3] for x in licences.Scanner(licences.TEMPLATES).scan(words(text))] == [("MIT", 250_000, 250_005)]


def test_licences_on_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = Counter(r.doc_id for r in licences.licence_scan(docs).collect())
    shape = re.compile(r"Licensed under CC BY-NC 4.0|GNU General Public License, version 3|Apache License, Version 2.0|Released under the MIT License|All rights reserved")
    assert found == Counter({r.doc_id: n for r in docs.collect() if (n := len(shape.findall(r.text)))})


def encoded(path, end):
    t = Tokenizer.from_file(path)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("path", [WORD_BPE, BYTE_BPE])
def test_encoder_equals_the_tokenizer(path):
    from skillweft.llm.tokens import CachedEncoder

    plain = Tokenizer.from_file(path)
    rng = np.random.default_rng(5)
    parts = [" ", "  ", "\n", "\t", "a", "Tt", "ll", "'", "'s", "12", "_", "-", "...", "é", "ß", "Ñ", "·", "²", "́", "中", "\U0001f600", "\x1d", " ", "<|endoftext|>", "İ"]
    texts = ["".join(rng.choice(parts, rng.integers(0, 25))) for _ in range(1500)]
    enc = CachedEncoder(path, limit=50)  # forgets again and again
    for i in range(0, len(texts), 40):
        for text, ids in zip(texts[i : i + 40], enc.encode(texts[i : i + 40]), strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text


def check_packing(spark, docs, rows, capacity):
    want = encoded(WORD_BPE, 1)
    held, placed = packing.pack(docs, workspace(spark, "t"), WORD_BPE, 1, capacity)
    got = placed.collect()
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(want(t))
    for i, docs_ in ids.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, docs_))
        assert Counter((r.start, r.ids_crc32, r.doc_tokens) for r in by_doc[i]) == Counter((s, zlib.crc32(d[s : s + capacity].tobytes()), len(d)) for d in docs_ for s in range(0, len(d), capacity))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:k]) for k in range(len(s))]
        assert sum(r.length for r in s) <= capacity
    return held, placed, seqs


def test_packing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    _, placed, seqs = check_packing(spark, docs, rows, 2048)
    assert sum(r.length for s in seqs.values() for r in s) > 0.97 * 2048 * len(seqs)


def test_packing_odd_rows(spark):
    rows = [*ODD, *((100 + i, "", "en", "s") for i in range(70))]
    held, placed, _ = check_packing(spark, frame(spark, rows), [r[:2] for r in rows], 256)
    whole = packing.sequences(held, placed).collect()
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in whole)
    assert all(len(r.ids) == r.length for r in whole)
    assert Counter(i for r in whole for i in r.ids)[1] == len(rows)
    assert packing.pack(frame(spark, []), workspace(spark, "t"), WORD_BPE, 1)[1].collect() == []


def test_column_generation_reaches_the_bound():
    rng = np.random.default_rng(3)
    ends = packing.classes(2048)
    n = np.bincount(np.searchsorted(ends, np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048)), minlength=len(ends))
    patterns = packing.plan(ends, n, 2048)
    assert (sum(a * x for a, x in patterns) == -(-n // packing.bundles(ends))).all()
    assert all((a * packing.bundles(ends) * ends).sum() <= 2048 for a, _ in patterns)
    assert sum(x for _, x in patterns) * 2048 <= (n * ends).sum() * 1.02 + 2048 * 8


def test_language_accuracy_and_calibration(spark, sf):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.fit(langid.taught(docs))
    held = langid.identify(docs.where(langid.held_out(docs.doc_id)), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert np.mean([r.lang_rejected for r in held]) < 0.02
    assert all(0 <= r.lang_score <= 1 for r in held)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)


@pytest.mark.parametrize("lang", ["es", "de"])
def test_a_language_that_was_left_out_is_rejected(spark, sf, lang):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = langid.fit(langid.taught(docs).where(F.col("lang") != lang))
    held = langid.identify(docs.where(langid.held_out(docs.doc_id)), model).collect()
    assert np.mean([r.lang_rejected for r in held if r.lang == lang]) >= 0.9
    assert np.mean([r.lang_rejected for r in held if r.lang != lang]) <= 0.01
    strangers = ["Это предложение написано на русском языке", "这是一个用中文写的句子", "To zdanie jest napisane po polsku i powinno zostać odrzucone", "zxqv kjhg wpt qqqq mnbv"]
    names, score, rejected = model.predict(strangers)
    assert all(rejected) and max(score) < 0.5 and set(names) <= set(model.languages)
    assert 1e-3 < model.temperature < 1e3


def test_the_sample_is_bounded(spark):
    docs = frame(spark, [(i, f"text number {i} of many", f"l{i % 5}", "s") for i in range(500)])
    seen = []
    train, langid_train = langid.train, lambda rows, noise=(), **k: seen.append(len(rows)) or train(rows, noise, **k)
    langid.train = langid_train
    try:
        langid.fit(docs, sample=50)
    finally:
        langid.train = train
    assert seen[0] < 110


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(docs)
    out = {(r.doc_id, r.text): r for r in langid.identify(frame(spark, ODD), model).collect()}
    for key in ((1, None), (2, ""), (6, "\n \t ...")):
        assert (out[key].lang_pred, out[key].lang_score, out[key].lang_rejected) == ("und", 0.0, True)
    assert out[8, ODD[7][1]].lang_pred in model.languages
    assert len(langid.identify(frame(spark, ODD), model).collect()) == len(ODD)
    assert langid.identify(frame(spark, []), model).collect() == []
    assert langid.fit(frame(spark, [])).languages == ["und"]


def test_scores_of_a_long_text_add_up():
    model = langid.train([("a", *np.unique(langid.grams(langid.codes("abc abd"), 15)[0], return_counts=True)), ("b", *np.unique(langid.grams(langid.codes("xyz xyw"), 15)[0], return_counts=True))] * 12, bits=10)
    assert model.predict(["abc abd " * 200_000])[0] == model.predict(["abc abd"])[0] == ["a"]


def test_rollups(spark):
    rollup = rollups.Rollup(spark, workspace(spark, "t"))
    assert rollup.totals().collect() == []
    rows = spark.createDataFrame([("s", "en", 5), ("s", "en", 7), (None, None, 1), ("t", "de", 4)], "source string, lang string, tokens long")
    assert rollup.commit("a", rollups.changes(rows, "v1", 1))
    assert not rollup.commit("a", rollups.changes(rows, "v1", 1))
    assert rollup.commit("b/ü", rollups.changes(rows.where("source = 's'"), "v1", -1))

    assert rollup.commit("c", rollups.changes(rows.where("source = 't'"), "v1", 0, F.lit(3)))
    assert rollup.commit("d", rollups.changes(rows.limit(0), "v1", 1))
    assert sorted(map(tuple, rollup.totals().collect()), key=str) == [("t", "de", "v1", 1, 7), (None, None, "v1", 1, 1)]


def test_grams_across_slices(monkeypatch):
    rng = np.random.default_rng(1)
    text = "".join(rng.choice(list("abcdé ,"), 5000))
    model = langid.Model(["a", "b"], rng.normal(size=(1 << 10, 2)), np.zeros(2), 1.0, 0.0, 10)
    whole = model.scores([text, "", "ab", None, text[:777]])
    for size in (1, 2, 3, 64, 1000, 4999):
        monkeypatch.setattr(langid, "SLICE", size)
        cut = model.scores([text, "", "ab", None, text[:777]])
        assert (cut[1] == whole[1]).all()
        assert np.allclose(cut[0], whole[0])


def test_more_labels_than_languages(spark):
    docs = frame(spark, [(i, f"text {i}", f"l{i}", "s") for i in range(5)])
    with pytest.raises(ValueError, match="more than 4"):
        langid.fit(docs, languages=4)
    assert len(langid.fit(docs, languages=5).languages) == 5


def test_scores_are_reliable(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(langid.taught(docs))
    held = [r for r in langid.identify(docs.where(langid.held_out(docs.doc_id)), model).collect() if r.lang and r.lang_pred != "und"]
    score, right = np.array([r.lang_score for r in held]), np.array([r.lang_pred == r.lang for r in held])
    assert abs(score.mean() - right.mean()) < 0.05  # a calibrated score says how often it is right
    kept = np.array([not r.lang_rejected for r in held])
    assert right[kept].mean() >= right.mean()
    assert kept.mean() > 0.95


def test_compaction_keeps_totals_and_idempotence(spark):
    rollup = rollups.Rollup(spark, workspace(spark, "t"))
    rows = spark.createDataFrame([("s", "en", 5), (None, "de", 2)], "source string, lang string, tokens long")
    assert not rollup.compact()
    for k in range(5):
        assert rollup.commit(f"b{k}", rollups.changes(rows, "v", 1))
        if k in (1, 2):
            assert rollup.compact()
        assert sorted(map(tuple, rollup.totals().collect()), key=str) == [("s", "en", "v", k + 1, 5 * (k + 1)), (None, "de", "v", k + 1, 2 * (k + 1))]
        assert not any(rollup.commit(f"b{j}", rollups.changes(rows, "v", 1)) for j in range(k + 1))
    assert rollup.committed().count() == 5
    assert len(rollup._folders("b-")) == 2


def test_a_lost_batch_counts_nothing(spark):
    work = workspace(spark, "t")
    rollup = rollups.Rollup(spark, work)
    rows = spark.createDataFrame([("s", "en", 5)], "source string, lang string, tokens long")
    rollups.changes(rows, "v", 1).groupBy("source", "lang", "version").agg({"sign": "sum"}).write.parquet(f"{work}/batches/attempt-lost")
    assert rollup.totals().collect() == []
    assert rollup.commit("x", rollups.changes(rows, "v", 1))
    assert [r.tokens for r in rollup.totals().collect()] == [5]


def test_copies_with_null_and_repeated_ids(spark, tmp_path):
    rows = [(1, "a b", "en", "s"), (1, "a b", "en", "s"), (None, "a b", "en", "s"), (3, "a b", "en", "s"), (4, None, "en", "s"), (5, None, "en", "s"), (6, "", "en", "s")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    n = encoded(BYTE_BPE, 2)
    got = queries.op5_token_rollup(spark, str(tmp_path)).collect()
    kept = [t or "" for i, t, _, _ in rows if i != 3]  # only a larger id of an equal text goes
    assert [(r.docs, r.tokens) for r in got] == [(len(kept), sum(len(n(t)) for t in kept))]


def test_token_rollup_query(spark, sf):
    want, count = Counter(), encoded(BYTE_BPE, 2)
    seen = set()
    for r in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect()):
        if r.text not in seen:
            seen.add(r.text)
            want[r.source, r.lang] += len(count(r.text))
    assert {(r.source, r.lang): r.tokens for r in queries.op5_token_rollup(spark, sf).collect()} == dict(want)
    assert len(rollups.counted(frame(spark, ODD), BYTE_BPE).collect()) == len(ODD)


def vector_truth(rows, cosine=0.95):
    ok = [i is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for i, v in rows]
    near = lambda a, b: len(a) == len(b) and np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine
    link = [[x != y and ok[x] and ok[y] and near(rows[x][1], rows[y][1]) for y in range(len(rows))] for x in range(len(rows))]
    label = list(range(len(rows)))
    for _ in rows:
        label = [min([label[x], *(label[y] for y in range(len(rows)) if link[x][y])], key=lambda k: (rows[k][0] is None, rows[k][0], k)) for x in range(len(rows))]
    return sorted(((i, sum(link[k]), rows[label[k]][0] if i is not None else None, i is not None and rows[label[k]][0] == i) for k, (i, _) in enumerate(rows)), key=str)


def vector_rows(dim, seed):
    rng = np.random.default_rng(seed)
    out, i = [], 0
    for _ in range(12):
        c = rng.normal(size=dim)
        for _ in range(rng.integers(1, 7)):
            out.append((i, [float(np.float32(x)) for x in c + rng.normal(size=dim) * rng.choice([0, 0.15, 0.3, 0.35])]))
            i += 1
    return out


def test_no_unit_holds_more_than_two_chunks(spark):
    """One cell with ten chunks at home and one with a few homes and many guests."""
    rows = [(i, 8, 0, 5, True, b"x") for i in range(1000)] + [(2000 + i, 8, 0, 9, i < 20, b"x") for i in range(1500)]
    cells = spark.createDataFrame(rows, "node long, dim int, block int, cell long, home boolean, at binary")
    counts = cells.groupBy("dim", "block", "cell").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("guests"))
    got = vectors.units(cells, counts, 100).collect()
    size, met = Counter(r.unit for r in got), Counter()
    assert max(size.values()) <= 2 * 100 * 1.4  # chunks are dealt by a hash
    by = defaultdict(lambda: defaultdict(list))
    for r in got:
        by[r.unit, r.low, r.high][r.side].append(r.node)
    for (_, low, high), sides in by.items():
        if low == high:
            met.update((min(a, b), max(a, b)) for a in sides[low] for b in sides[low] if a < b)
        else:
            met.update((min(a, b), max(a, b)) for a in sides[low] for b in sides[high])
    home = lambda n: n < 1000 or 2000 <= n < 2020
    cell = lambda n: n < 1000
    assert met == {(a, b): 1 for c in (True, False) for a in sorted(r[0] for r in rows if cell(r[0]) == c) for b in sorted(r[0] for r in rows if cell(r[0]) == c) if a < b and (home(a) or home(b))}


@pytest.mark.parametrize("same", [True, False])
def test_near_rows_against_all_pairs(monkeypatch, same):
    monkeypatch.setattr(vectors, "TILE", 16)
    rng = np.random.default_rng(2)
    a = np.round(rng.normal(size=(150, 8)) * 40).clip(-127, 127).astype(np.int8)
    b = a if same else np.round(rng.normal(size=(90, 8)) * 40).clip(-127, 127).astype(np.int8)
    for budget in (0.02, 0.3, 1.0):
        d = ((a[:, None].astype(float) - b[None].astype(float)) ** 2).sum(2)
        if same:
            np.fill_diagonal(d, np.inf)
        got_a, got_b = vectors.near_rows(a, b, budget, same)
        sure = d <= budget * vectors.STEPS**2  # and no more than the rounding allows
        most = d <= (budget**0.5 + (8**0.5 + 1) / vectors.STEPS) ** 2 * vectors.STEPS**2
        assert (got_a >= sure.any(1)).all()
        assert (got_b >= sure.any(0)).all()
        assert (got_a <= most.any(1)).all()
        assert (got_b <= most.any(0)).all()


@pytest.mark.parametrize("grid", [1, 2, 3])
def test_links_are_the_same_with_any_grid(spark, grid):
    rows = vector_rows(8, 5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(df, workspace(spark, "t"), grid=grid, chunk=7).collect()), key=str) == vector_truth(rows)


def test_vectors_whose_squares_overflow_or_vanish(spark):
    rows = [(1, [1e200, 1e200]), (2, [1e200, 1.01e200]), (3, [1e-200, 1e-200]), (4, [1.0, 1.0]), (5, [5e-324, 5e-324]), (6, [1e300, -1e300]), (7, [1e-310, 0.0]), (8, [2.0, 0.0])]
    found = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), workspace(spark, "t"))
    assert sorted(map(tuple, found.collect())) == [(i, 4, 1, i == 1) for i in range(1, 6)] + [(6, 0, 6, True), (7, 1, 7, True), (8, 1, 7, False)]


@pytest.mark.parametrize(("lot", "size"), [(1, 1 << 30), (1 << 30, 3 * 8 * 16)])
def test_links_are_the_same_in_small_and_wide_work_arrays(spark, monkeypatch, lot, size):
    """Products of matrices for all pairs, or pairs one by one; and chunks of three vectors."""
    monkeypatch.setattr(vectors, "LOT_BYTES", lot)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 5)
    monkeypatch.setattr(vectors, "CHUNK_BYTES", size)
    rows = vector_rows(16, 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.near_vectors(df, workspace(spark, "t"), grid=1).collect()), key=str) == vector_truth(rows)


def test_a_wide_unit_stays_small():
    """As many wide vectors as a unit may have, all near each other."""
    n = 2 * (vectors.CHUNK_BYTES // (8 * 1536))
    rng = np.random.default_rng(1)
    x = (rng.normal(size=1536) + rng.normal(size=(n, 1536)) * 0.1).astype(np.float32)
    assert 3 * x.astype(float).nbytes < 256 << 20
    zero = pa.array(np.zeros(n, np.int32))
    unit = {"node": pa.array(np.arange(n)), "weight": pa.array(np.ones(n, np.int64)), "low": zero, "high": zero, "side": zero, "block": zero, "vector": pa.array(list(x[:400]))}
    found = [vectors._compare("<f4", 0.95)(pa.table({**{k: v[:400] for k, v in unit.items()}, "block": pa.array(np.full(400, k, np.int32))})) for k in range(4)]
    assert sum(f.links.sum() for f in found) == 400 * 399


@pytest.mark.parametrize(("dim", "chunk", "kind"), [(16, 8192, "float"), (16, 5, "double"), (3, 4, "float"), (1, 8, "double")])
def test_vectors_against_brute_force(spark, dim, chunk, kind):
    rows = [*vector_rows(dim, dim), (900, None), (901, [0.0] * dim), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (904, [None] * dim), (905, []), (None, [1.0] * dim), (906, [1.0] * (dim + 1)), (907, [2.0] * (dim + 1)), (908, [1.0] * dim), (909, [1.0] * dim), (910, [3.0] * dim)]
    df = spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, label int, node long, unit long")
    found = vectors.near_vectors(df, workspace(spark, "t"), chunk=chunk)
    assert sorted(map(tuple, found.collect()), key=str) == vector_truth(rows)
    assert vectors.near_vectors(df.limit(0), workspace(spark, "t")).collect() == []


def test_sharding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = sharding.shard(docs, workspace(spark, "t")).collect()
    assert len(rows) == len(text)
    assert all(r.size == len(text[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode()) for r in rows)
    by_text, size, slots = defaultdict(set), Counter(), defaultdict(list)
    for r in rows:
        by_text[text[r.doc_id]].add(r.shard)
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(map(len, by_text.values())) == 1
    assert max(size.values()) - min(size.values()) <= 1000
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_sharding_odd_rows(spark):
    rows = [*ODD, *((50 + i, "the same text", "en", "s") for i in range(20))]
    got = sharding.shard(frame(spark, rows), workspace(spark, "t"), 3, hot_share=0.3).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 50}) == 1
    assert sharding.shard(frame(spark, []), workspace(spark, "t"), 3).collect() == []


def test_differencing():
    for sums in ([], [(5,)], [(8,), (7,), (6,), (5,), (4,)]):
        out = sharding.differencing(sums, 2)
        total = [0, 0]
        for t, to in zip(sums, out, strict=True):
            assert sorted(to) == [0, 1]
            for s, k in zip(t, to, strict=False):
                total[k] += s
        assert abs(total[0] - total[1]) <= (5 if len(sums) == 1 else 2)


def test_groups_are_differenced_in_lots(spark):
    rng = np.random.default_rng(9)
    sizes = [int(x) for x in rng.integers(1, 10_000, 3000)]
    groups = spark.createDataFrame([(bytes([i % 256, i // 256]), s) for i, s in enumerate(sizes)], "key binary, bytes long").repartition(3)
    got = sharding.balanced(groups, workspace(spark, "t"), 4, lot=100).collect()
    assert sorted(bytes(r.key) for r in got) == sorted(bytes([i % 256, i // 256]) for i in range(3000))
    sums = Counter()
    for r in got:
        sums[r.shard] += sizes[r.key[0] + 256 * r.key[1]]
    assert max(sums.values()) - min(sums.values()) <= 200


def test_differencing_against_the_best_partition():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = [int(x) for x in rng.integers(1, 100, 9)]
        to = [p[0] for p in sharding.differencing([(x,) for x in sizes], 2)]
        spread = abs(sum(x if k else -x for x, k in zip(sizes, to, strict=True)))
        best = min(abs(sum(x if m >> i & 1 else -x for i, x in enumerate(sizes))) for m in range(1 << 9))
        assert best <= spread <= best + 20  # a heuristic: near the best, never better


PAGE = "<!doctype html><html><head><title>t</title><style>p{{}}</style><script>var x='</p><p>no';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><div class='cookie-notice'>We use cookies</div>{0}<aside>side</aside><form><input><button>Go</button></form><footer>&copy; f</footer></body></html>"


def test_extract():
    e = html_.extract
    assert e(None) == e("") == e("<p></p>") == ""
    assert e(PAGE.format("<article><h1>A &amp; B</h1><p>one<b>two</b>  three<br>four<p>five &lt;6&gt;</p><!-- c --><section class=comments><p>me</p></section></article>")) == "A & B onetwo three four five <6>"
    assert e(PAGE.format("<div id=content><p>one</p> x < y <ul><li>a<li>b</ul></div>")) == "one x < y a b"
    assert e(PAGE.format("<main><div class=sidebar>s</div><header>h</header><p>m</p></main>")) == "h m"
    assert e("<article>a<p>b") == "a b"
    assert e("plain &eacute;&#233;&#xe9; &unknown; &am") == "plain ééé &unknown; &am"
    assert e("<p>a&nbsp;b c") == "a b c"
    assert e("<div " * 3 + "x") is not None
    assert e("<p>" + "x " * 200_000) == ("x " * 200_000).strip()
    for tag in ("b", "div", "p", "article", "nav", "ul><li"):
        page = f"<{tag}>" * 20_000 + "deep" + "".join(f"</{x}>" for x in tag.split("><")[::-1]) * 20_000
        assert e(page) == ("" if tag == "nav" else "deep")
        labels, depths = html_.fold(html_.parse(page))
        assert len(labels) == len(depths) <= html_.LEVELS + 1
    assert e("<p>a</p>" + "<a title='it's>b" * 20_000).startswith("a ")
    assert e('<a title="x>y" class=q>z</a><p data-x="<p>">w') == "z w"


def test_attributes_and_depth_have_no_cap():
    e = html_.extract
    assert e(f'<article><p data-x="{"a>" * 50_000}">one</p><p>two</p></article>') == "one two"
    assert e(f"<article><p data-x='{'a>' * 50_000}>one</p><p>two</p></article>").endswith("one two")
    assert e("<article>" + "<div>" * 5_000 + "<p class=ad>x</p><nav>m</nav>one<p>two</p>" + "</div>" * 5_000 + "</article>") == "one two"
    assert e("<p title=it's>one</p><p title='it>two</p>") == "one two"
    assert e("<article><p class='notice period'>one</p><p id=ad>two</p></article>") == "one two"


def test_names_that_do_not_say_what_an_element_is_for():
    e = html_.extract
    for name in ("content has-sidebar", "no-sidebar", "layout sidebar-right", "related"):
        assert e(PAGE.format(f"<div class='{name}'><article><p>one</p></article></div>")) == "one"
    assert e("<main><h1>t</h1><div class='sidebar-layout'><article>one</article></div></main>") == "one"
    assert e("<article>one</article><div class=sidebar><article>two</article></div>") == "one"
    assert e("<div>one</div><div class=related><article>two</article></div>") == "one"
    assert e("<div style='display:none' class=nav><article>two</article></div>") == ""
    inside = "<h2 id='search-results'>a</h2><section id='related-work'><p class='notice'>b</p></section><div data-id='menu' data-class=ad>c</div><h3 id=share>d</h3>"
    assert e(f"<article>{inside}<div class=ad>x</div><div class=comments>x</div><div id=comments>x</div></article>") == "a b c d"
    assert e("<h2 id=login-notice>a</h2><p data-role='menu'>b</p><p title='x class=ad'>c</p>") == "a b c"
    assert e("<div itemprop=articleBody><p class=alert>a</p></div>") == "a"


def test_tree_matching():
    t = ("a", [("b", []), ("c", [("d", [])]), ("b", [])])
    u = ("a", [("c", [("d", []), ("e", [])]), ("b", [])])
    assert html_.match(t, t) == 5
    assert html_.match(t, u) == 4
    w = html_.merge(t, u)
    assert html_.match(w, t) == 5
    assert html_.match(w, u) == 5
    assert html_.numbers(w, t)[0] == 0
    assert -1 not in html_.numbers(w, u)


def test_constant_texts_become_template(spark):
    page = lambda i, extra="": f"<html><body><div><p>Share this page</p><p>Story {i} of the day</p>{extra}<div><span>Read more here</span></div></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page(i)) for i in range(8)]
    rows += [(100 + i, f"http://h.example/c{i}", page(7)) for i in range(30)]  # copies don't make an article a template
    rows += [(200, "http://other.example/", page(1)), (201, None, None), (202, "not a url", ""), (202, "not a url", ""), (None, "http://h.example/x", page(9, "<h2>Odd</h2>"))]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "page_id long, url string, html string, text string, host string, template int")
    got = html_.main_text(df, workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    assert all(text[i] == f"Story {i} of the day" for i in range(8))
    assert all(text[100 + i] == "Story 7 of the day" for i in range(30))
    assert text[None] == "Story 9 of the day Odd"
    assert text[200] == "Share this page Story 1 of the day Read more here"
    assert text[201] == text[202] == ""
    assert html_.main_text(df.limit(0), workspace(spark, "t")).collect() == []


def test_copies_of_other_shapes_lose_their_template(spark):
    page = lambda i, extra="": f"<html><body>{extra}<div><p>Share this page</p><p>Story {i} of the day</p></div></body></html>"
    extras = ["", "<aside>a</aside>", "<nav>n</nav>", "<aside><ul><li>a</li></ul></aside>", "<aside>a</aside><nav>n</nav>"]
    rows = [(10 * i + k, f"http://h.example/{i}/{k}", page(i, x)) for i in range(8) for k, x in enumerate(extras if i < 2 else extras[:1])]
    got = html_.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), workspace(spark, "t")).collect()
    assert {r.page_id: r.text for r in got} == {r[0]: f"Story {r[0] // 10} of the day" for r in rows}


def test_pages(spark, sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in queries.op8_main_text(spark, sf).collect():
        m = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        want = " ".join(htmllib.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", m))).split())
        assert (r.text, r.n_chars) == (want, len(want))


def test_the_wrapper_decides(spark):
    # without marks and names: the same container holds the story on every page, the rest is template or short
    page = lambda i, k: f"<html><body><div class=k1><p>Home {i % 2}</p></div><div class=k2><p>Buy now, {k} left</p></div><div class=k3><h1>Title {i}</h1><p class='notice period'>First words of story {i}. {'More text. ' * 20}</p><p>About us</p></div><div class=k4>All pages, all stories</div></body></html>"
    story = lambda i: f"Title {i} First words of story {i}. {'More text. ' * 20}".strip()
    rows = [(i, f"http://h.example/{i}", page(i, 7 * i)) for i in range(12)]
    rows += [(50 + i, f"http://marked.example/{i}", page(i, 7 * i).replace("<div class=k3>", "<article>").replace("</div><div class=k4>", "</article><div class=k4>")) for i in range(12)]
    got = html_.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), workspace(spark, "t"))
    assert {r.page_id: r.text for r in got.collect()} == {k + i: story(i) for i in range(12) for k in (0, 50)}


def test_articles_renamed(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    renamed = pages.withColumn("html", F.regexp_replace("html", "<(/?)article", "<$1div"))
    one, two = (html_.main_text(p, workspace(spark, "t")) for p in (pages, renamed))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


STORY = "<h1>Title {0}</h1><p>Story {0} begins on line {0} and goes on for a while, {0} times over.</p><p>It ends {0}.</p>"


def told(i):
    return f"Title {i} Story {i} begins on line {i} and goes on for a while, {i} times over. It ends {i}."


@pytest.mark.parametrize(
    "page",
    [
        "<body><form id='aspnetForm'><div class='top'><ul><li>Menu</li></ul></div><div id='content'>{0}<input value='x'><button>Send</button></div></form></body>",
        "<body><article>{0}<ol class='comment-list'><li class='comment'>Reader {1} likes it</li><li class='comment'>So do I</li></ol></article></body>",
        "<body><article>{0}<div id='comments-section'><p>Reader {1} likes it a lot, and says so at length</p></div></article></body>",
        "<body><main><article class='post'>{0}</article><section class='more'><article><h2>Other {1}</h2><p>A teaser of {1}</p></article></section></main></body>",
        "<body><main><article class='post'>{0}</article><article class='tease'><h2>Other {1}</h2></article></main></body>",
        "<body><form><article>{0}</article></form><form><h2>Subscribe</h2><input></form></body>",
    ],
)
def test_forms_comments_and_teasers(spark, page):
    pages = [(i, f"http://h/{i}", page.format(STORY.format(i), 1000 - i)) for i in range(10)]
    assert all(told(i) in html_.extract(p) and "Reader" not in html_.extract(p) and "teaser" not in html_.extract(p) for i, _, p in pages)
    got = {r.page_id: r.text for r in html_.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), workspace(spark, "t")).collect()}
    assert got == {i: told(i) for i in range(10)}


def test_class_names_of_one_page_dont_grow_the_wrapper(spark):
    import hashlib

    h = lambda *x: hashlib.md5(repr(x).encode()).hexdigest()[:8].translate(str.maketrans("0123456789", "ghijklmnop"))
    pages = [(i, f"http://h/{i}", "<body><nav>Home</nav><div class='page'>" + f"<div class='s{h(i)}'>{STORY.format(i)}" + "".join(f"<div class='c{h(i, k)}'><p>Part {i} {k}</p></div>" for k in range(3 + i % 9)) + "</div><div class='end'>All rights here</div></div></body>") for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    work = workspace(spark, "t")
    got = {r.page_id: r.text for r in html_.main_text(df, work).collect()}
    assert got == {i: " ".join([told(i), *(f"Part {i} {k}" for k in range(3 + i % 9))]) for i in range(300)}
    assert max(r.n for r in spark.read.parquet(f"{work}/relabelled").groupBy("host").agg(F.countDistinct("tree").alias("n")).collect()) <= 9


def test_wrappers_are_merged_in_rounds(spark):
    trees = [(h, html_._dumps(("#", [(f"x{i}", []), ("p", [(f"y{i % 7}", [])])]))) for h in ("a", "b") for i in range(40)]
    got = {r.host: html_._loads(r.wrapper) for r in html_.wrappers(spark.createDataFrame(trees, "host string, tree string"), workspace(spark, "t"), 3).collect()}
    assert sorted(got) == ["a", "b"]
    for h, t in trees:
        assert html_.numbers(got[h], html_._loads(t))[0] == 0


def test_simple_tree_matching_against_all_matchings():
    rng = np.random.default_rng(0)

    def tree(depth):
        return (str(rng.integers(0, 2)) if depth < 3 else "r", [tree(depth - 1) for _ in range(rng.integers(0, 3))] if depth else [])

    def best(a, b):
        if a[0] != b[0]:
            return 0

        def rows(x, y):
            if not x or not y:
                return 0
            return max(rows(x[1:], y), rows(x, y[1:]), best(x[0], y[0]) + rows(x[1:], y[1:]))

        return 1 + rows(a[1], b[1])

    for _ in range(60):
        a, b = tree(3), tree(3)
        assert html_.match(a, b) == best(a, b)
        w = html_.merge(a, b)
        assert html_.match(w, a) == len(html_.flat(a)[0])


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 32])
def test_bit_packing(bits):
    rng = np.random.default_rng(bits)
    ids = rng.integers(0, 1 << bits, 1001, dtype=np.uint64).astype(np.uint32)
    data = idfile.packed(ids, bits)
    assert len(data) == -(-1001 * bits // 8)
    assert (idfile.unpacked(data, bits, 1001) == ids).all()
    assert (idfile.unpacked(data, bits, 50, 777) == ids[777:827]).all()
    assert idfile.width(50257) == 16
    with pytest.raises(ValueError, match="fit"):
        idfile.packed(np.array([1 << bits], np.uint64), bits)
    assert idfile.width(1) == 1


def test_part_file_random_access(tmp_path, monkeypatch):
    monkeypatch.setattr(idfile, "BLOCK", 64)
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (0, 1, 63, 64, 65, 500, 0)]
    w = idfile.PartWriter(f"file://{tmp_path}/a/x.swtb", 13)
    for i, d in enumerate(docs):
        w.add(None if i == 0 else i, d)
    assert w.close() == sum(map(len, docs))
    f = idfile.PartFile(f"file://{tmp_path}/a/x.swtb")
    whole = np.concatenate(docs)
    for a, n in ((0, len(whole)), (63, 2), (130, 400), (5, 0)):
        assert (f.read(a, n) == whole[a : a + n]).all()
    assert f.doc_ids[0] == idfile.NULL_ID


def test_token_files(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, count, start = {}, encoded(BYTE_BPE, 2), 0
    for r in sorted(docs.collect()):
        ids = count(r.text)
        want[r.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op9_token_files(spark, sf).collect()} == want


def test_token_files_odd_rows(spark):
    parts = idfile.write_ids(frame(spark, ODD), workspace(spark, "t"), BYTE_BPE, 50257, 2)
    rows = sorted(idfile.read_ids(spark, parts).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ODD), key=lambda i: (i is not None, i))
    count = encoded(BYTE_BPE, 2)
    assert Counter(bytes(r.ids) for r in rows) == Counter(count(t).tobytes() for _, t, *_ in ODD)
    assert [r.start for r in rows] == [sum(len(x.ids) // 4 for x in rows[:k]) for k in range(len(rows))]
    none = idfile.write_ids(frame(spark, []), workspace(spark, "t"), BYTE_BPE, 50257, 2)
    assert idfile.read_ids(spark, none).collect() == []


def contamination_truth(rows, items, size=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_slices_of_a_text_hold_its_words(monkeypatch):
    rng = np.random.default_rng(8)
    for size in (1, 2, 7, 50):
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", size)
        for text in (None, "", " . ", "a", "Ab" * 40, " x " * 30, " ".join("w" * rng.integers(0, 12) for _ in range(80)), "é中\x1cf, g"):
            parts = list(decontaminate.sliced(text))
            assert sum(parts, []) == words(text)
            assert all(len(b" ".join(p)) <= max(size, max(map(len, p))) for p in parts)


@pytest.mark.parametrize("block", [200_000, 8])
def test_contamination(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD", 200)
    rng = np.random.default_rng(4)
    word = lambda n: " ".join(rng.choice([f"W{k}" for k in range(40)], n))
    items = [(i, word(rng.integers(1, 30) if i else 14)) for i in range(12)] + [(12, None), (13, "..."), (None, "w1 w2"), (14, "alone"), (15, "alone")]
    rows = []
    for i in range(60):
        w = word(rng.integers(0, 60)).split()
        if i % 3 == 0:
            k = rng.integers(0, len(w) + 1)
            w[k:k] = (items[i % 12][1] or "").upper().split()
        rows.append((i, ", ".join(w)))
    rows += [(93, "w1 " * 400_000 + items[1][1]), (7, "alone again; ALONE"), (7, "alone again; ALONE"), (None, "x alone"), (90, None), (91, ""), (92, "w1 " * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, items int, spans int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.report(decontaminate.contamination(docs, bench, workspace(spark, "t"), block=block))
    assert sorted(map(tuple, found.collect()), key=str) == contamination_truth(rows, [x for x in items if x[0] is not None])
    assert decontaminate.contamination(docs.limit(0), bench, workspace(spark, "t"), block=block).collect() == []
    assert decontaminate.report(decontaminate.contamination(docs, bench.limit(0), workspace(spark, "t"))).where("contaminated").collect() == []


def test_fm_index_against_scan():
    rng = np.random.default_rng(6)
    text = rng.integers(0, 4, 500).astype(np.int64)
    index = decontaminate.FMIndex(text, 3)
    patterns = np.zeros((40, 5), np.int64)
    lengths = rng.integers(1, 6, 40)
    for i, n in enumerate(lengths):
        patterns[i, 5 - n :] = rng.integers(1, 4, n)
    lo, hi = index.search(patterns, lengths)
    for i, n in enumerate(lengths):
        at = sorted(index.locate(np.arange(lo[i], hi[i])).tolist()) if hi[i] > lo[i] else []
        assert at == [k for k in range(len(text) - n + 1) if (text[k : k + n] == patterns[i, 5 - n :]).all()]


def test_removal_spans():
    assert decontaminate.merged(np.array([5, 0, 8]), np.array([4, 3, 2])) == [(0, 3), (5, 10)]
    assert decontaminate.without_spans("A b, c. D e f", [(1, 3), (5, 6)]) == "A . D e "
    assert decontaminate.without_spans(None, []) is None
