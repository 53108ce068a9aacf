"""Filter audit, Merkle manifest and exact deduplication against brute force, on odd rows, small ranges, colliding digests and restarts."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_llm_operators import ODD, frame

from skillweft.llm import exactdup, lattice, merkle
from skillweft.llm.common import workspace


def failed(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    return {c for c, bad in zip("ABCD", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t) is not None), strict=True) if bad}


def audit_truth(rows, labels):
    fails = []
    for i, text, _, source in rows:
        same = [j for j, t, _, _ in rows if (t or "") == (text or "") and i is not None and j is not None and j < i]
        marks = [x for x in labels if x[0] == i and i is not None]
        fails.append((source or "", failed(text) | ({"E"} if same else set()), any(q == 1 for _, q, _ in marks), any(x == 1 for _, _, x in marks)))
    out = {}
    for part in {f[0] for f in fails}:
        mine, shapley = [f for f in fails if f[0] == part], Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order, 1):
                hit = [f for f in left if c in f[1]]
                left = [f for f in left if c not in f[1]]
                shapley[c] += len(hit)
                out[part, "".join(order), k] = [len(left), len(hit), sum(c in f[1] for f in mine) - len(hit), sum(f[1] == {c} for f in mine), sum(f[2] for f in hit), sum(f[3] for f in hit)]
        for (p, order, k), v in out.items():
            if p == part:
                v.append(shapley[order[k - 1]])
    return out


def test_filter_audit(spark):
    rng = random.Random(5)
    text = lambda: " ".join(rng.choice(["Alpha", "beta", "GAMMA", "x|y", "d", "e\x1cf"]) if rng.random() < 0.4 else f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 190, 200, 260, 900])))
    texts = [text() for _ in range(40)]
    rows = [*ODD, *[(20 + i, rng.choice(texts), "en", rng.choice(["s", "t", None, ""])) for i in range(120)]]
    labels = [(25, 1, 0), (25, 0, 1), (26, 1, None), (None, 1, 1), (6, None, 1), (6, None, 1), (9999, 1, 1)]
    known = spark.createDataFrame([(*r, 1) for r in labels], "doc_id long, quality int, toxic int, part int")
    got = lattice.filter_audit(frame(spark, rows), known, workspace(spark, "t")).collect()
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == audit_truth(rows, labels)
    assert lattice.filter_audit(frame(spark, []), known, workspace(spark, "t")).collect() == []
    with pytest.raises(ValueError):
        lattice.audit(spark.createDataFrame([], "part string, mask int, good boolean, toxic boolean"), "AA")


def test_steps_are_paths_of_the_lattice(spark):
    rows = lattice.steps(spark, "ABCDE").collect()
    assert len(rows) == 600
    assert len({(r.applied, r.next) for r in rows}) == 80
    for _, path in itertools.groupby(sorted(rows, key=lambda r: (r.filter_order, r.step)), key=lambda r: r.filter_order):
        path = list(path)
        assert all(b.applied == a.applied | 1 << a.next for a, b in itertools.pairwise(path))


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [merkle.digest_of(nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
        out.append(nodes)
    return out


def manifest_truth(rows):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    by = {}
    for i, text, lang, source, n in rows:
        f = lambda t, i=i, lang=lang, source=source, n=n: merkle.digest_of([*map(enc, (i, source, lang, n, t))])
        bad = f(text.translate(lower)) if i is not None and text is not None and zlib.crc32(str(i).encode()) % 5 == 0 else None
        by.setdefault(source, []).append((i is not None, i or 0, f(text), bad, i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources}
    top = levels([trees[s][-1][0] for s in sources])

    def path(tree, i):
        for nodes in tree[:-1]:
            yield i % 16, nodes[i // 16 * 16 : i // 16 * 16 + 16]
            i //= 16

    out = []
    for rank, s in enumerate(sources):
        for i, (_, _, leaf, bad, doc) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            p = [*path(trees[s], i), *path(top, rank)]
            folded = merkle.fold(bad or leaf, p)
            out.append((doc, leaf, trees[s][-1][0], top[-1][0], merkle.digest_of(h for at, run in p for k, h in enumerate(run) if k != at), folded, folded == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("part_rows", "fan_in"), [(100_000, 32), (7, 2), (40, 3)])
def test_manifest(spark, monkeypatch, part_rows, fan_in):
    monkeypatch.setattr(merkle, "PART_ROWS", part_rows)
    monkeypatch.setattr(merkle, "FAN_IN", fan_in)
    rows = [*[(i, t if t is None or len(t) < 1000 else t[:5000], lang, s) for i, t, lang, s in ODD], *[(1000 + i, f"Text {i} Ä", "en", "big") for i in range(290)], *[(5000 + i, "T", "de", f"s{i % 19:02d}é") for i in range(60)], *[(None, "Same", "en", "hot")] * 25]
    got = merkle.manifest(merkle.document_leaves(frame(spark, rows)), workspace(spark, "t"))
    assert sorted(map(tuple, got.collect()), key=str) == manifest_truth([(*r, None) for r in rows])


def test_manifest_of_few(spark):
    for rows in ([], [(1, "A", "en", None)], [(None, None, None, None)], [(1, "A", "en", "s"), (1, "A", "en", "t")]):
        got = merkle.manifest(merkle.document_leaves(frame(spark, rows)), workspace(spark, "t"))
        assert sorted(map(tuple, got.collect()), key=str) == manifest_truth([(*r, None) for r in rows])


def test_fragments_are_a_monoid():
    rng = random.Random(3)
    leaves = {0: 40, 1: 1, 2: 300, merkle.TOP: 3}
    nodes = [(t, 0, i, hashlib.sha256(f"{t}-{i}".encode()).hexdigest()) for t, n in leaves.items() if t != merkle.TOP for i in range(n)]
    root = None
    for _ in range(5):
        rng.shuffle(nodes)
        cuts = sorted(rng.sample(range(len(nodes)), 9))
        parts = []
        for a, z in itertools.pairwise([0, *cuts, len(nodes)]):
            f = merkle.Forest(dict(leaves))
            for n in nodes[a:z]:
                f.add(*n)
            parts.append(f)
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [parts[k].merge(parts[k + 1])]
        assert len(parts[0].nodes) == 1
        ((key, held),) = parts[0].nodes.items()
        assert key == (merkle.TOP, 1)
        root = root or held
        assert held == root


def dedup_truth(rows):
    by = {}
    for i, t, *_ in rows:
        by.setdefault(t or "", []).append(i)
    out = []
    for i, t, *_ in rows:
        ids = by[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [32, 1])
def test_exact_dedup_in_batches(spark, tmp_path, size):
    """With one byte of digest nearly all texts collide, so only their bytes tell them apart."""
    rng = random.Random(size)
    rows = [*ODD, *[(20 + i, rng.choice(["hot", "hot", "hot", f"text {rng.randrange(250)}", "A", "a", "a ", None]), "en", "s") for i in range(500)]]
    rng.shuffle(rows)
    for k in range(4):
        frame(spark, rows[k::4]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    work = workspace(spark, "t")
    got = exactdup.dedup_folder(spark, f"{tmp_path}/in", work, "1", size)
    assert spark.read.text(f"{work}/checkpoint/commits").count() >= 8  # four batches
    assert sorted(map(tuple, got.collect()), key=str) == dedup_truth(rows)
    more = [(9000 + i, rng.choice(["hot", "A", f"new {i}"]), "en", "s") for i in range(40)]
    frame(spark, more).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = exactdup.dedup_folder(spark, f"{tmp_path}/in", work, "1", size)  # goes on from its checkpoint
    assert sorted(map(tuple, got.collect()), key=str) == dedup_truth([*rows, *more])


def test_exact_dedup_windows_and_empty(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exactdup, "WINDOW_TEXTS", 3)
    rows = [(i, f"t{i % 7}", "en", "s") for i in range(60)]
    frame(spark, rows).write.parquet(f"{tmp_path}/in")
    assert sorted(map(tuple, exactdup.exact_dedup(spark, f"{tmp_path}/in").collect()), key=str) == dedup_truth(rows)
    frame(spark, rows).limit(0).write.parquet(f"{tmp_path}/none")
    none = exactdup.exact_dedup(spark, f"{tmp_path}/none")
    assert none.collect() == []
    assert none.columns == exactdup.exact_dedup(spark, f"{tmp_path}/in").columns


def test_state_goes_on_where_the_session_has_another_store(spark, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    frame(spark, [(1, "a", "en", "s"), (2, "a", "en", "s")]).write.parquet(f"{tmp_path}/in")
    got = exactdup.exact_dedup(spark, f"{tmp_path}/in")
    assert got.where(F.col("kept")).count() == 1
    assert spark.conf.get(key, None) == before


@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_merkle_manifest", "op13_exact_dedup"])
def test_queries_equal_their_sql(spark, sf, name):
    import duckdb

    from skillweft.llm import queries

    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    cur = c.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(cur.fetchall(), key=str)
