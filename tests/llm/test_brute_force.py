"""Operators that SQL can't express, against brute force, held-out accuracy or exact arithmetic."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, exact_dedup, html_extract, line_dedup, lm_scoring, mixing, near_dedup, quality, toxicity
from quillon.llm.common import scratch_path

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def shingles(text):
    words = text.split()
    n = min(3, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else frozenset([("", text)])


def near_groups(rows):
    """Groups of (id, text) by all pairs."""
    sets = [(i, shingles(t)) for i, t in rows if t is not None]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if min(len(a), len(b)) >= 0.5 * max(len(a), len(b)) and len(a & b) >= 0.5 * len(a | b):
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i in root}


def test_near_groups_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).select("doc_id", "text").collect()]
    want = near_groups(rows)
    sizes = {r: sum(1 for x in want.values() if x == r) for r in set(want.values())}
    got = {r.doc_id: r.keep_id for r in near_dedup.near_dedup(spark, SF).collect()}
    assert got == {i: r for i, r in want.items() if sizes[r] > 1}


def test_near_groups_of_shared_passages_and_chains(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=40)
    rows, at = [], 0
    for _ in range(60):  # a passage that all share, and own words of various lengths
        rows.append((at, " ".join(passage + rng.choices(words, k=rng.randint(0, 90)))))
        at += 1
    own = rng.choices(words, k=80)
    for _ in range(20):  # a chain of edits
        own = own[:]
        own[rng.randrange(80)] = rng.choice(words)
        rows.append((at, " ".join(own)))
        at += 1
    want = near_groups(rows)
    kept = sorted(r.doc_id for r in near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == sorted(set(want.values()))


def brute_lines(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        keep = []
        for line in t.split("\n"):
            if line.strip(" ") == "" or line not in seen:
                keep.append(line)
            seen.add(line)
        out[i] = "\n".join(keep)
    return out


@pytest.mark.parametrize("options", [{}, {"bits": 1 << 23}, {"broadcast_bits": 0}, {"broadcast_bits": 0, "bits": 1 << 24}])
def test_lines_equal_brute_force(spark, options):
    rng = random.Random(3)
    lines = [f"line {i}" for i in range(200)] + ["", " ", "\t"]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 30)))) for i in range(150)]
    got = {r.doc_id: r.text for r in line_dedup.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got == brute_lines(rows)


def brute_scores(rows):
    import math
    from collections import Counter

    grams = [[Counter(tuple(t.split()[i : i + n]) for i in range(len(t.split()) - n + 1)) for n in (1, 2, 3)] for _, t in rows]
    every = [sum((g[n] for g in grams), Counter()) for n in range(3)]
    total = sum(every[0].values())
    out = {}
    for (ident, t), own in zip(rows, grams):
        words = t.split()
        rest = [lambda g, n=n: every[n][g] - own[n][g] for n in range(3)]
        score = 0.0
        for i, w in enumerate(words):
            s = math.log10(max(rest[0]((w,)), 0.5) / max(total - len(words), 1))
            for n in (1, 2):
                if i < n:
                    break
                g = tuple(words[i - n : i + 1])
                s = math.log10(rest[n](g) / rest[n - 1](g[:-1])) if rest[n](g) else s + math.log10(0.4)
            score += s
        out[ident] = round(score / len(words), 6) if words else None
    return out


def test_scores_equal_brute_force_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_CHARS", 400)
    monkeypatch.setattr(lm_scoring, "PARTITION_NGRAMS", 300)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("a b c d e f g".split() + [f"u{i}"], k=rng.randint(0, 25)))) for i in range(120)] + [(900 + i, "a " * 300) for i in range(3)]
    got = {r.doc_id: r.score and round(r.score, 6) for r in lm_scoring.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx(brute_scores(rows))


def test_counts_and_hashes_round_trip():
    counts = np.array([0, 1, 254, 255, 256, 3_000_000_000])
    assert (lm_scoring.unpack_counts(lm_scoring.pack_counts(counts)) == counts).all()
    for spread in (1 << 30, 1 << 56):
        values = np.unique(np.random.default_rng(1).integers(0, spread, 500).astype(np.uint64))
        assert (lm_scoring.unpacked(lm_scoring.packed(values)) == values).all()
    texts = ["  a b\x1cc d \x85", "", None, " x ", "　", "a\x1f b"]
    words, sizes = lm_scoring.split_words(texts)
    assert words.to_pylist() == [w for t in texts for w in (t or "").split()] and list(sizes) == [len((t or "").split()) for t in texts]


def test_machine_equals_sum_over_pairs():
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE).astype(np.float32), rng.normal(size=(quality.SIZE, quality.RANK)).astype(np.float32))
    x = quality.features(["one two", None], [np.array([5, 9, 5]), np.array([], dtype=np.int64)], [[1, 2], []])
    got, starts = machine.parts(x)[0], [0, *x.ends[:-1]]
    for r, (a, b) in enumerate(zip(starts, x.ends)):
        c, v = x.columns[a:b], x.values[a:b]
        want = 0.3 + machine.linear[c] @ v + sum(machine.factors[c[i]] @ machine.factors[c[j]] * v[i] * v[j] for i, j in itertools.combinations(range(len(c)), 2))
        assert got[r] == pytest.approx(want, rel=1e-3, abs=1e-3)


def held_out(spark, label):
    rows = documents(spark).join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    return rows.where(f"pmod(xxhash64(doc_id), 4) > 0").select("doc_id", label), rows.where("pmod(xxhash64(doc_id), 4) = 0")


def test_quality_held_out(spark):
    labels, rest = held_out(spark, "quality")
    machine = quality.fit(documents(spark), labels, ["lang", "source"])
    got = quality.with_quality(rest, machine, ["lang", "source"], "p").select("quality", (F.col("p") >= F.lit(machine.threshold)).alias("keep")).collect()
    good, bad = ([r.keep for r in got if r.quality == q] for q in (1, 0))
    assert sum(good) >= 0.9 * len(good) and sum(bad) <= 0.4 * len(bad)


def toxic_texts(n, seed):
    """Invented prose; toxic texts have two words of a set behind one of several beginnings."""
    rng = random.Random(seed)
    part = lambda: "".join(rng.choice("ba co du fe gi lo mu ne pi ro su ta".split()) for _ in range(rng.randint(2, 4)))
    plain = lambda: [part() for _ in range(rng.randint(30, 120))]
    toxic = []
    for _ in range(n):
        words = plain()
        for _ in range(3):
            words.insert(rng.randrange(len(words)), rng.choice(["zwykle", "vroxat", "kjelmo"]) + rng.choice(["", "ba", "co", "ning"]))
        toxic.append(" ".join(words))
    return toxic, [" ".join(plain()) for _ in range(4 * n)]


def test_toxicity_held_out():
    model = toxicity.train(*toxic_texts(150, 1))
    score = model.scorer()
    toxic, plain = toxic_texts(60, 2)
    assert sum(score(t) >= model.threshold for t in toxic) >= 0.9 * len(toxic)
    assert sum(score(t) >= model.threshold for t in plain) <= 0.03 * len(plain)
    assert model.ordinary != model.toxic and len(model.ordinary) == len(model.toxic)


def test_toxic_documents_go_and_the_end_of_a_text_counts(spark):
    model = toxicity.train(*toxic_texts(150, 1))
    toxic, plain = toxic_texts(20, 3)
    late = " ".join(plain[:40]) + " zwykle vroxat kjelmo zwyklening vroxatco" * 30
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*plain[:40], late, None, ""])], "doc_id long, text string")
    left = {r.doc_id for r in toxicity.reject_toxic(docs, model).collect()}
    assert 40 not in left and {41, 42} <= left and len(left) >= 41


def test_gradients_of_the_labeller():
    rng = np.random.default_rng(0)
    model = html_extract.Labeller(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x, y = rng.normal(size=(5, 2, html_extract.INPUT)), rng.integers(0, 2, (5, 2)).astype(float)
    mask = np.ones((5, 2), dtype=bool)
    mask[3:, 1] = False

    def loss():
        p = model.forward(x, mask)[0]
        return -(np.where(mask, y * np.log(p) + (1 - y) * np.log(1 - p), 0)).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in model.w:
        flat, at = model.w[name].reshape(-1), 3 % model.w[name].size
        old = flat[at]
        flat[at] = old + 1e-4
        up = loss()
        flat[at] = old - 1e-4
        down = loss()
        flat[at] = old
        assert grads[name].reshape(-1)[at] == pytest.approx((up - down) / 2e-4, rel=2e-2, abs=2e-4)


def test_pages_held_out(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = html_extract.fit(pages.where("page_id % 2 = 0"))
    own = [html_extract.blocks(r.html) for r in pages.where("page_id % 2 = 1").collect()]
    hit = np.concatenate([(p >= 0.5) == [b.label for b in page] for page, p in zip(own, html_extract.label(model, own)) if page])
    assert hit.mean() >= 0.97
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    assert len(got) == pages.count() and all(r.n_content <= r.n_blocks for r in got.values())


@pytest.mark.parametrize("shards", [1, 5])
def test_neighbours_against_brute_force(spark, shards, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 16)
    monkeypatch.setattr(ann, "CHUNK", 2)
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    held = rows.orderBy("vec_id").toPandas()
    vectors = np.stack(held["embedding"]).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    got = ann.nearest(rows, shards=shards, ask=F.col("vec_id") % 20 == 0).toPandas()
    asked = [i for i, v in enumerate(held["vec_id"]) if v % 20 == 0]
    assert set(got["vec_id"]) == {held["vec_id"][i] for i in asked} and (got.groupby("vec_id").size() == 10).all()
    found = 0
    for i in asked:
        near = vectors @ vectors[i]
        near[i] = -np.inf
        found += (got[got["vec_id"] == held["vec_id"][i]]["similarity"] >= np.sort(near)[-10] - 1e-6).sum()
    assert found >= 0.9 * 10 * len(asked)


def test_poisson_counts_are_the_inverse_distribution(spark):
    docs = spark.createDataFrame([(i, "t", "hot" if i % 3 else "b") for i in range(3000)], "doc_id long, text string, source string")
    rated = {r.source: r for r in mixing.rates(docs).collect()}
    counts = {r.doc_id: r.n for r in mixing.mix(docs, number="copy").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    import hashlib

    for i in range(0, 3000, 7):
        u = int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert counts.get(i, 0) == sum(c <= u for c in rated["hot" if i % 3 else "b"].cdf)
    for source, r in rated.items():
        n = sum(c for i, c in counts.items() if ("hot" if i % 3 else "b") == source)
        assert abs(n - r.n * r.rate) < 5 * (r.n * r.rate) ** 0.5


def test_index_keeps_its_buckets_and_is_compacted(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "COMPACT", 3)
    path = scratch_path(spark, "index")
    texts = [[f"t{b}-{i}" for i in range(20)] for b in range(5)]
    for b, own in enumerate(texts):
        index = exact_dedup.DigestIndex(spark, path, 4 if b == 0 else 9)
        assert index.buckets == 4
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(own + texts[0])], "doc_id long, text string")
        assert exact_dedup.deduplicate(docs, index, f"b{b}").count() == 20
        index.forget()
    index = exact_dedup.DigestIndex(spark, path)
    assert index.version >= 1 and index.table().count() == 100
    again = spark.createDataFrame([(0, "t3-1"), (1, "new")], "doc_id long, text string")
    assert [r.doc_id for r in exact_dedup.deduplicate(again, index).collect()] == [1]
    index.forget()
    assert not spark.catalog.tableExists(index.name)
