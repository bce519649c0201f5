"""Whitening, spelling variants and benchmark decontamination against brute force, on odd rows too."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridwell.llm import decontaminate, spelling, whitening
from gridwell.llm.queries import queries

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "a b c d e", "é   x", "x" * 20_000, "w " * 5_000, "a\nb\na\n\n\nb\n", "<|endoftext|>", "\x00 \x1c"]
SCHEMA = "vec_id long, embedding array<float>, label int, row string, whitened double"


# -- 11


def embeddings(spark, vectors):
    return spark.createDataFrame([(k if k % 5 else None, v, 1, "row", 0.5) for k, v in enumerate(vectors)], SCHEMA)


def test_jacobi_matches_a_library_and_keeps_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 3, 7, 20):
        a = rng.normal(size=(d, d))
        a = a @ a.T
        e, v = whitening.jacobi(a)
        assert np.allclose(e, np.linalg.eigvalsh(a)[::-1]) and np.allclose(v @ np.diag(e) @ v.T, a) and np.allclose(v.T @ v, np.eye(d))
    # scaled by 1e-8 to 1e8, eigenvalues keep their digits
    scale = np.array([1e8, 1.0, 1e-8])
    core = np.array([[1, 0.3, 0.2], [0.3, 1, 0.1], [0.2, 0.1, 1]])
    e, _ = whitening.jacobi(core * np.outer(scale, scale))
    assert np.prod(e) == pytest.approx(np.linalg.det(core), rel=1e-12)
    assert e[-1] == pytest.approx(1e-16 * np.linalg.det(core) / np.linalg.det(core[:2, :2]), rel=1e-9)


def test_whitening_of_a_table(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()}
    x = np.floor(64 * np.array(list(rows.values()), float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(0)
    e, u = np.linalg.eigh(np.cov(x.T - 1_000_000, bias=True))
    e, u = e[::-1], u[:, ::-1]
    place = {k: i for i, k in enumerate(rows)}
    got = queries()["op11_embedding_whitening"](spark, SF).collect()
    assert len(got) == 32 * n and {r["component"] for r in got} == set(range(1, 33))
    white = np.zeros((n, 32))
    for r in got:
        white[place[r["vec_id"]], r["component"] - 1] = r["whitened"]
    want = (x - s / n) @ u[:, :32] / np.sqrt(e[:32])
    assert np.allclose(white, want * np.sign((white * want).sum(0)), atol=1e-8)
    assert np.allclose(np.cov(white.T, bias=True), np.eye(32), atol=1e-9)
    for r in random.Random(2).sample(got, 50):
        assert r["n"] == n and r["deviation"] == sum((n * int(v) - int(t)) ** 2 for v, t in zip(x[place[r["vec_id"]]], s, strict=True))
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9


def test_odd_vectors(spark):
    good = [[float(k % 3), float(k % 5), 2.0 * (k % 3), 7.0] for k in range(30)]
    bad = [None, [], [1.0, None, 2.0, 3.0], [float("nan")] * 4, [float("inf"), 0.0, 0.0, 0.0], [1.0], [1.0] * 5]
    df = embeddings(spark, good + bad + good[:4])
    model = whitening.fit(df)
    assert model.centre.n == 34 and model.known.tolist() == [True, True, False, False]
    assert model.eigenvalues.argsort()[::-1].tolist() == [0, 1, 2, 3] and model.identity_error < 1e-9
    got = whitening.whitened(df, model).collect()
    assert len(got) == 34 and all(r["whitened"][2:] == [None, None] for r in got) and got[0]["row"]["whitened"] == 0.5
    assert got[0]["whitened"] == got[30]["whitened"]  # copies
    assert sum(got[k]["whitened"][0] for k in range(34)) == pytest.approx(0, abs=1e-9)
    # one vector, the same vectors, none
    for vectors in ([[1.0, 2.0]], [[1.0, 2.0]] * 3):
        one = whitening.fit(embeddings(spark, vectors))
        assert one.known.tolist() == [False, False] and one.explained == [None, None] and one.identity_error is None
        assert [r["deviation"] for r in whitening.whitened(embeddings(spark, vectors), one).collect()] == [0] * len(vectors)
    assert whitening.fit(embeddings(spark, [])) is None and whitening.fit(embeddings(spark, [None, []])) is None


def test_huge_entries_stay_exact(spark):
    vectors = [[3e38, 1.0], [-3e38, 2.0], [0.0, 3.0]]
    df = embeddings(spark, vectors)
    model = whitening.fit(df)
    got = whitening.whitened(df, model).collect()
    assert model.centre.sums == [3_000_000, 3_000_000 + 64 * 6] and [r["deviation"] for r in got] == [None, None, 0 + 192**2]
    exact = whitening.Centre(3, [10, 2**62])
    x = np.array([[2, 2**61], [4, 5]], np.int64)
    assert exact.deviations(x).tolist() == [[3 * int(a) - s for a, s in zip(r, exact.sums, strict=True)] for r in x]


def test_an_empty_table_gives_no_components(spark, tmp_path):
    embeddings(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries()["op11_embedding_whitening"](spark, str(tmp_path))
    assert got.collect() == [] and got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


# -- 12


def brute_variants(docs):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= 3}
    letters = {c for w in n for c in w}
    near = {}
    for w in n:
        cuts = [(w[:k], w[k:]) for k in range(len(w) + 1)]
        there = {a + z[1:] for a, z in cuts if z} | {a + c + z[1:] for a, z in cuts if z for c in letters} | {a + c + z for a, z in cuts for c in letters}
        near[w] = (there & n.keys()) - {w}
    best = {w: min(near[w], key=lambda o: (-n[o], o), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n), key=str)


def variants_of(spark, docs):
    rows = [(k, t, "form", 1) for k, t in docs]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int")
    return sorted((tuple(r) for r in spelling.variants(spelling.counted(df)).collect()), key=str)


def test_variants_of_a_table(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in queries()["op12_spelling_variants"](spark, SF).collect()), key=str)
    assert got == brute_variants(docs) and any(r[1] for r in got)


def test_variants_of_few_letters_ties_and_odd_rows(spark):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("abÉé") for _ in range(rnd.randint(4, 7))) for _ in range(80)]
    docs = [(k if k % 9 else None, "-".join(w for w in rnd.sample(words, 25) for _ in range(rnd.randint(1, 5)))) for k in range(40)]
    docs += [(k, t) for k, t in enumerate(ODD)] + docs[:3]
    got = variants_of(spark, docs)
    assert got == brute_variants(docs) and max(r[4] for r in got) > 2 and any(r[1] for r in got)
    assert variants_of(spark, []) == [] and variants_of(spark, [(1, None), (2, "a b c")]) == []


def test_very_long_words_meet_as_short_ones_do(spark, monkeypatch):
    rnd = random.Random(5)
    base = "".join(rnd.choice("abcdé") for _ in range(70))
    words = [base, base[:30] + "z" + base[31:], base + "b", base[:9] + base[10:], base[:65], base[:64], base[:63], base[:5] + "x" + base[5:64]]
    docs = [(k, " ".join(w for i, w in enumerate(words) for _ in range(3 + i * i))) for k in range(3)] + [(k, base * 200) for k in range(4, 8)]
    want = brute_variants(docs)
    assert variants_of(spark, docs) == want and sum(r[4] > 0 for r in want) >= 7
    monkeypatch.setattr(spelling, "PIECE", 10)
    assert variants_of(spark, docs) == want


@settings(max_examples=60, deadline=None)
@given(st.text("ab", min_size=5, max_size=12), st.text("ab", min_size=5, max_size=12), st.sampled_from([0, 7, 64]))
def test_keys_meet_where_words_are_near(a, b, long):
    usual, spelling.LONG = spelling.LONG, long
    try:
        (x, dx, wx), (y, dy, wy) = spelling.spellings(a), spelling.spellings(b)
    finally:
        spelling.LONG = usual
    cuts = lambda w: {w[:k] + w[k + 1 :] for k in range(len(w))}
    replaced = len(a) == len(b) and sum(p != q for p, q in zip(a, b, strict=True)) == 1
    assert (len(set(wx) & set(wy)) == 1) == replaced or a == b
    assert (x == y) == (a == b) and (x in dy) == (a in cuts(b)) and (y in dx) == (b in cuts(a)) and len(dx) == len(cuts(a))


# -- 13


def brute_hits(docs, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = {}
    for name, text in items:
        w = words(text)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add("" if name is None else str(name))
    sizes, out = {len(w) for w in windows}, []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if those := windows.get(tuple(w[k : k + size])):
                    hit |= set(range(k, k + size))
                    found |= those
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def hits_of(spark, docs, items):
    d = spark.createDataFrame([(k, t, "spans", 1) for k, t in docs], "doc_id long, text string, spans string, n_words int")
    i = spark.createDataFrame([(k, t, "x") for k, t in items], "item_id long, text string, name string")
    got = decontaminate.marked(d, i).collect()
    for r in got:
        ends = [x for s in r["spans"] for x in (s["begin"], s["end"])]
        assert ends == sorted(set(ends)) and r["row"]["spans"] == "spans"
    return sorted(((r["row"]["doc_id"], r["n_words"], sum(s["end"] - s["begin"] for s in r["spans"]), r["items"]) for r in got), key=str)


@pytest.mark.parametrize("block", [1 << 21, 60, 7])
def test_hits_of_few_words_in_blocks(spark, monkeypatch, block):
    rnd = random.Random(6)
    text = lambda n: rnd.choice([" ", ", ", "\n"]).join(rnd.choice("ab") + rnd.choice("Cdé") for _ in range(n))
    docs = [(k if k % 8 else None, text(rnd.randint(0, 70))) for k in range(150)] + list(enumerate(ODD))
    docs += docs[:3]
    items = [(k % 9 if k % 7 else None, docs[rnd.randrange(150)][1] if k % 3 else text(rnd.choice([1, 2, 4, 9, 10, 11, 40]))) for k in range(30)]
    items += [(50, None), (51, ""), (52, "!?"), *items[:2]]
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    monkeypatch.setattr(decontaminate, "STRETCH", 16)
    assert hits_of(spark, docs, items) == brute_hits(docs, items)


def test_hits_of_a_table_and_of_empty_ones(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    want = brute_hits(docs, items)
    assert hits_of(spark, docs, items) == want and any(r[2] for r in want)
    assert hits_of(spark, [], items) == [] and hits_of(spark, docs[:5], []) == brute_hits(docs[:5], [])
    assert hits_of(spark, docs[:5], [(1, None)]) == brute_hits(docs[:5], [])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=10, max_size=10), st.lists(st.lists(st.integers(0, 3), max_size=25), min_size=4, max_size=4))
def test_each_shared_window_shares_a_fingerprint(window, around):
    def prints(words):
        h = decontaminate.window_hashes(np.array(words, np.uint64) + np.uint64(1), decontaminate.gram(10))
        return set(h[decontaminate.winnowed(h, 10 - decontaminate.gram(10) + 1)].tolist())

    assert prints(around[0] + window + around[1]) & prints(around[2] + window + around[3])
