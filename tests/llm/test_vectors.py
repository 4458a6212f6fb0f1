"""Fill-in-middle, whitening and top-k search against brute force, on hard rows and on the small test data."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import TESTDATA
from runwise.llm import fim, topk, whitening
from runwise.llm.queries import QUERIES

# columns whose names operators use inside
CLASH = "vec_id bigint, embedding array<double>, x int, row int, length int, n int, block int, top int, score int, Rank int, part int, data int, q_row int"
EXTRA = tuple(range(11))


def _frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], CLASH).repartition(parts)


def _whole(rows, factor):
    """(id, integer vector) of the rows that take part, all of one length."""
    good = [(i, [math.floor(e * factor) for e in v]) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    size = max((len(v) for _, v in good), default=0)
    return [(i, v + [0] * (size - len(v))) for i, v in good]


ODD = [(1, None), (2, [0.5, None, 1.0]), (3, [float("nan"), 0.0, 1.0]), (4, [float("inf"), 0.0, 1.0]), (5, []), (6, [0.25]), (None, [0.5, 0.5, 0.5])]


def _draws(seed, n, size, scale=1.0):
    r = random.Random(seed)
    return [[r.gauss(0, scale) for _ in range(size)] for _ in range(n)]


HARD = ODD + [(i, v) for i, v in enumerate(_draws(3, 60, 5), 10)] + [(20, _draws(3, 60, 5)[0])] * 3 + [(100 + i, [3.0, -3.0, 1.0, 0.0, 9.0]) for i in range(40)] + [(0, [-0.001, 0.0, 0.0, -0.0, 0.001])]


# --- fill-in-middle ------------------------------------------------------------------------------

TEXTS = [None, "", "a", "\n", "\n\n\n", "one\ntwo\nthree", "é\nü\n\n日本\n" * 7, "has <P> inside", "<S>", "a<\nM>\n<", "x" * 300_000 + "\n" + "y\n" * 5000, "\r\n \x1c z"]


def _expected(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    out = f"<S>{s}<P>{p}<M>{m}" if h[3] % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, len(units), "spm" if h[3] % 100 < spm else "psm", len(p), len(m), out


@pytest.mark.parametrize("percent, spm", [(100, 50), (40, 0), (100, 100), (0, 50)])
def test_fim_hard_rows(spark, percent, spm):
    rows = [(i, t) for i in (None, 1, 2, 3, 4, 77) for t in TEXTS] + [(5, TEXTS[6])] * 2
    df = spark.createDataFrame([(i, t, 1, "z", "q") for i, t in rows], "doc_id bigint, text string, n int, form string, Output string").repartition(3)
    out = fim.fill_in_middle(df, percent=percent, spm_percent=spm)
    found = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple((x is not None, x or 0) for x in r[:5]) + (r[5],)
    assert sorted((tuple(r[:6]) for r in found), key=key) == sorted((_expected(i, t, percent, spm) for i, t in rows), key=key)
    assert sorted(r["back"] for r in found) == sorted(t or "" for _, t in rows)


def test_fim_restores_all_texts(spark):
    found = QUERIES["op11_fill_in_middle"](spark, TESTDATA).collect()
    t = pq.read_table(f"{TESTDATA}/documents.parquet")
    texts = dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert len(found) == t.num_rows
    assert all(r["restored_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest() for r in found)
    assert {r["form"] for r in found} >= {"psm", "spm"}


def test_fim_empty_table_and_sentinels(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert fim.fill_in_middle(none).collect() == []
    assert none.select(fim.restored(F.col("text"), F.col("text"))).collect() == []
    for marks in (("a", "a", "b"), ("<", "<S", "<M"), ("<P<", "[S]", "{M}"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinels"):
            fim.fill_in_middle(none, sentinels=marks)
    own = spark.createDataFrame([(i, "[[pre\n[pre]] x\n]\n") for i in range(8)], "doc_id bigint, text string")
    out = fim.fill_in_middle(own, sentinels=("[pre]", "{suf}", "(mid)"))
    assert {r[0] for r in out.select("form").collect()} == {"plain"}
    out = fim.fill_in_middle(own, sentinels=("~pre", "{suf}", "(mid)"))
    back = out.select(fim.restored(F.col("output"), F.col("form"), ("~pre", "{suf}", "(mid)"))).collect()
    assert {r[0] for r in back} == {"[[pre\n[pre]] x\n]\n"} and "plain" not in {r[0] for r in out.select("form").collect()}


def test_rotation_is_its_own_inverse():
    r = random.Random(1)
    for _ in range(200):
        data = bytearray(r.randbytes(r.randint(0, 40)))
        a, b, c = sorted(r.randint(0, len(data)) for _ in range(3))
        want = bytes(data[:a] + data[b:c] + data[a:b] + data[c:])
        before = bytes(data)
        fim.rotate(data, a, b, c)
        assert bytes(data) == want
        fim.rotate(data, a, a + c - b, c)
        assert bytes(data) == before


# --- whitening -----------------------------------------------------------------------------------

def _check_whitening(rows, found, components=4, factor=256):
    good = _whole(rows, factor)
    x = np.array(sorted(set(tuple(v) for _, v in good)), float)
    n, sums = len(x), [int(s) for s in x.sum(0)]
    c = x - x.sum(0) / n
    e, vectors = np.linalg.eigh(c.T @ c / n)
    e, vectors = e[::-1], vectors[:, ::-1]
    kept = [k for k in range(min(components, len(e))) if e[k] > 1e-12 * e.sum()]
    assert len(found) == len(good) * len(kept)
    for k in kept:
        mine = [r for r in found if r["component"] == k + 1]
        want = [(i if i is not None else -1, tuple(v), float((np.array(v) - x.sum(0) / n) @ vectors[:, k] / e[k] ** 0.5)) for i, v in good]
        got = [(r["vec_id"] if r["vec_id"] is not None else -1, r["deviation"], r["whitened"]) for r in mine]
        far = [(i, sum((n * p - s) ** 2 for p, s in zip(v, sums)), w) for i, v, w in want]
        for sign in (1, -1):
            a = sorted((i, int(d), round(w, 7) + 0.0) for i, d, w in got)
            b = sorted((i, d, round(sign * w, 7) + 0.0) for i, d, w in far)
            if all(p[:2] == q[:2] and abs(p[2] - q[2]) < 1e-6 for p, q in zip(a, b)):
                break
        else:
            raise AssertionError(f"component {k + 1} differs")
        assert all(r["n"] == n and abs(r["explained"] / (e[k] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in mine)


def test_whitening_hard_rows(spark):
    _check_whitening(HARD, whitening.whiten(_frame(spark, HARD)).collect())


@pytest.mark.parametrize("components", [1, 9])
def test_whitening_of_few_directions(spark, components):
    """Rows of rank three in eight dimensions, copied over and over."""
    r = random.Random(5)
    base = [[r.randint(-4, 4) for _ in range(8)] for _ in range(3)]
    rows = [(i, [float(sum(w * b[j] for w, b in zip(ws, base))) for j in range(8)]) for i, ws in enumerate([[r.randint(-9, 9) * k for k in (1, 2, 5)] for _ in range(50)] * 3)]
    _check_whitening(rows, whitening.whiten(_frame(spark, rows), components=components).collect(), components)


def test_whitening_of_equal_variances(spark):
    """The corners of a cross: every direction has the same variance, which one Krylov space would not show."""
    rows = [(2 * d + s, [float((-1) ** s) if j == d else 0.0 for j in range(6)]) for d in range(6) for s in range(2)]
    found = whitening.whiten(_frame(spark, rows), components=6).collect()
    assert len(found) == 72
    assert all(abs(r["explained"] - 1 / 6) < 1e-12 and r["identity_error"] < 1e-12 for r in found)
    w = {(r["vec_id"], r["component"]): r["whitened"] for r in found}
    assert all(abs(sum(w[i, k] ** 2 for k in range(1, 7)) - 6) < 1e-9 for i in range(12))


def test_whitening_of_the_small_table(spark):
    t = pq.read_table(f"{TESTDATA}/embeddings.parquet")
    rows = list(zip(t["vec_id"].to_pylist(), t["embedding"].to_pylist()))
    _check_whitening(rows, QUERIES["op12_embedding_whitening"](spark, TESTDATA).collect())


def test_bidiagonal_form():
    r = np.random.default_rng(2)
    x = r.standard_normal((40, 7)) * [1, 1, 1e-3, 1e3, 1, 0, 1e-6]
    V, B = whitening.bidiagonalise(lambda a, A: (x.T @ (x @ a), (x @ A).T @ (x @ a), (x @ a) @ (x @ a)), 7, np.linalg.norm(x))
    assert np.allclose(V.T @ V, np.eye(7), atol=1e-13)
    assert np.allclose(B, np.triu(B) - np.triu(B, 2))
    assert np.allclose(np.linalg.svd(B)[1], np.linalg.svd(x)[1], rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("rows", [[], ODD[:4], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, []), (2, [])]])
def test_whitening_without_variance(spark, rows):
    assert whitening.whiten(_frame(spark, rows)).collect() == []


# --- top-k search --------------------------------------------------------------------------------

def _best(rows, asked, k=20, factor=64):
    good = list(enumerate(_whole(rows, factor)))
    out = []
    for q, (i, v) in good:
        if i is None or not asked(i):
            continue
        scores = sorted((-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for c, (j, w) in good if c != q)
        out += [(i, n, None if none else j, -s) for n, (s, none, j) in enumerate(scores[:k], 1)]
    return sorted(map(repr, out))


def _found(df):
    assert df.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 20, 500])
def test_search_hard_rows(spark, k):
    assert _found(topk.top_products(_frame(spark, HARD), F.col("vec_id") % 5 == 0, k)) == _best(HARD, lambda i: i % 5 == 0, k)


@pytest.mark.parametrize("seed, scale", [(1, 0.0), (2, 1.0), (3, 4.0)])
def test_search_in_many_blocks(spark, monkeypatch, seed, scale):
    """Vectors of few main axes and of very different lengths, so that bounds drop most; a third are copies."""
    for name, n in (("CANDIDATES", 19), ("WAVE", 3), ("QUERIES", 11), ("CANDIDATES_AT_ONCE", 10), ("QUERIES_AT_ONCE", 4)):
        monkeypatch.setattr(topk, name, n)
    r = random.Random(seed)
    rows = [(i, [r.gauss(0, 1) * math.exp(scale * length) / (j + 1) ** 2 for j in range(12)]) for i, length in enumerate(r.random() for _ in range(300))]
    rows += [(1000 + i, rows[0][1]) for i in range(150)]
    assert _found(topk.top_products(_frame(spark, rows, 5), F.col("vec_id") % 20 == 0)) == _best(rows, lambda i: i % 20 == 0)


def test_bounds_drop_no_candidate_and_spare_products(monkeypatch):
    r = np.random.default_rng(4)
    x = (r.standard_normal((4000, 16)) * 400 / np.arange(1, 17) ** 2).astype(np.int64)
    x = x[np.argsort(-(x * x).sum(1))]
    axes = np.linalg.eigh((x.T @ x).astype(float))[1][:, ::-1]
    seen = []
    products = topk._products
    monkeypatch.setattr(topk, "_products", lambda q, c, most: seen.append(len(q) * len(c)) or products(q, c, most))
    all_, q = topk.Side(x, axes, [4, 8]), topk.Side(x[::40], axes, [4, 8])
    at, best = topk.best_of(q, np.arange(0, 4000, 40), np.full(100, topk._NONE), all_, np.arange(4000), np.arange(4000), 5, [4, 8])
    scores = q.x @ x.T
    scores[np.arange(100), np.arange(0, 4000, 40)] = topk._NONE
    assert (np.sort(best, 1) == np.sort(scores, 1)[:, -5:]).all()
    assert sum(seen) < 0.5 * scores.size


def test_search_of_large_numbers():
    """Scores beyond the integers that floating point and a combined order hold."""
    x = np.array([[1 << 30, 3], [1 << 30, 2], [-(1 << 30), 1], [1 << 30, 3]], np.int64)
    s = topk.Side(x, np.eye(2), [1])
    at, best = topk.best_of(s, np.arange(4), np.full(4, topk._NONE), s, np.arange(4), np.arange(4), 2, [1])
    assert sorted(zip(best[0].tolist(), at[0].tolist())) == [((1 << 60) + 6, 1), ((1 << 60) + 9, 3)]


@pytest.mark.parametrize("rows", [[], ODD[:4], [(0, [1.0, 2.0])], [(5, [1.0]), (7, [2.0])]])
def test_search_without_pairs(spark, rows):
    assert topk.top_products(_frame(spark, rows), F.col("vec_id") % 20 == 0).collect() == []
