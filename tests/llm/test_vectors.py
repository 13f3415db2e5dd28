"""Vector codes and whitening, against plain numpy over all rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import types as T

from eventfold.llm import vector_codes, whitening
from eventfold.llm.cover_tree import assigned, squared, tree_of

KIND = (
    T.StructType()
    .add("vec_id", "long")
    .add("embedding", T.ArrayType(T.FloatType()))
    .add("label", "integer")
    # names that operators use themselves
    .add("id", "string")
    .add("v", "string")
    .add("error", "string")
    .add("n", "string")
)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "i", "v", "e", "n") for r in rows], KIND)


def some(count=300, width=32):
    rng = np.random.default_rng(8)
    spread = rng.uniform(0.2, 3, width)
    rows = [(int(i), (rng.standard_normal(width) * spread).astype(np.float32).tolist(), int(i % 3)) for i in range(count)]
    copy = rows[5][1]
    rows += [(1000 + i, copy, None) for i in range(150)]  # one vector, many times
    rows += [(7, copy, 1), (7, copy, 1)]  # an id of two vectors, a repeated row
    rows += [(2000, None, 0), (2001, [], 0), (2002, [None] + copy[1:], 0)]
    rows += [(2003, [math.nan] + copy[1:], 0), (2004, [math.inf] + copy[1:], 0)]
    rows += [(None, rows[9][1], 2)]
    return rows


def usable(rows):
    return [r for r in rows if r[1] and all(c is not None and math.isfinite(c) for c in r[1])]


@pytest.fixture(scope="module")
def table(spark):
    return vectors(spark, some()).repartition(5).cache()


def plain_codes(rows, parts=16, entries=64, rounds=2):
    rows = sorted(usable(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.floor(256 * np.array([r[1] for r in rows], np.float64)).astype(np.int64)
    cut = x.reshape(len(x), parts, -1)
    codes, books, error = [], [], 0
    for p in range(parts):
        own, book = cut[:, p], cut[:entries, p].copy()
        for _ in range(rounds):
            to = squared(own, book).argmin(axis=1)
            for k in range(len(book)):
                if (to == k).any():
                    book[k] = own[to == k].sum(axis=0) // (to == k).sum()
        to = squared(own, book).argmin(axis=1)
        error = error + ((own - book[to]) ** 2).sum(axis=1)
        codes.append(to)
        books.append(book)
    shown = ",".join(str(v) for b in books for e in b for v in e)
    of = {}
    for r, e in zip(rows, error):
        of[r[2]] = of.get(r[2], 0) + int(e)
    return sorted(
        (
            (r[0], "".join(f"{c[i]:02x}" for c in codes), int(e), of[r[2]], hashlib.sha256(shown.encode()).hexdigest())
            for i, (r, e) in enumerate(zip(rows, error))
        ),
        key=repr,
    )


@pytest.mark.parametrize("chunk", [4096, 37])
def test_codes(table, monkeypatch, chunk):
    monkeypatch.setattr(vector_codes, "CHUNK", chunk)
    got = vector_codes.code_rows(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(some())


def test_labels_too_many_to_broadcast(table, monkeypatch):
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert sorted((tuple(r) for r in vector_codes.code_rows(table).collect()), key=repr) == plain_codes(some())


def test_few_and_no_vectors(spark):
    few = some()[:3]
    got = vector_codes.code_rows(vectors(spark, few)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_codes(few)
    for none in ([], [(1, None, 1)]):
        assert vector_codes.code_rows(vectors(spark, none)).collect() == []
        assert whitening.whitening_rows(vectors(spark, none)).collect() == []


def test_codes_decode_to_near_vectors(table):
    found, books = vector_codes.compressed(table)
    known = {r[0]: r[1] for r in usable(some()) if r[0] != 7}
    for r in found.collect():
        if r.id in known:
            off = np.floor(256 * np.array(known[r.id], np.float64)) - 256 * vector_codes.decoded(bytes(r.code), books)
            assert int((off * off).sum()) == r.error


def test_widths_that_do_not_fit(spark):
    with pytest.raises(Exception, match="cannot be cut"):
        vector_codes.code_rows(vectors(spark, [(1, [0.5] * 10, 1)])).collect()
    with pytest.raises(Exception, match="different widths"):
        whitening.whitening_rows(vectors(spark, [(1, [0.5] * 10, 1), (2, [0.5] * 9, 1)]).coalesce(1)).collect()


@pytest.mark.parametrize("copies", [1, 50])
@pytest.mark.parametrize("width", [1, 2, 4, 9])
def test_trees_assign_as_comparing_all(width, copies):
    rng = np.random.default_rng(width)
    points = rng.integers(-30, 30, (600, width))
    points = np.concatenate([points, np.repeat(points[:3], copies, axis=0)])
    tree = tree_of(points)
    for book in (points[:64], points[:1], np.repeat(points[:2], 3, axis=0), points[:40] * 9):
        to, counts, sums, compared = assigned(tree, book)
        want = squared(points, book).argmin(axis=1)
        assert (to == want).all()
        assert (counts == np.bincount(want, minlength=len(book))).all()
        assert all((sums[k] == points[want == k].sum(axis=0)).all() for k in range(len(book)))
        assert compared <= len(points)
    # far apart clusters are assigned as whole subtrees
    far = np.concatenate([points, points + 10_000])
    assert assigned(tree_of(far), np.stack([points[0], points[0] + 10_000]))[3] == 0
    assert (tree.radius[tree.first == tree.last] == 0).any()


def test_tree_covers_and_separates():
    points = np.random.default_rng(3).integers(-500, 500, (700, 3))
    tree = tree_of(points)
    for i in range(len(tree.low)):
        own = tree.points[tree.low[i] : tree.high[i]]
        assert np.sqrt(((own - tree.centre[i]) ** 2).sum(axis=1)).max() <= tree.radius[i] * (1 + 1e-12)
        kids = range(tree.first[i], tree.last[i])
        assert all(2 * tree.radius[k] <= tree.radius[i] * (1 + 1e-12) for k in kids)
        heads = tree.centre[list(kids)]
        if len(heads) > 1:
            apart = squared(heads, heads) + np.eye(len(heads), dtype=np.int64) * 10**9
            assert 2 * np.sqrt(apart.min()) > tree.radius[i]
            assert tree.low[tree.first[i]] == tree.low[i] and tree.high[tree.last[i] - 1] == tree.high[i]


def plain_whitening(rows, most=8):
    rows = usable(rows)
    x = np.floor(1024 * np.array([r[1] for r in rows], np.float64)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    v = d.T @ d / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    deviation = [sum(int(a) ** 2 for a in row) for row in (n * x - s).tolist()]
    return rows, n, deviation, d @ u / np.sqrt(e), e / np.trace(v)


def checked(got, rows, most):
    rows, n, deviation, whitened, explained = plain_whitening(rows, most)
    for c in range(len(explained)):
        own = sorted(((r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1), key=lambda t: repr(t[:2]))
        want = sorted(((r[0], d, w) for r, d, w in zip(rows, deviation, whitened[:, c])), key=lambda t: repr(t[:2]))
        assert [t[:2] for t in own] == [t[:2] for t in want]
        a, b = (np.array([t[2] for t in x]) for x in (own, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-8
        assert all(abs(r.explained / explained[c] - 1) < 1e-10 for r in got if r.component == c + 1)
    assert {r.n for r in got} == {n}
    assert max(r.identity_error for r in got) < 1e-10


def test_whitening(table):
    got = whitening.whitening_rows(table).collect()
    assert len(got) == 8 * len(usable(some()))
    checked(got, some(), 8)


def test_whitening_of_fewer_dimensions(spark):
    rows = [(i, [float(i % 5), float(i * i % 7) * 9], 0) for i in range(40)]
    got = whitening.whitening_rows(vectors(spark, rows)).collect()
    assert len(got) == 80
    checked(got, rows, 8)


def test_whitening_without_variance(spark):
    got = whitening.whitening_rows(vectors(spark, [(1, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)])).collect()
    assert {(r.whitened, r.explained, r.identity_error, r.deviation) for r in got} == {(0.0, 0.0, 0.0, 0)}
    assert len(got) == 4


def test_large_deviations_are_exact():
    n, x = 4_000_000_000, np.array([[3_000_000, 1], [5, 7]])
    model = whitening.Whitening(n, np.array([100_000, 3]), np.ones(1), np.ones((2, 1)), 2.0)
    want = [sum((n * a - s) ** 2 for a, s in zip(row, (100_000, 3))) for row in x.tolist()]
    assert [int(d) for d in whitening._exact(x, model).to_pylist()] == want


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["spread", "clusters", "rank", "equal", "zero"])
def test_components_by_projectors(n, kind):
    rng = np.random.default_rng(n)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    e = {
        "spread": np.exp(rng.uniform(-9, 9, n)),
        "clusters": np.where(np.arange(n) % 3 == 0, 7.0, 1.0),
        "rank": np.where(np.arange(n) < 3, 5.0 + np.arange(n), 0.0),
        "equal": np.ones(n),
        "zero": np.zeros(n),
    }[kind]
    a = (q * e) @ q.T
    a = (a + a.T) / 2
    values, vectors = whitening.components(a, 8)
    size = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.sort(e)[::-1][:8]).max() <= 1e-13 * size
    assert np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-13


def test_polar_factor_is_the_sign():
    rng = np.random.default_rng(2)
    q, _ = np.linalg.qr(rng.standard_normal((20, 20)))
    e = np.concatenate([np.geomspace(1e-10, 1, 12), -np.geomspace(1e-9, 5, 8)])
    assert np.abs(whitening.polar((q * e) @ q.T) - (q * np.sign(e)) @ q.T).max() < 1e-5
