"""Jaccard join, suffix dedup, fingerprints and components against brute force."""

import hashlib
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventfold.llm import fingerprints, jaccard, suffixes
from eventfold.llm.components import components
from nasty import documents, plain, sentence, texts


def shingles(text, words):
    split = (text or "").encode().lower().split()
    return {tuple(split[k : k + words]) for k in range(max(1, len(split) - words + 1))} if split else set()


def brute_components(rows, words, percent):
    sets = [shingles(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if a and b and 100 * both >= percent * (len(a) + len(b) - both):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)].append(doc_id)
    return [
        (doc_id, len(sets[i]), min(least[root(i)], default=None) if sets[i] else doc_id)
        for i, (doc_id, _) in enumerate(rows)
    ]


def linked(docs, words, percent):
    return plain(jaccard.linked(docs, words, percent).drop("kid", "kth", "label").collect())


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (1, 50)])
def test_links_are_all_found(docs, words, percent):
    assert linked(docs, words, percent) == plain(brute_components(texts(), words, percent))


def near_copies(rng, n):
    """Chains, groups around one text, and a passage that all share."""
    passage, rows, last = sentence(rng, 25), [], sentence(rng, 70).split()
    centre = last[:]
    for i in range(n):
        kind = rng.randrange(4)
        if kind == 0:
            last = last[:]  # a step further from the last one
            last[rng.randrange(len(last))] = f"n{i}"
            rows.append((i, " ".join(last)))
        elif kind == 1:
            own = centre[:]
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"m{i}"
            rows.append((i, " ".join(own)))
        elif kind == 2:
            rows.append((i, passage + " " + sentence(rng, rng.randrange(1, 60))))
        else:
            rows.append((i, sentence(rng, rng.randrange(1, 8), start=rng.randrange(3))))
    return rows


@pytest.mark.parametrize(("frequent", "at_once", "partners"), [(262_144, 4_000_000, 256), (3, 200, 2)])
def test_links_of_groups_and_chains(spark, monkeypatch, frequent, at_once, partners):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "COUNTED_AT_ONCE", at_once)
    monkeypatch.setattr(jaccard, "PARTNERS", partners)
    rows = near_copies(random.Random(6), 160)
    docs = documents(spark, rows).repartition(4)
    assert linked(docs, 4, 85) == plain(brute_components(rows, 4, 85))


def test_one_of_each_component_stays(docs):
    stay = jaccard.one_of_each(docs, 5, 80)
    assert stay.columns == docs.columns
    found = Counter((r.doc_id, r.text) for r in stay.collect())
    best = {}
    for (doc_id, text), (_, n, component) in zip(texts(), brute_components(texts(), 5, 80)):
        # two texts have the id 23, and are components of their own
        key = (component, text if component == 23 else "") if n else object()
        best.setdefault(key, []).append((doc_id, text))
    assert sum(found.values()) == len(best)
    for group in best.values():
        ids = [i for i, _ in group if i is not None]
        assert any(found[g] for g in group if not ids or g[0] == min(ids))


def test_a_prefix_is_long_enough():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randrange(2, 60)
        a = np.array(sorted(rng.sample(range(200), n)), np.uint64)
        b = np.array(sorted({*rng.sample(a.tolist(), max(1, n - rng.randrange(4))), rng.randrange(200)}), np.uint64)
        both = len(np.intersect1d(a, b))
        if len(a) != len(b) or (a != b).any():
            if 100 * both >= 85 * (len(a) + len(b) - both):
                often = np.array(sorted(rng.sample(range(200), 30)), np.uint64)
                place = np.array(rng.sample(range(1, 31), 30), np.int64)
                parts = [jaccard.prefix(x, often, place, 85) for x in (a, b)]
                assert len(np.intersect1d(*parts)) >= min(2, both)


def brute_spans(rows, length):
    data = [(t or "").encode() for _, t in rows]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = []
    for (doc_id, _), d in zip(rows, data):
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = []
        for i, x in enumerate(gone):
            if x and (not i or not gone[i - 1]):
                spans.append([i, i])
            if x:
                spans[-1][1] = i + 1
        out.append((doc_id, len(d), repr(spans), bytes(b for b, x in zip(d, gone) if not x)))
    return out


@pytest.mark.parametrize(("length", "hot"), [(400, 4096), (400, 2), (64, 4096), (64, 2), (100, 30)])
def test_repeated_bytes_are_cut(docs, length, hot):
    got = suffixes.without_repeats(docs, length, hot_from=hot).collect()
    spans = [(r.doc_id, r.n_bytes, repr([[s.b, s.e] for s in r.spans]), bytes(r.kept)) for r in got]
    assert plain(spans) == plain(brute_spans(texts(), length))


def test_slices_and_chunks_do_not_matter(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 97)
    monkeypatch.setattr(suffixes, "SORTED_AT_ONCE", 50)
    monkeypatch.setattr(suffixes, "GIVEN_AT_ONCE", 3)
    monkeypatch.setattr(suffixes, "WINDOWS_AT_ONCE", 150)
    monkeypatch.setattr(suffixes, "WINDOWS_OF_PART", 100)
    for hot in (4096, 2):
        got = suffixes.without_repeats(docs, 100, hot_from=hot).collect()
        spans = [(r.doc_id, r.n_bytes, repr([[s.b, s.e] for s in r.spans]), bytes(r.kept)) for r in got]
        assert plain(spans) == plain(brute_spans(texts(), 100))


def test_many_equal_rows_take_no_square_of_them(spark):
    """Spans of rows that repeat each other meet as a set, not once for each row."""
    text = sentence(random.Random(6), 400)
    docs = documents(spark, [(1, text)] * 3000 + [(2, text[:500])])
    began = time.time()
    rows = suffixes.without_repeats(docs, 400).select("doc_id", "n_bytes", "kept").collect()
    assert len(rows) == 3001 and all(bytes(r.kept) == b"" for r in rows)
    assert time.time() - began < 120


def test_words_kept_are_bounded():
    hashes = fingerprints.WordHashes()
    words = [b"x" * n for n in (1, 64, 65, 10_000)]
    first = [hashes[w] for w in words]
    assert [hashes[w] for w in words] == first and set(hashes) == set(words[:2])


def test_windows_share_their_anchor_wherever_they_are():
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 100, 300, dtype=np.uint8).tobytes()
    found = set()
    for before in (0, 17, 500):
        data = rng.integers(97, 123, before, dtype=np.uint8).tobytes() + passage
        at = before + 50
        for first, last, anchor, gram in suffixes.segments(data, 120):
            k = np.flatnonzero((first <= at) & (at <= last))
            found |= {(int(anchor[i]) - at, int(gram[i])) for i in k}
    assert len(found) == 1


def test_whole_rows_are_carried(docs):
    got = suffixes.without_repeats(docs, 100, with_row=True)
    assert set(got.select("row.*").columns) == set(docs.columns) - {"text"}
    assert got.count() == len(texts())


def test_edited_texts_and_sketches(spark):
    rows = [(i, t) for i, t in {r[0]: r for r in texts()}.values() if i is not None]
    got = {r.doc_id: r for r in fingerprints.fingerprints(documents(spark, rows).repartition(5)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    own = {i: set(_sketch(t or "")) for i, t in rows}
    for k, (doc_id, text) in enumerate(order):
        next_id, following = order[(k + 1) % len(order)]
        text, following, r = text or "", following or "", got[doc_id]
        edited = text[: len(text) - len(text) // 3] + following[: len(text) // 3]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == _shown(own[doc_id])
        assert r.edited_fingerprint == _shown(set(_sketch(edited)))
        assert r.near_next == _share(own[doc_id], own[next_id])
        assert r.near_edited == _share(own[doc_id], set(_sketch(edited)))


def _sketch(text):
    hashes = fingerprints.shingle_hashes(text.encode(), fingerprints.WordHashes()).tolist()
    return [h for h in hashes if h < 2**62] or ([min(hashes)] if hashes else [])


def _shown(hashes):
    return "".join(f"{h:016x}" for h in sorted(hashes))


def _share(a, b):
    return len(a & b) / len(a) if a else float(not b)


def test_repeated_and_null_ids_each_have_a_row(docs):
    got = fingerprints.fingerprints(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in texts())


def test_sketches_merge():
    hashes = fingerprints.WordHashes()
    rng = random.Random(9)
    a, b = sentence(rng, 300).encode(), sentence(rng, 40).encode()
    one, two = (fingerprints.shingle_hashes(x, hashes) for x in (a, b))
    both = fingerprints.merged(fingerprints.sketch(one), fingerprints.sketch(two))
    assert (both == fingerprints.sketch(np.concatenate([one, two]))).all()


def test_containment_of_unequal_texts():
    hashes = fingerprints.WordHashes()
    rng = random.Random(9)
    large = sentence(rng, 5000)
    part = " ".join(large.split()[1000:1200])
    one, two = (fingerprints.sketch(fingerprints.shingle_hashes(t.encode(), hashes)) for t in (part, large))
    assert fingerprints.containment(one, two) == 1.0
    assert fingerprints.containment(two, one) < 0.1


def test_components_of_paths_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 150)] + [(300, 300), (7, 6)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 150)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_a_long_path_in_no_order(spark, seed):
    rng = random.Random(seed)
    path = rng.sample(range(100_000), 4_000)
    edges = [rng.sample(pair, 2) for pair in zip(path, path[1:])]
    other = rng.sample(range(100_000, 200_000), 800)
    edges += [(other[rng.randrange(i)], other[i]) for i in range(1, 800)]
    rng.shuffle(edges)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: min(path) for i in path} | {i: min(other) for i in other}


def test_components_without_links(spark):
    links = spark.createDataFrame([(3, 3)], "a long, b long")
    assert components(links).columns == ["node", "label"]
    assert components(links).count() == components(links.limit(0)).count() == 0


def test_empty_tables(no_docs):
    assert jaccard.linked(no_docs, 4, 85).count() == 0
    assert jaccard.one_of_each(no_docs, 4, 85).count() == 0
    assert suffixes.without_repeats(no_docs, 400).count() == 0
    assert fingerprints.fingerprints(no_docs).count() == 0
