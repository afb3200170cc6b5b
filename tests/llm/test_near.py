"""Near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import zstandard
from conftest import prose

from kerbside.llm import common as C
from kerbside.llm import line_dedup, minhash_dedup, neardup, suffix_dedup
from kerbside.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


class Groups(dict):
    def root(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def linked(sets, percent):
    groups, keys = Groups(), sorted(sets)
    for k, i in enumerate(keys):
        groups.root(i)
        for j in keys[:k]:
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                groups.join(i, j)
    return groups


def word_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def check_near(rows, corpus):
    sets = {i: word_set(t) for i, t in corpus}
    groups = linked(sets, 75)
    got = {r["doc_id"]: r for r in rows}
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(s) for i, s in sets.items()}
    assert {i: r["component_id"] for i, r in got.items()} == {i: groups.root(i) for i in sets}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_near_documents(docs, corpus):
    check_near(minhash_dedup.near_duplicates(docs).collect(), corpus)


def test_near_documents_without_lucky_centre(spark):
    # a chain: each text resembles its neighbours only, so stars alone can't join it
    rng = random.Random(3)
    words = [str(rng.random()) for _ in range(400)]
    corpus = [(i, " ".join(words[7 * i : 7 * i + 100])) for i in range(40)]
    check_near(minhash_dedup.near_duplicates(spark.createDataFrame(corpus, "doc_id bigint, text string")).collect(), corpus)


def test_near_documents_edges(spark, empty):
    assert minhash_dedup.near_duplicates(empty).collect() == []
    text = " ".join(map(str, range(30)))
    rows = [(None, text), (5, text), (5, text), (2, text), (9, None)]
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS component_id", "2 AS bits")).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in got) == [(-1, -1, True), (2, 2, True), (5, 2, False), (5, 2, False), (9, 9, True)]


def test_estimate(spark):
    rng = np.random.default_rng(0)
    for share in (0.3, 0.6, 0.9):
        both = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
        n = int(1000 * share)
        sets = [np.sort(np.concatenate((both[:n], rng.integers(0, 1 << 63, 1000 - n).astype(np.uint64)))) for _ in "ab"]
        bits = [neardup.pack_bits(neardup.minima(s, np.array([0, 1000]), neardup.N_BITS))[0].tolist() for s in sets]
        row = spark.createDataFrame([tuple(bits)], "x array<bigint>, y array<bigint>").select(neardup.estimate("x", "y").alias("e")).first()
        assert abs(row["e"] - n / (2000 - n)) < 0.2


def check_lines(rows, corpus):
    occurrences = {}
    for i, t in sorted(corpus):
        for k, line in enumerate((t or "").split("\n")):
            form = line.strip(" \t\n\v\f\r").translate(LOWER)
            if form:
                occurrences.setdefault(form, []).append((i, k))
    forms = sorted(occurrences, key=lambda f: occurrences[f][0])
    groups = linked({k: {f[j : j + line_dedup.SIZE] for j in range(max(1, len(f) - line_dedup.SIZE + 1))} for k, f in enumerate(forms)}, line_dedup.PERCENT)
    gone = {o for k, f in enumerate(forms) for n, o in enumerate(occurrences[f]) if n or groups.root(k) != k}
    texts = dict(corpus)
    for r in rows:
        i = r["doc_id"]
        left = [x for k, x in enumerate((texts[i] or "").split("\n")) if (i, k) not in gone]
        assert r["text"] == (None if texts[i] is None else "\n".join(left)), i
        assert r["n_removed"] == sum(x[0] == i for x in gone)
    assert len(rows) == len(corpus) and gone


def test_lines(docs, corpus):
    check_lines(line_dedup.dedup_lines(docs).collect(), corpus)


def test_lines_edges(spark, empty):
    assert line_dedup.dedup_lines(empty).collect() == []
    line = "the same line of many words in it"
    rows = [(None, line), (3, line), (1, f"{line}\nx\nx"), (2, None)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "7 AS lines", "8 AS z")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == {None: line, 3: "", 1: f"{line}\nx", 2: None}


def check_spans(rows, corpus, length):
    raw = {i: (t or "").encode() for i, t in corpus}
    n = Counter(b[i : i + length] for b in raw.values() for i in range(len(b) - length + 1))
    for r in rows:
        b = raw[r["doc_id"]]
        covered = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if n[b[i : i + length]] > 1:
                covered[i] += 1
                covered[i + length] -= 1
        gone = np.cumsum(covered[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()), r["doc_id"]


def test_spans(docs, corpus):
    rows = suffix_dedup.dedup_spans(docs).collect()
    assert len(rows) == len(corpus) and sum(r["n_removed"] for r in rows) > 5000
    check_spans(rows, corpus, suffix_dedup.LENGTH)


def test_spans_edges(spark, empty):
    assert suffix_dedup.dedup_spans(empty).collect() == []
    text = "".join(map(str, range(150)))
    rows = [(None, text), (None, text[:-1] + "é"), (4, None), (4, "z" * 300), (4, "y" * 300)]
    got = suffix_dedup.dedup_spans(spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS uid", "2 AS part")).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 300, 300, len(text) - 1, len(text) - 1]


def test_long_texts_in_segments(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    data = np.frombuffer(np.random.default_rng(1).integers(97, 123, 3000).astype(np.uint8).tobytes(), np.uint8)
    starts = []
    for low, piece, bounds in suffix_dedup.segments(data, np.array([0, 3000])):
        _, _, first, count = suffix_dedup.anchors(piece, bounds)
        starts += [low + a + i for a, n in zip(first.tolist(), count.tolist(), strict=True) for i in range(n)]
    assert sorted(starts) == list(range(3000 - suffix_dedup.LENGTH + 1))


def test_interval_expansion():
    rng = np.random.default_rng(0)
    for _ in range(60):
        length = int(rng.integers(3, 12))
        strings = [bytes(rng.integers(97, 97 + int(rng.integers(1, 4)), int(rng.integers(0, 40))).astype(np.uint8)) for _ in range(int(rng.integers(1, 12)))]
        n = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        want = [i + length <= len(s) and n[s[i : i + length]] > 1 for s in strings for i in range(len(s))]
        got = suffix_dedup.repeated_starts(np.frombuffer(b"".join(strings), np.uint8), np.concatenate(([0], np.cumsum([len(s) for s in strings]))).astype(np.int64), length)
        assert got.tolist() == want


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(-300, 300), rng.randint(-300, 300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1100)] + [(None, 3), (4, 4)]
    groups = Groups()
    for a, b in edges:
        if a is not None:
            groups.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: groups.root(x) for x in groups if groups.root(x) != x}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_repeated_ids_and_clashing_names(spark):
    """Rows with one doc_id but different texts are told apart, whatever their order; inner names don't clash with the input's."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    for rows in ([(5, a), (5, b), (7, b + " word")], [(5, b), (7, b + " word"), (5, a)], [(7, b + " word"), (5, a), (5, b)]):
        got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)).collect()
        assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False)]
    line, other = "the same line of many words in it", "quite another line that nobody else has got"
    rows = [(1, line), (5, line), (5, other), (5, f"x\n{other} here"), (6, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS gone_id", "2 AS u1", "3 AS lines", "4 AS c0", "5 AS z", "6 AS n_lines")
    got = line_dedup.dedup_lines(df).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_removed"]) for r in got) == [(1, line, 0), (5, "", 1), (5, other, 0), (5, "x", 1), (6, "", 0)]
    assert all((r["gone_id"], r["u1"], r["lines"], r["c0"], r["z"]) == (1, 2, 3, 4, 5) for r in got)


def near_group(n: int, words: int = 120) -> list[tuple[int, str]]:
    """Copies of one text with more and more words put in, so that many resemble the text, some only each other, many none."""
    rng = random.Random(11)
    base = prose(rng, words)
    out = []
    for i in range(n):
        near = list(base)
        for _ in range(rng.randint(0, 14)):
            near.insert(rng.randrange(len(near)), prose(rng, 1)[0] + str(i))
        out.append((i, " ".join(near)))
    return out


@pytest.mark.parametrize("middle", [0, 1024])
def test_one_large_bucket(spark, monkeypatch, middle):
    """2,000 near copies of one text, of which many aren't linked with the centres: exact as brute force finds them, in pairs that don't grow with the square."""
    monkeypatch.setattr(minhash_dedup, "link", lambda *a: neardup.link(*a, middle))
    corpus = near_group(2000)
    sets = [np.sort(np.array([hash(s) for s in word_set(t)])) for _, t in corpus]
    tokens = {t: i for i, t in enumerate(sorted(set(np.concatenate(sets).tolist())))}
    matrix = np.zeros((len(corpus), len(tokens)), np.float32)
    for i, s in enumerate(sets):
        matrix[i, [tokens[t] for t in s.tolist()]] = 1
    inter, size = matrix @ matrix.T, matrix.sum(1)
    groups = Groups()
    for i in range(len(corpus)):
        groups.root(i)
        for j in np.flatnonzero(100 * inter[i, :i] >= 75 * (size[i] + size[:i] - inter[i, :i])).tolist():
            groups.join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in minhash_dedup.near_duplicates(spark.createDataFrame(corpus, "doc_id bigint, text string").repartition(4)).collect()}
    want = {i: groups.root(i) for i, _ in corpus}
    assert got == want and 100 < len(set(want.values())) < 1900


def test_rare_pairs_lose_none(spark):
    """Every pair of unlike components that has the similarity is among the pairs by rarest shingles."""
    rng = random.Random(2)
    corpus = near_group(120, 60) + [(200 + i, " ".join(prose(rng, rng.randint(1, 30)))) for i in range(40)]
    sets = {i: word_set(t) for i, t in corpus}
    opened = spark.createDataFrame([(i, i % 3 == 0, i) for i, _ in corpus], "id bigint, query boolean, component bigint")
    texts = spark.createDataFrame([(i, zstandard.compress(t.encode())) for i, t in corpus], "id bigint, z binary")
    got = {(r["a"], r["b"]) for r in neardup.rare_pairs(opened, texts, lambda data, offsets: C.shingles(data, offsets, 5), 75).collect()}
    similar = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    assert {p for p in similar if p[0] % 3 == 0 or p[1] % 3 == 0} <= got and similar and len(got) < len(corpus) ** 2 / 4


def test_recall_at_the_threshold():
    """Pairs of exactly the least similarity meet in some band as often as the docstrings say."""
    rng = np.random.default_rng(4)
    for bands, rows, similarity, least in ((minhash_dedup.BANDS, minhash_dedup.ROWS, 0.75, 0.998), (line_dedup.BANDS, line_dedup.ROWS, 0.6, 0.98)):
        met = 0
        for _ in range(1000):
            values = rng.integers(0, 1 << 63, 400).astype(np.uint64)
            own = round(400 * (1 - similarity) / 2)
            x = neardup.minima(np.concatenate((values[own:], values[: 400 - own])), np.array([0, 400 - own, 800 - 2 * own]), bands * rows)
            k = neardup.band_keys(x, bands, rows)
            met += bool((k[0] == k[1]).any())
        assert met >= 1000 * least


def test_components_with_hot_nodes(spark):
    """A star of more neighbours than a task should have, tied to others, with its centre in the middle of the ids."""
    rng = random.Random(6)
    edges = [(5000, i) for i in range(3000, 7000)] + [(2000 + i, 3000 + i) for i in range(0, 900, 3)] + [(rng.randrange(1, 900), rng.randrange(1, 900)) for _ in range(300)] + [(1, 2000)]
    groups = Groups()
    for a, b in edges:
        groups.join(a, b)
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {x: groups.root(x) for x in groups if groups.root(x) != x}


def sets_at(rng, n, shared, own):
    """n pairs of sets with so many shared values and so many of each one's own: values and bounds of 2 n rows."""
    rows = []
    for _ in range(n):
        both = rng.integers(0, 1 << 63, shared, dtype=np.uint64)
        rows += [np.concatenate((both, rng.integers(0, 1 << 63, own, dtype=np.uint64))) for _ in range(2)]
    return np.concatenate(rows) << np.uint64(1), np.arange(0, 2 * n + 1) * (shared + own)


@pytest.mark.parametrize(("shared", "own"), [(3, 1), (75, 25), (300, 100)])
def test_marks_of_links_are_alike(shared, own):
    """Sets with a similarity of 0.6, short ones too, keep nearly all pairs; those with 0.1 lose nearly all."""
    rng = np.random.default_rng(shared)
    for a, b, low, high in ((shared, own, 0.997, 1), (2 * own, 9 * own, 0, 0.02)):
        marks = neardup.marks_of(neardup.minima(*sets_at(rng, 4_000, a, b), 75), 5)
        like = neardup.differ(marks[::2], marks[1::2]) <= neardup.most_differ(60)
        assert low <= like.mean() <= high


def test_unlike_members_of_a_bucket_are_no_candidates():
    """Of 300 unlike members only the three alike pairs are proposed and none waits in a large bucket; a clump of 60 does."""
    rng = np.random.default_rng(1)
    own = rng.integers(0, 1 << 63, (300, 100), dtype=np.uint64) << np.uint64(1)
    own[:, :15] = own[0, :15]
    own[[10, 20, 30], :90] = own[[11, 21, 31], :90]
    both = rng.integers(0, 1 << 63, (60, 100), dtype=np.uint64) << np.uint64(1)
    both[:, :90] = both[0, :90]

    def found(rows):
        n = len(rows)
        marks = neardup.marks_of(neardup.minima(rows.ravel(), np.arange(n + 1) * 100, 75), 5)[:, 0]
        return neardup.bucket_pairs(np.zeros(n, np.uint32), np.arange(n), np.zeros(n, bool), 48, marks, neardup.most_differ(60))

    a, b, _, members = found(own)
    assert {(10, 11), (20, 21), (30, 31)} <= set(zip(a.tolist(), b.tolist(), strict=True)) and len(a) < 500 and not len(members)  # of 44,850
    a, b, _, members = found(np.concatenate((own, both)))
    assert sorted(members.tolist()) == list(range(300, 360)) and (10, 11) in set(zip(a.tolist(), b.tolist(), strict=True))
    assert {(300, i) for i in range(301, 360)} <= set(zip(a.tolist(), b.tolist(), strict=True))
