"""Ball trees, source divergence and best-fit packing against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from kerbside.llm import ball_tree, best_fit, divergence, registry
from kerbside.llm import terms as T

tokenizers_of = pytest.importorskip("public_tokenizers")
LOWER = {i: i + 32 for i in range(65, 91)}
LETTERS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
TERMS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TABLE = "doc_id bigint, text string, lang string, source string"


def words(text, pattern):
    return pattern.findall((text or "").translate(LOWER))


@pytest.mark.parametrize(("kind", "pattern"), [(T.LETTERS, LETTERS), (T.LETTERS_DIGITS, TERMS)])
def test_terms(corpus, kind, pattern):
    texts = [t or "" for _, t in corpus] + ["a1b ÉÀx\x00y日本9", "", "9", "Z[z`{é}"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    found, bounds = T.terms(data, np.cumsum([0, *(len(t.encode()) for t in texts)]), kind)
    found = [x.decode() for x in found.to_pylist()]
    assert [found[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [words(t, pattern) for t in texts]
    assert T.terms(np.zeros(0, np.uint8), np.zeros(3, np.int64), kind)[1].tolist() == [0, 0, 0]


# --- 11


def brute_ranks(rows, items, k=10):
    texts = [(i, words(t, TERMS)) for i, t in rows]
    n, length = sum(bool(w) for _, w in texts), sum(len(w) for _, w in texts)
    df = Counter(t for _, w in texts for t in set(w))
    out = []
    for item, text in items:
        asked, found = Counter(words(text, TERMS)), []
        for i, w in texts:
            tf, m = Counter(w), 25 + 75 * len(w) * n // length if length else 0
            score = sum(c * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m)) for t, c in asked.items() if tf[t])
            if score and i is not None:
                found.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def ranks(df):
    return sorted(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def test_ball_tree(spark, docs, corpus, empty, monkeypatch):
    items = [(i, t) for i, t in corpus if i % 7 == 0] + [(900, "th er on an"), (901, "nowhere"), (902, None), (903, "x" * 900)]
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    want = brute_ranks(corpus, items)
    assert len(want) > 100 and ranks(ball_tree.search(docs.selectExpr("*", "1 AS score", "2 AS rank", "3 AS term"), asked)) == want
    monkeypatch.setattr(ball_tree, "BLOCK_BYTES", 2000)  # an item is scored as it is without the others
    assert ranks(ball_tree.search(docs, asked)) == want
    assert ranks(ball_tree.search(docs, asked, 3)) == [r for r in want if r[1] <= 3]
    assert ball_tree.search(empty, asked).collect() == [] and ball_tree.search(docs, asked.limit(0)).collect() == []


def test_ball_tree_ties_and_null_ids(spark):
    rows = [(5, "a b"), (3, "a b"), (3, "a b"), (None, "a b"), (9, "b a"), (1, "c c c"), (2, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = [(1, "a a B"), (None, "c")]
    got = ball_tree.search(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert sorted((r["item_id"] or 0, r["rank"], r["doc_id"], r["score"]) for r in got) == sorted((i or 0, *x) for i, *x in brute_ranks(rows, [(1, "a a B"), (0, "c")]))


def test_tree_opens_few_leaves_and_misses_none():
    """Vectors in tight groups: bounds hold, and balls far from the item stay shut."""
    rng = np.random.default_rng(3)
    n, terms = 2000, 400
    group = rng.integers(0, 20, n)
    rows = [np.sort(rng.choice(20, 8, replace=False)) + 20 * g for g in group]
    size, term = np.array([len(r) for r in rows]), np.concatenate(rows)
    value = rng.integers(1, 10**6, len(term))
    tree = ball_tree.Tree(np.arange(n), size, term, value, terms)
    opened = []
    dense = np.zeros((n, terms), np.int64)
    dense[np.repeat(np.arange(n), size), term] = value
    for q in range(20):
        asked = np.arange(20) + 20 * q
        weight = rng.integers(1, 20000, 20)
        scores, ids = tree.search(asked, weight, 10, (np.zeros(0, np.int64), np.zeros(0, np.int64)), np.zeros(terms, np.int64))
        want = dense[:, asked] @ weight
        order = np.lexsort((np.arange(n), -want))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()
        limits, where = tree.limits(asked, weight.astype(float)), np.empty(n, np.int64)
        where[tree.ids] = np.arange(n)
        for node, (low, high) in enumerate(zip(tree.low, tree.high, strict=True)):
            assert want[tree.ids[low:high]].max() <= limits[node]
        opened.append(sum(not c and limits[x] >= scores[-1] for x, c in enumerate(tree.child)))
    assert np.mean(opened) < sum(not c for c in tree.child) / 4


# --- 12


def brute_divergence(rows, least=3, top=200):
    rows = [(lang or "", source or "", words(t, LETTERS)) for t, lang, source in rows]
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, w in rows:
        groups[lang].add(source)
        docs[lang].update(set(w))
        count[lang, source].update(w)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = {s: [1 + 10**9 * (count[lang, s][t] + 1) // (sum(count[lang, s][x] for x in kept) + len(kept)) for t in kept] for s in sources}
        total = [sum(count[lang, s][t] for s in sources) for t in kept]
        whole = [1 + 10**9 * (n + 1) // (sum(total) + len(kept)) for n in total]
        f = lambda p, q: (p - q) * (p - q) // q
        for s in sources:
            pairs = [(-sum(map(f, share[s], share[o])), o) for o in sources if o != s]
            own = [(-f(p, q), t) for p, q, t in zip(share[s], whole, kept, strict=True) if p > q and count[lang, s][t]]
            for part, found in (("pair", sorted(pairs, key=lambda x: (x[0], x[1].encode()))), ("term", sorted(own, key=lambda x: (x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, -v, r + 1) for r, (v, item) in enumerate(found)]
    return sorted(out)


def audited(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_divergence(spark, docs, corpus, empty, monkeypatch):
    rows = [(t, None if i % 5 == 0 else "en", f"src{i % 3}") for i, t in corpus]
    want = brute_divergence(rows)
    clashing = docs.selectExpr("*", "1 AS term", "2 AS n", "3 AS block", "4 AS item")
    assert {r[2] for r in want} == {"pair", "term"} and audited(divergence.audit(clashing)) == want
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "TILE", 2)
    assert audited(divergence.audit(docs)) == want
    assert divergence.audit(empty).collect() == []


def test_divergence_of_groups_without_terms(spark):
    rows = [("a b", "x", "s"), ("a b", "x", "t"), ("b A", "x", "t"), (None, "x", None), ("12", "x", "u"), ("q", "y", "s"), (None, "y", "t"), ("z", "w", "s"), ("b b b é é", "x", "t"), ("É a", "x", "t")]
    got = divergence.audit(spark.createDataFrame([(None, *r) for r in rows], TABLE))
    want = brute_divergence(rows)
    assert ("y", "s", "pair", "t", 0, 1) in want and audited(got) == want


def test_gallop():
    rng = np.random.default_rng(1)
    for n, m in ((0, 5), (5, 0), (1, 1), (300, 5000), (5000, 40), (700, 700)):
        a, b = (np.unique(rng.integers(0, 9000, k)) for k in (n, m))
        assert divergence.gallop(a, b).tolist() == np.searchsorted(b, a).tolist()
        mine, theirs = divergence.overlap(a, b)
        assert a[mine].tolist() == b[theirs].tolist() == np.intersect1d(a, b).tolist()
    assert divergence.shares(np.array([2 * 10**15]), 3 * 10**15 + 7).tolist() == [1 + 10**9 * (2 * 10**15 + 1) // (3 * 10**15 + 7)]


# --- 13


def paths():
    return tokenizers_of.path("byte_bpe_50k.json"), tokenizers_of.path("byte_bpe_50k.tiktoken"), tokenizers_of.PATTERN


def checked(rows, full):
    """Sequences are gapless and not overfull; their number."""
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by_sequence.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own[:-1])]).tolist() and sum(n for _, n in own) <= full
    return len(by_sequence)


def test_best_fit(spark, docs, corpus, empty):
    from tokenizers import Tokenizer

    tokenizer, full = Tokenizer.from_file(paths()[0]), 2048
    rows = best_fit.pack(best_fit.pieces(docs.selectExpr("*", "1 AS length", "2 AS open"), *paths())).collect()
    by_doc, total = defaultdict(list), 0
    for r in rows:
        by_doc[r["doc_id"]].append(r)
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // full))) and all(r["length"] == full for r in own[1:])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist()
        total += len(ids)
    assert len(rows) == sum(map(len, by_doc.values())) and checked(rows, full) <= -(-total // full) + 1
    assert best_fit.pack(best_fit.pieces(empty, *paths())).collect() == []


def test_unit_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    tokenizer, units = Tokenizer.from_file(paths()[0]), best_fit.UnitIds(*paths())
    rng = random.Random(1)
    texts = ["ΣΑΣ Σ", "é ́x", "<|endoftext|> hi", "a<|endoftext|>b x", "it's I'LL", "日本語 😀", "²³ ½ª  x\xa0\xa0y", "\r\n\x0b", "d\x85\x85q  \n\n z", "a\x1cb", "\n", "", " ", "a ", " a", "a\n", "\na", "a\n\nb", "x\0y z", "word" * 40]
    texts += ["".join(rng.choice(["it's", "'ll ", " \n", " foo", "bar", "\n", "1,2", "é", " the ", "x", "\t", " ", "日"]) for _ in range(30)) for _ in range(400)]
    for text, ids in zip(texts, units.encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_exchanges_empty_bins():
    """Bins that best fit leaves half full: 6+2+2, 5+3+2, 4+4+... only exchanges bring them into fewer."""
    full, lengths = 10, [6, 5, 5, 4, 4, 3, 3]
    start = [[0, 5], [1, 3], [2, 4], [6]]  # 9, 9, 9, 3
    got = best_fit.improve(start, lengths, full)
    assert len(got) == 3 and sorted(i for b in got for i in b) == list(range(7)) and all(sum(lengths[i] for i in b) <= full for b in got)
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 1100, 300).tolist()
        first = best_fit.best_fit(lengths, 2048)
        last = best_fit.improve([list(b) for b in first], lengths, 2048)
        assert -(-sum(lengths) // 2048) <= len(last) <= len(first) and sorted(i for b in last for i in b) == list(range(300))
        assert all(sum(lengths[i] for i in b) <= 2048 for b in last)


@pytest.mark.parametrize("lengths", [[2048] * 7, [1] * 5000, [1100] * 50, [1]])
def test_even_lengths(lengths):
    number, offset, room = best_fit.packed(np.array(lengths), 2048)
    assert len(set(number.tolist())) == max(-(-sum(lengths) // 2048), sum(x > 1024 for x in lengths))
    assert (np.bincount(number, lengths)[number] + room == 2048).all() and (offset + lengths <= 2048).all()


def test_open_bins_meet(spark, monkeypatch):
    """Groups too small to fill their bins: what they leave open is packed in later rounds."""
    monkeypatch.setattr(best_fit, "GROUP", 40)
    rng = random.Random(3)
    lengths = [(i, rng.randint(1, 900)) for i in range(1000)]
    rows = spark.createDataFrame(lengths, "doc_id bigint, length bigint").repartition(4)
    got = best_fit.pack(rows).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == lengths
    assert checked(got, 2048) <= -(-sum(n for _, n in lengths) // 2048) + 3


# --- the registered queries


def test_queries(spark, docs, corpus, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, "th er on"), (2, None), (3, "an ré he in")]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    duck = pytest.importorskip("duckdb").connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("op11_ball_tree", "op12_source_divergence"):
        want = duck.sql(registry.ORACLE_SQL[name])
        got = registry.QUERIES[name](spark, str(tmp_path)).select(*want.columns)
        assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
        assert [x for _, x in got.dtypes] == [{"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int"}[str(x)] for x in want.types]
    got = registry.QUERIES["op13_best_fit"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("piece", "int"), ("start", "bigint"), ("length", "bigint"), ("ids_crc32", "bigint"), ("sequence_id", "bigint"), ("offset", "bigint")]
    units, texts = best_fit.UnitIds(*paths()), dict(corpus)
    for r in got.collect():
        [ids] = units.encode([texts[r["doc_id"]] or ""])
        whole = np.append(ids, np.uint32(0)).astype("<u4")
        assert r["ids_crc32"] == zlib.crc32(whole[r["start"] : r["start"] + r["length"]].tobytes())


def test_terms_of_arrow_slices():
    column = pa.array(["x", None, "A b", "é"]).slice(1)
    [(first, end, row, place, count, n)] = ball_tree.vectors(column, pa.array([b"b", b"a"], pa.large_binary()))
    assert (first, end, row.tolist(), place.tolist(), count.tolist(), n.tolist()) == (0, 3, [1, 1], [0, 1], [1, 1], [0, 2, 1])
