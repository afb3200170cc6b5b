"""Rules, packing, sharding, tokens, search, extraction and toxicity."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from kerbside.llm import byte_bpe, html_extract, packing, quality_rules, sharding, topk_search, toxicity

tokenizers_of = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def clashing(df):
    return df.selectExpr("*", "1 AS score", "2 AS bin", "3 AS node", "4 AS n_words", "5 AS fail_bits", "6 AS kept")


def test_quality_rules(docs, corpus, empty):
    rows = {r["doc_id"]: r for r in quality_rules.apply_policy(quality_rules.ledger(clashing(docs))).collect()}
    for i, t in corpus:
        text = t or ""
        w = WORD.findall(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        repeated = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), len(lines))
        r = rows[i]
        assert tuple(r[c] for c in quality_rules.MEASURES) == want, i
        bits = r["fail_bits"]
        assert bool(bits & quality_rules.mask("base")) == (len(w) < 20 or 100 * len(repeated) > 30 * len(w))
        assert r["kept"] == (bits & quality_rules.mask("v1") == 0)
    assert quality_rules.ledger(empty).collect() == []


def test_ablation(docs):
    rows = quality_rules.ledger(docs)
    bits = [r["fail_bits"] for r in rows.collect()]
    for r in quality_rules.ablation(rows).collect():
        b = quality_rules.bit(r["rule"])
        assert (r["n_failed"], r["n_only"], r["n_rejected_without"]) == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x not in (0, b) for x in bits))


def test_packing(docs, corpus, empty):
    from tokenizers import Tokenizer

    path = tokenizers_of.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pieces(clashing(docs), path).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 4096
    assert len({r["sequence_id"] for r in rows}) == len(rows)
    for i, t in corpus:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        own = sorted(by_doc[i], key=lambda r: r["start"])
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == ids
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own[:-1])]).tolist() and own[0]["doc_tokens"] == len(ids)
    assert packing.pieces(empty, path).collect() == []


def test_batches_of_equal_lengths(docs):
    made = packing.pieces(docs, tokenizers_of.path("word_bpe_49k.json"), full=64)
    rows = packing.batches(made.repartition(2), 64).collect()
    by_batch = {}
    for r in rows:
        by_batch.setdefault(r["batch_id"], []).append(r)
    assert len(rows) == made.count()
    short = Counter()
    for own in by_batch.values():
        [length] = {r["length"] for r in own}
        assert sorted(r["batch_row"] for r in own) == list(range(len(own))) and len(own) <= 64 // length
        short[length] += len(own) < 64 // length
    assert max(short.values()) <= 2 and len(by_batch) < len(rows)  # one for each of the two tasks
    assert packing.batches(made.limit(0), 64).collect() == []


ODD = ["ΣΑΣ Σ", "é ́x", "<|endoftext|> hi", "a<|endoftext|>b <|startoftext|>x.<|startoftext|>", "<|ENDOFTEXT|>É<|endoftext|><|endoftext|> <|endoftext |>", "x y\t\tq", "it's I'LL we'd", "日本語 😀😀", "²³ ½ª a_b __  x\xa0\xa0y ÷×", "İI ß", "\r\n\x0b", "d\x85\x85q  \n\n z", "a\x1cb", "x  y", "word" * 40]


def test_word_ids_are_the_tokenizers():
    from tokenizers import Tokenizer

    path = tokenizers_of.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abeénñ'’.,!1 \n") for _ in range(60)) for _ in range(200)]
    for text, ids in zip(texts, packing.WordIds(path).encode(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_byte_bpe(docs, corpus, empty):
    import tiktoken

    path, pattern = tokenizers_of.path("byte_bpe_multi_50k.tiktoken"), tokenizers_of.PATTERN
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    codec = byte_bpe.codec(path, pattern)
    rng = random.Random(2)
    for text in ODD + ["".join(rng.choice("abeénñ'.,!1 \n\t") for _ in range(60)) for _ in range(200)]:
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text), text
        assert codec.decode(ids) == text.encode()
    for r in byte_bpe.round_trip(clashing(docs), path, pattern).collect():
        text = dict(corpus)[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    back = byte_bpe.decode(byte_bpe.encode(docs, path, pattern), path, pattern)
    assert {r["doc_id"]: bytes(r["raw"]).decode() for r in back.collect()} == {i: t or "" for i, t in corpus}
    assert byte_bpe.round_trip(empty, path, pattern).collect() == []


def test_sharding(docs, corpus, empty):
    rows = sharding.shard_by_bytes(clashing(docs), 8).toPandas()
    assert len(rows) == len(corpus)
    texts = {i: t or "" for i, t in corpus}
    for i, size, crc in zip(rows["doc_id"], rows["size"], rows["text_crc32"], strict=True):
        assert (size, crc) == (len(texts[i].encode()) + 1, zlib.crc32(texts[i].encode()))
    for _, part in rows.groupby("shard"):
        assert sorted(part["slot"]) == list(range(len(part)))
    assert (rows.assign(text=rows.doc_id.map(texts)).groupby("text")["shard"].nunique() == 1).all()
    assert sharding.shard_by_bytes(empty, 8).collect() == []


def test_shards_are_even(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400) + str(i), "en", "s") for i in range(3000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string"), 8).toPandas().groupby("shard")["size"].sum()
    assert len(got) == 8 and got.max() < 1.02 * got.min()


def test_search(docs, corpus, empty):
    d = {i: Counter(WORD.findall((t or "").translate(LOWER))) for i, t in corpus}
    size = {i: sum(c.values()) for i, c in d.items()}
    mean, df = sum(size.values()) / len(d), Counter(w for c in d.values() for w in c)
    queries = [i for i in d if i % 9 == 0]
    got = {}
    for r in topk_search.search(clashing(docs), docs.where("doc_id % 9 = 0").selectExpr("doc_id AS query_id", "text")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"], r["score"]))
    for q in queries:
        scores = []
        for i, c in d.items():
            s = sum(n * math.log(1 + (len(d) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * size[i] / mean)) for w, n in d[q].items() if w in c)
            if s > 0:
                scores.append((-round(s, 9), i))
        want = sorted(scores)[:10]
        found = sorted(got.get(q, []))
        assert [i for _, i, _ in found] == [i for _, i in want] and all(abs(a[2] + b[0]) < 1e-6 for a, b in zip(found, want, strict=True)), q
    assert topk_search.search(empty, empty.selectExpr("doc_id AS query_id", "text")).collect() == []


def test_pruning_finds_the_best():
    rng = np.random.default_rng(0)
    n, terms = 4000, 50
    row, term = np.repeat(np.arange(n), 5), rng.integers(0, terms, 5 * n)
    count = rng.integers(1, 4, 5 * n)
    count[row == 77] = 60
    shard = topk_search.Shard(np.arange(n), np.full(n, 20), row, term, count, terms, 20.0)
    wanted = np.unique(term[row == 77])
    ids, scores = shard.search(wanted, np.ones(len(wanted)), 1)
    assert ids.tolist() == [77] and scores[0] > 2.0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy now.</div><article><h1>{title}</h1><p><b>{first}<br><p>{second} &amp; more</p></article><footer>&copy; site</footer></body></html>"""


def pages(n=60):
    rng = random.Random(0)
    made = []
    for _ in range(n):
        parts = [" ".join("".join(rng.choice(("ba", "do", "ki", "lu")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 40))) for _ in range(3)]
        made.append((PAGE.format(title=parts[0], first=parts[1], second=parts[2]) + " " * 400, "\n".join([parts[0], parts[1], parts[2] + " & more"])))
    return made


def test_html_extraction(spark):
    made = pages()
    rows = [(i, f"u{i}", h) for i, (h, _) in enumerate(made)] + [(100, None, None), (101, "u", ""), (None, "u", "<p>cut <b"), (102, "u", made[0][0][: made[0][0].index("more")])]
    got = {r["page_id"]: r for r in html_extract.extract_pages(spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text")).collect()}
    assert sum(got[i]["text"] == want for i, (_, want) in enumerate(made)) == len(made)
    assert got[100]["text"] == got[101]["text"] == "" and got[102]["text"].startswith(made[0][1][:20])
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and len(got) == len(rows)
    assert html_extract.extract_pages(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []


STORY = "The river rose in the night, and by morning the lower fields were under water. Nobody had seen that before, though the old ones spoke of it."
#: Ends of an article and the text that they must give.
ENDS = [
    ('<p title="5" tall">An odd quote.</p>', "An odd quote."),
    ("<p title='it is\">A single one.</p>", "A single one."),
    ('<p data-a="x > y">A sign in a value.</p>', "A sign in a value."),
    ('<p>Before <svg class="i"/> and after.</p>', "Before and after."),
    ("<p>Before <svg><svg><path/></svg><text>in</text></svg> and after.</p>", "Before and after."),
    ('<p>Before <img src="a.png"> and after.</p>', "Before and after."),
    ('<p>One.</p><script src="x"/><p>Two.</p>', "One.\nTwo."),
    ('<p>One.</p><script src="x"></script ><p>Two.</p>', "One.\nTwo."),
    ("<p>One.</p><script>let a = '<p>no</p>'</script><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><style>p { color: red }</style><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><iframe src=a /><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><template><p>no</p></template><p>Two.</p>", "One.\nTwo."),
    ("<p>One.</p><!-- <p>no</p> --><p>Two.</p>", "One.\nTwo."),
    ("<table><tr><th>Year</th><td>Rain</td></tr></table>", "Year\nRain"),
    ("<table><tbody><tr><td>Year<td>Rain<tr><td>Last<td>None</tbody></table>", "Year\nRain\nLast\nNone"),
    ("<dl><dt>Term<dd>What it means.</dl>", "Term\nWhat it means."),
    ("<ul><li>First thing<li>Second thing</ul>", "First thing\nSecond thing"),
    ("<ol><li>First thing</li><li>Second thing</li></ol>", "First thing\nSecond thing"),
    ("<figure><img src=a><figcaption>The lower fields.</figcaption></figure>", "The lower fields."),
    ("<pre>a  b</pre>", "a b"),
    ("<blockquote><p>They said so.</p></blockquote>", "They said so."),
    ("<h2>What then</h2><p>Nothing.</p>", "What then\nNothing."),
    ("<p>H<sub>2</sub>O &lt; &#x41;&nbsp;&eacute;</p>", "H2O < A \u00e9"),
    ("<p>One<br>two</p>", "One two"),
    ("<p>One<p>Two", "One\nTwo"),
    ("<P>Upper</P>", "Upper"),
    ("<p>5 < 6 and 7 > 6</p>", "5 < 6 and 7 > 6"),
    ("<p><b>Bold <i>both</b> rest</i></p>", "Bold both rest"),
    ("<div><p>In a box.</p></div>", "In a box."),
    ("<p>Left <a href='/x'>linked</a> right.</p>", "Left linked right."),
]


@pytest.fixture(scope="module")
def trees():
    return html_extract.train([h for h, _ in pages()])


@pytest.mark.parametrize(("end", "text"), ENDS)
def test_html_ends_of_articles(trees, end, text):
    body = "".join(f"<p>{STORY}</p>" for _ in range(6))
    page = f'<html><body><nav><a href="/">Home</a></nav><article><h1>Flood</h1>{body}{end}</article><footer>Site</footer></body></html>'
    assert html_extract.extract(trees, [page]) == ["\n".join(["Flood", *[STORY] * 6, text])]


def test_html_without_marks_or_text():
    made = [h.replace("<article>", "<div>").replace("</article>", "</div>") for h, _ in pages()]
    trees = html_extract.train(made)
    page = f'<html><body><ul class="menu"><li><a href="/">Home</a></li></ul><div class="content"><p>{STORY}</p><p>{STORY}</p></div><div class="footer"><a href="/b">About</a></div></body></html>'
    assert html_extract.extract(trees, [page, "", "<svg"]) == [f"{STORY}\n{STORY}", "", ""]
    assert html_extract.extract(html_extract.train([]), ["", "<!-- -->"]) == ["", ""]


def test_html_other_templates():
    model = html_extract.train([h for h, _ in pages()])
    story = " ".join(["First paragraph of the story, long enough."] * 6)
    page = '<html><body><header class="site-header"><h1>Site</h1></header><div class="cookie-notice">We use cookies.</div><div class="content"><h1>Title here</h1><p>STORY</p><aside class="sidebar"><p>Related</p></aside><p>Second <a href="x">link</a> here.<p>Third</div><div class="comments"><p>A comment, it is.</p></div><footer>c</footer></body></html>'.replace("STORY", story).replace("here.", f"here. {story}")
    [text] = html_extract.extract(model, [page])
    assert f"{story}\nSecond link here. {story}" in text and "comment" not in text and "cookies" not in text and "Related" not in text


def labelled(n=500):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        words = ["".join(rng.choice(("th", "er", "on", "an", "re")) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))]
        bad = int(rng.random() < 0.3)
        if bad:
            for _ in range(rng.randint(2, 4)):
                words[rng.randrange(len(words))] = rng.choice(("vileword", "vilewords", "nastyone", "Nastyone."))
        rows.append((i, " ".join(words), bad))
    return rows


def test_toxicity(spark, empty):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (None, "x")], "doc_id bigint, text string").selectExpr("*", "1 AS score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (1001, None)], "doc_id bigint, toxic int")
    got = toxicity.score_documents(docs, labels).toPandas()
    assert len(got) == len(rows) + 2 and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.5)).all()
    held = got[got.held_out & got.doc_id.notna() & (got.doc_id < 1000)]
    assert set(held.doc_id.astype(int)) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    y = held.doc_id.map({i: y for i, _, y in rows})
    assert (held.predicted == y).mean() > 0.9
    alone = toxicity.score_documents(docs.limit(3), labels.limit(0)).toPandas()
    assert alone.score.between(0, 1).all()
    assert toxicity.score_documents(empty, labels).collect() == []


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.initial(1).items()}
    inputs, index, length, w = rng.standard_normal((6, toxicity.WORD_DIM + toxicity.CHAR_DIM)), rng.integers(0, 6, (3, toxicity.WINDOW)), np.array([toxicity.WINDOW, 5, 1]), np.array([0.3, -0.5, 0.7])
    logit, memory = toxicity.forward(p, inputs, index, length)
    assert np.allclose(toxicity.logits(p, inputs, index, length), logit, atol=1e-5)
    g = toxicity.gradients(p, inputs, index, memory, w)
    for k in ("Wf", "Wb", "Uf", "Ub", "cf", "attend", "out"):
        flat, i = p[k].ravel(), 3
        old, e = flat[i], 1e-4
        flat[i] = old + e
        up = toxicity.forward(p, inputs, index, length)[0] @ w
        flat[i] = old - e
        down = toxicity.forward(p, inputs, index, length)[0] @ w
        flat[i] = old
        assert abs((up - down) / 2 / e - g[k].ravel()[i]) < 1e-4 * max(1, abs(g[k].ravel()[i])) + 1e-4, k


def test_windows_cover_texts():
    v = toxicity.Vocabulary(pa.array([" ".join(map(str, range(n))) for n in (0, 1, 32, 33, 48, 100)]))
    places, length, bounds = v.windows()
    assert length.tolist()[:3] == [0, 1, 32]
    for t, n in enumerate((0, 1, 32, 33, 48, 100)):
        own = range(bounds[t], bounds[t + 1])
        assert {int(x) for k in own for x in places[k, : length[k]]} == set(range(v.bounds[t], v.bounds[t] + n))
