from __future__ import annotations

import itertools
import math

import numpy as np

from leafline.llm import html_text, quality_classifier


def test_marginals_match_enumeration():
    rng = np.random.default_rng(2)
    energy, link = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weights = {}
    for y in itertools.product((0, 1), repeat=5):
        weights[y] = math.exp(sum(energy[0, t] * v for t, v in enumerate(y)) + sum(link[a, b] for a, b in zip(y, y[1:], strict=False)))
    total = sum(weights.values())
    good, pairs = quality_classifier.marginals(energy, np.array([5]), link)
    for t in range(5):
        assert abs(good[0, t] - sum(w for y, w in weights.items() if y[t]) / total) < 1e-9
    want = sum(w * sum((a, b) == (1, 0) for a, b in zip(y, y[1:], strict=False)) for y, w in weights.items()) / total
    assert abs(pairs[1, 0] - want) < 1e-9
    padded = np.concatenate([energy, np.full((1, 3), 9.0)], axis=1)
    assert np.allclose(quality_classifier.marginals(padded, np.array([5]), link)[0][0, :5], good[0])


def test_held_out_quality(spark, sf_dir, odd_docs, no_docs):
    large = sf_dir.replace("sf0.001", "sf0.01")
    out = quality_classifier.query(spark, large).join(spark.read.parquet(f"{large}/labels.parquet"), "doc_id").where("held_out").toPandas()
    ranks, good = out.score.rank(), out.quality == 1
    auc = (ranks[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.97 and (out.predicted == out.quality).mean() > 0.95
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality_classifier.train(docs, labels, most=50)
    rows = quality_classifier.score(odd_docs, field).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert quality_classifier.score(no_docs, field).count() == 0
    none = quality_classifier.train(docs, labels.where("false"))
    assert {r["score"] for r in quality_classifier.score(odd_docs.limit(3), none).collect()} == {0.5}


def test_nothing_is_learned_from_held_out_rows(spark, sf_dir):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_classifier.train(docs, labels), quality_classifier.train(docs, turned)
    assert np.array_equal(a.weights, b.weights) and a.curve == b.curve


PAGE = """<html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="page"><div class="post"><h1>Main  title</h1><p>First &amp; longest paragraph of the text, with <a href="x">a link</a> in it.<p>Second
 paragraph<br>of it, unclosed.<ul><li>item one<li>item two</ul><form><input value="q"><p>Sign up</p></form></div>
<div class="sidebar"><p>Related reading</p></div><div id="comments"><p>Nice post!</p></div></div><footer>(c) me</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "Main title\nFirst & longest paragraph of the text, with a link in it.\nSecond paragraph of it, unclosed.\nitem one\nitem two"
    assert html_text.main_text("<article><header><h1>In</h1></header><p>Text</p><div class='ad'>Buy</div></article><p>Other long text around it, but not of the article at all.</p>") == "In\nText"


def test_densities_choose_among_marked_elements():
    long = [f"Paragraph {i} tells at length what the page is about, with a number of words that no card has." for i in range(6)]
    two = [f"<article><p>{a}</p><p>{b}</p></article>" for a, b in zip(long[::2], long[1::2], strict=True)]
    assert html_text.main_text(f"<body>{''.join(two)}</body>") == "\n".join(long)
    assert html_text.main_text(f"<body><ul><li>{'</li><li>'.join(two)}</li></ul></body>") == "\n".join(long)
    cards = "".join(f"<article><h3>Card {i}</h3><p>Short.</p></article>" for i in range(3))
    story = "".join(f"<p>{x}</p>" for x in long)
    assert html_text.main_text(f"<body><div>{story}</div><div>{cards}</div></body>") == "\n".join(long)
    assert html_text.main_text(f"<body><div>{cards}</div><article>{story}</article></body>") == "\n".join(long)


def test_broken_pages():
    assert html_text.main_text(None) == "" and html_text.main_text("") == "" and html_text.main_text("<nav><a>x</a></nav>") == ""
    assert html_text.main_text("just words") == "just words"
    assert html_text.main_text("<article><p>cut off &am") == "cut off &am"
    assert html_text.main_text("<p>a<!-- open") == "a" and html_text.main_text("<p>a<script>b") == "a" and html_text.main_text("</p></div>x") == "x"
    assert html_text.main_text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    assert html_text.main_text("<p>1 < 2 and 3 > 2</p>") == "1 < 2 and 3 > 2"


def test_pages_table(spark, sf_dir):
    import html
    import re

    for r in html_text.query(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_extract_on_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x", 5), (2, "<p>a</p>", "x", 6), (2, "<p>a</p>", "x", 6)], "page_id long, html string, text string, n_chars int")
    assert [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(df).collect()] == [(1, "", 0), (2, "a", 1), (2, "a", 1)]
    assert html_text.extract(df.where("false")).count() == 0


def plain_features(line, earlier):
    import re

    words = line.split()
    n = len(words)
    if not n:
        return [1.0] + [0.0] * 19
    many = lambda pattern: len(re.findall(pattern, line))
    symbols, bars, shouts = many(r"[#*$%&|<>{}\[\]~^=\\_@]") / n, many("[|»›•·]") / n, many("!!") / n
    same = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    common = max(words.count(w) for w in set(words)) / n
    out = [0, min(symbols, 3), symbols > 0.3, min(bars, 1), bars > 0.2, min(shouts, 1), shouts > 0.2, line.isupper(), same, same > 0.3, len(set(words)) / n if n >= 8 else 1, common if n >= 8 else 0]
    out += [math.log(1 + n) / 5, min((len(line) - n + 1) / n, 20) / 10, line[-1] in ".!?…", line[0].isupper(), many("[0-9]") / len(line), line in earlier, n < 4, n > 60]
    return [float(np.float32(x)) for x in out]


def plain_score(text, field):
    """Marginals by sums over both labels of each line, in plain numbers."""
    lines = [x.strip() for x in (text or "").split("\n") if x.strip()] or [""]
    own = [plain_features(x, lines[:i]) for i, x in enumerate(lines)]
    none = [0.0] * 20
    rows = [[*own[i], *(own[i - 1] if i else none), *(own[i + 1] if i + 1 < len(own) else none), float(i == 0), float(i + 1 == len(own)), 1.0] for i in range(len(own))]
    energy = [min(30.0, max(-30.0, sum((v - m) / s * w for v, m, s, w in zip(r, field.mean, field.spread, field.weights, strict=True)))) for r in rows]
    emit = [(1 / (1 + math.exp(e)), 1 / (1 + math.exp(-e))) for e in energy]
    pair = [[math.exp(field.link[a][b]) for b in (0, 1)] for a in (0, 1)]
    unit = lambda v: [x / sum(v) for x in v]
    ahead, back = [unit(emit[0])], [[1.0, 1.0]]
    for e in emit[1:]:
        ahead.append(unit([sum(ahead[-1][a] * pair[a][b] for a in (0, 1)) * e[b] for b in (0, 1)]))
    for e in reversed(emit[1:]):
        back.append(unit([sum(pair[a][b] * e[b] * back[-1][b] for b in (0, 1)) for a in (0, 1)]))
    good = [unit([x * y for x, y in zip(f, b, strict=True)])[1] for f, b in zip(ahead, reversed(back), strict=True)]
    sizes = [len(x) + 1 for x in lines]
    a, b = field.curve
    return 1 / (1 + math.exp(-(a * sum(g * s for g, s in zip(good, sizes, strict=True)) / sum(sizes) + b)))


def test_scores_by_a_plain_loop(spark, sf_dir, odd_docs):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = quality_classifier.train(docs, labels)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in quality_classifier.query(spark, sf_dir).collect():
        assert abs(r["score"] - plain_score(texts[r["doc_id"]], field)) < 1e-6 and r["predicted"] == int(r["score"] >= 0.3)
    for r in quality_classifier.score(odd_docs, field).collect():
        assert abs(r["score"] - plain_score(r["text"], field)) < 1e-6


def test_whole_texts_are_learned_from(spark):
    import random

    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice("here there people water house little great under while again".split()) for _ in range(12)).capitalize() + "."
    junk = lambda: " | ".join("#$%" for _ in range(9))
    # bad documents turn bad behind their hundredth line only
    rows = [(i, "\n".join([prose() for _ in range(100)] + [(prose if i % 2 else junk)() for _ in range(40)])) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    field = quality_classifier.train(docs, labels)
    out = quality_classifier.score(docs, field).collect()
    assert min(r["score"] for r in out if r["doc_id"] % 2) > max(r["score"] for r in out if not r["doc_id"] % 2)


def test_the_sample_is_bounded_and_settled(spark):
    rows = [(i % 40, f"text {i % 50}\nof two lines") for i in range(400)] + [(41, "\n".join("abcdefghijkl")), (None, "no id"), (42, None)]
    docs = spark.createDataFrame(rows, "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(43)] + [(i, 1) for i in range(43)] + [(None, 1), (5, None)], "id long, label int")
    a = quality_classifier.sample(docs, labels, 30, 100).collect()
    b = quality_classifier.sample(docs.repartition(7), labels.repartition(5), 30, 100).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str) and 0 < len(a) <= 30
    assert len({(r["id"], r["text"]) for r in a}) == len(a) and all(r["label"] == r["id"] % 2 for r in a)
    assert sum((r["text"] or "").count("\n") + 1 for r in quality_classifier.sample(docs, labels, 1000, 20).collect()) <= 20
    assert 41 not in {r["id"] for r in quality_classifier.sample(docs, labels, 1000, 100).collect()}


def test_pages_without_helpful_marks():
    long = [f"Paragraph {i} tells at length what the page is about, with a number of words that no card has." for i in range(6)]
    story, text = "".join(f"<p>{x}</p>" for x in long), "\n".join(long)
    comments = f"<div class='comments'><p>{'nice ' * 300}</p></div>"
    pages = [
        f"<div class='c'>{story}</div><div><article><h3>Teaser</h3><p>Short teaser</p></article></div>",  # a teaser in an article
        f"<div class='page'><div class='entry'>{story}</div><div class='x'><article><p>Short teaser</p></article></div></div>",
        f"<main><article>{story}</article><div><ul><li><a href='x'>Link one</a></li><li><a href='y'>Link two</a></li></ul></div></main>",
        f"<main><div><article>{story}</article></div></main>",
        f"<form action='x'><div>{story}<input></div></form>",
        f"<div class='elementor-widget-container'>{story}</div>",
        f"<form><div class='widget'>{story}{comments}</div><div class='related'><p>More to read, in a few words</p></div></form>",
        f"<div class='share-page'>{story}</div><nav><a>Home</a></nav>",
        f"<div>{story}</div><div class='widget'><p>{'shop ' * 60}</p></div>{comments}",
    ]
    for page in pages:
        assert html_text.main_text(f"<html><body>{page}</body></html>") == text, page
    assert html_text.main_text(f"<p>Short story.</p>{comments}") == "Short story."


def test_a_very_long_page():
    paragraphs = [f"Paragraph {i} of a very long page &amp; its words." for i in range(30000)]
    text = html_text.main_text("<body><div class='c'><p>" + "</p><p>".join(paragraphs) + "</p></div></body>")
    assert text == "\n".join(paragraphs).replace("&amp;", "&")


def test_density_choice_by_its_definition():
    """Random pages without marked elements against recursive sums: characters, tags and links of every node counted anew."""
    import random

    rng = random.Random(6)
    words = lambda n: " ".join(rng.choice(["one", "seven", "letters", "of", "text"]) for _ in range(n))

    def page(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice([f"<p>{words(rng.randint(1, 40))}</p>", f"<p>{words(6)} <a>{words(3)}</a></p>", f"<ul><li><a>{words(2)}</a></li></ul>"])
        return "<div>" + "".join(page(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    def kids(n):
        return [x for x in n.children if not isinstance(x, str)]

    def counts(n, in_link=False):
        """Characters, tags below, those in links."""
        in_link = in_link or n.tag == "a"
        c = sum(len(x.replace(" ", "")) for x in n.children if isinstance(x, str))
        t, lc, lt = 0, c * in_link, int(n.tag == "a")
        for k in kids(n):
            kc, kt, klc, klt = counts(k, in_link)
            c, t, lc, lt = c + kc, t + kt + 1, lc + klc, lt + klt
        return c, t, lc, t + 1 if n.tag == "a" else lt

    for _ in range(60):
        root = html_text.parse(f"<html><body>{page(4)}{page(3)}</body></html>")
        body = kids(root)[0]
        whole = counts(body)

        def density(n, whole=whole):
            c, t, lc, lt = counts(n)
            if not c:
                return 0.0
            t, lt = max(t, 1), max(lt, 1)
            inner = math.log(c / max(c - lc, 1) * lc + whole[2] / whole[0] * c + math.e)
            return c / t * math.log(math.e * max(c / max(lc, 1) * t / lt, 1.0)) / math.log(inner + math.e - 1)

        def all_nodes(n):
            return [n] + [x for k in kids(n) for x in all_nodes(k)]

        nodes = [n for n in all_nodes(root) if counts(n)[0]]
        total = {id(n): sum(density(k) for k in kids(n) if counts(k)[0]) or density(n) for n in nodes}
        best = max(total.values())
        chosen = html_text.main_nodes(root)
        heart = [n for n in nodes if total[id(n)] >= best - 1e-9]
        assert any(h in all_nodes(c) for h in heart for c in chosen)
        path, n = [], next(h for h in heart if any(h in all_nodes(c) for c in chosen))
        top = n
        while n is not None and n.tag != "html":
            path.append(n)
            n = n.parent
        limit = min(map(density, path))
        beside = [k for p in path[1:] for k in kids(p) if k not in path and counts(k)[0] and density(k) >= limit]
        assert {id(c) for c in chosen} == {id(top)} | {id(b) for b in beside}
