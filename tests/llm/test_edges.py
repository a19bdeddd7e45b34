"""Nulls, empty tables, long texts, repeats and clashing names; SQL of this subpackage; trees and models against plain versions."""

import math
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tracklens.llm import bpe, html, jaccard, langid, licenses, linkgraph, queries, spotsigs, wordpieces

public_tokenizers = pytest.importorskip("public_tokenizers")

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCABULARY, RANKS = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.tiktoken"))


def test_queries_match_their_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    for name, text in queries.ORACLES.items():
        df, result = queries.QUERIES[name](spark, sf), c.sql(text)
        assert sorted(df.columns) == sorted(result.columns)
        at = [result.columns.index(x) for x in df.columns]
        want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
        assert sorted((tuple(map(plain, r)) for r in df.collect()), key=repr) == want and want, name


def test_empty_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert linkgraph.judge(pages, queries.URL_RULES).count() == html.extract(pages, ["page_id"]).count() == 0
    assert licenses.scan(docs, ["doc_id"]).count() == wordpieces.count_tokens(docs, VOCABULARY, ["doc_id"]).count() == 0
    assert langid.predict(docs, langid.fit(docs, F.lit(True)), ["doc_id"]).count() == 0
    assert bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ["doc_id"]).count() == jaccard.components(docs).count() == spotsigs.with_next(docs).count() == 0


def test_operators_refuse_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the house", "en", "s", 9)], DOCS).withColumns({c: F.lit(1) for c in ("__text", "score", "lang_pred", "n_tokens", "labels", "__html")})
    model = langid.fit(docs, F.lit(True))
    for call in (
        lambda: langid.predict(docs, model, ["score"]), lambda: bpe.encode(docs, RANKS, public_tokenizers.PATTERN, ["n_tokens"]), lambda: wordpieces.count_tokens(docs, VOCABULARY, ["__text"]), lambda: licenses.scan(docs, ["labels"]),
        lambda: html.extract(docs, ["__html"], "text"),
    ):
        with pytest.raises(ValueError):
            call()


def test_very_long_texts(spark):
    text = "the MIT License of a green house " * 6_000
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, text + "end", "en", "s", 0), (3, "x" * 500_000, "en", "s", 0)], DOCS)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    found = {r["doc_id"]: len(r["base"]) for r in licenses.scan(docs, ["doc_id"]).collect()}
    assert found == {1: 6_000, 2: 6_000, 3: 0}
    assert {len(r["sigs"]) for r in spotsigs.with_next(docs).collect()} == {1, 4}  # "mit" is an anchor, too
    page = "<article>" + "<p>green house</p>" * 50_000 + "</article>"
    assert len(html.main_text(page)) == 50_000 * 13 - 2


def test_html_tree_asks_for_neighbours():
    asked, todo = set(), [html.tree()]
    while todo:
        node = todo.pop()
        if node.feature >= 0:
            asked.add(html.FEATURES[node.feature])
            todo += [node.below, node.above]
    assert {"words", "link_density", "words_before", "link_density_after"} <= asked
    seen = html.labelled()
    assert len(seen) < 200 and all(html.is_main(r[:-1], html.tree()) == bool(r[-1]) for r in seen)


def test_html_features_against_plain_python():
    page = "<ul><li><a href=1>one two</a> x<li>three</ul><h2>four <a href=2>five</a></h2><article><p>six seven</article>"
    want = [(3.0, 2 / 3, 0, 0, 1, 0, 0, 0, 1, 0), (1, 0, 3, 2 / 3, 2, 0.5, 0, 0, 1, 0), (2, 0.5, 1, 0, 2, 0, 0, 0, 1, 1), (2, 0, 2, 0.5, 0, 0, 0, 1, 1, 0)]
    for got, f in zip(html.features(html.blocks(page)), want, strict=True):
        assert got == pytest.approx(f)


def test_html_pages_without_names_are_told_by_their_blocks():
    """Held-out pages of plain divs, on which the names of elements and classes say nothing."""
    words = lambda n: " ".join(["word"] * n)
    link = lambda n: f"<a href=x>{words(n)}</a>"
    blocks = [(link(1), 0), (link(2), 0), (words(2), 0), (link(3), 0), (words(9), 1), (words(50), 1), (words(3), 1), (words(70), 1), (link(4), 0), (words(1), 0), (link(2), 0)]
    page = "".join(f"<div>{text}</div>" for text, _ in blocks)
    found = html.blocks(page)
    assert not any(b.beside or b.in_main for b in found)
    got = [html.is_main(f, html.tree()) for f in html.features(found)]
    by_tree = sum(a == bool(b) for a, (_, b) in zip(got, blocks, strict=True))
    assert by_tree == len(blocks) > sum(b for _, b in blocks)  # by names alone all would be main text


def test_html_long_and_broken_quotes():
    value = "x" * 300 + "> y <b> " + "z" * 300
    assert html.main_text(f'<article><p title="{value}">Hello</p></article>') == "Hello"
    assert html.main_text("<article><p title=\"x>Hello</p></article>") == "Hello"
    assert html.main_text("<article><p data-x=' \" > '>A</p><p>1 < 2, 3 > 2</p></article>") == "A\n\n1 < 2, 3 > 2"
    assert html.main_text("<p x='<b' y=" * 20_000).count("x=") == 20_000


def test_license_windows_follow_the_rules(spark):
    long = " ".join(f"w{k}" for k in range(40))
    rule = licenses.Rule("own", "own", 1, f"^(?:{long})(?= |$)", ("w0",))
    df = licenses.scan(spark.createDataFrame([(1, f"a {long} b"), (2, long[:-2])], "doc_id bigint, text string"), ["doc_id"], table=[rule])
    assert {r["doc_id"]: r["labels"] for r in df.collect()} == {1: ["own"], 2: []}
    with pytest.raises(ValueError):
        licenses.scan(df, ["doc_id"], "doc_id", [licenses.Rule("x", "x", 1, "^a.*b", ("a",))])


def test_language_scores_against_plain_python(spark):
    rows = [(1, "the house of the", "en"), (2, "la casa de la", "es"), (3, "the casa", "es"), (4, None, "es"), (5, "der", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(docs, F.lit(True))
    counts = {x: Counter(w for _, t, y in rows if t and y == x for w in t.split()) for x in ("en", "es")}
    grams = {x: Counter() for x in counts}
    for x, words in counts.items():
        for w, n in words.items():
            f = f" {w} "
            for size in range(1, langid.MAX_GRAM + 1):
                for i in range(len(f) - size + 1):
                    if f[i : i + size] != " ":
                        grams[x][f[i : i + size]] += n
    log = lambda c, k: {x: math.log(c[x][k] + 0.5) - math.log(c[x].total() + 0.5 * (len(set(c["en"]) | set(c["es"])) + 1)) for x in c}

    def of_word(w):
        if any(w in c for c in counts.values()):
            return log(counts, w)
        f = f" {w} "
        for back, size in enumerate(range(min(langid.MAX_GRAM, len(f)), 0, -1)):
            hits = [log(grams, f[i : i + size]) for i in range(len(f) - size + 1) if any(f[i : i + size] in g for g in grams.values())]
            if hits:
                return {x: sum(h[x] for h in hits) / len(hits) - langid.STEP_PENALTY * back for x in counts}
        return dict.fromkeys(counts, 0.0)

    for text in ("the house", "casas del", "zzz thee", "de", "qqq"):
        each = [of_word(w) for w in text.split()]
        total = {x: sum(e[x] for e in each) for x in counts}
        best = max(sorted(total), key=lambda x: total[x])
        share = 1 / sum(math.exp((v - total[best]) / math.sqrt(len(each))) for v in total.values())
        told, score = model.predict(text, {})
        assert told == best and score == pytest.approx(share, rel=1e-4), text
