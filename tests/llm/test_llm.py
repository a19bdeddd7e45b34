"""The operators against brute force, on small tables with awkward rows."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracklens.llm import bpe, chat, decontaminate, html, jaccard, langid, licenses, linkgraph, queries, spotsigs, wordhash, wordpieces

public_tokenizers = pytest.importorskip("public_tokenizers")

WORDS = "the of and house river mit license apache general public walk stone under green is a b c".split()
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    base = [" ".join(r.choices(WORDS, k=r.randrange(5, 120))) for _ in range(12)]
    texts = [*base, *base[:3], None, "", " \n\t", "word", "Two words", "MIT License. mit-LICENSE", "Aé KMIT license", "x" * 5000, "?!. --"]
    for t in base[:6]:
        words = t.split()
        for _ in range(3):
            w = list(words)
            w[r.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    out = [(i * 3, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[0], (None, "the of and the of and house", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def folder(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def test_word_hashes_do_not_depend_on_pieces():
    text = ("abc  deéf\t" * 50).encode()
    whole = wordhash.words_of(text)
    for piece in (1, 3, 7, 64):
        for a, b in zip(whole, wordhash.words_of(text, piece=piece), strict=True):
            assert a.tolist() == b.tolist()
    ((_, n, hashes, first),) = wordhash.batch_words(pa.array(["abc deéf", None, "", "ABC"]))
    assert n == 4 and first.tolist() == [0, 2, 2, 2, 3] and hashes[0] == hashes[2] == whole[2][0] and hashes[1] == whole[2][1]


def test_jaccard_against_brute_force(spark, docs, rows, monkeypatch):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", lower(text or ""))
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set()

    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = sorted((r[0] or -1, len(s), least.get(find(i), -1)) for i, (r, s) in enumerate(zip(rows, sets, strict=True)))
    for rounds in (0, jaccard.PIVOT_ROUNDS, 3):
        monkeypatch.setattr(jaccard, "PIVOT_ROUNDS", rounds)
        monkeypatch.setattr(jaccard, "HOT_ROWS", 2 if rounds else 1024)
        got = jaccard.components(docs).collect()
        assert sorted((x[0] or -1, x[1], -1 if x[2] is None else x[2]) for x in got) == want
    assert jaccard.components(docs.limit(0)).collect() == []


def test_trie_finds_all_similar_sets():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, r.integers(40, 60), replace=False), r.integers(0, 1 << 60, r.integers(0, 6)).astype(np.uint64)])) for _ in range(80)]
    trie = jaccard.Trie(sets)
    for probe in sets[:40]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, probe)) >= 85 * len(np.union1d(s, probe))}
        assert set(trie.similar(probe, 85)) == want


def test_myers_against_dynamic_programming():
    r = random.Random(5)
    for _ in range(200):
        item, text = ([r.randrange(4) for _ in range(r.randrange(1, n))] for n in (12, 40))
        masks = {}
        for i, w in enumerate(item):
            masks[w] = masks.get(w, 0) | 1 << i
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            new = [0]
            for i, v in enumerate(item):
                new.append(min(row[i] + (v != w), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        got = decontaminate.myers(masks, len(item), text, len(item))[0]
        assert min(best, len(item)) == got or best == len(item)


def test_decontamination(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"
    near = item.replace("four ", "4 ").replace("nine", "nine and")
    far = "one two three four five six seven words that differ from there on to the end of it all"
    texts = [f"Intro. {item.upper()}! tail", f"a {near} b", far, None, "", item[:30], " ".join([item] * 3)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    bench = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "short one"), (None, item)], "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.find(docs, bench, min_words=6).collect())) == [(0, 7, 0), (1, 7, 2), (6, 7, 0)]
    assert sorted(r[0] for r in decontaminate.clean(docs, bench, min_words=6).collect()) == [2, 3, 4, 5]
    short = spark.createDataFrame([(9, "Seven words"), (10, "?!")], "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.find(docs, short).collect())) == [(2, 9, 0)]


def test_decontamination_against_brute_force(spark, monkeypatch):
    r = random.Random(11)
    items = [[r.choice("abcdefgh") for _ in range(n)] for n in (1, 3, 4, 5, 9, 14, 23)]
    texts = []
    for _ in range(60):
        words = [r.choice("abcdefgh") for _ in range(r.randrange(0, 30))]
        planted = list(r.choice(items))
        for _ in range(r.randrange(0, 4)):
            planted[r.randrange(len(planted))] = r.choice("abcxyz")
        texts.append(words + planted + words[:5] if r.random() < 0.7 else words)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")

    def least(item, text):
        row = list(range(len(item) + 1))
        best = row[-1]
        for w in text:
            new = [0]
            for i, v in enumerate(item):
                new.append(min(row[i] + (v != w), row[i + 1] + 1, new[i] + 1))
            row, best = new, min(best, new[-1])
        return best

    want = {(i, j, d) for i, t in enumerate(texts) for j, item in enumerate(items) if (d := least(item, t)) <= len(item) // 5}
    assert {tuple(x) for x in decontaminate.find(docs, bench).collect()} == want
    kept = sorted(set(range(60)) - {i for i, _, _ in want})
    for size in (decontaminate.BLOCK_BYTES, 16):  # one block, several
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert {tuple(x) for x in decontaminate.find(docs, bench).collect()} == want
        assert sorted(x[0] for x in decontaminate.clean(docs, bench).collect()) == kept


def test_decontamination_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 7, "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, "x y")], "item_id bigint, text string")
    assert decontaminate.clean(docs, bench.limit(0)).count() == 7 and decontaminate.find(docs.limit(0), bench).count() == 0


def test_licenses_base_against_brute_force(spark, docs, rows, tmp_path):
    got = queries.op4_license_scans(spark, folder(spark, tmp_path, documents=docs)).collect()
    phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for r in rows:
        words = re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(r[1] or ""))
        at = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        want.append((r[0] or -1, len(words), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    assert sorted(((x[0] or -1, *x[1:6]) for x in got), key=str) == sorted(want, key=str)
    for x in got:
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1


def test_license_rules_suppress_what_they_contain(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3", "SPDX-License-Identifier: BSD-3-Clause", "no terms at all", None, "the licensed driver is released under stress"]
    df = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), ["doc_id"])
    labels = {r["doc_id"]: r["labels"] for r in df.collect()}
    assert labels == {0: ["apache", "apache-2.0"], 1: ["gpl", "gpl-3.0"], 2: ["bsd-3-clause"], 3: [], 4: [], 5: []}
    found = {r["doc_id"]: r["detections"] for r in df.collect()}
    assert [(d["start"], d["end"], d["label"]) for d in found[0]] == [(0, 8, "apache-2.0")]
    assert len(licenses.rules()) > 200


def test_html(spark):
    page = (
        "<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>T&eacute;st &amp; x</h1>"
        "<p>One<br>two <b>thr</b>ee<!-- no --><div class=ad>buy</div><p>Three <a href=y>links</a></p><form>q<input></form><script>if(a<b)'</p>'</script><aside>more</aside></article>"
        "<section id='comments'><p>hi there</section><footer>c</footer>"
    )
    assert html.main_text(page) == "Tést & x\n\nOne two three\n\nThree links"
    assert html.main_text("<p>x  y</p><ul><li><a href=1>l</a><li><a>m</a></ul>") == "x y" and html.main_text("a &lt; b") == "a < b"
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    pages = spark.createDataFrame([(1, "u", page), (2, None, None)], "page_id bigint, url string, html string")
    assert [r["n_chars"] for r in html.extract(pages, ["page_id", "url"]).orderBy("page_id").collect()] == [len(html.main_text(page)), 0]


def test_fingerprints_against_plain_python(spark, docs, rows, tmp_path):
    got = queries.op7_fingerprints(spark, folder(spark, tmp_path, documents=docs)).collect()
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5((r[1] or "").encode()).hexdigest()))
    want, prints = [], {}
    for r, after in zip(order, [*order[1:], order[0]], strict=True):
        text, following = r[1] or "", after[1] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + following[:k]
        want.append((r[0] or -1, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted((x[0] or -1, x[1], x[2]) for x in got) == sorted(want)
    texts = {r[0]: r[1] or "" for r in rows}
    for x in got:
        assert prints.setdefault(texts[x["doc_id"]], x["fingerprint"]) == x["fingerprint"] and 0 <= x["near_edited"] <= 1 and 0 <= x["near_next"] <= 1
    one = spotsigs.with_next(docs.limit(1)).collect()
    assert len(one) == 1 and one[0]["text"] == one[0]["next_text"]
    assert spotsigs.with_next(docs.limit(0)).collect() == []


def plain_signatures(text):
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    found = {
        (w + " " + " ".join([x for x in words[i + 1 :] if x not in spotsigs.ANCHORS][: spotsigs.CHAIN])) for i, w in enumerate(words) if w in spotsigs.ANCHORS
    } or ({" " + (" ".join(words) or text)} if text else set())
    return sorted(hashlib.md5(x.encode()).hexdigest()[: spotsigs.DIGITS] for x in found)


def test_signatures_and_likeness_against_plain_python(spark, rows):
    texts = ["the river bank of green stone walls and so on", "river the", "no words", "", "?!", "the the of a to in for by river flows", "a " * 500 + "house door", *(r[1] or "" for r in rows)]
    df = spotsigs.with_signatures(spark.createDataFrame([(a, b) for a, b in zip(texts, [*texts[1:], texts[0]], strict=True)], "a string, b string"), "a", "x")
    df = spotsigs.with_signatures(df, "b", "y")
    for r in df.select("*", spotsigs.likeness(F.col("x"), F.col("y")).alias("like"), spotsigs.is_near_copy(F.col("x"), F.col("y")).alias("near")).collect():
        x, y = set(plain_signatures(r["a"])), set(plain_signatures(r["b"]))
        like = len(x & y) / len(x | y) if x | y else 1.0
        assert r["x"] == sorted(x) and r["like"] == pytest.approx(like) and r["near"] == (like >= spotsigs.SIMILAR)


def test_next_rows_of_a_hot_key(spark):
    rows = [(k % 3 if k % 3 else None, f"text {k}") for k in range(60)] + [(2, f"hot {k}") for k in range(200)]
    got = {r["text"]: r["next_text"] for r in spotsigs.with_next(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), hashlib.md5(r[1].encode()).hexdigest()))
    assert got == {a[1]: b[1] for a, b in zip(order, [*order[1:], order[0]], strict=True)}


def test_language_id(spark, sf, docs, rows):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.fit(table, ~langid.held_out())
    out = langid.predict(table.withColumn("h", langid.held_out()), model, ["doc_id", "lang", "h"]).where("h").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in table.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    odd = langid.predict(spark.createDataFrame([(None,), ("",), ("12 ?",), ("²",), ("zzz",)], "text string"), model, []).collect()
    assert [r["lang_pred"] == "und" for r in odd] == [True, True, True, True, False] and all(0 <= r["score"] <= 1 for r in odd)
    nothing = langid.fit(table.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}


def test_chat_query_against_plain_python(spark, tmp_path):
    rows = [(1, 0, "user", "hi <turn> \\l \\b </turn>\n"), (1, 1, "assistant", "a\nb"), (1, 2, "assistant", None), (2, 5, None, "x"), (2, 5, None, "x"), (None, None, "system", "\\"), (3, 0, "assi\nstant", "### User: \\n")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {r["conv_id"]: r for r in queries.op9_chat_formatting(spark, folder(spark, tmp_path, conversations=df)).collect()}
    hostile = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", hostile), (-7, 1, "assistant", hostile)]
    assert len(got) == 5
    for conv, r in got.items():
        turns = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(turns), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()


def test_chat_folds_events(spark):
    events = [(1, 0, 1, "message", "user", "q"), (1, 1, 2, "message", "assistant", "par"), (1, 1, 3, "delta", None, "tial"), (1, 1, 4, "regenerate", None, None), (1, 1, 5, "delta", None, "fin"), (1, 1, 6, "delta", None, "al"), (1, 0, 7, "edit", None, "question")]
    df = chat.fold(spark.createDataFrame(events, "conv_id int, turn int, seq int, kind string, role string, text string"))
    assert [(r["role"], r["text"]) for r in df.orderBy("turn").collect()] == [("user", "question"), ("assistant", "final")]


def test_word_pieces_against_greedy_search():
    r = random.Random(2)
    for _ in range(150):
        vocabulary = {"".join(r.choices("abc", k=r.randrange(1, 5))) + r.choice(["", "</w>"]) for _ in range(r.randrange(1, 14))}
        automaton = wordpieces.Automaton(sorted(vocabulary))
        for _ in range(40):
            word = "".join(r.choices("abc", k=r.randrange(1, 12)))
            rest, n = [*word, "</w>"], 0
            while rest:
                size = next((k for k in range(len(rest), 0, -1) if "".join(rest[:k]) in vocabulary), 0)
                if not size:
                    break
                rest, n = rest[size:], n + 1
            assert automaton.count(word) == (1 if rest else n), (vocabulary, word)


def test_token_counts(spark, docs):
    out = wordpieces.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id"]).collect()
    assert len(out) == docs.count() and all(r["n_tokens"] >= r["n_words"] for r in out)


def test_bpe_against_tiktoken(spark, docs, rows):
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.loaded(path, public_tokenizers.PATTERN)
    r = random.Random(1)
    odd = ["".join(r.choice(["é", "世", "\U0001f600", " ", "  ", "\n", "'s", "²", "\x85", "\x1c", "ab", "THE", "7", "퟿"]) for _ in range(r.randrange(30))) for _ in range(300)]
    for text in [*odd, *(x[1] or "" for x in rows), "ab" * 2000, " " * 300]:
        packed = own.encode(text)
        assert np.frombuffer(packed, "<u4").tolist() == reference.encode_ordinary(text)
        assert own.decode(packed).decode() == text
    out = bpe.encode(docs, path, public_tokenizers.PATTERN, ["doc_id"], with_ids=True)
    texts = sorted(x[1] or "" for x in rows)
    assert sorted(x["text"] for x in bpe.decode(out, path, public_tokenizers.PATTERN, ["doc_id"]).collect()) == texts


def test_urls(spark):
    links = "<a href='https://bad.com/x'>b</a><a href=\"http://good.net/\">g</a>"
    pages = [
        (1, "https://example.com/en/71?q", None), (2, "http://A.Example.COM/en/8", ""), (3, "https://x.net/de/", None), (4, "https://example.net/de/81", None), (5, None, links),
        (6, "nothing", links), (7, "ftp://notcom/en/", None), (8, "http://fan.org/fr/#x", "<a href=http://a.example.com/z>x</a>"), (9, "https://x.net?a/b", None), (9, "https://x.net?a/b", None), (10, "http://com/en/", None),
    ]
    out = linkgraph.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), queries.URL_RULES).collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out}
    assert len(out) == len(pages)
    assert got[1] == ("example.com", "/en/71", "example.com/en/7", "allow") and got[2] == ("a.example.com", "/en/8", "com/en/", "block")
    assert got[3] == ("x.net", "/de/", "net/de/", "allow") and got[4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[5] == ("", "", None, "allow") and got[6] == ("", "", None, "allow") and got[7] == ("notcom", "/en/", None, "allow")
    assert got[8] == ("fan.org", "/fr/", None, "block") and got[9] == ("x.net", "", None, "allow") and got[10][2:] == ("com/en/", "block")


def plain_ranks(edges, seeds):
    """Personalised PageRank by power iteration; mass without a way out returns to the seeds."""
    total = sum(seeds.values())
    seeds = {h: x / total for h, x in seeds.items()}
    hosts = set(seeds) | {x for e in edges for x in e[:2]}
    out_of = {s: sum(n for x, _, n in edges if x == s) for s, _, _ in edges}
    ranks = dict(seeds)
    for _ in range(400):
        lost = sum(r for h, r in ranks.items() if h not in out_of)
        ranks = {h: seeds.get(h, 0) * (1 - linkgraph.DAMPING + linkgraph.DAMPING * lost) + linkgraph.DAMPING * sum(ranks.get(s, 0) * n / out_of[s] for s, d, n in edges if d == h) for h in hosts}
    return ranks


def test_page_rank_against_power_iteration(spark):
    edges = [("a", "b", 2), ("a", "c", 1), ("b", "c", 1), ("c", "a", 3), ("c", "sink", 2)]
    chain = [(f"h{k}", f"h{k + 1}", 1) for k in range(30)]  # longer than a few rounds reach
    df = linkgraph.propagate(
        spark.createDataFrame([("x", *e) for e in edges] + [("y", *e) for e in chain], "walk string, src string, dst string, n bigint"),
        spark.createDataFrame([("x", "a", 3.0), ("x", "b", 1.0), ("y", "h0", 2.0)], "walk string, host string, mass double"),
    )
    got = {(r["walk"], r["host"]): r["rank"] for r in df.collect()}
    want = {("x", h): r for h, r in plain_ranks(edges, {"a": 3.0, "b": 1.0}).items()} | {("y", h): r for h, r in plain_ranks(chain, {"h0": 2.0}).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= linkgraph.TOLERANCE for k in want)
    assert sum(r for (w, _), r in got.items() if w == "x") == pytest.approx(1) and got["y", "h30"] > 0


def test_url_verdicts_against_a_plain_graph(spark):
    pages = [
        (1, "https://example.com/en/71", "<a href='//friend.org/x'>a</a><img src=http://cdn.net/i>"), (2, "http://bad.example.com/en/8", "<a href='/in'>b</a>"), (3, "https://fan.info/fr/", "<a href=https://bad.example.com/q>"),
        (4, "https://friend.org/fr/", ""), (5, "http://www.fan.info/x", None), (6, "http://lonely.info/", "<base href='http://friend.org/'>"), (7, "http://cdn.net/", "<link rel=canonical href=http://deep.a.cdn.net/>"), (8, "http://deep.a.cdn.net/fr", ""),
    ]
    edges = {}
    for s, d, n in [("example.com", "friend.org", 1), ("example.com", "cdn.net", 1), ("fan.info", "bad.example.com", 1), ("lonely.info", "friend.org", 1), ("cdn.net", "deep.a.cdn.net", 1)] + [
        e for a, b in [("bad.example.com", "example.com"), ("www.fan.info", "fan.info"), ("deep.a.cdn.net", "a.cdn.net"), ("a.cdn.net", "cdn.net")] for e in ((a, b, 1), (b, a, 1))
    ]:
        edges[s, d] = edges.get((s, d), 0) + n
    edges = [(*e, n) for e, n in edges.items()]
    trust, distrust = plain_ranks(edges, {"example.com": 1}), plain_ranks([(d, s, n) for s, d, n in edges], {"bad.example.com": 1})
    out = linkgraph.judge(spark.createDataFrame(pages, "page_id bigint, url string, html string"), queries.URL_RULES).collect()
    for r in out:
        t, d = trust.get(r["host"], 0), distrust.get(r["host"], 0)
        assert r["links"] > 0 and abs(r["trust"] - t) < 2e-3 and abs(r["distrust"] - d) < 2e-3
        if r["rule"] is None:
            assert r["verdict"] == ("block" if d > 0 and d >= t else "allow")
    assert {r["verdict"] for r in out if r["rule"] is None} == {"allow", "block"}
