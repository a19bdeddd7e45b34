"""Sentence pieces against the sentencepiece library: ids, decoding, odd texts, whole query."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tracklens.llm import pieces, queries

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")

ODD = ["", " ", "   ", "a", " a ", "a▁b", "▁▁▁", "a  b   c    d" * 9, "\n\n\t", "x\x00y", "<s> </s> <0x41> <unk>", "don't stop—now… 3.14 ², ½", "漢字かな交じり文", "한국어 문장", "👩‍👩‍👧 \U0001f600x", "é é ｆｕｌｌ", "�", "=" * 300, "ab" * 5000, "²." * 9, " ".join("z" * k for k in range(70))]


@pytest.fixture(scope="module")
def both():
    return pieces.loaded(PATH)


def test_ids_and_texts_as_the_library(both):
    own, library = both
    rng = random.Random(5)
    signs = "ab et  ▁.,'\n0²éжт漢ก👍́\x07" + "".join(map(chr, range(0x4E00, 0x4E20)))
    texts = ODD + ["".join(rng.choices(signs, k=rng.randint(1, 200))) for _ in range(400)]
    for text in texts:
        ids = library.encode(text, add_eos=True)
        assert own.encode(text) == ids, text
        assert own.decode(ids) == library.decode(ids), text
        whole = " " + text.replace("▁", " ") if text else ""
        assert own.merge(whole) + [own.end] == ids, text  # the parts change nothing
    assert own.agrees(library)


def test_decodes_any_ids_as_the_library(both):
    own, library = both
    rng = random.Random(6)
    for _ in range(500):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 12))]
        assert own.decode(ids) == library.decode(ids), ids


def test_parts_that_differ_are_told(both):
    own, library = both
    own.fresh.append((" house", [5]))
    assert not own.agrees(library) and own.agrees(library)


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces(b"\x12\x02\x18\x01")


def test_query_over_whole_documents(spark, sf, both):
    library = both[1]
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op13_sentence_pieces(spark, sf).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), True)


def test_nulls_repeats_empty_tables_and_names(spark):
    docs = spark.createDataFrame([(1, None, "en"), (2, "a b", "en"), (2, "a b", "en"), (None, "x" * 100_000, None)], "doc_id bigint, text string, lang string").withColumns({"n_tokens": F.lit(1), "__text": F.lit("x")})
    rows = pieces.encode(docs, PATH, ["doc_id", "lang"], with_ids=True)
    found = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in rows.collect())
    assert found[1:] == [(1, 1), (2, 3), (2, 3)] and found[0][1] > 1000
    back = {r["doc_id"]: r["text"] for r in pieces.decode(rows, PATH, ["doc_id"]).collect()}
    assert back == {1: "", 2: "a b", None: "x" * 100_000}
    assert pieces.encode(docs.limit(0), PATH, ["doc_id"]).count() == 0
    for name in ("n_tokens", "__text"):
        with pytest.raises(ValueError):
            pieces.encode(docs, PATH, [name])
