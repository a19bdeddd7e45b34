"""The corpus pipeline's stages on small cases."""

import re

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from tracklens.llm import decontaminate, langid  # noqa: E402


def test_ngram_jaccard_drops_near_copies_of_five_words_and_80_percent(spark):
    words = [f"w{k}" for k in range(100)]
    near = [*words[:30], "changed", *words[31:70], "too", *words[71:]]  # 86 / 106 = 0.81 at five words, 89 / 105 = 0.848 at four
    far = [*words[:20], "a", *words[21:50], "b", *words[51:80], "c", *words[81:]]  # 81 / 111 = 0.73 at five words
    texts = [words, near, [w + "x" for w in words], [w + "y" for w in words], [w + "y" for w in far]]
    docs = spark.createDataFrame([(k, " ".join(t), "en", "s", 0) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, "").collect()) == [0, 2, 3, 4]


EXTRA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, lang_pred string, n_tokens int, __text string, __row int, component_id string"


@pytest.fixture(scope="module")
def awkward(spark):
    long = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    texts = [(1, long), (1, "the house by the river was green and old and quiet"), (2, long), (2, long), (3, None), (4, ""), (5, "12 ?!"), (None, "the stone walls of the old house fall in the river"), (None, "the stone walls of the old house fall in the river"), (6, "la casa verde de la calle vieja con el rio y la luna"), (7, "the house of words " * 20_000)]
    return spark.createDataFrame([(i, t, "en", "s", 0, 0.5, "x", 7, "y", k, "z") for k, (i, t) in enumerate(texts)], EXTRA)


def test_language_stage_keeps_columns_and_drops_what_has_no_letter(spark, awkward):
    out = corpus_pipeline.language_id(spark, awkward, "")
    assert out.columns == awkward.columns and out.dtypes == awkward.dtypes
    assert sorted(r["__row"] for r in out.collect()) == [0, 1, 2, 3, 7, 8, 9, 10]


def test_jaccard_stage_tells_repeated_ids_apart(spark, awkward):
    out = corpus_pipeline.ngram_jaccard(spark, awkward, "")
    kept = [r["__row"] for r in out.collect()]
    assert out.columns == awkward.columns
    # Of the copies 0, 2, 3 the least id stays, with the other text of its id; of the copies without id one; texts without words all.
    assert {0, 1, 4, 5, 6, 9, 10} <= set(kept) and not {2, 3} & set(kept) and len({7, 8} & set(kept)) == 1 and len(kept) == 8


def test_last_stages_on_awkward_rows(spark, awkward, sf):
    out = corpus_pipeline.decontamination(spark, awkward, sf)
    assert out.count() == awkward.count() and out.columns == awkward.columns
    ids = corpus_pipeline.byte_bpe(spark, awkward, sf)
    assert ids.count() == awkward.count() and {"score", "lang_pred", "__row", "n_tokens", "ids"} <= set(ids.columns)


def test_stages_on_an_empty_table(spark, awkward, sf):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, awkward.limit(0), sf).count() == 0


def test_pipeline_against_its_stages_by_brute_force(spark, sf):
    """Kept ids of the whole run: no two near copies, each dropped document is explained."""
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").collect()}
    assert kept and kept <= set(docs)

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0d]+", (text or "").lower())
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} if words else set()

    sets = {k: shingles(t) for k, t in docs.items()}
    alike = lambda a, b: a and b and 100 * len(a & b) >= 80 * len(a | b)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(sets[a], sets[b])]
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet"), ~langid.held_out())
    told = {k: model.predict(t, {}) for k, t in docs.items()}
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    dirty = {r[0] for r in decontaminate.find(spark.read.parquet(f"{sf}/documents.parquet"), bench).collect()}
    for k in set(docs) - kept:
        foreign = told[k][0] == langid.UNDETERMINED or told[k][1] < corpus_pipeline.LEAST_SCORE
        assert foreign or k in dirty or any(j < k and alike(sets[k], sets[j]) for j in docs), k
