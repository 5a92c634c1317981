"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns: each query keeps its contract."""

import pytest

from heliograin.llm import registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, body string, size double, component string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
TEXTS = [None, "", "  \n\t ", "one", "12 34 %%", LONG, "Ab cd. " * 50, "Ab cd. " * 50, "İstanbul Straße ΑΣ 中文   x", "<b>&amp;</b>", "a\x0bb\x0cc\x1cd"]


def rows():
    made = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}", None, "x", "y", 1.5, "z") for i, t in enumerate(TEXTS)]
    return made + [made[6], made[1]]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    tables = {
        "documents": (rows(), DOCS),
        "benchmark": ([(1, None, "q"), (2, "", "q"), (3, "Ab cd. " * 4, "q"), (3, "one", "q"), (4, "zz yy xx", "q")], "item_id long, text string, item string"),
        "pages": ([(1, None, None, "t"), (2, "http://a.b/c", "", "t"), (3, "::", "<p>x <i>y</i>&nbsp;z<br>w<p>", "t"), (3, "http://a.b/c", "<article>" + "<div>" * 400 + "deep &lt; <script>no</script>", "t")], "page_id long, url string, html string, text string"),
        "labels": ([(3, 1, 0, "x"), (6, 0, 0, "x"), (None, 1, 1, "x"), (7, None, 0, "x")], "doc_id long, quality int, toxic int, text string"),
        "conversations": ([(1, None, None, None, "k"), (1, 2, "user", LONG, "k"), (1, 2, "user", LONG, "k"), (None, 1, "", "x", "k")], "conv_id long, turn long, role string, text string, kind string"),
        "embeddings": (
            [(1, None, 1, "d"), (2, [], 1, "d"), (3, [0.0, 0.0], 1, "d"), (4, [1.0, None], 1, "d"), (5, [float("nan"), 1.0], 1, "d"), (6, [1.0, 1.0], None, "d")]
            + [(7, [1.0, 1.0], 1, "d"), (8, [2.0, 2.0], 1, "d"), (9, [1.0, 1.01, 0.0], 1, "d"), (10, [1.0, 1.0], 2, "d"), (7, [1.0, 1.0], 1, "d")],
            "vec_id long, embedding array<float>, label int, digest string",
        ),
    }
    for name, (found, schema) in tables.items():
        spark.createDataFrame(found, schema).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], schema).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_edge_rows_and_empty_tables(spark, folders, name):
    got = registry.QUERIES[name](spark, folders[0]).collect()
    one_for_each = {"op1": 4, "op3": 11, "op13": 2}.get(name.split("_")[0], len(rows()))
    if name.split("_")[0] not in ("op5", "op7", "op11"):
        assert len(got) == one_for_each
    assert registry.QUERIES[name](spark, folders[1]).count() == 0


def test_embedding_edges(spark, folders):
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in registry.QUERIES["op3_embedding_dedup"](spark, folders[0]).collect())
    assert got == [(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 2, 7), (7, 2, 7), (8, 2, 7), (9, 0, 9), (10, 0, 10)]


def test_page_edges(spark, folders):
    got = {(r.page_id, r.text) for r in registry.QUERIES["op1_html_extraction"](spark, folders[0]).collect()}
    assert got == {(1, ""), (2, ""), (3, "x y z w"), (3, "deep <")}


def test_decontamination_edges(spark, folders):
    got = {(r.doc_id, r.item_id) for r in registry.QUERIES["op5_decontamination"](spark, folders[0]).collect()}
    assert got == {(3, 3), (6, 3), (7, 3)}


def test_language_edges(spark, folders):
    got = {r.doc_id: (r.lang_pred, r.score) for r in registry.QUERIES["op4_language_id"](spark, folders[0]).collect()}
    assert all(got[k] == ("und", 0.0) for k in (0, 1, 2, 4)) and got[6][0] == "en"


def test_simhash_and_tokens_of_edges(spark, folders):
    prints = {r.doc_id: r for r in registry.QUERIES["op6_simhash_dedup"](spark, folders[0]).collect()}
    assert {prints[k].fingerprint for k in (0, 1, 2)} == {"0" * 16} and prints[2].component_id == 0 and prints[7].component_id == 6
    tokens = sorted((r.start, r.n_tokens) for r in registry.QUERIES["op10_token_store"](spark, folders[0]).collect())
    assert [a for a, _ in tokens] == [sum(n for _, n in tokens[:k]) for k in range(len(tokens))]


def test_pipeline_stages_on_edge_and_empty_tables(spark, folders):
    import corpus_pipeline
    from heliograin.llm import common

    for folder in folders:
        docs = common.table(spark, folder, "documents")
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, folder)
            found = got.collect()
            if name != "token_store":
                assert got.columns == docs.columns
            assert len(found) <= 3 * docs.count() and (found == []) >= (docs.count() == 0)
    assert corpus_pipeline.run(spark, folders[0]).count() > 0


def test_stages_keep_rows_without_an_id(spark):
    from heliograin.llm import simhash_dedup, source_mixing

    rows = [(None, f"some text of its own number {i} and so on", "s") for i in range(6)] + [(None, "some text of its own number 0 and so on", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert sorted(r.text for r in simhash_dedup.keep_first(docs).collect()) == sorted({t for _, t, _ in rows})
    assert source_mixing.mix(docs).count() == 7
