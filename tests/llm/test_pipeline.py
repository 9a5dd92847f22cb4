import pytest
from tests.llm.test_near import brute
from tests.llm.test_packing import best_fit, verify

import corpus_pipeline as c
from loomwright.llm import language, mixing, toxicity
from loomwright.llm.packing import CAPACITY
from loomwright.session import materialize, table


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_on_its_own_input(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns = docs.columns
    assert [n for n, _ in c.STAGES] == ["toxicity", "language", "near_duplicates", "mixing", "packing"]
    for name, stage in c.STAGES[:-1]:
        out = materialize(spark, stage(spark, docs, tiny))
        assert out.columns == columns
        before, after = rows_of(docs), rows_of(out)
        if name == "toxicity":
            model = toxicity.Model(*toxicity.fit(docs, table(spark, tiny, "labels")))
            want = [r for r in before if round(toxicity.noisy_or([x[2] for x in model.scores(r[1])]), 9) < 0.5]
        elif name == "language":
            model = language.fit(docs)
            want = [r for r in before if not model.classify([r[1]])[0][2]]
            assert len(want) >= 0.98 * len(before)
        elif name == "near_duplicates":
            roots = brute([r[:2] for r in before], c.NEAR_PERCENT)  # the stage links from 80, op1 from 85
            want = [r for r, (d, _, root) in zip(before, roots, strict=True) if d == root]
        else:
            chosen = {r.doc_id for r in mixing.sample(spark, docs).where("sampled").collect()}
            want = [r for r in before if r[0] in chosen]
        assert after == want and after
        docs = out
    verify(c.STAGES[-1][1](spark, docs, tiny).collect(), [r[:2] for r in rows_of(docs)], lambda n: best_fit(n, CAPACITY))


@pytest.fixture
def folder(spark, tmp_path):
    hard = [(1, "a fine day for a walk in the park", "en", "s", 3, "more"), (1, "a fine day for a walk in the park", "en", "s", 3, "more"), (2, None, None, None, None, None), (None, "some words without a number here", "en", "s", 1, "x"), (3, "", "en", "s", 0, "x")]
    spark.createDataFrame(hard, "doc_id long, text string, lang string, source string, n_chars long, `_mix_rate` string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return f"file://{tmp_path}"


def test_texts_of_one_id_are_not_lost(spark, folder):
    rows = [(1, "a fine day for a walk in the park", "en", "s", 1, "x"), (1, "quite another text under the same number", "en", "s", 2, "x"), (1, "quite another text under the same number", "en", "r", 2, "x"), (2, "a fine day for a walk in the park", "en", "s", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_row` string")
    out = c.drop_near_duplicates(spark, docs, folder).collect()
    assert sorted(map(tuple, out)) == sorted([rows[0], rows[2]])


def test_hard_rows(spark, folder):
    docs = table(spark, folder, "documents")
    out = c.drop_toxic(spark, docs, folder)
    assert out.count() == 5
    out = materialize(spark, c.keep_known_languages(spark, out, folder))
    assert {r.doc_id for r in out.collect()} == {1, None}
    out = materialize(spark, c.drop_near_duplicates(spark, out, folder))
    assert sorted(str(r.doc_id) for r in out.collect()) == ["1", "None"]
    assert {r.doc_id for r in c.pack(spark, out, folder).collect()} == {1, None}
    assert all(stage(spark, docs.limit(0), folder).count() == 0 for _, stage in c.STAGES)
