"""The pipeline's stages, each against a plain version on its own input."""

import collections

from tests.conftest import SMALL
from tests.llm.test_operators import SCHEMA, check_packing, odd_rows, plain_components

import corpus_pipeline
from tileforge.llm import common, licenses, quality


def test_stages(spark, tmp_path):
    docs = common.table(spark, SMALL, "documents")
    columns, taken = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out = spark.read.parquet(path)
        taken[name] = (docs, out)
        docs = out
    before, after = taken["quality"]
    labels = common.table(spark, SMALL, "labels")
    judged = quality.judge(before, quality.calibrate(before, labels)).collect()
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in judged if r.kept} and after.columns == columns

    before, after = taken["exact_dedup"]
    groups = collections.defaultdict(list)
    for r in before.collect():
        groups["".join(c for c in r.text if c not in " \t\n\x0b\f\r")].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in after.collect()} == {min(g)[1] for g in groups.values()}

    before, after = taken["near_dedup"]
    want = plain_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert {r.doc_id for r in after.collect()} == {c for _, _, c, _ in want}

    before, after = taken["mix"]
    times = collections.Counter(r.doc_id for r in after.collect())
    assert max(times.values()) <= 3 and after.columns == columns
    words = {r.doc_id: len(r.text.split()) for r in before.collect()}
    assert sum(words[i] * n for i, n in times.items()) <= sum(words.values())

    before, after = taken["pack"]
    check_packing(after.collect(), [(r.doc_id, r.text) for r in before.collect()])


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_run_on_odd_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, very long texts, columns with the names of the operators' own, and no rows at all."""
    long = " ".join(f"word{i} of" for i in range(4000))
    more = [(100 + i, f"text {i} " + " ".join(f"w{(i * 7 + k) % 901}" for k in range(90)), None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 2}", 0, "r", 7, *["c"] * 4) for i in range(60)]
    odd = [*odd_rows(), *more, more[0], more[1], (200, long, None, None, None, *[None] * 6), (201, long + " end", None, None, None, *[None] * 6)]
    for name, rows in (("odd", odd), ("empty", [])):
        folder = tmp_path / name
        spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, None, None), (None, 1, 0)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        docs = common.table(spark, str(folder), "documents")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            path = str(folder / stage_name)
            stage(spark, docs, str(folder)).write.parquet(path)
            before, docs = docs, spark.read.parquet(path)
            assert docs.columns == before.columns
        out = corpus_pipeline.pack_stage(spark, docs, str(folder)).collect()
        check_packing(out, [(r.doc_id, r.text) for r in docs.collect()]) if rows else None
        assert bool(out) == bool(rows) and corpus_pipeline.run(spark, str(folder)).count() == len(out)
        kept = {r.doc_id for r in docs.collect()}
        assert not rows or (len({200, 201} & kept) <= 1 and kept & set(range(100, 160)) and 1 not in kept)


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "the text of a page under the mit license", "en", "kept", "too", "and this")], "doc_id long, text string, lang string, _words string, _known string, _lines string")
    for out in (licenses.scan(docs), quality.judge(docs, quality.calibrate(docs, spark.createDataFrame([], "doc_id long, quality int")))):
        r = out.first()
        assert (r._words, r._known, r._lines) == ("kept", "too", "and this") and set(docs.columns) <= set(out.columns)
