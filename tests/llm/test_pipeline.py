from collections import Counter

import corpus_pipeline as cp
from wardline.llm import langid
from wardline.llm.common import table
from tests.conftest import SF_SMALL
from tests.llm.test_mixing import words
from tests.llm.test_near_dup import brute
from tests.llm.test_pii import plain_base
from tests.llm.test_tokens import check_packing


def through(spark, docs):
    """Every stage's stored result, by name."""
    out = {"documents": docs}
    for name, stage in cp.STAGES:
        path = cp.shared_folder(spark, f"test-{name}")
        stage(spark, docs, SF_SMALL).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def test_stages_take_effect(spark):
    docs = table(spark, SF_SMALL, "documents")
    junk = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "123 !!! 456", "en", "src0", 11)], docs.schema)
    path = cp.shared_folder(spark, "test-in")
    docs.union(junk).write.parquet(path)
    at = through(spark, spark.read.parquet(path))
    rows = {k: v.collect() for k, v in at.items()}
    for name in list(at)[:-1]:
        assert at[name].columns == docs.columns
    assert {r.doc_id for r in rows["documents"]} - {r.doc_id for r in rows["language"]} == {10_000, 10_001}
    groups = {d: c for d, _, c, _ in brute([(r.doc_id, r.text) for r in rows["language"]], 80)}
    kept = [groups[r.doc_id] for r in rows["near_duplicates"]]
    assert sorted(kept) == sorted(set(groups.values()))
    assert not any(plain_base(r.text) for r in rows["personal_data"])
    before = {r.doc_id: r.text for r in rows["near_duplicates"]}
    assert all(r.text == before[r.doc_id] for r in rows["personal_data"] if not plain_base(before[r.doc_id]) and "<" not in r.text)
    sizes, mixed = Counter(), Counter()
    for r in rows["personal_data"]:
        sizes[r.source] += words(r.text)
    for r in rows["mixing"]:
        mixed[r.source] += words(r.text)
    assert abs(sum(mixed.values()) - 1.5 * sum(sizes.values())) <= len(sizes)
    assert all(mixed[s] <= 2 * sizes[s] for s in sizes)
    check_packing([(r.doc_id, r.text) for r in rows["mixing"]], rows["packing"], 1024)


def test_edges(spark, edge_docs, no_docs):
    path = cp.shared_folder(spark, "test-in")
    edge_docs.write.parquet(path)
    at = through(spark, spark.read.parquet(path))
    assert {r.doc_id for r in at["language"].collect()} >= {None, 9, 11, 12, 13, 14}
    assert at["near_duplicates"].where("doc_id in (11, 12, 13)").count() == 1
    assert at["near_duplicates"].where("doc_id = 14").count() == 1
    empty = cp.shared_folder(spark, "test-in")
    no_docs.write.parquet(empty)
    assert through(spark, spark.read.parquet(empty))["packing"].count() == 0


def test_threshold_keeps_learned_languages(spark):
    docs = table(spark, SF_SMALL, "documents")
    got = langid.predict(docs, langid.learn(docs)).where(f"score < {cp.MIN_LANGUAGE_SCORE}").count()
    assert got == 0


def test_groups_stay_when_files_are_packed_anew(spark, monkeypatch):
    """Between the reads of the stage Spark packs the files into other
    partitions, as after the loss of an executor."""
    path = cp.shared_folder(spark, "test-in")
    rows = [(i, f"text number {i // 2} of many that stand here twice each {i // 2}", "en", "s", 50) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(16, "doc_id").write.parquet(path)
    conf, names, real = spark.conf, ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"), cp.near_duplicates
    before = {n: conf.get(n) for n in names}

    def packed_anew(*args, **options):
        out = real(*args, **options)
        conf.set(names[0], "1")
        conf.set(names[1], "1g")
        return out

    monkeypatch.setattr(cp, "near_duplicates", packed_anew)
    try:
        conf.set(names[0], "1g")
        kept = [r.doc_id for r in cp.near_duplicate_groups(spark, spark.read.parquet(path), "").collect()]
    finally:
        for n, v in before.items():
            conf.set(n, v)
    assert sorted(i // 2 for i in kept) == list(range(32))


LANGUAGES = {"en": "the river runs down from the hills and through the old town", "de": "der fluss läuft aus den bergen durch die alte stadt",
             "fr": "la rivière descend des collines et traverse la vieille ville", "es": "el río baja de las colinas y cruza la ciudad vieja",
             "it": "il fiume scende dalle colline e attraversa la città vecchia"}


def _language_stage(spark, rows):
    path = cp.shared_folder(spark, "test-in")
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(path)
    return {r.doc_id for r in cp.language(spark, spark.read.parquet(path), "").collect()}


def test_code_switched_texts_stay(spark):
    rows = [(i, t, k) for i in range(0, 200, 5) for n, (k, t) in enumerate(LANGUAGES.items()) for i in [i + n]]
    mixed = " ".join(LANGUAGES.values())
    more = [(1000, mixed, None), (1001, "ok", None), (1002, "река течёт с холмов через старый город", None), (1003, "12 !!!", None),
            (1004, "the name 東京 stands here in an english text", None)]
    field = langid.fit([(t, k) for _, t, k in rows])
    assert langid.Labeller(field).predict([mixed])[1][0] < 0.4
    assert _language_stage(spark, rows + more) == {i for i, _, _ in rows} | {1000, 1001, 1004}


def test_without_labels_texts_stay(spark):
    rows = [(1, "some words", None), (2, None, None), (3, "река", None), (4, "12 !!!", None)]
    assert _language_stage(spark, rows) == {1, 3}


def test_columns_of_any_name_stay(spark, edge_docs):
    names = ["lang_pred", "score", "_row", "spans", "_copy", "_taken", "_written", "kept", "digest"]
    docs = edge_docs.selectExpr("*", *[f"'{n}' AS `{n}`" for n in names])
    path = cp.shared_folder(spark, "test-in")
    docs.write.parquet(path)
    at = through(spark, spark.read.parquet(path))
    plain_path = cp.shared_folder(spark, "test-in")
    edge_docs.write.parquet(plain_path)
    plain = through(spark, spark.read.parquet(plain_path))
    for stage in ("language", "near_duplicates", "personal_data", "mixing"):
        rows = at[stage].collect()
        assert at[stage].columns == docs.columns and all(r[n] == n for r in rows for n in names)
        assert sorted(str(r.text) for r in rows) == sorted(str(r.text) for r in plain[stage].collect())
    assert at["packing"].count() == plain["packing"].count()


def test_rows_that_share_an_id_do_not_multiply(spark):
    from wardline.llm.near_dup import near_duplicates

    docs = [(None if i % 2 else 7, f"text {i} " + " ".join(f"w{(i * 7 + k) % 97}" for k in range(30))) for i in range(60)] * 2
    rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(rows) == 120 and all(r.n_shingles > 0 for r in rows)
