import corpus_pipeline
from sparkwright.llm.jaccard import one_of_each
from sparkwright.llm.language_id import recognised

from .helpers import documents, empty, frame
from .test_jaccard import brute


def test_one_document_of_each_group_stays(spark):
    rows = documents()
    df = frame(spark, rows)
    got = one_of_each(df)
    assert got.columns == df.columns
    groups = brute(rows)
    n = {}
    for doc_id, size, component in groups:
        if size:
            n.setdefault(component, set()).add(doc_id)
    kept = [(r["doc_id"], r["text"]) for r in got.collect()]
    without = [r for r in rows if not (r[1] or "").split()]
    lonely = [r for r in rows if r[0] is None]
    assert len(kept) == len({c for c in n if c is not None}) + len(without) + len(lonely)
    assert {c for c in n if c is not None} <= {k[0] for k in kept}
    assert one_of_each(empty(spark)).count() == 0


def test_columns_of_any_name_pass(spark):
    rows = [(1, "a b c d e f", 1, 2, 3.5), (2, "a b c d e f", 1, 2, 3.5), (2, "a b c d e f", 1, 2, 3.5), (3, "g h i j k", 1, 2, 3.5), (4, None, 1, 2, 3.5)]
    out = one_of_each(spark.createDataFrame(rows, "doc_id long, text string, __of int, own_0 int, `a.b` double"))
    assert out.columns == ["doc_id", "text", "__of", "own_0", "a.b"]
    assert sorted((r["doc_id"], r["__of"], r["own_0"], r["a.b"]) for r in out.collect()) == [(1, 1, 2, 3.5), (3, 1, 2, 3.5), (4, 1, 2, 3.5)]


def test_texts_of_no_language_go_and_others_stay(spark):
    rows = [r for s in range(6) for r in documents(s)]
    rows = [(None if r[0] is None else r[0] + 1000 * (k // 90), *r[1:]) for k, r in enumerate(rows)] + [(10**6, "qwrtzp " * 200, None, "s"), (10**6 + 1, "$$$ 12", "en", "s")]
    got = recognised(frame(spark, rows), 0.5)
    assert got.columns == frame(spark, rows).columns
    ids = {r["doc_id"] for r in got.collect()}
    assert not ids & {10**6, 10**6 + 1}
    good = {r[0] for r in rows if r[1] and len(r[1]) > 100 and "xxxx" not in r[1] and r[0] is not None and r[0] < 10**6}
    assert good <= ids


def test_stages(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 977}x" for j in range(60)), "en", f"s{i % 3}") for i in range(30)]
    rows += [(100 + i, rows[i][1], "en", "s1") for i in range(5)] + [(200, "!!! 123", "en", "s1"), (201, None, None, None)]
    words = " ".join(f"secret{j}" for j in range(20))
    rows.append((300, rows[0][1][:100] + words, "en", "s2"))
    frame(spark, rows).select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) as n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        docs = out
    ids = {r["doc_id"] for r in docs.collect()}
    assert ids and ids <= set(range(30))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == ids and len(got) == docs.count()
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def pipeline_over(spark, path, rows, items):
    frame(spark, rows).select("doc_id", "text", "lang", "source").selectExpr("*", "length(text) as n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return corpus_pipeline.run(spark, str(path)).collect()


def test_no_documents_and_no_benchmark(spark, tmp_path):
    assert pipeline_over(spark, tmp_path, [], []) == []


def test_documents_without_any_lang_pass(spark, tmp_path):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 977}x" for j in range(60)), None, "s") for i in range(12)]
    got = pipeline_over(spark, tmp_path, [*rows, (50, None, None, None), (3, *rows[3][1:])], [])
    assert {r["doc_id"] for r in got} == set(range(12))  # a source without words has none to give to the mix
