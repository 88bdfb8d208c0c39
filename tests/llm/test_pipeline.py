"""The pipeline's stages against brute force on a small corpus."""

import hashlib
import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm import bpe

R = random.Random(9)
WORDS = ["".join(R.choices("abcdefgh", k=R.randint(2, 7))) for _ in range(600)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def test_pipeline(spark, tmp_path):
    item = prose(30)
    rows = [(i, prose(60)) for i in range(150)]
    toxic = {i for i in range(150) if i % 5 == 1}
    rows = [(i, t + " idiot moron" if i in toxic else t) for i, t in rows]
    copies = {200 + i: rows[i][1] for i in range(0, 50, 10)}
    leak, secret = (300, prose(20) + " " + item + " " + prose(20)), (301, prose(30) + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" ' + prose(30))
    rows += [*copies.items(), leak, secret]
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    text = dict(rows)
    text[301] = text[301].replace('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962', "[SECRET]")
    want = {i for i in text if i not in toxic and i not in copies and i != 300}
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    assert set(got) == want
    assert all(got[i] == hashlib.sha256(",".join(map(str, enc.encode_ordinary(text[i]))).encode()).hexdigest() for i in want)


def test_stages_keep_the_columns(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c d e", "en", "s", 9)], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 1, name
        assert stage(spark, docs.limit(0), str(tmp_path)).select(F.count("*")).first()[0] == 0, name


def test_odd_rows_go_through_the_whole_pipeline(spark, tmp_path):
    item, long = prose(40), prose(9000)
    rows = [(i, prose(60)) for i in range(60)]
    rows = [(i, t + " idiot moron" if i % 5 == 1 else t) for i, t in rows]
    odd = [(100, None), (101, ""), (102, " \n"), (None, prose(30)), (None, None), (103, rows[0][1]), (103, rows[0][1]), (104, long), (105, long + " end"), (106, long + " " + item), (107, "é" * 4000), (107, None)]
    sf = str(tmp_path)
    table = [(i, t, None if i is None else "en", None, len(t) if t else None, "x", 7) for i, t in rows + odd]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, words string, c1 int").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 5 == 1)) for i in range(60)] + [(None, 1, 1), (100, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(0, item), (1, None), (2, ""), (None, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.dtypes == docs.dtypes, name
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect())
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    count = lambda t: len(enc.encode_ordinary(t or ""))
    # toxic ones go; of copies the least id stays (103 is a copy of 0, 105 one of 104); 106 leaks
    want = [(False, i, count(t)) for i, t in rows if i % 5 != 1]
    want += [(False, i, count(t)) for i, t in odd if i in (100, 101, 102, 104)] + [(True, 0, count(t)) for i, t in odd if i is None]
    one = [x for x in got if x[1] == 107]
    assert len(one) == 1 and one[0][2] in (0, count("é" * 4000))  # rows of one id are one document
    assert [x for x in got if x[1] != 107] == sorted(want)
