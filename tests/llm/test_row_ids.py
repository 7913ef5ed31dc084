import os

from linetrail.llm.common import with_stable_id
from pyspark.sql import functions as F


def test_ids_do_not_depend_on_splits(spark, tmpdir_path):
    path = os.path.join(tmpdir_path, "docs.parquet")
    docs = spark.range(40_000).selectExpr("id as doc_id", "sha2(string(id), 512) as text", "'mine' as _metadata").repartition(2)
    docs.write.option("parquet.block.size", 64 << 10).parquet(path)

    def ids(df, size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            read = df.select("doc_id", "rid")
            return read.rdd.getNumPartitions(), {r.doc_id: r.rid for r in read.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    files = spark.read.parquet(path)
    for source in (files, files.select("doc_id", "text").where("doc_id >= 0"), docs, spark.read.parquet(path, path)):
        df = with_stable_id(source, "test-docs")
        (few, one), (many, other) = ids(df, "128m"), ids(df, "200k")
        assert many > few and one == other and len(one) == 40_000
        assert df.columns == [*source.columns, "rid"] and df.select("rid").distinct().count() == source.count()


def test_names_of_helpers_pass_through(spark, tmp_path):
    from linetrail.llm import line_dedup, ngram_join
    names = ["_rid", "_maybe", "_gone", "_bucket", "_bits", "_rid_path", "_rid_place", "_rid_file", "_rid_at"]
    docs = spark.createDataFrame([(1, "one line of text that repeats\nand one"), (2, "one line of text that repeats"), (3, "other words stand in this one")], "doc_id long, text string")
    docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names}).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for got in (ngram_join.keep_one(docs), with_stable_id(docs, "x"), line_dedup.dedup_lines(docs)):
        rows = got.collect()
        assert {r.doc_id for r in rows} == {1, 2, 3} and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert {r.doc_id: r.n_dropped for r in rows} == {1: 0, 2: 1, 3: 0}
