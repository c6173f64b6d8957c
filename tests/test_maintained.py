from pyspark.sql import functions as F

from gapengine.operators import catalogue as cat, index as ix, segments as seg
from gapengine.sources.files import file_kind, scan
from gapengine.sources.tabular import ROW_SCHEMA, read_split_exports, rows_reader, rows_to_tests


def _same_as_built_anew(spark, path, docs):
    terms = ix.doc_terms(docs)
    corpus = ix.corpus_stats(docs, terms)
    postings, sizes, stats = seg.segment_terms(spark, path)
    plain = lambda df, *cols: sorted(map(repr, df.select(*cols).collect()))
    assert plain(postings, "doc_id", "term", "tf", "doc_length") == plain(terms, "doc_id", "term", "tf", "doc_length")
    assert plain(sizes, "n_docs", "avg_length") == plain(corpus, "n_docs", "avg_length")
    cols = ["term", "df", F.round("idf", 9), "is_distinctive"]
    assert plain(stats, *cols) == plain(ix.term_stats(terms, corpus), *cols)
    raw = ix.raw_buckets(ix.weighted_features(docs))
    buckets, idf = seg.segment_buckets(spark, path)
    assert plain(buckets, "doc_id", "bucket", F.round("raw", 9)) == plain(raw, "doc_id", "bucket", F.round("raw", 9))
    assert plain(idf, "bucket", F.round("idf", 9)) == plain(ix.bucket_idf(raw, corpus), "bucket", F.round("idf", 9))


def test_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = lambda rows: spark.createDataFrame(rows, "segment string, doc_id string, text string")
    plain = lambda rows: docs(rows).select("doc_id", "text")
    seg.create_segments(spark, path)
    assert seg.live_segments(spark, path).count() == 0
    a = [("a", "a/1", "retry payment timeout timeout"), ("a", "a/2", "discount limit"), ("a", "a/3", "")]
    b = [("b", "b/1", "payment refused twice"), (None, "x/1", "timeout of the discount service")]
    seg.load_segments(docs(a + b), path)
    _same_as_built_anew(spark, path, plain(a + b))
    a = [("a", "a/1", "retry payment"), ("a", "a/9", "discount limit exceeded")]
    seg.load_segments(docs(a), path)
    _same_as_built_anew(spark, path, plain(a + b))
    seg.drop_segments(spark.createDataFrame([(None,), ("nobody",)], "segment string"), path)
    _same_as_built_anew(spark, path, plain(a + b[:1]))
    seg.drop_segments(spark.createDataFrame([(None,)], "segment string"), path)  # gone already
    seg.compact_segments(spark, path)
    assert seg.live_segments(spark, path).select("version").distinct().count() == 1
    _same_as_built_anew(spark, path, plain(a + b[:1]))
    # Files of a load that never reached the manifest change nothing.
    spark.createDataFrame([("b", "b/1", "lost", 1, 1)], "segment string, doc_id string, term string, tf bigint, doc_length bigint").write.parquet(f"{path}/postings/version=99")
    _same_as_built_anew(spark, path, plain(a + b[:1]))


def test_split_exports(spark, tmp_path):
    long = "x" * 200_000
    lines = ["ID,Title,Shelf,Module,Steps"] + [f'T-{i},"pays, {i}",{i},desk,"step ""{i}"""' for i in range(120_000)]
    lines[500:500] = [f"T-long,{long},1,desk,go", "T-bad,too,many,cells,in,here", "T-few,short", ",,,,"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.tsv").write_text("ID\tTitle\tShelf\tModule\tSteps\nno\tno\tno\tno\tno\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = read_split_exports(spark, str(tmp_path), ["ID", "Title", "Shelf", "Module", "Steps"], names="*.csv")
        assert rows.rdd.getNumPartitions() > 3
        got = rows.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 120_004 and len({r.row_no for r in got}) == len(got) and {r.source for r in got} == {"a.csv"}
    assert {r.id for r in got if r.issue} == {"T-bad", "T-few"}
    assert next(r for r in got if r.id == "T-long").name == long
    assert next(r for r in got if r.id == "T-7").name == "pays, 7" and next(r for r in got if r.id == "T-7").scenario == 'step "7"'
    placed = [r.id for r in sorted(got, key=lambda r: r.row_no) if not r.issue and r.id and r.id != "T-long"]
    assert placed == [f"T-{i}" for i in range(120_000)]


def test_cells_of_any_length(spark, tmp_path):
    (tmp_path / "long.csv").write_text("ID,Title\nA,one\nB," + "y" * 200_000 + "\nC,three\nD,four\n")
    rows = scan(spark, str(tmp_path)).select("path", "content").mapInPandas(rows_reader(10), ROW_SCHEMA).collect()
    assert [(r.id, len(r.name), r.issue) for r in rows] == [("A", 3, None), ("B", 200_000, None), ("C", 5, None), ("D", 4, None)]


def test_metrics_in_one_pass(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ID,Title,Module\nA,one,m\nA,two,m\nB,one,m\n,"",\nbad,row\nC,ONE,m\n')
    rows = read_split_exports(spark, str(tmp_path / "a.csv"), ["ID", "Title", "Module"])
    out = str(tmp_path / "out")
    found = cat.ingest_in_one_pass(rows, lambda r: rows_to_tests(r).withColumn("source_id", F.lit(1).cast("bigint")), out)
    assert found == {"scanned": 6, "issues": 1, "skipped": 1, "discovered": 4, "duplicates": 2, "stored": 2}
    assert sorted(r.test_id for r in spark.read.parquet(out).collect()) == ["A", "A#2"]


def test_rejected_files_are_not_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("ID,Title\nA,one\n")
    (tmp_path / "big.csv").write_text("ID,Title\n" + "B,two\n" * 10_000)
    (tmp_path / "picture.png").write_text("no")
    files = scan(spark, str(tmp_path), file_kind, max_bytes=1000)
    assert [r.path.rsplit("/", 1)[-1] for r in files.select("path").collect()] == ["a.csv"]
    files.collect()
    leaf = files._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert leaf.metrics().apply("numFiles").value() == 1 and leaf.metrics().apply("filesSize").value() == 15
