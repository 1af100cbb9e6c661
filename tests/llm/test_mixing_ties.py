from tessera.llm.mixing import mix_sources, mixed_documents


def test_equal_rows_at_the_cut_are_taken_one_by_one(spark):
    rows = [(None, "a b c d e f g h i j", "c")] * 1000 + [(i, "w " * 10, "ab"[i % 2]) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    got = mix_sources(df).toPandas()
    own = got[got.source == "c"]
    assert len(got) == 3000 and abs(own.target.iloc[0] - 50000 / 3) < 1e-6
    assert abs(own.taken.sum() - own.target.iloc[0]) <= 5 and set(own.copies) == {1, 2}
    assert len(mixed_documents(df).where("source = 'c'").collect()) == own.copies.sum()


def test_long_texts_null_columns_and_clashing_names(spark):
    long = "word " * 300_000
    rows = [(1, long, None, 1, "x"), (2, long + "end", None, 2, "y"), (3, None, "a", 3, None), (None, "", "a", None, None), (4, "one two", "a", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m_row int, target string")
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    assert got[1].size == 300_000 and got[2].size == 300_001 and got[3].size == 0 and got[3].taken == 0
    mixed = mixed_documents(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= {1, 2, 4}
