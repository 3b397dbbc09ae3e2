"""The files of the derived trees are made once, however many rounds of inlining read them."""

from papergraph.plans import derived, layout


def _documents(spark, tmp_path):
    texts = ["a b1\nÀc-d\n\ne\nf", "", "x\n\U0001d400y"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))


def test_rounds_read_stored_files(spark, tmp_path, capsys):
    _documents(spark, tmp_path)
    out = layout.inlined_sources(spark, str(tmp_path))
    out.explain()
    assert "regexp_replace(line" not in capsys.readouterr().out
    assert out.count() == 3


def test_letters_and_blanks_stay(spark, tmp_path):
    _documents(spark, tmp_path)
    text = {r["doc_id"]: r["text"] for r in derived.tex(spark, str(tmp_path)).collect()}
    assert "\na b % a note" in text[0] and "\ncd % a note" in text[0] and "\ny % a note" in text[2]
