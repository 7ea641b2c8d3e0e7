"""Columns of the input whose names clash with ours pass unchanged."""

from pyspark.sql import functions as F

from flockline.llm import langid, lines, mixing, packing


def table(spark):
    rows = [(k, "line one here\nline two here\nline three here\n" + f"own words number {k}", "en", f"s{k % 2}") for k in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_clashing_names(spark):
    docs = table(spark)
    plain = sorted((r.doc_id, r.text) for r in lines.dedup_lines(docs).collect())
    odd = docs.withColumns({"dup_id": F.lit(5), "dup_starts": F.lit("x"), "DUP_ID_": F.lit(6)})
    got = lines.dedup_lines(odd).collect()
    assert sorted((r.doc_id, r.text) for r in got) == plain and {(r.dup_id, r.dup_starts, r["DUP_ID_"]) for r in got} == {(5, "x", 6)}

    odd = docs.withColumns({"mix_place": F.lit(7), "mix_copies": F.lit(8), "mix_sub": F.lit("y"), "mix_source": F.lit("z")})
    rows = mixing.repeated(odd).collect()
    assert {(r.mix_place, r.mix_copies, r.mix_sub, r.mix_source) for r in rows} == {(7, 8, "y", "z")}
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in mixing.repeated(docs).collect())

    odd = docs.withColumns({"__text": F.lit(1), "whole_text": F.lit(2), "score": F.lit(3)})
    rows = langid.identify(odd).collect()
    assert {(r["__text"], r["whole_text"], r.lang_pred) for r in rows} == {(1, 2, "en")}


def test_packing_demands_the_json_form(tmp_path):
    import shutil

    import pytest

    alone = tmp_path / "ranks.tiktoken"
    shutil.copy(packing.VOCABULARY, alone)
    with pytest.raises(FileNotFoundError):
        packing.Encoder(str(alone))
