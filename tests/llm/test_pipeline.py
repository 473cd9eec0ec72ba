"""The pipeline's stages on planted cases."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_act(spark, tmp_path):
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeio" for c in "lmnrst"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, base, line = prose(40), prose(120), prose(12)
    near = base.split()
    near[30] = near[90] = "changed"
    texts = [prose(80) for _ in range(20)]
    texts += [base, " ".join(near), prose(30) + " " + item + " " + prose(30), "1234 5678", None, f"{line}\n{prose(20)}", f"{line}\n{prose(20)}", texts[0]]
    rows = [(i, t, "xx" if i < 20 else None, "s", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("size", F.lit("own")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = str(tmp_path)
    kept, at = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, sf)
        if name != "mixing":
            assert out.columns == at.columns and out.dtypes == at.dtypes
        path = str(tmp_path / name.replace(" ", "_"))
        out.write.parquet(path)
        at = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in at.collect()})
    everything = set(range(len(texts)))
    assert everything - set(kept[0]) == {23, 24}  # no language
    assert set(kept[0]) - set(kept[1]) == {27}  # all its lines repeat
    assert kept[1][26] == texts[26].split("\n")[1] and kept[1][25] == texts[25]
    assert set(kept[1]) - set(kept[2]) == {21}
    assert set(kept[2]) - set(kept[3]) == {22}
    assert set(kept[4]) <= set(kept[3])


HARD = [
    (None, "alpha beta gamma delta epsilon zeta", "xx", None, None), (None, "eta theta iota kappa lambda mu", "xx", "s", 1), (1, "nu xi omicron pi rho sigma", "xx", "s", 1),
    (1, "tau upsilon phi chi psi omega", "xx", "s", 1), (2, None, None, None, None), (3, "", "xx", "s", 0), (4, "word " * 60_000, "xx", "t", 300_000),
    (5, "gamma beta alpha zeta delta epsilon", "xx", "t", 9), (5, "gamma beta alpha zeta delta epsilon", "xx", "t", 9),
]


def test_stages_on_hard_tables(spark, tmp_path):
    """Null and repeated ids, null and empty and long texts, repeated rows, clashing names, empty tables."""
    spark.createDataFrame([(1, "one passage of a benchmark that no document holds at all"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("row", "rest", "class", "of", "t", "size", "taken", "target", "lang_pred", "score", "kept_text", "bucket", "key"):
        docs = docs.withColumn(c, F.lit("own"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    left = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        left[name] = sorted((r["doc_id"] or 0, (r["text"] or "")[:5]) for r in out.collect())
        if name != "mixing":
            assert out.columns == docs.columns
            assert all(r["class"] == "own" for r in out.select("class").collect())
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    texts = [(0, "alpha"), (0, "eta t"), (1, "nu xi"), (1, "tau u"), (4, "word "), (5, "gamma"), (5, "gamma")]
    nothing = [(2, ""), (3, "")]
    assert left["language ID"] == texts
    assert set(texts + nothing) == set(left["line dedup"])
    assert left["n-gram Jaccard join"] == sorted(set(texts) | set(nothing))
    assert left["benchmark decontamination"] == sorted(texts + nothing)
    assert set(left["mixing"]) <= set(texts)


def test_stages_carry_any_columns(spark, tmp_path):
    """Names with dots and ticks, maps, arrays and structs, and no column besides those needed."""
    spark.createDataFrame([(1, "one passage of a benchmark that no document holds at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(HARD, "doc_id long, text string, lang string, source string, n_chars long")
    odd = docs.withColumns({"a.b": F.lit(1), "c`d": F.lit(2), "m": F.create_map(F.lit("k"), F.col("source")), "s.t": F.struct(F.lit(3).alias("x.y")), "l": F.array(F.create_map(F.lit(1), F.lit(2)))})
    least = docs.select("doc_id", "text", "lang", "source")
    for df in (odd, least):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, str(tmp_path))
            new = ["size", "source_size", "target", "taken"] if name == "mixing" else []
            assert out.columns == df.columns + new
            rows = out.collect()
            assert rows
            if df is odd:
                assert all((r["a.b"], r["c`d"], r["s.t"]["x.y"], r["m"]["k"]) == (1, 2, 3, r["source"]) for r in rows)


def test_mix_of_texts_under_one_id(spark, tmp_path):
    """Each shows its own size, source and words; none exceeds three times its size."""
    rows = [(1, " ".join(["w"] * n), None, s, 0) for n, s in ((10, "s1"), (2, "s2"), (40, "s2"), (10, "s3"))] + [(None, "a b c", None, None, 0), (1, "w w", None, "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).collect()
    sizes = {"s1": 10, "s2": 44, "s3": 10, None: 3}
    assert out
    for r in out:
        assert r["size"] == len(r["text"].split()) and r["source_size"] == sizes[r["source"]] and 0 < r["taken"] <= 3 * r["size"]
    assert len({r["target"] for r in out if r["source"] == "s2"}) == 1


def test_run_and_oracles(spark):
    assert corpus_pipeline.run(spark, SF).count() > 50
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        expected = [dict(zip(names, r, strict=True)) for r in found.fetchall()]
        assert sorted(names) == columns
        assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(repr(tuple(r[c] for c in columns)) for r in expected)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_has_every_row(spark, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.count()
    if name in ("op4_decontaminate", "op11_filter_audit"):
        assert rows > 0
    elif name == "op13_conversations":
        assert rows == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count()
    else:
        source = "pages" if name in ("op5_html_text", "op7_warc") else "documents"
        assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count()
