"""Functions registered for SQL against the column functions."""

from pyspark.sql import functions as F

from reviewlake.functions import paths as P
from reviewlake.functions import register
from reviewlake.functions import text as X
from reviewlake.plans.catalog import table
from reviewlake.sources import diffs


def test_scalars_equal_column_functions(spark, sf):
    register.register(spark)
    t = "FileUtils.deleteIfExists ignores readBuffer, see PROJ-1234 and proj_777; tests fail (+1) in src/A.java:12"
    rows = spark.createDataFrame([(t, "user/1234-x", "src/A.java:12", "test/unit/A.java"), ("c++1 +10", "PROJ-4321", "none", "src/java/A.java"), (None, None, None, None)], "t string, b string, l string, p string")
    got = rows.selectExpr("keys_in_text(t)", "keys_in_branch(b)", "has_plus_one(t)", "words_of(t)", "identifiers_of(t)", "location_path(l)", "location_line(l)", "is_test_path(p)", "is_production_path(p)", "jaccard(words_of(t), words_of(l))", "norm_name(t)").collect()
    c = F.col
    want = rows.select(X.keys_in_text(c("t")), X.keys_in_branch(c("b")), X.plus_one(c("t")), F.array_sort(X.words(c("t"))), F.array_sort(X.identifiers(c("t"))), X.location(c("l"))["path"], X.location(c("l"))["line"], P.is_test(c("p")), P.is_prod(c("p")), X.jaccard(X.words(c("t")), X.words(c("l"))), X.folded(c("t"))).collect()
    assert [tuple(r) for r in got][:2] == [tuple(r) for r in want][:2] and got[0][0] == ["PROJ-1234", "PROJ-777"]
    assert abs(spark.sql("SELECT poisson_tail(4L, 3D)").first()[0] - 0.352768) < 1e-6


def test_diff_lines_equal_the_window_form(spark, sf):
    register.register(spark)
    d = table(spark, sf, "diffs")
    d.createOrReplaceTempView("some_diffs")
    got = spark.sql("SELECT pr, x.path, x.line_no, x.text, x.new_file FROM some_diffs, LATERAL diff_lines(diff) x")
    want = diffs.added_lines(diffs.diff_lines(d)).select("pr", "path", F.col("line_no").cast("int"), "text", "new_file")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() > 1000
