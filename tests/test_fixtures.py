from pyspark.sql import functions as F

from patchlight.jobs import fixtures as fx
from patchlight.operators import labeling


def test_commits_hold_the_whole_text(spark, tmp_path):
    late = "word " * 5000 + "closes CVE-2024-12345"
    docs = [(1, late, "en", "a", len(late)), (17, late, "en", "a", len(late)), (37, None, "en", "a", 0), (57, "", "en", "a", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r["id"]: r for r in labeling.apply_lfs(fx.commits(spark, str(tmp_path)), labeling.MESSAGE).select("id", "body", F.col("lf_cve_id")).collect()}
    for k in (1, 17):
        assert (rows[k]["body"], rows[k]["lf_cve_id"]) == (late, 1)
    for k in (37, 57):
        assert (rows[k]["body"], rows[k]["lf_cve_id"]) == ("", -1)
