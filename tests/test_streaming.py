from civilspark.operators.scoring import batch_report, batch_summary
from civilspark.streaming import comments as streaming

SCHEMA = "id bigint, text string"


def test_stream_equals_batch(spark, tmp_path):
    source, out = str(tmp_path / "in"), tmp_path / "out"
    texts = ["you idiot", "fine", " ", None, "b!tch scum", "moron moron"]
    data = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    data.where("id < 3").coalesce(1).write.mode("append").parquet(source)

    def drain():
        stream = streaming.comment_stream(spark, source, SCHEMA, maxFilesPerTrigger=1)
        scored = streaming.score_comments(stream, keep=["id"])
        streaming.write_reports(
            scored, ["id"], str(out / "rows"), str(out / "c1")
        ).awaitTermination()
        streaming.write_summaries(
            scored, str(out / "summary"), str(out / "c2")
        ).awaitTermination()
        return (
            sorted(map(tuple, spark.read.parquet(str(out / "rows")).collect())),
            spark.read.parquet(str(out / "summary")).collect(),
        )

    def batch(df):
        scored = streaming.score_comments(df, keep=["id"])
        return (
            sorted(map(tuple, batch_report(scored, ["id"]).collect())),
            batch_summary(scored).collect(),
        )

    assert drain() == batch(data.where("id < 3"))
    # A later run goes on where the checkpoint stands.
    data.where("id >= 3").coalesce(1).write.mode("append").parquet(source)
    assert drain() == batch(data)
