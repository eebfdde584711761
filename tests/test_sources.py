import pytest

from civilspark.operators import vocabulary
from civilspark.operators.scoring import batch_report, predict_batch
from civilspark.session import shared_folder
from civilspark.sources import readers, writers


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(
        'tweet_text,cyberbullying_type\n"two\nlines, one ""quoted""",age\n,gender\nplain,religion\n'
    )
    df = readers.read_labelled_csv(spark, str(path))
    assert [tuple(r) for r in df.collect()] == [
        ('two\nlines, one "quoted"', "age"),
        (None, "gender"),
        ("plain", "religion"),
    ]
    assert readers.resolve_labelled_columns(df).columns == ["text", "label"]


def test_labelled_csv_goes_by_name(spark, tmp_path):
    path = tmp_path / "permuted.csv"
    path.write_text("cyberbullying_type,extra,tweet_text\nage,1,some text\n")
    df = readers.read_labelled_csv(spark, str(path))
    assert df.columns == ["tweet_text", "cyberbullying_type"]
    assert [tuple(r) for r in df.collect()] == [("some text", "age")]
    everything = readers.read_labelled_csv(spark, str(path), schema=None)
    assert everything.columns == ["cyberbullying_type", "extra", "tweet_text"]


def test_columns_by_position(spark):
    df = spark.createDataFrame([("t", "l", 1)], "body string, kind string, n int")
    assert readers.resolve_labelled_columns(df).first().asDict() == {"text": "t", "label": "l"}
    mixed = spark.createDataFrame([(1, "t")], "n int, tweet_text string")
    assert readers.resolve_labelled_columns(mixed, "a", "b").first().asDict() == {
        "a": "t",
        "b": "t",
    }


@pytest.mark.parametrize(
    "columns, found",
    [
        (["id", "text", "comment"], "comment"),
        (["tweet", "content"], "content"),
        (["message", "text"], "text"),
        (["a", "b"], "a"),
    ],
)
def test_detect_text_column(columns, found):
    assert readers.detect_text_column(columns) == found


def test_comments_from_table(spark):
    df = spark.createDataFrame([(1, 5), (2, None)], "id int, tweet int")
    out = readers.comments_from_table(df, keep=["id"])
    assert [tuple(r) for r in out.collect()] == [(1, "5")]


def test_lines(spark):
    df = spark.createDataFrame([(1, " a \n\n  \n b c\r\nd")], "id int, text string")
    out = readers.lines_to_rows(df, "text", keep=["id"])
    assert [tuple(r) for r in out.collect()] == [
        (1, 0, "a"),
        (1, 3, "b c"),
        (1, 4, "d"),
    ]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_splits_round_trip(spark, tmp_path, fmt):
    data = [("train", 'x "y"\nz', "a"), ("val", "v, w", "b"), ("test", "t", "a")]
    df = spark.createDataFrame(data, "split string, text string, label string")
    path = str(tmp_path / "splits")
    writers.write_splits(df, path, fmt)
    for split, text, label in data:
        rows = writers.read_split(spark, path, split, fmt).collect()
        assert [tuple(r) for r in rows] == [(text, label)]


def test_report_round_trip(spark, tmp_path):
    comments = spark.createDataFrame([('an idiot, "yes"\nno',), ("fine",)], "text string")
    report = batch_report(predict_batch(comments)).coalesce(1)
    path = str(tmp_path / "report")
    writers.write_report(report, path)
    back = (
        spark.read.options(header=True, multiLine=True, escape='"')
        .schema(report.schema)
        .csv(path)
    )
    assert back.collect() == report.collect()
    with pytest.raises(Exception):
        writers.write_report(report, path)


def test_vocabulary_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a a b b c")], "id long, text string")
    vocab = vocabulary.build_vocabulary(df, "text", "id")
    writers.save_vocabulary(vocab, str(tmp_path / "vocab"))
    loaded = writers.load_vocabulary(spark, str(tmp_path / "vocab"))
    assert {tuple(r) for r in loaded.collect()} == {
        ("<pad>", 0, 0),
        ("<unk>", 1, 0),
        ("a", 2, 2),
        ("b", 3, 2),
    }


def test_shared_folder_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    one, two = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert one != two
    if root:
        assert one.startswith(root)
