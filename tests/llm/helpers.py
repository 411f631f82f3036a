"""Small fixtures shared by the tests of the training-data operators."""
import random

LONG = "words in a very long text. " * 4000


def edge_rows():
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "alpha beta gamma delta", "en", "s", 1), (1, "alpha beta gamma delta", "en", "s", 1),
        (2, None, "en", None, None), (None, "no id here at all", None, "s", 2), (3, "", "de", "s", 0),
        (4, LONG, "en", "s", 9), (5, "  \n\t ", None, "s", 4), (6, "1234 !!", "fr", "s", 7), (2, "same id twice", "de", "s", 3),
        (None, None, None, None, None),
    ]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHES = ["n_tokens", "spans", "component_id", "fp", "key", "row", "uid", "length", "offset", "score", "h", "count", "gone", "id", "digest", "once", "stays", "salt", "times", "first", "row_key"]


def edge_frame(spark, clashes=True):
    df = spark.createDataFrame(edge_rows(), SCHEMA).coalesce(2)
    if clashes:
        for c in CLASHES:
            df = df.selectExpr("*", f"'x' as {c}")
    return df


def empty_frame(spark):
    return spark.createDataFrame([], SCHEMA)


def strings(seed, alphabet, n, most):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, most))) for _ in range(n)]


def stored(spark, df, folder):
    """``df`` as a table that reads the same twice."""
    path = str(folder / "table")
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def read_differently(spark, monkeypatch, module):
    """From one written table to the next, source tables are dealt into other splits."""
    write, sizes = module.written, iter([40_000, 1 << 27, 90_000, 15_000] * 50)

    def changed(df, name):
        out = write(df, name)
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(next(sizes)))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        return out
    monkeypatch.setattr(module, "written", changed)
