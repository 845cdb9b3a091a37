"""Date forms are tried where their signs stand, and give what trying them all gives."""

from pyspark.sql import functions as F

from marketloom.functions import text as T
from marketloom.functions.dates import date_span

TEXTS = ["2024-03-05", "2024-03-05 10:11:12", "2024-03-05T10:11:12+03:00", "2024-03-05t10:11:12Z", "Tue, 5 Mar 2024 10:00:00 -0300", "5 Mar 2024 10:00:00 +0000", "Tue, 5 Mar 2024", "5 March 2024", " 5 mar 2024 ",
         "March 5, 2024", "05/03/2024", "2024-02-30", "soon", "", None, "5/3/2024", "March 5 2024", "2024-03-05 10:11", "-", ", /:"]
FORMS = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, d MMM yyyy HH:mm:ss Z", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "dd/MM/yyyy")


def test_forms_are_tried_by_their_signs(spark):
    c = F.col("c")
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3}, ", "")
    every = F.coalesce(*(F.try_to_timestamp(bare if "EEE" in f else F.trim(c), F.lit(f.removeprefix("EEE, "))) for f in FORMS))
    df = spark.createDataFrame([(t,) for t in TEXTS], "c string").select("c", T.parse_datetime(c).alias("got"), every.alias("every"))
    rows = df.collect()
    assert sum(r.got is not None for r in rows) >= 9
    assert [r.got for r in rows] == [r.every for r in rows]
    assert "contains" in str(T.parse_datetime(c)).lower()


def test_each_group_of_a_span_is_taken_once(spark):
    span = date_span(F.col("c"), F.col("posted"))
    df = spark.createDataFrame([("25th to 27th September", "2023-09-01"), ("nothing here", "2023-09-01"), ("until 3 oct 2023", "2023-09-01"), ("31st June", "2023-06-01")], "c string, posted string")
    df = df.select(F.col("c"), F.col("posted").cast("date").alias("posted")).select(span.alias("s"))
    got = [None if r.s is None else (str(r.s.start_date), str(r.s.end_date)) for r in df.collect()]
    assert got == [("2023-09-25", "2023-09-27"), None, ("None", "2023-10-03"), None]
    assert df._jdf.queryExecution().analyzed().toString().count("regexp_extract(") <= 20
