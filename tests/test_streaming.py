from tessera.operators import climate, words
from tessera.streaming import running
from tests.conftest import DATA, rows

SF = f"{DATA}/sf0.001"


def stream(spark, name):
    schema = spark.read.parquet(f"{SF}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(SF)


def drained(spark, df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_running_means_equal_the_batch(spark):
    got = drained(spark, running.running_means(stream(spark, "climate_obs")), "means", "complete")
    want = climate.means(climate.readings(spark.read.parquet(f"{SF}/climate_obs.parquet")), "station")
    shown = lambda df: rows(df.selectExpr("station", "round(avg_tmin, 6)", "round(avg_tmax, 6)"))
    assert shown(got) == shown(want)


def test_windowed_counts_equal_the_batch(spark):
    got = drained(spark, running.windowed_token_counts(stream(spark, "documents")), "tokens", "complete")
    want = words.token_counts(spark.read.parquet(f"{SF}/documents.parquet"), "text")
    assert rows(got.groupBy("token").sum("occurrences")) == rows(want)
