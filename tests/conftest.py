import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """The value of a Column over one row."""
    return lambda column: spark.range(1).select(column.alias("x")).head()[0]


@pytest.fixture
def docs(spark):
    """Documents from texts, numbered from 0."""
    return lambda *texts: spark.createDataFrame([(i, "<memory>", t) for i, t in enumerate(texts)], "doc_id long, source_name string, text string")
