import pytest
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def pytest_collection_modifyitems(items):
    """Python workers cannot import test modules, so they get their functions by value."""
    for module in {item.module for item in items}:
        cloudpickle.register_pickle_by_value(module)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def column(spark):
    """Values of an expression over rows of text columns a, b, c, d."""
    def values(rows, expression):
        rows = [row if isinstance(row, tuple) else (row,) for row in rows]
        schema = ", ".join(f"{name} string" for name in "abcd"[:len(rows[0])])
        numbered = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "i int, " + schema)
        return [row.v for row in numbered.select("i", expression.alias("v")).orderBy("i").collect()]
    return values


@pytest.fixture
def conf(spark):
    """Set session options for one test."""
    changed = {}

    def put(options):
        for key, value in options.items():
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield put
    for key, value in changed.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)


@pytest.fixture
def plan():
    """Executed plan of a frame, final where adaptive execution changed it."""
    def text(df):
        df.collect()
        return df._jdf.queryExecution().executedPlan().toString()
    return text
