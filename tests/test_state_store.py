import pytest
from meridex import queries as q
from meridex.streaming import jobs as ST
from oracle import SF, check
from pyspark.sql import functions as F

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
DEFAULT = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


@pytest.fixture
def plain(spark):
    """The session with the state store that Spark has by default, unlike that of the other tests."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, DEFAULT)
    yield spark
    spark.conf.set(PROVIDER, before)


def test_counters_in_a_session_with_defaults(plain):
    check(plain, q.QUERIES["stream_prior_counters"], q.ORACLE_SQL["stream_prior_counters"])
    assert plain.conf.get(PROVIDER) == DEFAULT


def test_counters_of_no_events(plain, tmp_path):
    plain.read.parquet(f"{SF}/events.parquet").where(F.lit(False)).coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    assert q.QUERIES["stream_prior_counters"](plain, str(tmp_path)).collect() == []


def test_settings_come_back_after_a_failed_start(plain):
    with pytest.raises(ValueError), ST.state_in_rocksdb(plain):
        assert plain.conf.get(PROVIDER) != DEFAULT
        raise ValueError
    assert plain.conf.get(PROVIDER) == DEFAULT
