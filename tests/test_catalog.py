import duckdb
import pytest

from tests.conftest import SF, canon
from vigil.catalog import ORACLES, QUERIES, address, host_name


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(same, name):
    same(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", ["alerts_fused"])
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


@pytest.fixture(scope="module")
def many_users(tmp_path_factory):
    """Events of users whose names in the SQL are no addresses from 64,000 on, beside some below."""
    path = tmp_path_factory.mktemp("many")
    shift = "CASE event_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 63990 WHEN 2 THEN 90000 ELSE 16383000 END"
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + {shift} AS user_id) FROM '{SF}/events.parquet' WHERE user_id < 1000) TO '{path}/events.parquet'")
    return path


@pytest.mark.parametrize("name", ["captured_packets", "community_id", "first_contact", "upload_top_dst", "netflow_records", "upload_alerts"])
def test_many_users(spark, many_users, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many_users}/events.parquet'")
    assert con.execute("SELECT count(*) FILTER (user_id >= 64000) > 100, count(*) FILTER (user_id < 64000) > 100 FROM events").fetchone() == (True, True)
    got, want = QUERIES[name](spark, str(many_users)).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert canon(got[cols].itertuples(index=False)) == canon(want[cols].itertuples(index=False))


def test_address(spark):
    rows = spark.createDataFrame([(0,), (63_999,), (64_000,), (16_383_999,), (None,)], "u long").select("u", address("u").alias("ip"))
    got = {r.u: (r.ip, r.name) for r in rows.withColumn("name", host_name(rows.ip)).collect()}
    assert got == {0: ("10.0.0.1", "10.0.0.1"), 63_999: ("10.0.255.250", "10.0.255.250"), 64_000: ("10.1.0.1", "10.0.256.1"), 16_383_999: ("10.255.255.250", "10.0.65535.250"), None: (None, None)}
    with pytest.raises(Exception, match="16,384,000 users"):
        spark.range(16_384_000, 16_384_001).select(address("id")).collect()


def test_many_users_fused(spark, many_users):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE (c_custkey + 63990 AS c_custkey) FROM '{SF}/customer.parquet') TO '{many_users}/customer.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{many_users}/events.parquet'")
    names = dict(con.execute(f"SELECT '10.0.' || c_custkey // 250 || '.' || c_custkey % 250 + 1, c_name FROM '{many_users}/customer.parquet'").fetchall())
    alerts = QUERIES["alerts_fused"](spark, str(many_users)).collect()
    uploads = {r.entity for r in alerts if r.threat_class == "exfiltration"}
    assert uploads == {e for (e,) in con.execute(f"SELECT DISTINCT entity FROM ({ORACLES['upload_alerts']})").fetchall()}
    assert all(r.entity.startswith(r.host) and r.asset_name == names.get(r.host, "unregistered") for r in alerts)
    assert any(int(r.host.split(".")[2]) > 255 and r.asset_name != "unregistered" for r in alerts)
