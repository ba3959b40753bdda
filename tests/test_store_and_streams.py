from concurrent.futures import ThreadPoolExecutor

import pytest

from hexlode.sources.store import Conflict, Store, stores
from hexlode.streaming.ingest import ingest_stream, token_bucket


def test_versions(spark, tmp_path):
    s = Store(spark, str(tmp_path / "a"))
    s.initialize({"name": "a"})
    for n in range(1, 6):
        assert s.save(nodes=spark.range(n)) == n
    assert s.versions() == [3, 4, 5] and s.load("nodes").count() == 5 and s.manifest()["stats"] == {"nodes": 5}
    assert s.update_manifest({"metadata": {"x": 1}})["metadata"] == {"name": "a", "x": 1} and s.versions() == [3, 4, 5]
    s.export(str(tmp_path / "out"))
    again = Store.import_from(spark, str(tmp_path / "out"), str(tmp_path / "b"))
    assert again.intact() and again.load("nodes").count() == 5 and len(stores(spark, str(tmp_path))) == 3 and again.manifest()["metadata"]["x"] == 1
    folder = s.manifest()["folder"]
    next((tmp_path / "a" / folder / "nodes").glob("*.parquet")).unlink()
    assert s.load("nodes").count() == 4 and not s.intact() and s.intact(4)
    again.delete()
    assert len(stores(spark, str(tmp_path))) == 2 and sorted(p.name[:4] for p in (tmp_path / "a").glob("v=*")) == ["v=3-", "v=4-", "v=5-"]
    with pytest.raises(FileNotFoundError):
        Store.import_from(spark, str(tmp_path / "none"), str(tmp_path / "c"))


def test_of_two_writers_one_fails(spark, tmp_path):
    one, two = (Store(spark, str(tmp_path / "s")) for _ in range(2))
    one.save(nodes=spark.range(3))
    base = one.manifest()["revision"]
    assert one.save(base, nodes=spark.range(4)) == 2
    with pytest.raises(Conflict):
        two.save(base, nodes=spark.range(9))
    assert two.load("nodes").count() == 4 and len(list((tmp_path / "s").glob("v=*"))) == 2 and two.save(nodes=spark.range(9)) == 3
    # at one time: as many versions as writers that didn't fail
    with ThreadPoolExecutor(4) as pool:
        base = one.manifest()["revision"]
        done = list(pool.map(lambda i: _tried(Store(spark, str(tmp_path / "s")), base, spark.range(i)), range(4)))
    assert sum(done) == 1 and one.manifest()["version"] == 4


def _tried(store, base, df):
    try:
        store.save(base, nodes=df)
    except Conflict:
        return False
    return True


def test_altered_contents_are_found(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    for n in (2, 1):
        s.save(nodes=spark.range(1000).selectExpr(f"id * {n} AS id", "map('k', id) AS m", "array(id) AS v"))
    assert s.intact()
    file = next((tmp_path / "s" / s.manifest()["folder"] / "nodes").glob("*.parquet"))
    data = bytearray(file.read_bytes())
    middle = len(data) // 2
    data[middle - 50 : middle] = bytes(50)
    file.write_bytes(bytes(data))
    file.with_name(f".{file.name}.crc").unlink(missing_ok=True)
    assert not s.intact() and s.load("nodes", deep=True).agg({"id": "max"}).first()[0] == 1998


def test_ingest_stream(spark, tmp_path):
    spark.createDataFrame([("n1", "First sentence here. Second one there.")], "node_id string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("node_id string, text string").parquet(str(tmp_path / "in"))
    seen = {}
    q = ingest_stream(stream, lambda n, e, i: seen.update({i: (n.count(), e.count())}), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == {0: (3, 2)}


def test_token_bucket(spark, tmp_path):
    spark.sql("SELECT 'k' AS key, timestamp_seconds(id * 0.1) AS ts FROM range(20)").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    q = token_bucket(stream, 1.0, 5.0).writeStream.format("memory").queryName("bucket").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bucket").where("allowed").count() == pytest.approx(6, abs=1)
