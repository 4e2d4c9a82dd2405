"""Reading logs, adapters with full accountability, contracts and manifests."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import files


def test_domains_and_row_index(spark, tmp_path):
    (tmp_path / "ipdr_x.csv").write_text("a,b\n" + "".join(f"{i},v{i}\n" for i in range(50)))
    (tmp_path / "other.csv").write_text("a,b\n1,x\n")
    df = files.with_row_index(files.read_logs(spark, str(tmp_path)))
    got = {(r["source_domain"], r["a"], r["source_row_index"]) for r in df.collect()}
    assert {("IPDR", str(i), i) for i in range(50)} | {("CDR", "1", 0)} == got


def test_adapters(spark, tmp_path):
    (tmp_path / "c.csv").write_text("txId,timestamp,input_wallet,output_wallet,amount_btc\n1,2026-01-01T00:00:00Z,a,b,1.5\n,2026-01-01T00:00:00Z,a,b,1\n2,bad,a,b,1\n3,2026-01-01T00:00:00Z,a,,1\n4,2026-01-01T00:00:00Z,a,b,-1\n")
    m = files.ingest(spark, "coin_transfers", str(tmp_path / "c.csv"), str(tmp_path / "out"))
    assert m["received"] == 5 and m["accepted"] == 1 and m["reasons"] == {"MISSING_TX_ID": 1, "INVALID_TIMESTAMP": 1, "MISSING_WALLET": 1, "INVALID_AMOUNT": 1}
    good, bad = files.CoinTransfers().load(spark, str(tmp_path / "c.csv"), limit=1)
    assert good.count() == 1 and bad.count() == 0
    with pytest.raises(ValueError):
        files.NetworkFlows().load(spark, str(tmp_path / "c.csv"))
    (tmp_path / "f.csv").write_text("id,dur,proto,sbytes,dbytes\n2,0.5,tcp,10,20\n3,-1,tcp,1,1\n")
    good, bad = files.NetworkFlows().load(spark, str(tmp_path / "f.csv"))
    r = good.first()
    assert r["epoch"] == 1421980003.0 and (r["actor_id"], r["target_id"], r["temporal_semantics"]) == ("FLOW_2", None, "SEQUENCE_ORDER_SURROGATE") and bad.count() == 1
    (tmp_path / "g.csv").write_text("id,dur,proto,sbytes,dbytes,srcip,dstip,stime,label,attack_cat\n7,0.5,tcp,10,20,10.0.0.1, ,1700000000,1,Worms\n")
    r = files.NetworkFlows().load(spark, str(tmp_path / "g.csv"))[0].first()
    assert (r["event_id"], r["actor_id"], r["target_id"], r["epoch"], r["temporal_semantics"]) == ("EVT_UNSW_7", "IP_10.0.0.1", None, 1700000000.0, "OBSERVED_TIMESTAMP")
    assert tuple(files.NetworkFlows().truths(spark, str(tmp_path / "g.csv")).first()) == ("EVT_UNSW_7", "Worms", 1)
    labels = spark.createDataFrame([(1, "illicit")], "txId int, class string")
    assert tuple(files.CoinTransfers().truths(spark, str(tmp_path / "c.csv"), labels).first()) == ("EVT_EL_1", "illicit", 1)
    assert files.CoinTransfers().count(spark, str(tmp_path / "c.csv")) == 5 and ("amount_btc", "double") in files.CoinTransfers().inspect(spark, str(tmp_path / "c.csv"))
    for bad_call in ({"path": str(tmp_path / "none.csv")}, {"path": str(tmp_path / "c.csv"), "sha256": "0" * 64}):
        with pytest.raises(ValueError):
            files.ingest(spark, "coin_transfers", out=str(tmp_path / "o2"), **bad_call)
    assert [n for n, _ in files.catalogue()] == ["coin_transfers", "interactions", "network_flows"]
    (tmp_path / "i.csv").write_text("src_user_id,dst_user_id,timestamp\nu,v,1700000000\nu,v,0\n")
    good, bad = files.Interactions().load(spark, str(tmp_path / "i.csv"))
    assert good.first()["event_id"] == "EVT_SO_SO_C2Q_000000" and good.first()["actor_id"] == "SO_u" and good.count() == 1 and bad.count() == 1
    names = files.register_graph(good, good)
    assert spark.sql(f"SELECT count(*) AS n FROM {names[0]} JOIN {names[1]} USING (event_id)").first()["n"] == 1


def test_json_sources(spark, tmp_path):
    (tmp_path / "social_a.json").write_text(json.dumps([{"post_id": 1, "n": 2.5}, {"post_id": 2}]))
    df = files.read_logs(spark, str(tmp_path / "social_a.json"), "json")
    assert sorted(r["post_id"] for r in df.collect()) == ["1", "2"] and df.first()["source_domain"] == "SOCIAL"
    p = spark.createDataFrame([("e1", '{"records": [{"x": 1}, {"x": 2}]}'), ("e2", "bad"), ("e3", None)], "id string, p string")
    assert [(r["id"], r["ordinal"], r["x"]) for r in files.read_json_records(p, "p", "x int", "id").orderBy("id", "ordinal").collect()] == [("e1", 0, 1), ("e1", 1, 2)]
    (tmp_path / "log.jsonl").write_text('{"event_id": "b"}\n{"event_id": "a"}\n')
    assert [(r["event_id"], r["position"]) for r in files.read_decision_log(spark, str(tmp_path / "log.jsonl")).orderBy("position").collect()] == [("b", 0), ("a", 1)]


def test_hashes_and_contracts(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.file_hashes(spark, str(tmp_path / "x.bin")).first()["sha256"] == hashlib.sha256(b"abc").hexdigest()
    df = spark.createDataFrame([("é", None, "f", 0)], "a string, b double, s string, i int")
    text = json.dumps({"row": {"a": "é", "b": None}, "schema_version": "1.0", "source_file": "f", "source_row_index": 0}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
    assert files.canonical_row_hash(df, ["a", "b"], "s", "i").first()["sha256_hash"] == hashlib.sha256(text.encode()).hexdigest()
    with pytest.raises(ValueError):
        files.write_contract(df, str(tmp_path / "o"), ["a", "zz"])
    files.write_contract(df, str(tmp_path / "o"), ["b", "a"], ["a"])
    assert spark.read.parquet(str(tmp_path / "o")).columns == ["b", "a"]


def test_graph_payload(spark):
    n = spark.createDataFrame([(1,), (1,), (2,)], "id int")
    e = spark.createDataFrame([(1, "CALLS", 2)], "src int, rel string, dst int")
    assert files.graph_payload(n, e).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind").collect()[1]["n"] == 2
