"""Files in, tables out."""

import json
from datetime import datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.rules import score_rules
from tallywatch.plans.analysis import analyse_batch, analyse_sheet
from tallywatch.schema import canonicalise
from tallywatch.sources import files, lookup, tables

LABELLED = """Timestamp,From Bank,Account,To Bank,Account,Amount Received,Receiving Currency,Amount Paid,Payment Currency,Payment Format,Is Laundering
2022/09/01 00:20,010,8000EBD30,010,8000EBD31,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0
2022/09/01 00:26,012,8000F4580,3208,8000F5340,0.01,US Dollar,0.01,US Dollar,Cheque,1
"""


def test_unique_names():
    assert files.unique_names([" a", "b", "a ", "a"]) == ["a", "b", "a.1", "a.2"]


def test_labelled_csv(spark, tmp_path):
    path = tmp_path / "labelled.csv"
    path.write_text(LABELLED)
    rows = canonicalise(files.read_labelled_csv(spark, str(path)), "features").orderBy("txn_id").collect()
    assert [r["txn_id"] for r in rows] == [0, 1]
    first, second = rows
    assert (first["ts"], first["amount"], first["label"]) == (datetime(2022, 9, 1, 0, 20), 3697.34, 0)
    assert (second["sender_account"], second["receiver_account"]) == ("8000F4580", "8000F5340")
    assert (second["sender_country"], second["receiver_country"], second["label"]) == ("012", "3208", 1)


def test_batch_csv_matches_by_position(spark, tmp_path):
    path = tmp_path / "any.csv"
    path.write_text(LABELLED.replace("Timestamp", " Timestamp "))
    df = files.read_batch_csv(spark, str(path))
    assert "Account.1" in df.columns and "Timestamp" in df.columns
    assert canonicalise(df, "v3").orderBy("txn_id").first()["amount"] == 3697.34


def test_every_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,\"4\n5\"\n")
    (tmp_path / "b.csv").write_text("y,z\n6,7\n")
    rows = files.read_batch_csv(spark, str(tmp_path), line_breaks=True).orderBy("txn_id").collect()
    assert [(r["txn_id"], r["x"], r["y"], r["z"]) for r in rows] == [(0, "1", "2", None), (1, "3", "4\n5", None), (2, None, "6", "7")]


def test_headers_of_many_files_and_splits(spark, tmp_path):
    """Full splits stop after their first lines; small files share tasks; empty ones have no header."""
    (tmp_path / "big.csv").write_text("\ufeffa,b\n" + "".join(f"{i},{'x' * 60}\n" for i in range(40_000)))
    for i in range(6):
        (tmp_path / f"s{i}.csv").write_text(["a,b\n1,2\n", "b,c\n", "", "a,b"][i % 4])
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for parts in ("128m", "300000b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", parts)
            found = {r["file"].rsplit("/", 1)[1]: r["header"] for r in files.file_headers(spark, str(tmp_path)).collect()}
            assert found == {"big.csv": "a,b", "s0.csv": "a,b", "s1.csv": "b,c", "s3.csv": "a,b", "s4.csv": "a,b", "s5.csv": "b,c"}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_what_a_sheet_and_json_refuse(spark, tmp_path):
    sheet = 'Date,Amount,MCC\n2024-01-01 10:00:00,5.5,1\n2024-01-01 10:00:00,,1\nnever,"1,000",2\n2024-01-01,7\n2024-01-01,8,1,9\n"2024-01-01,9,1\n'
    (tmp_path / "a.csv").write_text(sheet)
    found = sorted((r["position"], r["reason"], r["record"]) for r in files.csv_rejects(spark, str(tmp_path / "a.csv")).collect())
    assert [f[:2] for f in found] == [
        (1, "no amount"), (2, "amount does not parse"), (2, "ts does not parse"), (3, "number of values"), (4, "number of values"), (5, "number of values"),
    ]
    assert found[3][2] == "2024-01-01,7" and json.loads(found[0][2])["MCC"] == "1"
    assert files.read_batch_csv(spark, str(tmp_path / "a.csv")).count() == 6
    (tmp_path / "in.json").write_text('{"amount": 1}\n{"mcc": "5"}\nnope\n{"amount": "x"}\n')
    rejects = files.named_rejects(files.json_records(spark, str(tmp_path / "in.json")), "json").collect()
    assert sorted((r["position"], r["reason"]) for r in rejects) == [(1, "no amount"), (2, "not JSON or of other types"), (3, "not JSON or of other types")]


def test_labelled_csv_with_other_columns_is_refused(spark, tmp_path):
    lines = LABELLED.splitlines()
    (tmp_path / "a.csv").write_text(LABELLED)
    (tmp_path / "b.csv").write_text("\n".join([",".join(reversed(lines[0].split(","))), *lines[1:]]))
    with pytest.raises(ValueError, match="b.csv"):
        files.read_labelled_csv(spark, str(tmp_path))


def test_row_ids_follow_file_order(spark, tmp_path):
    """Dense ids in file order, although the file is read in many splits."""
    path = tmp_path / "big.csv"
    path.write_text("n,pad\n" + "".join(f"{i},{'x' * 50}\n" for i in range(5000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = files.read_batch_csv(spark, str(path))
        assert df.rdd.getNumPartitions() > 3
        assert df.filter(F.col("txn_id") != F.col("n").cast("bigint")).count() == 0 and df.count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_blank_normalisation(spark):
    df = spark.createDataFrame([("nan", 1.0), ("None", None), (None, 2.0), ("ok", 3.0)], "a string, b double")
    got = [tuple(r) for r in files.blank_normalised(df).collect()]
    assert got == [("", 1.0), ("", None), ("", 2.0), ("ok", 3.0)]


def test_json(spark, tmp_path):
    path = tmp_path / "in.json"
    records = [
        {"amount": 9500.5, "mcc": "6012", "sender_country": "usa", "receiver_country": "irn", "transaction_date": "2024-01-05T10:00:00"},
        {"amount": 1, "merchant_category_code": "1"},
        {"mcc": "1"},
    ]
    path.write_text("\n".join(json.dumps(r) for r in records))
    rows = files.read_json(spark, str(path)).orderBy(F.col("amount").desc()).collect()
    assert len(rows) == 2
    assert (rows[0]["mcc"], rows[0]["sender_country"], rows[0]["ts"]) == ("6012", "USA", datetime(2024, 1, 5, 10))
    assert rows[1]["mcc"] == "1" and rows[1]["ts"] is not None and rows[1]["card_number"] == ""
    assert [r["mcc"] for r in files.json_rejects(spark, str(path)).collect()] == ["1"]


def test_equal_and_card_less_json_records_stay_apart(spark, tmp_path):
    path = tmp_path / "in.json"
    record = {"amount": 5.0, "transaction_date": "2024-01-05T10:00:00", "sender_account": "a", "receiver_account": "b"}
    swapped = [{"amount": 5.0, "sender_account": "A"}, {"amount": 5.0, "receiver_account": "A"}]
    path.write_text("\n".join([*[json.dumps(record)] * 12, *map(json.dumps, swapped), "not json"]))
    rows = files.read_json(spark, str(path))
    assert sorted(r["txn_id"] for r in rows.collect()) == list(range(14))
    assert score_rules(rows).agg(F.max("feature_card_velocity")).first()[0] == 0
    assert [r["_corrupt_record"] for r in files.json_rejects(spark, str(path)).collect()] == ["not json"]


def test_scored_table_and_lookup(spark, txn, tmp_path):
    path = str(tmp_path / "scored")
    scored = score_rules(txn)
    tables.save_scored(scored, path, "one")
    tables.save_scored(scored.filter("score > 50"), path, "two")
    tables.save_scored(scored, path, "one")  # again: replaces, does not add
    assert tables.load_scored(spark, path, "one").count() == txn.count()
    found = tables.lookup_transaction(tables.load_scored(spark, path, "one"), 17)
    assert found.count() == 1
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(txn_id,17)" in plan and "PartitionFilters: [isnotnull(batch_id" in plan


def scans(df, metric):
    """A metric of every file scan that ``df`` made when it ran, from its executed plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName().startswith("AdaptiveSparkPlan") else plan
    out, pending = [], [plan]
    while pending:
        node = pending.pop()
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            out.append(node.metrics().apply(metric).value())
        pending += [node.children().apply(i) for i in range(node.children().size())]
    return out


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export(spark, txn, tmp_path, fmt):
    scored = score_rules(txn).persist()
    tables.write_export(scored, str(tmp_path / "export"), fmt)
    read = {n: tables.read_export(spark, str(tmp_path / "export"), n, scored.schema, fmt) for n in tables.export_columns(scored)}
    levels = {r["risk_level"]: r["count"] for r in scored.groupBy("risk_level").count().collect()}
    counts = {n: df.count() for n, df in read.items()}
    assert counts == {
        "all_transactions": 1000, "high_risk": levels["HIGH"], "medium_risk": levels["MEDIUM"], "training_data": 1000,
    }
    assert set(read["training_data"].columns) == {c for c in scored.columns if c.startswith("feature_")} | {"score", "risk_level"}
    one = lambda df: sorted(map(tuple, df.select("txn_id", "score", "card_number", "feature_amount").collect()))
    assert one(read["high_risk"]) == one(scored.filter("risk_level = 'HIGH'"))
    scored.unpersist()


def test_an_export_scans_its_rows_once(spark, tmp_path):
    rows = score_rules(canonicalise(spark.range(50).selectExpr("id AS txn_id", "id * 1000.0 AS amount"), "v3"))
    rows.write.parquet(str(tmp_path / "rows"))
    views = tables.export_views(spark.read.parquet(str(tmp_path / "rows")))
    assert views.count() > 100
    assert scans(views, "numOutputRows") == [] or views._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.fixture(scope="module")
def found(spark, tmp_path_factory):
    """Forty thousand rows in many files and row groups; one account has a third of them."""
    folder = str(tmp_path_factory.mktemp("lookup"))
    account = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), (F.col("id") % 997).cast("string")))
    rows = spark.range(40_000).select(
        (F.col("id") * 7 % 40_000).alias("txn_id"), account.alias("sender_account"),
        F.when(F.col("id") % 5 > 0, F.concat(F.lit("r"), F.sha2(F.col("id").cast("string"), 256))).alias("reference"),
        F.repeat(F.lit("x"), 50).alias("padding"),
    )
    lookup.save_lookup(rows.repartition(8), folder, files=6, **{"parquet.block.size": "65536", "parquet.page.size": "8192"})
    return folder, rows.persist()


def test_a_lookup_by_id_reads_one_file_and_few_row_groups(spark, found):
    folder, rows = found
    files_there = spark.read.parquet(f"{folder}/rows/data").inputFiles()
    df = lookup.find(spark, folder, "txn_id", 12_345)
    assert len(files_there) >= 4 and len(df.inputFiles()) == 1
    assert [r["txn_id"] for r in df.collect()] == [12_345]
    in_file = spark.read.parquet(*df.inputFiles()).count()
    again = lookup.find(spark, folder, "txn_id", 12_345)
    again.collect()
    assert scans(again, "numFiles") == [1] and scans(again, "numOutputRows")[0] <= in_file / 3


def test_lookups_by_other_keys_find_all_rows(spark, found):
    folder, rows = found
    whole = {r["txn_id"]: r for r in rows.collect()}
    one = next(r for r in whole.values() if r["reference"] and r["txn_id"] > 20_000)
    df = lookup.find(spark, folder, "reference", one["reference"])
    assert [r["txn_id"] for r in df.collect()] == [one["txn_id"]] and len(df.inputFiles()) == 1
    for account in ("hot", "a5"):
        got = sorted(r["txn_id"] for r in lookup.find(spark, folder, "sender_account", account).collect())
        assert got == sorted(i for i, r in whole.items() if r["sender_account"] == account)
    sizes = [r["n"] for r in spark.read.parquet(f"{folder}/by_sender_account/data").groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 0.6 * 40_000  # the hot account is spread over files


def test_lookups_that_find_nothing(spark, found, tmp_path):
    folder, _ = found
    for key, value in (("txn_id", -1), ("txn_id", 10**9), ("reference", "none"), ("reference", None), ("sender_account", "zzz")):
        assert lookup.find(spark, folder, key, value).collect() == []
    lookup.save_lookup(spark.createDataFrame([], "txn_id bigint, reference string"), str(tmp_path))
    assert lookup.find(spark, str(tmp_path), "txn_id", 1).collect() == []
    assert lookup.find(spark, str(tmp_path), "reference", "r").collect() == []


def test_registry(spark, tmp_path):
    path = str(tmp_path / "registry")
    assert tables.latest_model(spark, path) is None and not tables.models_ready(spark, path)
    assert tables.model_status(spark, path)["model_version"] == "not-trained"
    tables.register_model(spark, path, model_version="a", trained_at=datetime(2024, 1, 2), classifier_path="c", forest_path="f")
    tables.register_model(spark, path, model_version="b", trained_at=datetime(2024, 1, 1))
    assert tables.latest_model(spark, path)["model_version"] == "a" and tables.models_ready(spark, path)


def test_sheet_and_batch_flows(spark, tmp_path):
    header = "Transaction Date,Transaction Amount,Merchant Category Code,SENDER ADDRESS COUNTRY,RECEIVER ADDRESS COUNTRY,Sender Account,Receiver Account\n"
    rows = ["2024-01-05 10:00:00,60000,6012,USA,IRN,a,b"] + ["2024-01-06 10:00:00,10,1,USA,USA,c,d"] * 20
    path = tmp_path / "sheet.csv"
    path.write_text(header + "\n".join(rows) + "\n")
    sheet = analyse_sheet(spark, str(path), str(tmp_path / "out"), "s1")
    assert sheet["kpis"].first()["high"] == 1 and sheet["network_edges"].count() == 2
    batch = analyse_batch(spark, str(path), str(tmp_path / "out2"), "b1", datetime(2024, 1, 7))
    assert batch["kpis"].first()["total"] == 21 and batch["alerts"].count() == 1
    assert batch["transactions"].orderBy("txn_id").first()["risk_level"] == "HIGH"
    assert C.V2.high == 61


def test_the_joined_table_follows_its_files(spark, tmp_path):
    import shutil

    from tallywatch.sources.star import transactions_table

    for name in ("events", "customer", "supplier"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", tmp_path / f"{name}.parquet")
    before = transactions_table(spark, str(tmp_path)).count()
    pq.write_table(pq.read_table(tmp_path / "events.parquet").slice(0, before // 2), tmp_path / "events.parquet")
    assert transactions_table(spark, str(tmp_path)).count() == before // 2
