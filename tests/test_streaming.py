"""Streams give what the batch gives."""

import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tallywatch import constants as C
from tallywatch.operators.rules import score_rules, snapshots_of
from tallywatch.operators.velocity import with_velocity
from tallywatch.plans.models import load_models, train_models
from tallywatch.streaming.scoring import (
    load_snapshots,
    read_transaction_stream,
    save_snapshots,
    score_stream,
    write_stream,
)
from tallywatch.streaming.keyed import KeyedVelocity
from tallywatch.streaming.rolling import RollingScores
from tallywatch.streaming.runs import RunStore, Table, summed
from tallywatch.streaming.velocity import TABLES, RunningVelocity
from tests.compare import connect, differences


def test_registered_streams_match_sql(spark, folder):
    import __spark_entry__ as entry

    con = connect(folder)
    for name in ("stream_scoring", "stream_velocity", "stream_state_velocity", "stream_state_late", "stream_scoring_rolling", "stream_hybrid"):
        assert differences(entry.queries()[name](spark, folder), con, entry.oracle_sql()[name])[:3] == []


def test_json_stream_equals_batch(spark, txn, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = txn.orderBy("txn_id").limit(60).collect()
    for part in range(3):
        lines = [
            json.dumps(
                {
                    "amount": r["amount"], "mcc": r["mcc"], "sender_country": r["sender_country"].lower(),
                    "receiver_country": r["receiver_country"], "receiver_first_name": r["receiver_first_name"],
                    "receiver_last_name": r["receiver_last_name"], "card_number": r["card_number"],
                    "transaction_reference": str(r["txn_id"]), "transaction_date": str(r["ts"]),
                    "sender_account": r["sender_account"], "receiver_account": r["receiver_account"],
                    "payment_format": r["payment_format"],
                }
            )
            for r in rows[part * 20 : part * 20 + 20]
        ]
        (source / f"{part}.json").write_text("\n".join(lines))
    save_snapshots(snapshots_of(txn), str(tmp_path / "snap"))
    incoming = read_transaction_stream(spark, str(source), maxFilesPerTrigger="1")
    scored = score_stream(incoming, load_snapshots(spark, str(tmp_path / "snap")))
    write_stream(scored, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {int(r["reference"]): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["txn_id"]: r for r in score_rules(txn).filter("txn_id < 60").collect()}
    assert len(got) == 60
    for key, row in got.items():
        assert (row["score"], row["flags_text"]) == (want[key]["score"], want[key]["flags_text"])

    # With models the same stream is blended; a record's own features are those of a lone row.
    train_models(txn, str(tmp_path / "models"), rounds=2, trees=5)
    models = load_models(spark, str(tmp_path / "models"))
    blended = score_stream(
        read_transaction_stream(spark, str(source)), load_snapshots(spark, str(tmp_path / "snap")), models
    )
    write_stream(blended, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out2"))
    assert out.count() == 60 and out.filter("score < 0 OR score > 100 OR model_score IS NULL").count() == 0


def test_running_velocity_replays_and_skew(spark, tmp_path):
    """In-order micro-batches equal the batch; running one again changes nothing; late rows count."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=20 * i), "a" if i % 3 else "b", f"p{i % 7}") for i in range(240)]
    df = spark.createDataFrame(rows, "txn_id bigint, ts timestamp, sender_account string, receiver_account string")
    running = RunningVelocity(str(tmp_path / "state"))
    for batch_id in range(4):
        part = df.filter(F.floor(F.col("txn_id") / 60) == batch_id)
        running.process(part, batch_id)
        if batch_id in (1, 3):
            running.process(part, batch_id)
    columns = ["txn_id", *C.VELOCITY_HOURS, "is_new_payee"]
    got = sorted(map(tuple, running.results(spark).select(*columns).collect()))
    want = sorted(map(tuple, with_velocity(df, "sender_account", "receiver_account").select(*columns).collect()))
    assert got == want

    # A late row changes the counts of rows after it, and is the first of its pair.
    late = spark.createDataFrame([(999, t0 + timedelta(minutes=1), "a", "p1"), (1000, None, "a", "p1")], df.schema)
    running.process(late, 4)
    running.process(late, 4)
    got = sorted(map(tuple, running.results(spark).select(*columns).collect()))
    both = df.unionByName(late)
    assert got == sorted(map(tuple, with_velocity(both, "sender_account", "receiver_account").select(*columns).collect()))
    assert (999, 1, 1, 1, 1) in got


def test_runs_stay_few_over_many_micro_batches(spark, tmp_path):
    """Files per day are bounded after 50 micro-batches, and running some of them again changes nothing."""
    table = Table("key string, n bigint, day string", summed(["key", "day"], "n"), ("day", "key"), ("day",))
    store = RunStore(str(tmp_path), {"t": table})
    for batch_id in range(50):
        rows = spark.createDataFrame([(f"k{batch_id % 7}", batch_id, "d")], table.schema).coalesce(1)
        for _ in range(2 if batch_id in (3, 15, 16, 49) else 1):  # where levels merge, behind that, and the last
            store.commit(spark, batch_id, {"t": rows})
    live = store.manifest(spark)
    levels = [level for _, level, _ in live]
    assert len(levels) <= 3 * 3 and max(levels) == 2
    assert len(list(tmp_path.glob("t/*/day=d/*.parquet"))) <= 2 * len(levels)
    assert len(list((tmp_path / "manifest").iterdir())) <= 3
    got = {r["key"]: r["n"] for r in store.current(spark, "t").collect()}
    assert got == {f"k{k}": sum(range(k, 50, 7)) for k in range(7)}


def test_velocities_over_merged_runs(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    schema = "txn_id bigint, ts timestamp, sender_account string, receiver_account string"
    rows = [(i, t0 + timedelta(minutes=9 * i + (i * 7919) % 40), f"s{i % 4}", f"p{i % 3}") for i in range(200)]
    running = RunningVelocity(str(tmp_path / "state"), fan=2)
    for batch_id in range(8):
        part = spark.createDataFrame(rows[25 * batch_id : 25 * batch_id + 25], schema).coalesce(1)
        for _ in range(2 if batch_id in (1, 6, 7) else 1):
            running.process(part, batch_id)
    columns = ["txn_id", *C.VELOCITY_HOURS, "is_new_payee"]
    got = sorted(map(tuple, running.results(spark).select(*columns).collect()))
    batch = with_velocity(spark.createDataFrame(rows, schema), "sender_account", "receiver_account").select(*columns)
    assert got == sorted(map(tuple, batch.collect()))
    assert sorted(run[:2] for run in running.store.manifest(spark)) == [(name, 3) for name in sorted(TABLES)]


def test_an_unfinished_manifest_is_not_read(spark, tmp_path):
    schema = "txn_id bigint, ts timestamp, sender_account string, receiver_account string"
    running = RunningVelocity(str(tmp_path / "state"))
    running.process(spark.createDataFrame([(1, datetime(2024, 1, 1), "a", "p")], schema), 0)
    before = running.results(spark).collect()
    (tmp_path / "state" / "manifest" / f"{1:020d}").mkdir()
    assert running.results(spark).collect() == before


def test_keyed_state_counts_in_any_order_and_lists_what_is_late(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(i, t0 + timedelta(minutes=7 * i), "a" if i % 3 else "b") for i in range(300)]
    rows += [(1000 + i, t0 + timedelta(minutes=7 * 30), "a") for i in range(5)]  # equal times
    df = spark.createDataFrame(rows, "txn_id bigint, ts timestamp, sender_account string")
    running = KeyedVelocity(str(tmp_path / "out"), "2 hours", salts=2)

    def deliver(name, part):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / name))
        incoming = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*"))
        running.start(incoming, str(tmp_path / "checkpoint")).awaitTermination()

    # The first half out of order by up to an hour, then the rest with two rows that are too late.
    half = F.col("ts") < F.lit(t0 + timedelta(hours=17))
    swapped = F.pmod(F.xxhash64("txn_id"), F.lit(10)) == 0
    near = F.col("ts") >= F.lit(t0 + timedelta(hours=16))
    deliver("0", df.filter(half & ~(swapped & near)))
    deliver("1", df.filter(half & swapped & near))
    late = spark.createDataFrame([(5000, t0 + timedelta(hours=1), "a"), (5001, None, "a")], df.schema)
    deliver("2", df.filter(~half).unionByName(late))
    kept = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "checkpoint"))
    assert 0 < kept.count() <= 2 * 2 * 28  # hours of a day and the delay, per sender and salt
    deliver("3", spark.createDataFrame([(None, t0 + timedelta(days=9), None)], df.schema))
    got = sorted(map(tuple, running.results(spark).collect()))
    batch = with_velocity(df, "sender_account", None).select("txn_id", *C.VELOCITY_HOURS)
    assert got == sorted(map(tuple, batch.collect()))
    assert [r["txn_id"] for r in running.late(spark).collect()] == [5000]
    assert kept.sparkSession.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "checkpoint")).count() == 0


def test_keyed_state_has_few_keys_for_many_senders(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(2**60 + i, t0 + timedelta(minutes=i % 600), f"s{i % 211}") for i in range(2000)]
    df = spark.createDataFrame(rows + [(None, datetime(2030, 1, 1), "s0")], "txn_id bigint, ts timestamp, sender_account string")
    running = KeyedVelocity(str(tmp_path / "out"), salts=2, buckets=3)
    df.filter("txn_id IS NOT NULL").write.parquet(str(tmp_path / "in" / "0"))
    running.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "checkpoint")).awaitTermination()
    kept = spark.read.format("statestore").option("stateVarName", "times").load(str(tmp_path / "checkpoint"))
    assert 0 < kept.select("key").distinct().count() <= 3 * 2
    df.filter("txn_id IS NULL OR txn_id % 2 = 0").write.parquet(str(tmp_path / "in" / "1"))  # an id and none together
    running.start(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in" / "*")), str(tmp_path / "checkpoint")).awaitTermination()
    again = df.filter("txn_id IS NOT NULL").filter(F.col("ts") <= F.lit(t0 + timedelta(minutes=539)))
    late = again.filter("txn_id % 2 = 0").select("txn_id")
    assert sorted(r[0] for r in running.late(spark).collect()) == sorted(r[0] for r in late.collect())
    got = {r["txn_id"]: tuple(r)[1:] for r in running.results(spark).filter("txn_id % 2 = 1").collect()}
    first = with_velocity(df.filter("txn_id IS NOT NULL"), "sender_account", None).filter("txn_id % 2 = 1").filter(F.col("ts") <= F.lit(t0 + timedelta(minutes=539)))
    want = {r["txn_id"]: tuple(r)[1:] for r in first.select("txn_id", *C.VELOCITY_HOURS).collect()}
    assert want and all(got[k] == want[k] for k in want)


def test_rolling_scores_see_what_came_before_and_replay(spark, txn, tmp_path):
    rolling = RollingScores(str(tmp_path), fan=2)
    for batch_id in range(4):
        part = txn.filter(F.col("txn_id") % 4 == batch_id)
        for _ in range(2 if batch_id in (1, 3) else 1):
            rolling.process(part, batch_id)
        rolling.process(txn.limit(0), 100 + batch_id)
    whole, so_far = snapshots_of(txn), rolling.snapshots(spark)
    assert so_far.stats.rows == whole.stats.rows
    assert abs(so_far.stats.mean - whole.stats.mean) < 1e-9 * whole.stats.mean
    assert abs(so_far.stats.std - whole.stats.std) < 1e-9 * whole.stats.std
    for a, b in ((so_far.cards, whole.cards), (so_far.receivers, whole.receivers)):
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect()))
    before = score_rules(txn.filter("txn_id % 4 = 3"), snapshots=snapshots_of(txn.filter("txn_id % 4 < 3")))
    columns = ["txn_id", "score", "flags_text", "feature_zscore"]
    got = rolling.results(spark).filter("txn_id % 4 = 3").select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, before.select(*columns).collect()))


def test_payees_are_never_forgotten(spark, tmp_path):
    schema = "txn_id bigint, ts timestamp, sender_account string, receiver_account string"
    running = RunningVelocity(str(tmp_path / "state"))
    days = [datetime(2024, 1, 1), datetime(2024, 1, 20), datetime(2029, 6, 1)]
    for i, day in enumerate(days):
        running.process(spark.createDataFrame([(i, day, "a", "p")], schema), i)
    got = {r["txn_id"]: r["is_new_payee"] for r in running.results(spark).collect()}
    assert got == {0: 1, 1: 0, 2: 0}
