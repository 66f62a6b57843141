"""Sources, quality gate, layers and the batch job."""

import datetime as dt
from pathlib import Path

import pytest
import rows

from txrisk import session
from txrisk.operators import quality, serving
from txrisk.operators.skew import HotKeys
from txrisk.operators.transactions import from_scenarios
from txrisk.__main__ import main
from txrisk.plans import lake, pipeline
from txrisk.plans.reads import LakeReads
from txrisk.schemas import ENRICHED, SCENARIOS_CSV, TRANSACTIONS, USERS
from txrisk.sources.files import read_layer, read_scenarios, read_users

DAY = dt.date(2026, 5, 22)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_users_csv(spark, tmp_path):
    rows.write_users_csv(tmp_path / "good.csv", "2025-01-01")
    rows.write_users_csv(tmp_path / "bad.csv", "soon")
    good = read_users(spark, str(tmp_path / "good.csv"))
    assert good.schema.simpleString() == USERS.simpleString()
    assert {r.created_on for r in good.collect()} == {dt.date(2025, 1, 1)}
    assert {r.created_on for r in read_users(spark, str(tmp_path / "bad.csv")).collect()} == {None}


def test_missing_scenario_file(spark, tmp_path):
    none = read_scenarios(spark, str(tmp_path / "absent.csv"))
    assert none.schema.names == SCENARIOS_CSV.names and none.count() == 0
    assert from_scenarios(none, rows.users(spark)).count() == 0


def test_missing_layer(spark, tmp_path):
    none = read_layer(spark, str(tmp_path / "absent"), ENRICHED)
    assert none.schema.names == ENRICHED.names and none.count() == 0
    assert serving.list_alerts(none).count() == 0


def test_bad_scenario_time_is_reported(spark, tmp_path):
    rows.write_cases_csv(
        tmp_path / "cases.csv",
        extra=[("late", "user_00001", "BR", 1.0, "web", 1, "tomorrow")],
    )
    users = rows.users(spark)
    txns = from_scenarios(read_scenarios(spark, str(tmp_path / "cases.csv")), users, DAY)
    report = quality.quality_report(users, txns, pipeline.enrich(txns), DAY)
    failed = {r.check_name: r for r in report.collect() if r.status == "FAIL"}
    assert failed.keys() == {"transacoes_sem_data_hora"}
    assert failed["transacoes_sem_data_hora"].invalid_count == 1
    assert failed["transacoes_sem_data_hora"].process_date == DAY
    with pytest.raises(quality.QualityError, match="transacoes_sem_data_hora"):
        quality.require_pass(report)


def test_each_check_counts_its_rows(spark):
    users = rows.users(spark)
    made = rows.transactions(spark, [
        rows.txn("ok"), rows.txn("user", user=None), rows.txn("null", amount=None),
        rows.txn("negative", amount=-0.01), rows.txn("time", when=None),
        rows.txn("country", country=None),
    ])
    scored = rows.enriched(spark, [
        dict(risk_score=0, risk_level="LOW", decision="APPROVE"),
        dict(risk_score=100, risk_level="CRITICAL", decision="BLOCK"),
        dict(risk_score=101, risk_level="HUGE", decision="REVIEW"),
        dict(risk_score=-1, risk_level="HIGH", decision="MAYBE"),
        dict(),
    ])
    report = quality.quality_report(users, made, scored)
    assert {r.check_name: (r.invalid_count, r.status) for r in report.collect()} == {
        "usuarios_com_id_nulo": (0, "PASS"),
        "usuarios_com_pais_residencia_nulo": (0, "PASS"),
        "transacoes_com_usuario_nulo": (1, "FAIL"),
        "transacoes_com_valor_invalido": (2, "FAIL"),
        "transacoes_sem_data_hora": (1, "FAIL"),
        "transacoes_sem_pais": (1, "FAIL"),
        "risk_score_fora_intervalo": (3, "FAIL"),
        "risk_level_invalido": (2, "FAIL"),
        "decision_invalida": (2, "FAIL"),
    }
    names = [r.check_name for r in serving.list_quality(report).collect()]
    assert names == sorted(names) and len(names) == 9


def job(spark, tmp_path, extra=(), root="lake", **options):
    rows.write_users_csv(tmp_path / "users.csv")
    rows.write_cases_csv(tmp_path / "cases.csv", extra)
    users = read_users(spark, str(tmp_path / "users.csv"))
    txns = from_scenarios(read_scenarios(spark, str(tmp_path / "cases.csv")), users, DAY)
    more = rows.transactions(spark, [rows.txn("tx_0", user="user_00002", ticket=150.0)])
    return pipeline.run(users, more, str(tmp_path / root), scenarios=txns, process_date=DAY,
                        **options)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 1])
def test_job_publishes_all_layers(spark, tmp_path, rows_per_task):
    got = {r.metric: r.value for r in job(spark, tmp_path, rows_per_task=rows_per_task).collect()}
    assert got == dict(users=5, transactions=7, enriched_transactions=7, alerts=1,
                       alerts_medium=0, alerts_high=0, alerts_critical=1, largest_user=2)
    root = str(tmp_path / "lake")
    stored = {layer.folder: lake.read(spark, root, layer) for layer in lake.LAYERS}
    assert {name: df.count() for name, df in stored.items()} == {
        "bronze/users": 5, "bronze/transactions": 7, "silver/enriched_transactions": 7,
        "gold/fraud_alerts": 1, "gold/data_quality": 9,
    }
    for layer in lake.LAYERS:
        assert stored[layer.folder].schema.simpleString() == layer.schema.simpleString()
    alert = stored["gold/fraud_alerts"].first()
    assert (alert.txn_id, alert.risk_level, alert.process_date) == (
        "scenario_impossible_travel", "CRITICAL", DAY)
    # tx_0 precedes the scenario of the same user by two hours.
    silver = {r.txn_id: r for r in stored["silver/enriched_transactions"].collect()}
    assert silver["scenario_valor_alto"].mins_since_prev == 120.0


def files(folder):
    return sorted(p for p in folder.rglob("*") if p.is_file())


BAD = [("x", "user_00001", "BR", -5.0, "web", 1, "2026-05-20 10:00:00")]


def test_failed_gate_leaves_the_lake_alone(spark, tmp_path):
    """After a failed run readers see the old rows, and nothing of the run is left."""
    job(spark, tmp_path)
    before = files(tmp_path / "lake")
    with pytest.raises(quality.QualityError):
        job(spark, tmp_path, extra=BAD)
    assert files(tmp_path / "lake") == before
    reads = LakeReads(spark, str(tmp_path / "lake"))
    assert reads.transactions().count() == 7 and reads.quality().count() == 9
    with pytest.raises(quality.QualityError):
        job(spark, tmp_path, root="fresh", extra=BAD)
    assert files(tmp_path / "fresh") == []
    assert LakeReads(spark, str(tmp_path / "fresh")).top_alerts().count() == 0


def test_job_leaves_nothing_in_the_shared_folder(spark, tmp_path):
    shared = Path(session.shared_folder(spark))
    before = set(shared.iterdir())
    job(spark, tmp_path, rows_per_task=1)
    with pytest.raises(quality.QualityError):
        job(spark, tmp_path, extra=BAD, rows_per_task=1)
    assert set(shared.iterdir()) == before


def test_readers_stay_with_their_run(spark, tmp_path):
    """A reader keeps its run while the next is published; the one before it is deleted then."""
    root = str(tmp_path / "lake")
    job(spark, tmp_path)
    first = LakeReads(spark, root)
    rows_of_first = first.transactions()
    late = [("late", "user_00001", "BR", 5.0, "mobile", 1, "2026-05-20 13:00:00")]
    job(spark, tmp_path, extra=late)
    assert rows_of_first.count() == first.enriched().count() == 7
    assert LakeReads(spark, root).enriched().count() == 8
    job(spark, tmp_path)
    runs = {p.name for p in (tmp_path / "lake" / lake.SILVER.folder).iterdir()}
    assert len(runs) == lake.KEPT_RUNS and f"run={first.run}" not in runs
    assert LakeReads(spark, root).enriched().count() == 7


def test_a_run_that_is_not_published_is_not_read(spark, tmp_path):
    run = lake.new_run()
    lake.write_layer(rows.users(spark), str(tmp_path), lake.BRONZE_USERS, run)
    assert lake.read(spark, str(tmp_path), lake.BRONZE_USERS).count() == 0
    lake.publish(spark, str(tmp_path), run)
    assert lake.read(spark, str(tmp_path), lake.BRONZE_USERS).count() == 5


def test_files_follow_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lake, "ROWS_PER_FILE", 40)
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i}", user_id="one", process_date=DAY, risk_level="HIGH") for i in range(400)
    ])
    assert lake.files_for(spark, 400) == 10 and lake.files_for(spark, 401) == 11
    lake.write_layer(made, str(tmp_path), lake.SILVER, "a")
    stored = list((tmp_path / lake.SILVER.folder).rglob("*.parquet"))
    assert 9 <= len(stored) <= 11
    # and so do the tasks of the features
    plan = plan_of(pipeline.enrich(rows.transactions(spark, [rows.txn("a")]), HotKeys(), tasks=11))
    assert "hashpartitioning(user_id" in plan and ", 11), REPARTITION_BY_NUM" in plan
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("gold"))
    made = rows.enriched(spark, [
        dict(txn_id=f"t{i}", user_id=f"user_{i % 7}", amount=float(i), risk_score=50 + i % 50,
             risk_level=["MEDIUM", "HIGH", "CRITICAL"][i % 3], decision="REVIEW",
             process_date=dt.date(2026, 5, 1 + i % 4), risk_reasons=["NEW_DEVICE"])
        for i in range(200)
    ])
    return lake.write_layer(made, root, lake.ALERTS, "run"), made


def test_layer_round_trip(gold):
    stored, made = gold
    assert stored.exceptAll(made).count() == 0 and made.exceptAll(stored).count() == 0


def test_layers_without_rows(spark, tmp_path):
    none = rows.enriched(spark, [])
    for layer in (lake.SILVER, lake.ALERTS):
        assert lake.write_layer(none, str(tmp_path), layer, "run").count() == 0


def test_other_read_errors_are_raised(spark, tmp_path):
    (tmp_path / "broken.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="broken.parquet"):
        read_layer(spark, str(tmp_path / "broken.parquet"), ENRICHED).count()


def test_filters_prune_and_push_down(gold):
    stored, _ = gold
    chosen = serving.list_alerts(
        stored, risk_level="HIGH", date_from="2026-05-02", date_to="2026-05-03", user_id="user_1",
        min_amount=5,
    ).select("txn_id", "risk_score")
    plan = plan_of(chosen)
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    partition_part = scan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "risk_level" in partition_part and "HIGH" in partition_part
    assert "process_date" in partition_part and "2026-05-02" in partition_part
    assert "EqualTo(user_id,user_1)" in scan and "GreaterThanOrEqual(amount,5.0)" in scan
    assert "prev_city" not in scan
    assert "TakeOrderedAndProject" in plan


def test_shared_folder_comes_from_the_session(spark):
    assert session.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert session.scratch_path(spark, "x") != session.scratch_path(spark, "x")


def test_object_store_settings():
    conf = session.object_store_conf("http://store:9000", "key", "secret", tls=False)
    assert conf["spark.hadoop.fs.s3a.endpoint"] == "http://store:9000"
    assert conf["spark.hadoop.fs.s3a.connection.ssl.enabled"] == "false"
    assert conf["spark.hadoop.fs.s3a.path.style.access"] == "true"
    assert conf["spark.hadoop.fs.s3a.connection.timeout"] == "60000"
    assert conf["spark.hadoop.fs.s3a.connection.establish.timeout"] == "5000"


def test_transactions_have_declared_columns(spark):
    made = rows.transactions(spark, [rows.txn("a")])
    assert made.schema.names == TRANSACTIONS.names


def test_reads_over_a_published_lake(spark, tmp_path):
    job(spark, tmp_path)
    reads = LakeReads(spark, str(tmp_path / "lake"))
    fields = {"txn_id", "user_id", "risk_score", "risk_level", "risk_reasons", "decision"}
    assert fields <= set(reads.top_alerts().columns)
    assert [r.txn_id for r in reads.top_alerts().collect()] == ["scenario_impossible_travel"]
    assert reads.alerts(risk_level="LOW").count() == 0
    assert reads.alerts(reason="NEW_DEVICE", decision="BLOCK", country="JP").count() == 1
    assert reads.quality().count() == 9
    assert reads.transaction("scenario_valor_alto").first().risk_score == 25
    assert reads.transaction("nothing").count() == 0
    assert [r.txn_id for r in reads.history("user_00001").collect()] == [
        "scenario_impossible_travel", "scenario_normal_br"]
    assert reads.risk_profile("user_00001").first().total_amount == 4285.9
    assert reads.risk_profile("nobody").count() == 0
    assert reads.all_risk_profiles().count() == 5
    assert reads.kpis().first().critical_alerts == 1
    assert reads.score_series().first().label == "ID scenario_impossible_travel"
    shown = reads.alert_page(1).first()
    assert shown.route_from == "BR" and shown.reason_labels[0] == "Viagem impossivel"
    assert reads.alert_page(2).count() == 0


def test_reads_before_anything_is_published(spark, tmp_path):
    reads = LakeReads(spark, str(tmp_path / "nowhere"))
    for df in (reads.top_alerts(), reads.quality(), reads.transaction("a"), reads.history("u"),
               reads.risk_profile("u"), reads.alert_page(1)):
        assert df.count() == 0
    assert reads.kpis().first().loaded_alerts == 0


def test_command_line(spark, tmp_path, capsys):
    rows.write_users_csv(tmp_path / "users.csv")
    rows.write_cases_csv(tmp_path / "cases.csv")
    lake.write_layer(
        rows.transactions(spark, [rows.txn("tx_0", user="user_00002")]), str(tmp_path),
        lake.BRONZE_TRANSACTIONS, "in",
    )
    main(["--users", str(tmp_path / "users.csv"), "--scenarios", str(tmp_path / "cases.csv"),
          "--transactions", lake.layer_path(str(tmp_path), lake.BRONZE_TRANSACTIONS, "in"),
          "--lake", str(tmp_path / "lake"), "--date", "2026-05-22"])
    assert "enriched_transactions" in capsys.readouterr().out
    assert LakeReads(spark, str(tmp_path / "lake")).top_alerts().count() == 1


def test_silver_is_laid_out_from_stored_rows(spark, tmp_path, monkeypatch):
    """The range shuffle reads its input twice, so it must not hold the windows."""
    plans, write = [], lake.write_layer

    def watched(df, root, layer, *rest):
        if layer is lake.SILVER:
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, root, layer, *rest)

    monkeypatch.setattr(lake, "write_layer", watched)
    txns = rows.transactions(spark, [rows.txn("1"), rows.txn("2", when="2026-05-20 10:30:00")])
    pipeline.run(rows.users(spark), txns, str(tmp_path / "lake"))
    assert len(plans) == 1 and "Window" not in plans[0]
