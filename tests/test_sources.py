"""Adapters on small hand-made raw files, preparation end to end, contracts, settings and the delay tool."""

import datetime as dt
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lagline.plans import cli, delay_tool, experiment, features
from lagline.plans.prepare import canonical, prepare
from lagline.sources import adapters, config, files, schema, sinks

D = dt.datetime


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text.lstrip("\n"))
    return folder


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def settings(tmp_path, **over):
    c = config.load()
    return config.Config(tmp_path / "raw", tmp_path / "out", c.ratios, c.delay, c.gap_us, {**c.datasets, **over})


CORE = ("event_time", "entity_id", "amount", "is_fraud")


def test_paysim(spark, tmp_path):
    put(tmp_path, "any.csv", "step,type,amount,nameOrig,isFraud\n1,PAYMENT,9.5,C1,0\n25,TRANSFER,100,C2,1\n")
    got = adapters.get("paysim").canonical(spark, tmp_path, {"start_date": "2023-01-01"})
    assert rows(got, *CORE) == [(D(2023, 1, 1), "C1", 9.5, False), (D(2023, 1, 2), "C2", 100.0, True)]
    assert got.columns[:4] == list(CORE)
    with pytest.raises(ValueError):
        adapters.get("paysim").canonical(spark, tmp_path, {})
    put(tmp_path, "other.csv", "a\n1\n")
    with pytest.raises(FileNotFoundError):
        files.single_csv(tmp_path)


def test_banksim(spark, tmp_path):
    put(tmp_path, "bs140513_032310.csv", "step,customer,age,merchant,category,amount,fraud\n0,'C1','4','M1','es_x',4.55,0\n179,'C2','2','M1','es_y',3.0,1\n")
    put(tmp_path, "bsNET140513_032310.csv", "Source,Target\n'C1','M1'\n")
    got = adapters.get("banksim").canonical(spark, tmp_path, {"start_date": "2023-01-01"})
    assert rows(got, *CORE, "merchant") == [(D(2023, 1, 1), "C1", 4.55, False, "M1"), (D(2023, 6, 29), "C2", 3.0, True, "M1")]


SPARKOV = "Unnamed: 0,trans_date_trans_time,cc_num,merchant,category,amt,gender,city,state,zip,lat,long,city_pop,job,dob,trans_num,unix_time,merch_lat,merch_long,is_fraud\n"


def sparkov_row(i, at, fraud=0, card="4321000000000001"):
    return f"{i},{at},{card},m{i % 3},food,{10 + i}.5,F,Town,ND,{500 + i},40.5,-80.1,{100 * i},Clerk,1980-01-02,t{i},{i},40.9,-80.3,{fraud}\n"


def sparkov_raw(folder, n=8):
    put(folder, "fraudTrain.csv", SPARKOV + "".join(sparkov_row(i, f"2019-01-0{1 + i // 3} 0{i}:00:00", int(i % 4 == 1)) for i in range(n)))
    put(folder, "fraudTest.csv", SPARKOV + "".join(sparkov_row(n + i, f"2020-07-0{1 + i} 01:00:00", int(i == 0)) for i in range(3)))


def test_sparkov(spark, tmp_path):
    sparkov_raw(tmp_path)
    a = adapters.get("sparkov")
    got = a.canonical(spark, tmp_path, {})
    assert "Unnamed: 0" not in got.columns and {r[0] for r in rows(got, "entity_id")} == {"4321000000000001"}
    cut = a.split(got, {"val_fraction": 0.5})
    n = {r["split"]: r["count"] for r in cut.groupBy("split").count().collect()}
    assert n == {"train": 4, "val": 4, "test": 3}
    assert {r[0] for r in rows(cut.where("split = 'test'"), "source_file")} == {"fraudTest.csv"}


IBM = {
    "credit_card_transactions-ibm_v2.csv": """
User,Card,Year,Month,Day,Time,Amount,Use Chip,Merchant Name,Merchant City,Merchant State,Zip,MCC,Errors?,Is Fraud?
0,0,2002,9,1,06:21,$134.09,Swipe Transaction,3527213246127876953,La Verne,CA,91750.0,5300,,No
0,0,2002,9,1,06:42,$-25.00,Online Transaction,-727612092139916043, ONLINE,,,5411,Bad PIN,No
0,1,2003,1,2,7:05,$10.00,Chip Transaction,-727612092139916043,Rome,Italy,,5499,,Yes
1,0,2011,1,1,00:01,"$1,000.00",Chip Transaction,55,Fargo,ND,58102.0,5816,,No
""",
    "sd254_cards.csv": """
User,CARD INDEX,Card Brand,Card Type,Has Chip,Cards Issued,Credit Limit,Acct Open Date,Expires,Year PIN last Changed,Card on Dark Web
0,0,Visa,Debit,YES,2,$24295,09/2002,12/2022,2008,No
0,1,Visa,Credit,NO,1,$21968,04/2014,12/2020,2014,Yes
1,0,Mastercard,Debit,YES,1,$100,01/2010,02/2024,2011,No
""",
    "sd254_users.csv": """
Person,Current Age,Retirement Age,Birth Year,Gender,City,State,Per Capita Income - Zipcode,Yearly Income - Person,Total Debt,FICO Score,Num Credit Cards
Ann,53,66,1966,Female,La Verne,CA,$29278,$59696,$127613,787,2
Bob,40,67,1980,Male,Fargo,ND,$100,$0,$5,700,1
""",
}


def test_ibm(spark, tmp_path):
    for name, text in IBM.items():
        put(tmp_path, name, text.replace('"$1,000.00"', "$1000.00"))
    got = adapters.get("ibm_ccf").canonical(spark, tmp_path, {}).orderBy("event_time")
    assert rows(got, *CORE) == [(D(2002, 9, 1, 6, 21), "0", 134.09, False), (D(2002, 9, 1, 6, 42), "0", -25.0, False), (D(2003, 1, 2, 7, 5), "0", 10.0, True), (D(2011, 1, 1, 0, 1), "1", 1000.0, False)]
    assert rows(got, "Person", "`Card Brand`", "`Credit Limit`") == [("Ann", "Visa", 24295.0), ("Ann", "Visa", 24295.0), ("Ann", "Visa", 21968.0), ("Bob", "Mastercard", 100.0)]
    by_card = adapters.get("ibm_ccf").canonical(spark, tmp_path, {"entity_key": "card"})
    assert {r[0] for r in rows(by_card, "entity_id")} == {"0-0", "0-1", "1-0"}
    with pytest.raises(ValueError):
        adapters.get("ibm_ccf").canonical(spark, tmp_path, {"entity_key": "house"})
    keyed = got.withColumns({"rid": F.row_number().over(__import__("pyspark").sql.Window.orderBy("event_time")), "reported_at": F.lit(None).cast("timestamp_ntz"), "split": F.lit("train")})
    f = features.ibm_ccf(keyed)
    assert len(sinks.feature_columns(f)) == 82 and len(sinks.artifact_columns(f)) == 8
    r = {x["event_time"]: x for x in sinks.check_features(f).collect()}[D(2003, 1, 2, 7, 5)]
    assert (r["first_foreign_for_entity"], r["merchant_is_foreign"], r["mcc_group"], r["entity_txn_ordinal"], r["card_on_dark_web"]) == (1, 1, "54", 2, 1)
    assert r["errors_7d"] == 0 and r["artifact_error_type"] == "No Error" and r["secs_since_same_merchant"] > 0


def test_ieee(spark, tmp_path):
    head = "TransactionID,isFraud,TransactionDT,TransactionAmt,ProductCD,card1,addr1,D1\n"
    put(tmp_path, "train_transaction.csv", head + "1,0,86400,68.5,W,139,315,14\n2,1,86401,29.0,W,139,,0\n3,0,86499,59.0,W,466,330,\n4,0,172800,5.0,W,139,315,15\n")
    put(tmp_path, "train_identity.csv", "TransactionID,id_01\n4,-5\n")
    put(tmp_path, "test_transaction.csv", head.replace("isFraud,", "") + "9,18403224,31.9,W,10409,170,419\n")
    put(tmp_path, "test_identity.csv", "TransactionID,id_01\n9,-45\n")
    a, o = adapters.get("ieee_cis"), {"start_date": "2017-12-01"}
    got = a.canonical(spark, tmp_path, o)
    assert rows(got, "event_time", "entity_id", "id_01") == [(D(2017, 12, 2), "139_315.0_-13.0", None), (D(2017, 12, 2, 0, 0, 1), "txn_2", None), (D(2017, 12, 2, 0, 1, 39), "txn_3", None), (D(2017, 12, 3), "139_315.0_-13.0", -5)]
    aux = a.auxiliary(spark, tmp_path, o)["unlabelled_test"]
    assert aux.count() == 1 and "isFraud" not in aux.columns


SAML = "Time,Date,Sender_account,Receiver_account,Amount,Payment_currency,Received_currency,Sender_bank_location,Receiver_bank_location,Payment_type,Is_laundering,Laundering_type\n"


def test_saml(spark, tmp_path):
    put(tmp_path, "SAML-D.csv", SAML + "10:35:19,2022-10-07,8724731955,2769355426,1459.15,UK pounds,UK pounds,UK,UK,Cash Deposit,0,Normal_Cash\n10:36:00,2022-10-07,8724731955,2769355426,9500,UK pounds,Euro,UK,Spain,ACH,1,Smurfing\n")
    got, dropped = canonical(spark, "saml_d", settings(tmp_path), tmp_path)
    assert dropped == "Is_laundering" and "Laundering_type" in got.columns
    assert rows(got, *CORE)[0] == (D(2022, 10, 7, 10, 35, 19), "8724731955", 1459.15, False)
    f = features.saml_d(schema.with_rid(got, ["event_time", "entity_id", "amount"]).withColumns({"reported_at": F.lit(None).cast("timestamp_ntz"), "split": F.lit("train")}))
    assert len(sinks.feature_columns(f)) == 63 and len(sinks.artifact_columns(f)) == 3
    r = f.orderBy("event_time").collect()[1]
    assert (r["amount_just_under_10k"], r["is_cross_border"], r["receiver_in_count_24h"], r["first_receiver_for_entity"], r["receiver_prior_distinct_senders"]) == (1, 1, 1, 0, 1)


def test_amaretto_from_a_split_archive(spark, tmp_path):
    text = "EntryDate,Originator,Normalized Amount,Anomaly\n2019-01-01 06:07:08,acct_7,1250000.25,0\n2019-01-01 18:00:00,Client_1,5.0,3\n"
    whole = tmp_path / "x.zip"
    with zipfile.ZipFile(whole, "w") as z:
        z.writestr("amaretto_dataset_anon.csv", text)
    data = whole.read_bytes()
    whole.unlink()
    step = len(data) // 11 + 1
    for k in range(11):  # unpadded numbers: their order is numeric
        (tmp_path / f"amaretto_dataset_anon.zip.{k + 1}").write_bytes(data[k * step : (k + 1) * step])
    got = adapters.get("amaretto").canonical(spark, tmp_path, {})
    assert rows(got, *CORE, "Anomaly") == [(D(2019, 1, 1, 6, 7, 8), "acct_7", 1250000.25, False, 0), (D(2019, 1, 1, 18), "Client_1", 5.0, True, 3)]
    (tmp_path / "amaretto_dataset_anon.zip.3").unlink()
    (tmp_path / "_extracted" / "amaretto_dataset_anon.csv").unlink()
    with pytest.raises(FileNotFoundError):
        files.split_zip_member(tmp_path, "amaretto_dataset_anon.zip.*", "amaretto_dataset_anon.csv", tmp_path / "_extracted")


def test_prepare_features_and_studies(spark, tmp_path):
    c = settings(tmp_path)
    sparkov_raw(c.raw / "sparkov", n=9)
    for name in ("sparkov", "sparkov_slow"):
        prepare(spark, name, c)
    card = json.loads((c.processed / "sparkov" / "dataset_card.json").read_text())
    assert card["n_rows"] == 12 and card["split"]["counts"]["test"] == 3 and card["label_delay"]["n_campaigns"] >= 1
    df = spark.read.parquet(f"file://{c.processed}/sparkov/data.parquet")
    assert df.columns[:6] == list(schema.CORE)
    assert df.where("is_fraud <> (reported_at is not null)").count() == 0
    at = cli.build_features(spark, "sparkov", c)
    f = spark.read.parquet(at)
    assert len(sinks.feature_columns(f)) == 50 and "reported_at_slow" in f.columns
    study = experiment.delay_study(schema.with_rid(f, ["event_time", "entity_id", "amount"]), "slow", 4)
    assert study.where("split <> 'train' and y_true <> y_fit").count() == 0 and study.count() == 12
    assert max(len(r["history"]) for r in study.collect()) == 4
    before = sorted(p.name for p in c.processed.iterdir())
    with pytest.raises(RuntimeError):  # a failing write leaves the old folder
        class Bad:
            @property
            def write(self):
                raise RuntimeError

        sinks.publish(c.processed / "sparkov", {"data": Bad()}, {})
    assert sorted(p.name for p in c.processed.iterdir()) == before and (c.processed / "sparkov" / "dataset_card.json").exists()
    with pytest.raises(ValueError):
        sinks.check_names(["../x"])
    at = sinks.uri(tmp_path / "by" / "uri")  # any store that Spark writes to, named by its scheme
    for n in (3, 5):
        assert sinks.publish(at, {"data": spark.range(n)}, {"n": n}) == at and spark.read.parquet(f"{at}/data.parquet").count() == n
    assert [p.name for p in (tmp_path / "by").iterdir()] == ["uri"]


def test_row_numbers_do_not_depend_on_the_run(spark):
    rows = [(D(2020, 1, 1), "a", 5.0, k % 3) for k in range(9)]
    df = spark.createDataFrame(rows, "event_time timestamp_ntz, entity_id string, amount double, extra int")
    got = [schema.with_rid(df.repartition(n), ["event_time", "entity_id", "amount"]).orderBy("rid").collect() for n in (1, 4, 7)]
    assert got[0] == got[1] == got[2] and [r["rid"] for r in got[0]] == list(range(9))


def test_windows_study(spark):
    """The three regimes share their targets; parts are disjoint where they must be."""
    t0 = D(2016, 1, 1)
    data = [(i, f"e{i % 6}", t0 + dt.timedelta(hours=i), i % 9 == 0, float(i % 13), "x" if i % 2 else "y", 0.0, f"s{i % 4}") for i in range(240)]
    f = spark.createDataFrame(data, "rid long, entity_id string, event_time timestamp_ntz, is_fraud boolean, a double, b string, merchant_is_foreign double, artifact_merchant_state string").withColumn("reported_at", F.lit(None).cast("timestamp_ntz"))
    many = 6  # a, b, merchant_is_foreign and three of rarity
    targets = set()
    for regime in experiment.REGIMES:
        got = experiment.windows_study(f, regime, 5, 5, many)
        assert {len(r["rows"]) for r in got.collect()} == {5}
        targets.add(tuple(sorted(r["rid"] for r in got.collect())))
        if regime == "customers":
            assert got.where("split is not null").groupBy("entity_id").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert len(targets) == 1
    with pytest.raises(ValueError):
        experiment.windows_study(f, "other")


def test_feature_contract(spark):
    ok = spark.createDataFrame([("a", D(2020, 1, 1), None, False, "train", 1.0, None)], "entity_id string, event_time timestamp_ntz, reported_at timestamp_ntz, is_fraud boolean, split string, x double, c string")
    out = sinks.check_features(ok)
    assert dict(out.dtypes)["x"] == "float" and out.first()["c"] == "~na"
    for bad in (ok.withColumn("x", F.lit(float("inf"))), ok.drop("split"), ok.withColumn("Laundering_type", F.lit("x")), ok.withColumn("reported_at_slow", F.lit(1))):
        with pytest.raises(ValueError):
            sinks.check_features(bad)
    with pytest.raises(ValueError):
        sinks.check_features(ok, ("other",))


def test_schema(spark):
    ok = spark.createDataFrame([(D(2020, 1, 1), "a", 1.0, True)], "event_time timestamp_ntz, entity_id string, amount double, is_fraud boolean")
    schema.validate(ok)
    t = lambda *d: F.lit(str(D(*d))).cast("timestamp_ntz")
    for bad in (ok.where("1 = 0"), ok.drop("amount"), ok.withColumn("amount", F.lit(1)), ok.withColumn("entity_id", F.lit(None).cast("string")), ok.withColumn("event_time", t(1980, 1, 1)), ok.withColumn("reported_at", t(2019, 1, 1)), ok.withColumn("is_fraud", F.lit(False)).withColumn("reported_at", t(2021, 1, 1))):
        with pytest.raises(schema.SchemaError):
            schema.validate(bad)


def test_settings(tmp_path):
    c = config.load()
    assert c.delay_for("sparkov_slow").max_delay_days == 365 and c.gap_for("amaretto") == 3_600_000_000 and c.delay_for("banksim").median_days == 7
    for text in ("datasets: {paysim: {colour: red}}", "datasets: {paysim: {delay: {sigm: 1}}}", "campaign: {gap: 7}", "split: {ratios: [1, 1, 1]}", "datasets: {paysim: {delay: {sigma: -1}}}", "paths: {raw: null}", "a: [", "datasets: {x: {campaign_gap: '5'}}"):
        p = tmp_path / "s.yaml"
        p.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load(p)
    p.write_text("datasets: {paysim: {delay: {sigma: 2}}}")
    assert config.load(p).delay_for("paysim").median_days == 1.0  # laid over, not instead


def test_registry_and_fetch(tmp_path):
    assert adapters.names() == ["amaretto", "banksim", "ibm_ccf", "ieee_cis", "paysim", "saml_d", "sparkov", "sparkov_slow"]
    assert {"Anomaly", "Laundering_type", "is_fraud"} <= adapters.always_excluded()
    with pytest.raises(adapters.UnknownDataset):
        adapters.get("nope")
    with pytest.raises(ValueError):
        adapters.register(type("X", (adapters.Adapter,), {"name": "x"}))
    put(tmp_path / "have", "a.csv", "x\n")
    assert files.fetch(files.GitRepo("file:///nowhere"), tmp_path / "have") == tmp_path / "have"
    with pytest.raises(files.FetchError):
        files.fetch(files.GitRepo("file:///nowhere"), tmp_path / "none")
    assert "/rules" in files.HostedCompetition("c").advice(403) and "/rules" not in files.HostedDataset("d").advice(403)
    with pytest.raises(FileNotFoundError, match="a.csv"):
        files.require_file(tmp_path / "have", "b.csv")
    assert cli.main(["list"]) == 0 and cli.main(["info", "saml_d"]) == 1
    assert cli.report([cli.attempt("nope", print), cli.attempt("paysim", print)]) == 1
    assert cli.attempt("paysim", lambda n: 1 / len(n)).state == "done"
    assert cli.attempt("saml_d", print, commercial_only=True).state == cli.attempt("banksim", print, commercial_only=True).state == "skipped"
    with pytest.raises(SystemExit):
        cli.main(["prepare"])
    with pytest.raises(ZeroDivisionError):  # a bug isn't a dataset's failure
        cli.attempt("paysim", lambda n: 1 / 0)


def test_failed_fetch_leaves_what_was_there(tmp_path):
    put(tmp_path / "have", "a.csv", "x\n")
    with pytest.raises(files.FetchError):
        files.fetch(files.GitRepo("file:///nowhere"), tmp_path / "have", force=True)
    assert [p.name for p in tmp_path.iterdir()] == ["have"] and (tmp_path / "have" / "a.csv").exists()

    class Empty(files.Source):
        url = "nothing"

        def bring(self, into):
            pass

    with pytest.raises(files.FetchError, match="no files"):
        files.fetch(Empty(), tmp_path / "new")
    assert not (tmp_path / "new").exists()


def test_delay_tool(spark, tmp_path):
    src = put(tmp_path, "t.csv", "card,ts,label,note\n0007,2020-01-01 00:00:00,1,NA\n7,2020-01-01 00:00:00,true,\n0007,2020-01-01 12:00:00,1,x\n0007,2020-02-01 00:00:00,0,1.50\n") / "t.csv"
    _, slow = delay_tool.parse_regime("slow:15,1.665,365")
    card = delay_tool.run(spark, src, tmp_path / "o.csv", "card", "ts", "label", {"reported_at": delay_tool.PRESETS["card"], "reported_at_slow": slow})
    lines = (tmp_path / "o.csv").read_text().splitlines()
    assert lines[0] == "card,ts,label,note,campaign_id,reported_at,reported_at_slow" and lines[1].startswith("0007,2020-01-01 00:00:00,1,NA,0,")
    assert lines[4].startswith("0007,2020-02-01 00:00:00,0,1.50,,") and card["n_campaigns"] == 2 and card["frauds"] == 3
    assert set(card["regimes"][0]["censored"]) == {"p50", "p70", "p80"}
    with pytest.raises(delay_tool.ToolError):
        delay_tool.run(spark, src, tmp_path / "p.csv", "card", "ts", "note", {"reported_at": slow})
    with pytest.raises(delay_tool.ToolError):
        delay_tool.run(spark, src, tmp_path / "p.csv", "card", "ts", "label", {"reported_at": slow}, cutoff="2020-01-01T00:00:00Z")
    with pytest.raises(delay_tool.ToolError):
        delay_tool.parse_regime("x=1")
