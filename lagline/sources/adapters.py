"""Dataset adapters: raw files to the canonical table. Eight names, seven sources."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins
from ..operators.splits import keep_upstream_test
from .files import GitRepo, HostedCompetition, HostedDataset, Source, read_csv, require_file, single_csv, split_zip_member

_REGISTRY: dict[str, type[Adapter]] = {}


class UnknownDataset(KeyError):
    pass


class Adapter:
    name = ""
    raw_name = ""
    source: Source
    license = "unknown"
    commercial = True
    #: The raw label: dropped once is_fraud stands, unless it is is_fraud or describes the label.
    label = ""
    label_descriptive: tuple[str, ...] = ()
    caveats: tuple[str, ...] = ()
    mapping: dict[str, str] = {}

    def canonical(self, spark: SparkSession, raw: Path, options: dict) -> DataFrame:
        raise NotImplementedError

    def split(self, df: DataFrame, options: dict) -> DataFrame | None:
        """df with the source's own split, or None for the temporal one."""
        return None

    def auxiliary(self, spark: SparkSession, raw: Path, options: dict) -> dict[str, DataFrame]:
        return {}


def register(cls: type[Adapter]) -> type[Adapter]:
    if not cls.name or not cls.label:
        raise ValueError(f"{cls.__name__} needs a name and a label column")
    if cls.name in _REGISTRY:
        raise ValueError(f"{cls.name!r} is registered already")
    cls.raw_name = cls.__dict__.get("raw_name") or cls.name
    _REGISTRY[cls.name] = cls
    return cls


def get(name: str) -> Adapter:
    if name not in _REGISTRY:
        raise UnknownDataset(f"unknown dataset {name!r}; known are {', '.join(names())}")
    return _REGISTRY[name]()


def names() -> list[str]:
    return sorted(_REGISTRY)


def start_date(options: dict, name: str, column: str) -> str:
    if not options.get("start_date"):
        raise ValueError(f"{name} counts {column!r} from a date that it doesn't give: set datasets.{name}.start_date")
    return str(options["start_date"])


def core(df: DataFrame, time: Column, entity: Column, amount: Column, label: Column) -> DataFrame:
    """Core columns first; the source's columns follow, but for those that a core one replaces.

    Names differ by case alone to no reader of Spark's: such a source column gets the suffix _raw.
    """
    made = {"event_time": time.cast("timestamp_ntz"), "entity_id": entity.cast("string"), "amount": amount.cast("double"), "is_fraud": label.cast("boolean")}
    return df.select(*[c.alias(n) for n, c in made.items()], *[F.col(f"`{c}`").alias(f"{c}_raw" if c.lower() in made else c) for c in df.columns if c not in made])


@register
class PaySim(Adapter):
    name, source, label, license = "paysim", HostedDataset("ealaxi/paysim1"), "isFraud", "CC BY-SA 4.0"
    caveats = ("step is an hour offset from 1, so dates are anchored and mean nothing; many rows share an instant.",)
    mapping = {"event_time": "step (hours)", "entity_id": "nameOrig", "amount": "amount", "is_fraud": "isFraud"}

    def canonical(self, spark, raw, options):
        start = start_date(options, self.name, "step")
        df = read_csv(spark, single_csv(raw))
        return core(df, S.offset_from(start, F.col("step") - 1, 3_600_000_000), F.col("nameOrig"), F.col("amount"), F.col("isFraud"))


@register
class BankSim(Adapter):
    name, source, label, license, commercial = "banksim", HostedDataset("ealaxi/banksim1"), "fraud", "CC BY-NC-SA 4.0", False
    caveats = ("step is a day offset from 0, so dates are anchored and mean nothing.", "Strings come in literal single quotes, which are stripped.")
    mapping = {"event_time": "step (days)", "entity_id": "customer", "amount": "amount", "is_fraud": "fraud"}

    def canonical(self, spark, raw, options):
        start = start_date(options, self.name, "step")
        df = read_csv(spark, require_file(raw, "bs140513_032310.csv"))
        df = df.select(*[S.strip_quotes(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes])
        return core(df, S.offset_from(start, F.col("step"), S.DAY_US), F.col("customer"), F.col("amount"), F.col("fraud"))


@register
class Sparkov(Adapter):
    name, source, label, license = "sparkov", HostedDataset("kartik2112/fraud-detection"), "is_fraud", "CC0 1.0"
    parts = ("fraudTrain.csv", "fraudTest.csv")
    caveats = ("The upstream test file is the test split; validation is the end of the upstream train file.", "People are fabricated.")
    mapping = {"event_time": "trans_date_trans_time", "entity_id": "cc_num", "amount": "amt", "is_fraud": "is_fraud"}

    def canonical(self, spark, raw, options):
        read = {}
        for p in self.parts:
            df = read_csv(spark, require_file(raw, p))
            read[p] = df.drop(*[c for c in df.columns if c.startswith("Unnamed:")])
        df = joins.union_tagged(read)
        card = F.col("cc_num").cast("decimal(38,0)") if dict(df.dtypes)["cc_num"] == "double" else F.col("cc_num")
        return core(df, F.col("trans_date_trans_time"), card, F.col("amt"), F.col("is_fraud"))

    def split(self, df, options):
        return keep_upstream_test(df, F.col("source_file") == self.parts[1], float(options.get("val_fraction", 0.1)))


@register
class SparkovSlow(Sparkov):
    """The same rows under a slower delay; the raw files are shared."""

    name, raw_name = "sparkov_slow", "sparkov"
    caveats = (*Sparkov.caveats, "Its delay is a stress test: the same rows as sparkov but for reported_at.")


@register
class IbmCcf(Adapter):
    name, source, label, license = "ibm_ccf", HostedDataset("ealtman2019/credit-card-transactions"), "Is Fraud?", "Apache-2.0"
    money = ("Credit Limit", "Per Capita Income - Zipcode", "Yearly Income - Person", "Total Debt", "Amount")
    caveats = ("The users' file has no id: its row order is the User id.", "Times are in whole minutes.", "The licence is stated in two ways upstream.")
    mapping = {"event_time": "Year + Month + Day + Time", "entity_id": "User or User-Card", "amount": "Amount", "is_fraud": "Is Fraud?"}

    def canonical(self, spark, raw, options):
        kind = options.get("entity_key", "user")
        if kind not in ("user", "card"):
            raise ValueError(f"entity_key is 'user' or 'card', not {kind!r}")
        df = read_csv(spark, require_file(raw, "credit_card_transactions-ibm_v2.csv"))
        if dict(df.dtypes)["Time"] != "string":  # H:MM may be read as a time of today
            df = df.withColumn("Time", F.date_format("Time", "HH:mm"))
        cards = read_csv(spark, require_file(raw, "sd254_cards.csv"))
        # Row order of a small file is read where it is known: on the driver.
        import pandas as pd

        people = pd.read_csv(require_file(raw, "sd254_users.csv"))
        people.insert(0, "User", range(len(people)))
        users = spark.createDataFrame(people.astype(object).where(people.notna(), None))
        df = joins.lookup(df, cards, {"User": "User", "Card": "CARD INDEX"}, drop=("CARD INDEX",))
        df = joins.lookup(df, users, {"User": "User"})
        df = df.withColumns({c: S.parse_money_strict(F.col(f"`{c}`")) for c in self.money if c in df.columns})
        entity = F.col("User").cast("string") if kind == "user" else F.concat_ws("-", "User", "Card")
        return core(df, S.assemble_minute(F.col("Year"), F.col("Month"), F.col("Day"), F.col("Time")), entity, F.col("Amount"), F.trim(F.col("`Is Fraud?`").cast("string")) == "Yes")


@register
class IeeeCis(Adapter):
    name, source, label, license, commercial = "ieee_cis", HostedCompetition("ieee-fraud-detection"), "isFraud", "Competition rules (research use)", False
    caveats = ("entity_id is derived from three columns; rows without them are entities of their own.", "The unlabelled test set is written beside.")
    mapping = {"event_time": "TransactionDT (seconds)", "entity_id": "card1 + addr1 + (day - D1)", "amount": "TransactionAmt", "is_fraud": "isFraud"}

    def _read(self, spark, raw, part, options):
        start = start_date(options, self.name, "TransactionDT")
        rows, who = (read_csv(spark, require_file(raw, f"{part}_{x}.csv")) for x in ("transaction", "identity"))
        df = joins.lookup(rows, who, {"TransactionID": "TransactionID"})
        d = lambda c: F.col(c).cast("double")
        return df, S.offset_from(start, F.col("TransactionDT"), 1_000_000), S.account_uid(F.col("card1"), d("addr1"), F.col("TransactionDT"), d("D1"), F.col("TransactionID"))

    def canonical(self, spark, raw, options):
        df, time, uid = self._read(spark, raw, "train", options)
        return core(df, time, uid, F.col("TransactionAmt"), F.col("isFraud"))

    def auxiliary(self, spark, raw, options):
        df, time, uid = self._read(spark, raw, "test", options)
        return {"unlabelled_test": df.select(time.alias("event_time"), uid.alias("entity_id"), *[F.col(f"`{c}`") for c in df.columns])}


@register
class SamlD(Adapter):
    name, source, label, license, commercial = "saml_d", HostedDataset("berkanoztas/synthetic-transaction-monitoring-dataset-aml"), "Is_laundering", "CC BY-NC-SA 4.0", False
    label_descriptive = ("Laundering_type",)
    caveats = ("Amounts are in thirteen currencies and aren't converted.", "Laundering has two sides: the receiver is passed through.")
    mapping = {"event_time": "Date + Time", "entity_id": "Sender_account", "amount": "Amount", "is_fraud": "Is_laundering"}

    def canonical(self, spark, raw, options):
        df = read_csv(spark, require_file(raw, "SAML-D.csv"), "Time string, Date string, Sender_account long, Receiver_account long, Amount double, Payment_currency string, Received_currency string, Sender_bank_location string, Receiver_bank_location string, Payment_type string, Is_laundering int, Laundering_type string")
        return core(df, F.to_timestamp_ntz(F.concat_ws(" ", "Date", "Time"), F.lit("yyyy-MM-dd HH:mm:ss")), F.col("Sender_account"), F.col("Amount"), F.col("Is_laundering"))


@register
class Amaretto(Adapter):
    name, source, label, license = "amaretto", GitRepo("https://github.com/necst/amaretto_dataset"), "Anomaly", "MIT"
    label_descriptive = ("Anomaly",)
    caveats = ("Securities orders, not payments.", "Anomaly is 0 or one of five classes, and stays in the table.")
    mapping = {"event_time": "EntryDate", "entity_id": "Originator", "amount": "Normalized Amount", "is_fraud": "Anomaly > 0"}

    def canonical(self, spark, raw, options):
        df = read_csv(spark, split_zip_member(raw, "amaretto_dataset_anon.zip.*", "amaretto_dataset_anon.csv", Path(raw) / "_extracted"))
        return core(df, F.col("EntryDate"), F.col("Originator"), F.col("`Normalized Amount`"), F.col("Anomaly") > 0)


#: Columns that no model may see, besides what adapters declare; and clocks.
PIPELINE_COLUMNS = frozenset({"is_fraud", "reported_at", "campaign_id", "split"})
NOT_INPUTS = frozenset({"isFlaggedFraud", "trans_num", "source_file"})
ABSOLUTE_TIME = frozenset({"trans_date_trans_time", "unix_time", "Date", "Year"})


class ExcludedColumn(ValueError):
    pass


def always_excluded() -> frozenset[str]:
    """Read from the registry at each call, so a new adapter counts at once."""
    return PIPELINE_COLUMNS | NOT_INPUTS | {c for a in _REGISTRY.values() for c in a.label_descriptive}


def assert_no_excluded(columns) -> None:
    bad = sorted(set(columns) & always_excluded())
    if bad:
        raise ExcludedColumn(f"column(s) that no model may see: {bad}")
