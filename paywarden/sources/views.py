"""Payment-risk views over the given tables.

Times are epoch microseconds (``us``), money also exists as whole cents, so windows and sums
are exact.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.constants import DAY, HOUR
from ..functions.session import prepare

# --- fixed values: cycles used to give events a country and a currency ---------
COUNTRY_CYCLE = ["KE", "UG", "TZ", "NG", "GH", "ZA", "IR", "KP", "SY", "US", "GB", "VE"]
CURRENCY_CYCLE = ["KES", "NGN", "UGX", "USD", "IRR", "EUR"]
AS_OF = 996_624_000_000_000  # 2001-08-01 UTC, the end of the orders
T0 = 1_704_067_200_000_000  # 2024-01-01 UTC


def micros(col: Column) -> Column:
    return F.unix_micros(col.cast("timestamp"))


def _cycle(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def fast_clock(txn: DataFrame) -> DataFrame:
    """Transactions on a clock that runs 24 times faster."""
    offset = F.col("us") - T0
    return txn.withColumn("us", F.lit(T0) + F.floor((offset - F.pmod(offset, F.lit(24))) / 24).cast("long"))


class Views:
    """Risk-domain tables derived from one folder of parquet files."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = prepare(spark)
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def txn(self) -> DataFrame:
        e = self.table("events")
        k = F.regexp_extract("props", r"(\d+)", 1).cast("long")
        e = e.select("event_id", "user_id", "event_type", "value", micros(F.col("ts")).alias("us"), k.alias("k"))
        amount = F.round(F.col("value") * 2500.0, 2)
        return e.select(
            F.col("event_id").alias("txn_id"), "user_id", "us", amount.alias("amount"),
            F.round(amount * 100.0).cast("long").alias("cents"), F.upper("event_type").alias("type"), "k",
            F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(50)).alias("merchant_id"),
            F.concat(F.lit("dev-"), F.pmod("k", F.lit(30)).cast("string")).alias("device"),
            F.concat(F.lit("ip-"), F.col("k").cast("string")).alias("ip"),
            _cycle(COUNTRY_CYCLE, F.pmod(F.col("user_id") + F.col("k"), F.lit(12))).alias("country"),
            _cycle(CURRENCY_CYCLE, F.pmod("k", F.lit(6))).alias("currency"),
            (F.pmod("user_id", F.lit(180)) - 90 + F.col("k") / 100.0).alias("lat"),
            (F.pmod(F.col("k") * 3, F.lit(360)) - 180).cast("double").alias("lng"),
        )

    @cached_property
    def dense(self) -> DataFrame:
        """The same transactions on a clock that runs 24 times faster (for session counters)."""
        return fast_clock(self.txn)

    @cached_property
    def payments(self) -> DataFrame:
        """One row per order line, paid by the customer to the supplier."""
        li = self.table("lineitem").select(
            "l_orderkey", "l_suppkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag", "l_linestatus")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(o, li.l_orderkey == o.o_orderkey).select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
            F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("merchant_id"),
            micros(F.col("o_orderdate")).alias("us"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
            (F.col("l_returnflag") == "R").alias("refund"),
            ((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F")).alias("chargeback"),
        )

    @cached_property
    def merchants(self) -> DataFrame:
        n = self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))
        s = self.table("supplier")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"), "country")

    @cached_property
    def users(self) -> DataFrame:
        n = self.table("nation").select("n_nationkey", F.col("n_name").alias("country"))
        c = self.table("customer")
        return c.join(n, c.c_nationkey == n.n_nationkey).select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), "country")

    def predictions(self, domain: str) -> DataFrame:
        """Scored events of one domain; a quarter of them labelled some hours later."""
        factor = {"fraud": 37, "aml": 53, "merchant": 71}[domain]
        t = self.txn
        i = F.col("txn_id")
        score = F.pmod(i * factor, F.lit(1000)) / 1000.0
        labelled = F.pmod(i, F.lit(4)) == 0
        entity = F.col("merchant_id") if domain == "merchant" else F.col("user_id")
        return t.select(
            i.alias("prediction_id"), i.alias("transaction_id"), entity.alias("entity_id"), "user_id", "merchant_id",
            "amount", F.col("us").alias("created_us"), score.alias("score"),
            F.when(score >= 0.9, "BLOCK").when(score >= 0.75, "REVIEW").when(score >= 0.6, "MONITOR")
            .otherwise("APPROVE").alias("decision"),
            F.when(score >= 0.9, "CRITICAL").when(score >= 0.75, "HIGH").when(score >= 0.6, "MEDIUM")
            .otherwise("LOW").alias("level"),
            F.when(labelled, (F.pmod(i, F.lit(12)) == 0).cast("int")).alias("label"),
            F.when(labelled, F.col("us") + F.pmod(i, F.lit(96)) * HOUR).alias("labeled_us"),
        )

    @cached_property
    def all_predictions(self) -> DataFrame:
        frames = [self.predictions(d).withColumn("domain", F.lit(d)) for d in ("fraud", "aml", "merchant")]
        return frames[0].unionByName(frames[1]).unionByName(frames[2])

    @cached_property
    def label_events(self) -> DataFrame:
        """Feedback on fraud predictions: two waves, some for predictions that do not exist."""
        p = self.predictions("fraud").filter(F.pmod("prediction_id", F.lit(3)) != 1)
        wave = F.explode(F.sequence(F.lit(0), F.lit(1))).alias("wave")
        i = F.col("prediction_id")
        ev = p.select(i, "created_us", wave).filter((F.col("wave") == 0) | (F.pmod(i, F.lit(5)) == 0))
        missing = F.pmod(i, F.lit(11)) == 0
        return ev.select(
            (i * 2 + F.col("wave")).alias("event_id"), F.when(missing, -i).otherwise(i).alias("prediction_id"),
            F.pmod(F.floor(i / 3) + F.col("wave"), F.lit(2)).cast("int").alias("label"),
            (F.col("created_us") + (F.pmod(i, F.lit(50)) + 1 + F.col("wave") * 60) * HOUR).alias("us"),
            F.concat(F.lit("analyst-"), F.pmod(i, F.lit(7)).cast("string")).alias("labeled_by"),
            F.when(F.pmod(i, F.lit(2)) == 0, "MANUAL_REVIEW").otherwise("CHARGEBACK").alias("source"),
        )

    @cached_property
    def cases(self) -> DataFrame:
        """Cases opened for high AML scores, in every status."""
        i = F.col("prediction_id")
        status = _cycle(["OPEN", "ASSIGNED", "INVESTIGATING", "ESCALATED", "CLOSED_CONFIRMED", "CLOSED_FALSE_POSITIVE"],
                        F.pmod(i, F.lit(6)))
        return self.predictions("aml").filter("score >= 0.70").select(
            (i + 1_000_000_000).alias("case_id"), F.col("transaction_id").alias("entity_id"),
            F.when(F.pmod(i, F.lit(5)) != 0, i).alias("prediction_id"), "user_id", status.alias("status"),
            F.col("level").alias("priority"), F.lit("HIGH_RISK_SCORE").alias("trigger_reason"),
            F.col("created_us"), (F.pmod(i, F.lit(9)) == 0).alias("propagated"),
            F.when(F.pmod(i, F.lit(4)) == 0, "first note").alias("notes"),
            F.when(F.pmod(i, F.lit(3)) == 0, "team-a").alias("assignee"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        """Money moved from user to user, one row per transaction."""
        return self.txn.select(
            "txn_id", F.col("user_id").alias("sender"),
            (F.pmod(F.col("user_id") * 3 + F.col("k"), F.lit(101)) + 1).alias("receiver"), "us", "cents",
        ).filter("sender <> receiver")

    @cached_property
    def sanctions(self) -> DataFrame:
        """Watchlist in list order: nations and every tenth supplier, each with two aliases."""
        n = self.table("nation").select(F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name"),
                                        F.col("n_name").alias("country"))
        s = self.merchants.filter("merchant_id % 10 = 0").select((F.col("merchant_id") + 1000).alias("ordinal"), "name", "country")
        both = n.unionByName(s).select(F.col("ordinal").cast("long"), "name", "country")
        words = F.reverse(F.split(F.translate("name", "#", " "), " "))
        return both.select("ordinal", "name", F.array(F.upper("name"), F.concat_ws(" ", words)).alias("aliases"),
                           "country", F.lit("LIST-A").alias("source"))

    @cached_property
    def parties(self) -> DataFrame:
        """People and firms to screen: customers, and suppliers under an alias spelling."""
        u = self.users.select(F.col("user_id").alias("party_id"), "name", "country")
        reversed_name = F.concat_ws(" ", F.reverse(F.split(F.translate("name", "#", " "), " ")))
        m = self.merchants.select(
            (F.col("merchant_id") + 10_000_000).alias("party_id"),
            F.when(F.col("merchant_id") % 3 == 0, F.lower("name")).when(F.col("merchant_id") % 3 == 1, reversed_name)
            .otherwise(F.col("name")).alias("name"),
            F.when(F.col("merchant_id") % 4 == 0, "").otherwise(F.col("country")).alias("country"))
        return u.unionByName(m)

    @cached_property
    def merchant_edges(self) -> DataFrame:
        """Merchant relations: one edge row per order line pair of neighbouring suppliers."""
        o = self.table("lineitem").select(
            F.col("l_suppkey").alias("src"), (F.pmod(F.col("l_suppkey") * 7 + F.col("l_linenumber"), F.lit(100)) + 1).alias("dst"),
            F.col("l_linenumber").cast("long").alias("line"), "l_quantity")
        g = o.filter("src <> dst").groupBy("src", "dst", "line").agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
        return g.select("src", "dst", F.col("line").alias("ord"), (F.pmod("q", F.lit(10)) + 1).cast("double").alias("weight"))

    @cached_property
    def eval_set(self) -> DataFrame:
        """Labelled documents scored by length; language is the protected attribute."""
        d = self.table("documents").select("doc_id", "n_chars", "lang", "source")
        l = self.table("labels").select("doc_id", F.col("toxic").cast("int").alias("y"), F.col("quality").cast("int").alias("quality"))
        score = F.pmod(F.col("n_chars") * 7 + F.length("source"), F.lit(1000)) / 1000.0
        return l.join(d, "doc_id").select("doc_id", "y", "quality", score.alias("score"), "lang", "source")

    @cached_property
    def halves(self) -> tuple[DataFrame, DataFrame]:
        """Fraud scores of the first and the second half of January 2024."""
        p = self.predictions("fraud")
        middle = T0 + 15 * DAY
        return p.filter(F.col("created_us") < middle), p.filter(F.col("created_us") >= middle)

    @cached_property
    def ml_set(self) -> DataFrame:
        """Embeddings with a binary target."""
        e = self.table("embeddings")
        return e.select("vec_id", "embedding", (F.col("label") < 3).cast("int").alias("y"))

    # ---- inputs of the vectors ----------------------------------------------------
    @cached_property
    def auth_failures(self) -> DataFrame:
        return self.dense.filter("type = 'ERROR'").select("user_id", "us")

    @cached_property
    def accounts(self) -> DataFrame:
        """Account creation: the customer's first order, moved 10,400 days ahead; KYC by customer key."""
        first = self.table("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
        return first.select(
            F.col("o_custkey").alias("user_id"), (micros(F.col("d")) + 10400 * DAY).alias("created_us"),
            (F.pmod("o_custkey", F.lit(10)) / 10.0).alias("kyc_completeness_score"))

    @cached_property
    def merchant_accounts(self) -> DataFrame:
        """Merchants of the transactions with creation time and category code."""
        m = F.col("merchant_id")
        return self.txn.groupBy("merchant_id").agg(F.min("us").alias("f")).select(
            m, (F.col("f") - F.pmod(m * 13, F.lit(200)) * DAY).alias("created_us"),
            F.concat(F.lit("mcc-"), F.pmod(m, F.lit(8)).cast("string")).alias("mcc"))

    @cached_property
    def mcc_table(self) -> DataFrame:
        """Category risk, one row per category in use; two categories are left unknown."""
        m = self.merchant_accounts.select("mcc").distinct().filter("mcc not in ('mcc-3', 'mcc-7')")
        return m.select("mcc", (F.substring("mcc", 5, 2).cast("double") / 8.0).alias("mcc_risk_score"))

    @cached_property
    def ip_geo(self) -> DataFrame:
        """Country of each ip in use, every fifth unknown."""
        ips = self.txn.select("ip", "k").distinct().filter("k % 5 <> 4")
        return ips.select("ip", _cycle(COUNTRY_CYCLE, F.pmod(F.col("k") * 5, F.lit(12))).alias("ip_country"))

    @cached_property
    def confirmed_frauds(self) -> DataFrame:
        """Arrival of confirmed-fraud labels on the fast clock."""
        return self.dense.filter("txn_id % 12 = 0").select(
            "user_id", (F.col("us") + F.pmod("txn_id", F.lit(96)) * (HOUR // 24)).alias("us"))

    @cached_property
    def fraud_labels(self) -> DataFrame:
        return self.predictions("fraud").select(F.col("prediction_id").alias("txn_id"), "label")

    @cached_property
    def customer_risk(self) -> DataFrame:
        """Mean AML score per user in whole thousandths, with its level."""
        p = self.predictions("aml").withColumn("m", F.round(F.col("score") * 1000).cast("long"))
        r = p.groupBy("user_id").agg(F.sum("m").alias("s"), F.count(F.lit(1)).alias("n")).select(
            "user_id", F.floor(F.col("s") / F.col("n")).alias("risk_milli"))
        m = F.col("risk_milli")
        return r.withColumn("level", F.when(m >= 560, "CRITICAL").when(m >= 520, "HIGH").when(m >= 480, "MEDIUM").otherwise("LOW"))

    @cached_property
    def user_graph(self) -> DataFrame:
        """Stand-in network measures per user, by arithmetic on the key."""
        u = F.col("user_id")
        return self.txn.select("user_id").distinct().select(
            u, (F.pmod(u, F.lit(10)) / 10.0).alias("network_risk_score"), (F.pmod(u, F.lit(17)) == 0).cast("int").alias("circular_transfer_flag"),
            F.pmod(u, F.lit(9)).alias("shared_device_cluster_size"))
