"""Eight panel sources derived from an order / line-item / part / customer schema.

Household = customer, basket = order, product = part. Every rule is a deterministic function
of the row, so both engines of the correctness check see the same panel. Demographics, campaigns,
coupons and redemptions cover fixed shares of the rows, as partial coverage is part of the panel. A
few rows are faulty on purpose: baskets without a household, lines without a product, missing,
zero and negative sales, repeated lines, unknown promotion codes, unlinked coupons and double
redemptions.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.functions.columns import MONEY

#: Line items a task joins at most, on average: beyond so many per shuffle partition the join takes more.
ITEMS_A_TASK = 1_000_000
CAMPAIGNS = 30  # campaign classes; exposures are customers x these


class OrderTables:
    """Callable source provider over a folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._read_once: dict[str, DataFrame] = {}
        self._items: int | None = None

    def __call__(self, source: str) -> DataFrame:
        return getattr(self, source)()

    def _read(self, name: str) -> DataFrame:
        if name not in self._read_once:
            self._read_once[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read_once[name]

    def _by_basket(self, rows: DataFrame) -> DataFrame:
        """One side of the join of items and orders, in partitions whose size does not grow with the items.

        As long as the session's shuffle partitions are enough, the join is left as it is.
        """
        if self._items is None:  # counted from the file footers
            self._items = self._read("lineitem").count()
        wanted = -(-self._items // ITEMS_A_TASK)
        if wanted <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return rows
        return rows.repartition(wanted, "BASKET_ID")

    def _trips(self) -> DataFrame:
        since = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
        day = F.lit(1) + since % 711
        return self._read("orders").select(
            F.col("o_orderkey").alias("BASKET_ID"),
            F.when(F.col("o_orderkey") % 997 != 0, F.col("o_custkey")).alias("household_key"),
            day.cast("int").alias("DAY"),
            (F.lit(1) + F.floor((day - 1) / 7)).cast("int").alias("WEEK_NO"),
            (F.col("o_custkey") % 25).alias("STORE_ID"),
            ((F.col("o_orderkey") % 24) * 100 + F.col("o_orderkey") % 60)
            .cast("int")
            .alias("TRANS_TIME"),
        )

    def transaction_data(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(12,2)")
        off = F.col("l_discount").cast("decimal(4,2)")
        tax = F.col("l_tax").cast("decimal(4,2)")
        key = F.col("BASKET_ID")
        coupon = (key % 4 == 0) & (F.col("l_returnflag") == "R")
        none = F.lit(0).cast(MONEY)
        net = price * (F.lit(1).cast("decimal(4,2)") - off)
        sales = (
            F.when(key % 701 == 0, F.lit(None).cast(MONEY))
            .when(key % 401 == 0, none)
            .when(key % 601 == 0, (-net).cast(MONEY))
            .otherwise(net.cast(MONEY))
        )
        product = F.when((key + F.col("l_linenumber")) % 1009 != 0, F.col("l_partkey"))
        twice = (key % 307 == 0) & (F.col("l_linenumber") == 1)
        times = F.when(twice, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        quantity = (
            F.when(key % 501 == 0, F.lit(0.0))
            .when(key % 211 == 0, F.col("l_quantity") * 10)
            .otherwise(F.col("l_quantity"))
        )
        lines = self._read("lineitem").withColumnRenamed("l_orderkey", "BASKET_ID")
        repeated = self._by_basket(lines).withColumn("_time", F.explode(times))
        return repeated.join(self._by_basket(self._trips()), "BASKET_ID").select(
            "household_key",
            "BASKET_ID",
            "DAY",
            product.alias("PRODUCT_ID"),
            quantity.cast("double").alias("QUANTITY"),
            sales.alias("SALES_VALUE"),
            "STORE_ID",
            (-(price * off)).cast(MONEY).alias("RETAIL_DISC"),
            F.when(coupon, (-(price * tax)).cast(MONEY)).otherwise(none).alias("COUPON_DISC"),
            none.alias("COUPON_MATCH_DISC"),
            "TRANS_TIME",
            "WEEK_NO",
        )

    def product(self) -> DataFrame:
        key = F.col("p_partkey")
        brand_no = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
        department = (
            F.when(key % 50 == 0, F.lit("")).when(key % 51 != 0, F.col("p_type"))
        )
        return self._read("part").select(
            key.alias("PRODUCT_ID"),
            brand_no.alias("MANUFACTURER"),
            department.alias("DEPARTMENT"),
            F.when(brand_no % 2 == 0, "Private").otherwise("National").alias("BRAND"),
            F.split("p_name", " ").getItem(1).alias("COMMODITY_DESC"),
            F.col("p_name").alias("SUB_COMMODITY_DESC"),
            F.col("p_size").cast("string").alias("CURR_SIZE_OF_PRODUCT"),
        )

    def hh_demographic(self) -> DataFrame:
        key, nation, balance = F.col("c_custkey"), F.col("c_nationkey"), F.col("c_acctbal")
        age = (
            F.when(balance < 2000, "19-24")
            .when(balance < 4000, "25-34")
            .when(balance < 6000, "35-44")
            .otherwise("45-54")
        )
        marital = F.when(key % 4 == 0, "A").when(key % 4 == 1, "B").when(key % 4 == 2, " ")
        return (
            self._read("customer")
            .where(key % 3 == 0)
            .select(
                age.alias("classification_1"),
                marital.otherwise("U").alias("classification_2"),
                F.col("c_mktsegment").alias("classification_3"),
                F.when(nation % 2 == 0, "Homeowner").otherwise("Renter").alias("HOMEOWNER_DESC"),
                F.concat(F.lit("Group "), (nation % 5).cast("string")).alias("classification_5"),
                (key % 5 + 1).cast("string").alias("classification_4"),
                F.when(key % 7 != 0, F.concat(F.lit("Kids "), (nation % 3).cast("string"))).alias(
                    "KID_CATEGORY_DESC"
                ),
                key.alias("household_key"),
            )
        )

    def causal_data(self) -> DataFrame:
        """Promotion rows for a share of sold keys and for some weeks without a sale.

        Each sold key yields its candidates in place, so one scan and one distinct suffice.
        """
        p, s, w = F.col("PRODUCT_ID"), F.col("STORE_ID"), F.col("WEEK_NO")
        sold = self.transaction_data().select("PRODUCT_ID", "STORE_ID", "WEEK_NO")
        weeks = F.array_compact(
            F.array(
                F.when((p + s + w) % 3 == 0, w),
                F.when((p * 7 + w) % 5 == 0, (F.lit(1) + w % 102).cast("int")),
            )
        )
        keys = sold.select(
            "PRODUCT_ID", "STORE_ID", F.explode(weeks).alias("WEEK_NO")
        ).distinct()
        display = (
            F.when((p + w) % 4 == 0, "0").when((p + w) % 4 == 1, "1").when((p + w) % 4 == 2, "5")
        ).otherwise("A")
        mailer = (
            F.when((p + s) % 41 == 0, "Q")
            .when((p + s) % 3 == 0, "0")
            .when((p + s) % 3 == 1, "A")
            .otherwise("D")
        )
        codes = F.array_compact(
            F.array(
                F.struct(display.alias("display"), mailer.alias("mailer")),
                F.when(
                    (p + s + w) % 7 == 0,
                    F.struct(F.lit("2").alias("display"), F.lit("0").alias("mailer")),
                ),
            )
        )
        return keys.withColumn("_code", F.explode(codes)).select(
            "PRODUCT_ID", "STORE_ID", "WEEK_NO", "_code.display", "_code.mailer"
        )

    @staticmethod
    def _start(campaign: Column) -> Column:
        return (F.lit(1) + (campaign * 23) % 700).cast("int")

    @staticmethod
    def _kind(campaign: Column) -> Column:
        return F.when(campaign % 3 == 0, "TypeA").when(campaign % 3 == 1, "TypeB").otherwise(
            "TypeC"
        )

    def campaign_desc(self) -> DataFrame:
        orders = self._read("orders").select(
            (F.col("o_custkey") % CAMPAIGNS + 1).cast("int").alias("CAMPAIGN")
        )
        length = (F.lit(20) + F.count(F.lit(1)) % 20).cast("int")
        sized = orders.groupBy("CAMPAIGN").agg(length.alias("_length"))
        start = self._start(F.col("CAMPAIGN"))
        return sized.select(
            self._kind(F.col("CAMPAIGN")).alias("DESCRIPTION"),
            "CAMPAIGN",
            start.alias("START_DAY"),
            (start + F.col("_length")).alias("END_DAY"),
        )

    def campaign_table(self) -> DataFrame:
        campaigns = F.sequence(F.lit(1), F.lit(CAMPAIGNS))
        return (
            self._read("customer")
            .select(F.col("c_custkey").alias("household_key"), F.explode(campaigns).alias("CAMPAIGN"))
            .where((F.col("household_key") * 7 + F.col("CAMPAIGN") * 13) % 10 < 2)
            .withColumn("DESCRIPTION", self._kind(F.col("CAMPAIGN")))
        )

    def coupon(self) -> DataFrame:
        campaigns = F.sequence(F.lit(1), F.lit(CAMPAIGNS))
        part, campaign = F.col("PRODUCT_ID"), F.col("CAMPAIGN")
        return (
            self._read("part")
            .select(F.col("p_partkey").alias("PRODUCT_ID"), F.explode(campaigns).alias("CAMPAIGN"))
            .where((part + campaign * 17) % 97 == 0)
            .select(
                (F.lit(10_000_000) + campaign * 1000 + part % 50).cast("bigint").alias("COUPON_UPC"),
                "PRODUCT_ID",
                "CAMPAIGN",
            )
        )

    def coupon_redempt(self) -> DataFrame:
        """Some exposed households redeem once, every eleventh of them twice on the same day; every
        thirteenth redeems a coupon that no product is linked to. Campaigns are a list of 30, sent to the exposures."""
        hh, campaign = F.col("household_key"), F.col("CAMPAIGN")
        first_coupon = self.coupon().groupBy("CAMPAIGN").agg(F.min("COUPON_UPC").alias("COUPON_UPC"))
        span = F.col("END_DAY") - F.col("START_DAY") + 1
        times = F.when(hh % 11 == 0, F.sequence(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return (
            self.campaign_table()
            .where((hh * 31 + campaign * 7) % 8 == 0)
            .join(F.broadcast(self.campaign_desc().drop("DESCRIPTION")), "CAMPAIGN")
            .join(F.broadcast(first_coupon), "CAMPAIGN")
            .withColumn("_time", F.explode(times))
            .select(
                "household_key",
                (F.col("START_DAY") + hh % span).cast("int").alias("DAY"),
                F.when(hh % 13 == 0, F.lit(99).cast("bigint")).otherwise(F.col("COUPON_UPC")).alias(
                    "COUPON_UPC"
                ),
                "CAMPAIGN",
            )
        )
