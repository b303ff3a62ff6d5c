"""Source contracts. Column names, types, domains and expected rows."""

from dataclasses import dataclass, field

from pyspark.sql import types as T

from panelspark.functions.columns import MONEY

LONG, INT, TEXT = T.LongType(), T.IntegerType(), T.StringType()
QUANTITY = T.DoubleType()


@dataclass(frozen=True)
class Contract:
    columns: dict[str, T.DataType]
    expected_rows: int
    nullable: tuple[str, ...] = ()
    allowed: dict[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def schema(self) -> T.StructType:
        return T.StructType(
            [T.StructField(n, t, n in self.nullable) for n, t in self.columns.items()]
        )


CONTRACTS = {
    "transaction_data": Contract(
        {
            "household_key": LONG,
            "BASKET_ID": TEXT,
            "DAY": INT,
            "PRODUCT_ID": LONG,
            "QUANTITY": QUANTITY,
            "SALES_VALUE": MONEY,
            "STORE_ID": LONG,
            "RETAIL_DISC": MONEY,
            "COUPON_DISC": MONEY,
            "COUPON_MATCH_DISC": MONEY,
            "TRANS_TIME": INT,
            "WEEK_NO": INT,
        },
        2_595_732,
    ),
    "causal_data": Contract(
        {"PRODUCT_ID": LONG, "STORE_ID": LONG, "WEEK_NO": INT, "display": TEXT, "mailer": TEXT},
        36_786_524,
        allowed={
            "display": ("0", "1", "2", "3", "4", "5", "6", "7", "9", "A"),
            "mailer": ("0", "A", "C", "D", "F", "H", "J", "L", "P", "X", "Z"),
        },
    ),
    "coupon": Contract({"COUPON_UPC": LONG, "PRODUCT_ID": LONG, "CAMPAIGN": INT}, 124_548),
    "coupon_redempt": Contract(
        {"household_key": LONG, "DAY": INT, "COUPON_UPC": LONG, "CAMPAIGN": INT}, 2_318
    ),
    "campaign_table": Contract(
        {"household_key": LONG, "CAMPAIGN": INT, "DESCRIPTION": TEXT}, 7_208
    ),
    "campaign_desc": Contract(
        {"DESCRIPTION": TEXT, "CAMPAIGN": INT, "START_DAY": INT, "END_DAY": INT}, 30
    ),
    "product": Contract(
        {
            "PRODUCT_ID": LONG,
            "MANUFACTURER": INT,
            "DEPARTMENT": TEXT,
            "BRAND": TEXT,
            "COMMODITY_DESC": TEXT,
            "SUB_COMMODITY_DESC": TEXT,
            "CURR_SIZE_OF_PRODUCT": TEXT,
        },
        92_353,
        nullable=("DEPARTMENT", "COMMODITY_DESC", "SUB_COMMODITY_DESC", "CURR_SIZE_OF_PRODUCT"),
        allowed={"BRAND": ("private", "national")},
    ),
    "hh_demographic": Contract(
        {
            "classification_1": TEXT,
            "classification_2": TEXT,
            "classification_3": TEXT,
            "HOMEOWNER_DESC": TEXT,
            "classification_5": TEXT,
            "classification_4": TEXT,
            "KID_CATEGORY_DESC": TEXT,
            "household_key": LONG,
        },
        801,
        nullable=(
            "classification_1",
            "classification_2",
            "classification_3",
            "HOMEOWNER_DESC",
            "classification_5",
            "classification_4",
            "KID_CATEGORY_DESC",
        ),
    ),
}
SOURCES = tuple(CONTRACTS)
