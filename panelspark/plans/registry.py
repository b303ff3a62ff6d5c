"""Names of warehouse tables and the functions that declare them."""

BUILDERS = {}
LAYERS = {}
#: What reports over many tables read again and again: the two large sources and the steps next to them.
LARGE_SOURCES = ("transaction_data", "causal_data")
SHARED = (
    "products",
    "fct_basket",
    "household_week_spend",
    "fct_promotion_product_store_week",
    "fct_campaign_exposure",
)


def table(layer):
    """Register ``fn(warehouse) -> DataFrame`` under its own name."""

    def register(fn):
        BUILDERS[fn.__name__] = fn
        LAYERS.setdefault(layer, []).append(fn.__name__)
        return fn

    return register
