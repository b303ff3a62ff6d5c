"""Reading notes that results carry word for word."""

ROOT_CAUSE = "First and last observation windows; associative accounting decomposition only"
DENOMINATORS = (
    "Exposure and unique-household rates are different estimands; response is observational"
)
NONE_OBSERVED = (
    "Observed states include none; comparative tests may use it as a reference "
    "with sample sizes visible"
)
NONE_MISSING = (
    "Promotion analysis is restricted to observed modeled promotion states; "
    "no no-promo uplift claim is allowed"
)
CAMPAIGN_SEGMENT = "Observed response; recipient targeting and observability limits apply"
COUPON_CAMPAIGN = "Observed redemption; denominator is exposed panel households"
COUPON_SEGMENT = "Observed segment redemption; recipient targeting bias applies"
COUPON_CATEGORY = "Category-linked redemption; event counts are not additive across categories"
COUPON_BASKET = "Basket coupon flag; not exact redemption attribution"
COUPON_REPEAT = (
    "First observed coupon-discounted category purchase; not true acquisition or causal repeat"
)
PRIVATE_LABEL_ANOMALY = (
    "Review returns, negative net sales, brand mapping and denominator; no auto-cap applied."
)
PROMOTION_DEPENDENCY = "Association only; no profitability or causal lift claim"
MATERIALITY = (
    "Score is a documented prioritization heuristic, not causal impact or margin."
)
CATEGORY_LMDI = "Associative LMDI decomposition only; not causal attribution."
CATEGORY_LMDI_WITHHELD = (
    "Non-positive or incomplete component; LMDI withheld rather than fabricated."
)
DEMOGRAPHICS = "Descriptive demographic coverage only; no imputation or causal interpretation."
COHORT = (
    "First observed activity is not acquisition; cohorts after the 13-week cutoff are censored."
)
STABILITY = (
    "Deterministic segment comparison; first observed history and late-window censoring apply."
)
NOT_IN_TRIMMED = "Not observable in pre-trim window"
PROMOTION_AUDIT = (
    "Promotion comparisons are observational; raw 0/0 rows are a valid none candidate only when "
    "retained at product-store-week grain; no valid none state means no uplift/dependency-vs-no-"
    "promo claim."
)
STATS_BASKET = (
    "Observed basket-value distribution by panel segment; descriptive comparison, "
    "not causal effect."
)
STATS_PROMOTION = (
    "Promotion assignment is observational; a missing none state withholds no-promo uplift "
    "comparison."
)
STATS_CAMPAIGN = (
    "Campaign recipients may be targeted; CI describes observed response and not causal lift "
    "or ROI."
)
