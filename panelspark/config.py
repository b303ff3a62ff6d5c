"""Analysis thresholds. Fixed values; change them by passing another ``Thresholds``."""

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    # trajectory
    growing_factor: float = 1.10
    declining_factor: float = 0.90
    window_weeks: int = 13
    # segmentation
    promotion_coupon_basket_rate: float = 0.30
    promotion_discount_share: float = 0.20
    private_label_share: float = 0.60
    occasional_max_frequency_quintile: int = 2
    occasional_max_active_weeks: int = 8
    # alerts
    relative_decline: float = -0.10
    # basket affinity
    pair_min_support: float = 0.01
    pair_min_baskets: int = 100
    # campaign windows, in days
    pre_days: int = 28
    post_short_days: int = 14
    post_days: int = 28
    # segment stability
    exclusion_weeks: int = 13
    # category materiality weights
    spend_loss_weight: float = 0.50
    household_loss_weight: float = 0.20
    penetration_loss_weight: float = 0.15
    frequency_loss_weight: float = 0.10
    basket_value_loss_weight: float = 0.05
    # campaign findings
    finding_min_recipients: int = 50
    # planning range of the observation indexes
    first_day: int = 1
    last_day: int = 711
    first_week: int = 1
    last_week: int = 102
