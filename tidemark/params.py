"""Parameters: factor metadata, scoring, validation and replay settings.

The numbers and names in this file are fixed values that results depend on.
"""

from __future__ import annotations

HARD_FILTERS = ["is_st", "is_suspended", "is_delisted", "low_liquidity"]

# Factor name -> (type, direction, score group).
FACTORS: dict[str, tuple[str, str, str]] = {
    "return_20d": ("factor", "higher_is_better", "momentum"),
    "return_60d": ("factor", "higher_is_better", "momentum"),
    "above_ma60": ("factor", "higher_is_better", "momentum"),
    "volatility_20d": ("factor", "lower_is_better", "risk"),
    "max_drawdown_60d": ("factor", "lower_is_better", "risk"),
    "amount_cv_20d": ("factor", "lower_is_better", "risk"),
    "pe_ttm_percentile": ("factor", "lower_is_better", "valuation"),
    "pb_percentile": ("factor", "lower_is_better", "valuation"),
    "industry_pe_ttm_percentile": ("factor", "lower_is_better", "valuation"),
    "revenue_yoy": ("factor", "higher_is_better", "financial"),
    "profit_yoy": ("factor", "higher_is_better", "financial"),
    "operating_cashflow_to_profit": ("factor", "higher_is_better", "financial"),
    "is_st": ("hard_filter", "boolean_filter", "risk"),
    "is_suspended": ("hard_filter", "boolean_filter", "risk"),
    "is_delisted": ("hard_filter", "boolean_filter", "risk"),
    "low_liquidity": ("hard_filter", "boolean_filter", "risk"),
}
FACTOR_ORDER = list(FACTORS)
SCORED_DIRECTIONS = ("higher_is_better", "lower_is_better")

# Windows and thresholds of the factors.
FACTOR_PARAMS = {
    "return_short": 20,
    "return_long": 60,
    "ma_window": 60,
    "volatility_window": 20,
    "drawdown_window": 60,
    "amount_window": 20,
    "min_avg_amount": 50_000_000.0,
    "valuation_window": 252,
    "valuation_min_observations": 20,
    "industry_min_observations": 2,
}

# Composite score.
SCORING = {
    "top_n": 20,
    "min_available_factor_weight": 0.5,
    "single_observation_score": 50.0,
    "all_equal_score": 50.0,
    "groups": {
        "financial": {
            "enabled": True,
            "required": False,
            "weight": 0.30,
            "factors": {"revenue_yoy": 0.35, "profit_yoy": 0.35, "operating_cashflow_to_profit": 0.30},
        },
        "valuation": {
            "enabled": True,
            "required": False,
            "weight": 0.30,
            "factors": {"pe_ttm_percentile": 0.35, "pb_percentile": 0.35, "industry_pe_ttm_percentile": 0.30},
        },
        "momentum": {
            "enabled": True,
            "required": False,
            "weight": 0.40,
            "factors": {"return_20d": 0.50, "above_ma60": 0.50},
        },
        "event": {"enabled": False, "required": False, "weight": 0.0, "factors": {}},
    },
    "risk": {
        "max_penalty": 15.0,
        "factors": {"volatility_20d": 0.40, "max_drawdown_60d": 0.40, "amount_cv_20d": 0.20},
        "direction": "higher_is_worse",
    },
    "perturbation": 0.10,
    "min_signal_dates_per_year": 1,
}

# Gate on validation results.
VALIDATION_GATE = {
    "required_horizons": [20],
    "min_coverage": 0.2,
    "min_valid_oriented_ic_dates": 1,
    "min_mean_oriented_rank_ic": 0.0,
    "min_oriented_icir": -999.0,
    "require_group_return_rows": True,
}

# Single-factor validation.
VALIDATION = {"horizons": [5, 20, 60], "n_groups": 4, "min_ic_observations": 3, "min_group_size": 1}

# Trading rules and costs of the replay.
TRADING = {
    "initial_cash": 1_000_000.0,
    "lot_size": 100,
    "commission_bps": 2.5,
    "stamp_tax_bps": 10.0,
    "slippage_bps": 5.0,
    "min_commission": 5.0,
    "price_tolerance": 0.000001,
    "trading_days_per_year": 252.0,
}

# Data quality gate thresholds of this repository's queries.
QUALITY_GATE = {
    "min_price_coverage": 0.80,
    "min_valuation_coverage": 0.80,
    "min_factor_stock_coverage": 0.80,
    "min_hard_filter_coverage": 0.80,
}


def factor_names(kind: str = "factor") -> list[str]:
    return [name for name, (k, _, _) in FACTORS.items() if k == kind]


def direction(name: str) -> str:
    return FACTORS[name][1]


def select_factors(requested: list[str] | None, include_filters: bool = False) -> list[str]:
    """Requested names de-duplicated in order, or the default set; unknown names fail."""
    if requested is None:
        return [n for n, (kind, _, _) in FACTORS.items() if kind == "factor" or include_filters]
    unknown = [n for n in requested if n not in FACTORS]
    if unknown:
        raise ValueError(f"unknown factor names: {', '.join(unknown)}")
    return list(dict.fromkeys(requested))


def config_rows(scoring: dict = SCORING) -> list[tuple[str, str, str, float]]:
    """``(factor, role, group, weight)`` of every configured score item."""
    rows = [
        (name, "positive", group, weight)
        for group, spec in scoring["groups"].items()
        if spec["enabled"]
        for name, weight in spec["factors"].items()
    ]
    return rows + [(name, "risk_penalty", "risk", w) for name, w in scoring["risk"]["factors"].items()]
