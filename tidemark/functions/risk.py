"""Scalar rules of costs, regimes, sizing and circuit breaking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def conviction(alpha: Column, cap: float = 0.20, deadband: float = 0.0) -> Column:
    """sign(alpha) * min(|alpha| / cap, 1); 0 within the dead band."""
    return F.when(F.abs(alpha) <= deadband, 0.0).otherwise(F.signum(alpha) * clip(F.abs(alpha) / cap, 0, 1))


def slippage_bps(vol_bps: Column, bench_bps: Column, notional: Column, depth: Column, base: float = 3.0, k_vol: float = 2.0, k_liq: float = 10.0) -> Column:
    """base + k_vol * relative excess volatility + k_liq * depth ratio; unknown or non-positive depth counts as ratio 1."""
    ratio = F.when(depth > 0, F.try_divide(notional, depth)).otherwise(1.0)
    vol = F.when(bench_bps > 0, k_vol * F.greatest(F.lit(0.0), F.try_divide(vol_bps - bench_bps, bench_bps))).otherwise(0.0)
    return F.lit(base) + F.coalesce(vol, F.lit(0.0)) + k_liq * F.coalesce(ratio, F.lit(1.0))


def large_order(notional: Column, depth: Column, part: float = 0.1) -> Column:
    """Orders above a part of the depth are to be worked in slices; so are all where the depth is unknown."""
    return ~F.coalesce((depth > 0) & (notional <= part * depth), F.lit(False))


def executable_price(price: Column, is_long: Column, is_entry: Column, bps: Column) -> Column:
    """A long entry or a short exit pays up, the others receive less."""
    return price * F.when(is_long == is_entry, 1 + bps / 1e4).otherwise(1 - bps / 1e4)


def net_return(raw: Column, funding: Column, fee: float = 4.0, spread: float = 1.0, impact: Column | float = 3.0) -> Column:
    """Funding is signed and added; fee, half-spread and impact (bps) are charged on both legs."""
    return raw + funding - 2 * (fee + spread + (impact if isinstance(impact, Column) else F.lit(impact))) / 1e4


def regime(vol: Column, momentum: Column, funding_z: Column, high: float = 0.02) -> Column:
    """The state of a market by fixed rules, the first that holds; `high`: volatility from which it counts as high."""
    known = vol.isNotNull() & momentum.isNotNull()
    return (
        F.when(F.abs(funding_z) > 2, "funding_overheated")
        .when(known & (vol > high) & (momentum > 0.5), "high_volatility_uptrend")
        .when(known & (vol > high) & (momentum < -0.5), "panic_selloff")
        .when(known & (momentum > 0.5), "low_volatility_uptrend")
        .when(known & (momentum < -0.5), "low_volatility_downtrend")
        .otherwise("range_bound")
    )


def soft_daily_loss(mean_abs_daily: Column) -> Column:
    return F.greatest(F.lit(0.02), F.coalesce(1.5 * mean_abs_daily, F.lit(0.0)))


def breaker_level(drawdown: Column, daily_loss: Column, soft: Column, thresholds: tuple[float, float, float] = (0.20, 0.25, 0.30)) -> Column:
    """Highest level whose drawdown threshold, or multiple of the soft daily loss, is exceeded (1, 2 or 3; else 0)."""
    one, two, three = thresholds
    return F.when((daily_loss > 3 * soft) | (drawdown > three), 3).when((daily_loss > 2 * soft) | (drawdown > two), 2).when((daily_loss > soft) | (drawdown > one), 1).otherwise(0)


def breaker_flags(level: Column, connected: Column, reconciled: Column, killed: Column) -> Column:
    """The level raised by operating flags: a lost connection or a kill switch halts, unreconciled positions cut to half."""
    return F.greatest(level, F.when(~connected | killed, 3).when(~reconciled, 2).otherwise(0))


def breaker_reason(drawdown: Column, daily_loss: Column, soft: Column, connected: Column, reconciled: Column, killed: Column, thresholds: tuple[float, float, float] = (0.20, 0.25, 0.30)) -> Column:
    """What raised the level, as a list of names; "ok" where nothing did."""
    one, two, three = (f"drawdown>{round(100 * t)}%" for t in thresholds)
    fall = F.when(drawdown > thresholds[2], three).when(drawdown > thresholds[1], two).when(drawdown > thresholds[0], one)
    loss = F.when(daily_loss > 3 * soft, "daily_loss>hard").when(daily_loss > soft, "daily_loss>soft")
    parts = F.concat_ws(",", F.when(~connected, "connection_anomaly"), F.when(~reconciled, "reconciliation_drift"), F.when(killed, "kill_switch"), fall, loss)
    return F.when(parts == "", "ok").otherwise(parts)


def breaker_multiplier(level: Column) -> Column:
    return F.when(level >= 3, 0.0).when(level == 2, 0.5).otherwise(1.0)


def drawdown_scaler(drawdown: Column, start: float = 0.10, end: float = 0.20) -> Column:
    """1 up to `start`, 0 from `end`, linear between."""
    return clip((F.lit(end) - drawdown) / (end - start), 0, 1)


def confidence(quality: Column, alpha: Column, forecast: Column, meta: Column) -> Column:
    """Mean of data quality, agreement of signs and distance of the calibrated probability from one half."""
    agree = F.when(forecast.isNull() | (alpha == 0) | (F.signum(forecast) == F.signum(alpha)), 1.0).otherwise(0.5)
    return (quality + agree + F.abs(F.coalesce(meta, F.lit(0.5)) - 0.5) * 2) / 3


def sized(alpha: Column, meta: Column, vol: Column, sure: Column, level: Column, use_meta: bool = True, threshold: float = 0.55, edge_cap: float = 0.20, most: float = 0.25, target_vol: float = 0.30, most_scale: float = 3.0, bars: int = 2190) -> Column:
    """Target position: gate, edge (or conviction), volatility target, confidence haircut, limit, breaker."""
    sign = F.signum(alpha)
    edge = clip((meta - threshold) / edge_cap, 0, 1) if use_meta else clip(F.abs(alpha) / edge_cap, 0, 1)
    realised = vol * F.sqrt(F.lit(float(bars)))
    scale = F.when(realised > 1e-12, F.least(F.try_divide(F.lit(target_vol), realised), F.lit(most_scale))).otherwise(0.0)
    size = clip(most * edge * sign * scale * F.least(F.lit(1.0), sure / 0.8), -most, most)
    return F.coalesce(size, F.lit(0.0)) * breaker_multiplier(level)


def decided(alpha: Column, meta: Column, vol: Column, sure: Column, level: Column, width: Column, use_meta: bool = True, threshold: float = 0.55, edge_cap: float = 0.20, take: float = 1.5, stop: float = 1.5, **limits) -> Column:
    """`sized` as a decision: struct of position, approved, risk_level, stop_loss, take_profit (in barrier widths) and reason."""
    size = sized(alpha, meta, vol, sure, level, use_meta, threshold, edge_cap, **limits)
    flat = alpha.isNull() | (alpha == 0)
    none = flat | meta.isNull() if use_meta else flat
    low = ~none & (meta <= threshold) if use_meta else F.lit(False)
    open_ = F.coalesce(F.abs(size) > 1e-9, F.lit(False)) & ~none & ~low
    reason = F.when(none, "flat_or_no_meta" if use_meta else "flat").when(low, "below_threshold").when(open_, "edge" if use_meta else "conviction").otherwise(F.concat(F.lit("blocked cb="), level.cast("string")))
    bars_ = F.coalesce(F.nullif(width, F.lit(0.0)), F.lit(0.02))
    return F.struct(
        F.when(open_, size).otherwise(0.0).alias("position"), open_.alias("approved"), F.when(none, "none").when(low, "low").when(open_, "medium").otherwise("blocked").alias("risk_level"),
        F.when(none | low, 0.0).otherwise(stop * bars_).alias("stop_loss"), F.when(none | low, 0.0).otherwise(take * bars_).alias("take_profit"), reason.alias("reason"),
    )


def staleness(age_s: Column, warn: float = 3.0, skip: float = 10.0) -> Column:
    return F.when(age_s > skip, "skip").when(age_s > warn, "stale_warning").otherwise("normal")


def trade_type(before: Column, after: Column) -> Column:
    """Name of a change of weight."""
    return (
        F.when((before == 0) & (after > 0), "OPEN_LONG").when((before > 0) & (after == 0), "CLOSE_LONG")
        .when((before > 0) & (after > 0), F.when(after > before, "INCREASE_LONG").otherwise("REDUCE_LONG"))
        .when((before == 0) & (after < 0), "OPEN_SHORT").when((before < 0) & (after == 0), "CLOSE_SHORT")
        .when((before < 0) & (after < 0), F.when(after < before, "INCREASE_SHORT").otherwise("REDUCE_SHORT"))
        .when((before > 0) & (after < 0), "FLIP_LONG_TO_SHORT").when((before < 0) & (after > 0), "FLIP_SHORT_TO_LONG")
        .otherwise("UNKNOWN")
    )
