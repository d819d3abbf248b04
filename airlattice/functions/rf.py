"""Radio formulas as column expressions: losses, clearances, antennas, budgets. Distances in metres, levels in dB."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# Speed of light, earth radius, and the published default settings.
LIGHT_M_S = 299_792_458.0
EARTH_M = 6_371_000.0


@dataclass(frozen=True)
class Antenna:
    gain_dbi: float = 2.15
    feed_loss_db: float = 1.0


@dataclass(frozen=True)
class Radio:
    """Settings of a network: link budget, profile and validation."""

    frequency_mhz: float = 869.5
    tx_power_dbm: float = 22.0
    sensitivity_dbm: float = -130.0
    client_tx_power_dbm: float = 20.0
    client_sensitivity_dbm: float = -130.0
    fade_margin_db: float = 10.0
    misc_loss_db: float = 0.0
    k_factor: float = 1.0
    fresnel_clearance: float = 0.60
    strict: bool = False
    clutter_db_per_m: float | None = None
    sample_step_m: float = 200.0
    max_samples: int = 4096
    antenna: Antenna = field(default_factory=Antenna)

    @property
    def wavelength_m(self) -> float:
        return LIGHT_M_S / (self.frequency_mhz * 1e6)


def _d(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def fspl_db(distance_m: Column, mhz) -> Column:
    return F.lit(32.44) + F.lit(20.0) * F.log10(distance_m / F.lit(1000.0)) + F.lit(20.0) * F.log10(_d(mhz))


def received_dbm(tx_dbm, tx_gain, tx_feed, loss, rx_gain, rx_feed, misc) -> Column:
    return _d(tx_dbm) + _d(tx_gain) - _d(tx_feed) - _d(loss) + _d(rx_gain) - _d(rx_feed) - _d(misc)


def earth_bulge_m(d: Column, total: Column, k: float = 1.0) -> Column:
    return d * (total - d) / F.lit(2.0 * EARTH_M * k)


def fresnel_radius_m(d1: Column, d2: Column, mhz: float) -> Column:
    total = d1 + d2
    return F.when(total == 0, 0.0).otherwise(F.sqrt(F.lit(LIGHT_M_S / (mhz * 1e6)) * d1 * d2 / total))


def knife_edge_db(v: Column) -> Column:
    a = v - F.lit(0.1)
    return F.when(v <= -0.78, 0.0).otherwise(F.lit(6.9) + F.lit(20.0) * F.log10(F.sqrt(a * a + 1.0) + v - F.lit(0.1)))


def knife_edge_v(height: Column, d1: Column, d2: Column, mhz: float) -> Column:
    w = LIGHT_M_S / (mhz * 1e6)
    return F.when((d1 <= 0) | (d2 <= 0), F.lit(float("-inf"))).otherwise(height * F.sqrt(F.lit(2.0) * (d1 + d2) / (F.lit(w) * d1 * d2)))


def bullington_db(j: Column, total_m: Column) -> Column:
    """The knife edge's loss with the addition for a path of many edges."""
    return j + -F.expm1(-j / F.lit(6.0)) * (F.lit(10.0) + F.lit(0.02) * total_m / F.lit(1000.0))


def elevation_deg(distance: Column, from_m: Column, to_m: Column) -> Column:
    return F.degrees(F.atan2(to_m - from_m, distance))


def gain_at(points: Column, angle: Column) -> Column:
    """Gain of an antenna pattern, an array of (angle, gain) sorted by angle: linear between points, the ends beyond."""
    below = F.filter(points, lambda p: p["angle"] <= angle)
    above = F.filter(points, lambda p: p["angle"] > angle)
    a, b = F.try_element_at(below, F.lit(-1)), F.try_element_at(above, F.lit(1))
    between = a["gain"] + (angle - a["angle"]) / (b["angle"] - a["angle"]) * (b["gain"] - a["gain"])
    return F.when(F.isnan(angle), angle).when(a.isNull(), b["gain"]).when(b.isNull(), a["gain"]).otherwise(between)


def peak_gain(points: Column) -> Column:
    return F.array_max(F.transform(points, lambda p: p["gain"]))


# Signal-to-noise thresholds of the spreading factors.
SNR_THRESHOLD_DB = {7: -7.5, 8: -10.0, 9: -12.5, 10: -15.0, 11: -17.5, 12: -20.0}


def lora_sensitivity_dbm(bandwidth_hz: Column, noise_figure: Column, sf: Column) -> Column:
    snr = F.create_map(*(F.lit(x) for kv in SNR_THRESHOLD_DB.items() for x in kv))[sf]
    return F.lit(-174.0) + F.lit(10.0) * F.log10(bandwidth_hz) + noise_figure + snr


def planar_m(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = bx - ax, by - ay
    return F.sqrt(dx * dx + dy * dy)


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance rounded to two places, halves upwards."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    s1, s2 = F.sin((p2 - p1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = s1 * s1 + F.cos(p1) * F.cos(p2) * s2 * s2
    return F.floor(F.lit(2 * 6371.0088) * F.asin(F.least(F.lit(1.0), F.sqrt(a))) * 100.0 + 0.5) / 100.0


def sample_count(distance: Column, requested_m: float, resolution_m: float) -> Column:
    return F.greatest(F.ceil(distance / F.lit(max(requested_m, resolution_m))).cast("int") + 1, F.lit(3))


def optimistic_margin_db(distance: Column, r: Radio, peak_dbi: float | None = None) -> Column:
    """Margin over free space with both antennas at their peak, terrain left out: no link does better."""
    g = r.antenna.gain_dbi if peak_dbi is None else peak_dbi
    got = received_dbm(r.tx_power_dbm, g, r.antenna.feed_loss_db, fspl_db(distance, r.frequency_mhz), g, r.antenna.feed_loss_db, r.misc_loss_db)
    return got - F.lit(r.sensitivity_dbm) - F.lit(r.fade_margin_db)
