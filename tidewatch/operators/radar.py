"""The detector's parameters and the radar quantities that need no raster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SPEED_OF_LIGHT = 299_792_458.0
DETECTOR, VERSION = "cfar", "1"


@dataclass(frozen=True)
class Config:
    """The detector's fixed parameters."""

    block: int = 32
    k: float = 8.0
    censor: float = 4.0
    min_snr_db: float = 10.0
    land_block: int = 8
    land_sigma0_db: float = -22.0
    land_open_blocks: int = 2
    land_dilate_blocks: int = 10
    max_fill_fraction: float = 0.1
    min_length_m: float = 15.0
    max_length_m: float = 450.0
    min_pixels: int = 4
    k_grow: float = 2.5
    grow_halfwidth_px: int = 40
    min_heading_px: float = 4.0
    min_heading_aspect: float = 1.6
    merge_radius_m: float = 200.0


# -- calibration --------------------------------------------------------------------------------

def sigma0(dn: Column, noise: Column, gain: Column) -> Column:
    """Backscatter less thermal noise; it may be negative."""
    return (dn * dn - noise) / F.nullif(gain * gain, F.lit(0.0))


def to_db(x: Column) -> Column:
    return 10.0 * F.log10(F.greatest(x, F.lit(1e-12)))


def from_db(db: float) -> float:
    return 10.0 ** (db / 10.0)


def slant_range_m(two_way_s: Column) -> Column:
    return two_way_s * SPEED_OF_LIGHT / 2
