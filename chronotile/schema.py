"""Schemas, codes and parameters of the engine, and the checks of parameters."""

from __future__ import annotations

from dataclasses import dataclass, fields

BANDS = ["blue", "green", "red", "nir", "swir1", "swir2", "thermal"]
CLEAR, WATER, SHADOW, SNOW, CLOUD, FILL = 0, 1, 2, 3, 4, 255
NO_DATA, NO_CLASS = -9999, 255
#: unix_date + ORDINAL is the proleptic ordinal day; 16-bit days count from LAUNCH.
ORDINAL, LAUNCH = 719163, 723742

OBS = "pos long, seq int, date int, blue int, green int, red int, nir int, swir1 int, swir2 int, thermal int, qa int"
SEGMENTS = "pos long, seg int, t_start int, t_end int, t_break int, num_obs int, category smallint, change_prob smallint, coefs array<array<float>>, rmse array<float>, magnitude array<float>"
CM = "pos long, cm_idx int, cm smallint, cm_date smallint"

#: Parameter -> (type, lower bound, lower bound allowed, upper bound, upper bound allowed).
RANGES = {
    "t_cg": (float, 0, False, None, False),
    "pos": (int, 0, False, None, False),
    "starting_date": (int, 0, True, None, False),
    "n_cm": (int, 0, True, None, False),
    "conse": (int, 0, False, 12, False),
    "gap_days": (float, 0, True, None, False),
    "gate_tcg": (float, 0, False, None, False),
    "predictability_tcg": (float, 0, False, None, False),
    "dist_conse": (int, 0, False, 6, True),
    "t_angle_scale100": (float, 0, False, 18000, False),
    "t_cg_scale100": (float, 0, False, None, False),
}
FLAGS = {"b_output_cm", "b_c2", "b_pinpoint", "b_monitor_init", "transform_mode"}


def validate(**given) -> None:
    """Raise ValueError for a parameter of the wrong type or out of its range; unknown names pass."""
    for name, value in given.items():
        if name in FLAGS and not isinstance(value, bool):
            raise ValueError(f"{name} must be a boolean, not {value!r}")
        if name not in RANGES:
            continue
        kind, low, low_in, high, high_in = RANGES[name]
        if isinstance(value, bool) or not isinstance(value, (int, float) if kind is float else int):
            raise ValueError(f"{name} must be of type {kind.__name__}, not {value!r}")
        if value < low or (value == low and not low_in):
            raise ValueError(f"{name} = {value!r} is too small")
        if high is not None and (value > high or (value == high and not high_in)):
            raise ValueError(f"{name} = {value!r} is too large")


def check_series(days, bands, qa) -> None:
    """Raise ValueError unless a pixel's arrays are one-dimensional (bands: one array each) and equally long."""
    sizes = set()
    for name, a in (("days", days), ("qa", qa), *zip(BANDS, bands, strict=False)):
        shape = getattr(a, "shape", None) or (len(a),)
        if len(shape) != 1:
            raise ValueError(f"{name} has {len(shape)} dimensions")
        sizes.add(shape[0])
    if len(bands) != len(BANDS):
        raise ValueError(f"{len(bands)} bands instead of {len(BANDS)}")
    if len(sizes) != 1:
        raise ValueError(f"arrays of different lengths: {sorted(sizes)}")


@dataclass(frozen=True)
class Grid:
    """A tile of n_rows x n_cols pixels in n_block_x x n_block_y blocks."""

    n_rows: int
    n_cols: int
    n_block_x: int = 1
    n_block_y: int = 1

    def __post_init__(self) -> None:
        if self.n_cols % self.n_block_x or self.n_rows % self.n_block_y:
            raise ValueError("blocks must divide the tile")

    @property
    def block_width(self) -> int:
        return self.n_cols // self.n_block_x

    @property
    def block_height(self) -> int:
        return self.n_rows // self.n_block_y

    @classmethod
    def of(cls, config: dict) -> Grid:
        """From a mapping; names that are no fields are ignored."""
        return cls(**{f.name: int(config[f.name]) for f in fields(cls) if f.name in config})
