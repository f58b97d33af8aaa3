"""Settings as text: flags, aliases, steps of paths, sizes; for columns and for the driver."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
#: Other names of the band's modes (fixed values).
BAND_ALIASES = {
    "full": "both", "default": "both", "no_low_gate": "no_lower_zero", "no_lower_gate": "no_lower_zero", "upper_only": "no_lower_zero",
    "no_upper_bonus": "lower_zero_only", "zero_only": "lower_zero_only"
}
BAND_MODES = ("both", "no_lower_zero", "lower_zero_only")


def flag(value: Column, default: bool = False) -> Column:
    """Text as a boolean; what is neither is the default."""
    x = F.lower(F.trim(value))
    return F.when(x.isin(*TRUE), True).when(x.isin(*FALSE), False).otherwise(default)


def as_flag(value: object, default: bool = False) -> bool:
    if value is None or isinstance(value, bool):
        return default if value is None else value
    x = str(value).strip().lower()
    return True if x in TRUE else False if x in FALSE else default


def band_mode(value: str | None) -> str:
    x = str(value or "both").strip().lower().replace("-", "_")
    x = BAND_ALIASES.get(x, x)
    if x not in BAND_MODES:
        raise ValueError(f"unknown mode {value!r}")
    return x


def band_modes(value: Column) -> Column:
    """Null for an unknown mode."""
    x = F.replace(F.lower(F.trim(F.coalesce(F.nullif(value, F.lit("")), F.lit("both")))), F.lit("-"), F.lit("_"))
    known = F.create_map(*[F.lit(v) for kv in BAND_ALIASES.items() for v in kv])
    x = F.coalesce(known[x], x)
    return F.when(x.isin(*BAND_MODES), x)


def step_of(path: Column) -> Column:
    """The number that a path ends with; null without one."""
    return F.regexp_extract(path, r"(\d+)/*$", 1).try_cast("long")


def resume_point(paths: list[str]) -> str | None:
    """The path of the highest step."""
    steps = [(int(m[1]), p) for p in paths if (m := re.search(r"(\d+)/*$", p))]
    return max(steps)[1] if steps else None


def may_dump(active: Column, step: Column, last: Column) -> Column:
    return active & (step <= last)


def round_up(n: Column, k: int) -> Column:
    n = n.cast("long")  # a quotient would be a double, which leaves out digits from 2**53 on
    return n + F.pmod(-n, F.lit(k))


def common_multiple(sizes: list[int]) -> int:
    """What a batch must be a multiple of so that every rank gets a whole part."""
    return math.lcm(*sizes) if sizes else 1


def plain(value: object) -> object:
    """Settings in containers of any kind as dicts, lists and scalars; NaN as None, bytes as hex."""
    if hasattr(value, "items"):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)) or type(value).__name__ == "ndarray":
        return [plain(v) for v in value]
    if isinstance(value, bytes):
        return value.hex()
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value.item() if hasattr(value, "item") else value


#: Peak floating-point operations a second by device, dense 16-bit (fixed values of data sheets).
PEAK = {
    "CPU": 448e9, "GB200": 2.5e15, "B200": 2.25e15, "MI300X": 1336e12, "H100": 989e12, "H800": 989e12, "H200": 989e12, "A100": 312e12, "A800": 312e12, "L40S": 362.05e12,
    "L40": 181.05e12, "A40": 149.7e12, "L20": 119.5e12, "H20": 148e12, "910B": 354e12, "Ascend950DT": 432e12, "Ascend910": 354e12, "RTX 3070 Ti": 21.75e12,
}
#: B leaves a figure as it is (a fixed value, as all of these).
SCALE = {"B": 1.0, "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15}


def peak(device: Column, unit: str = "T") -> Column:
    """A device's peak in a unit, by the part of its name that is known; infinite otherwise.  Names
    are tried from the last in order of letters, so that longer ones come before their beginnings."""
    out = F.lit(float("inf"))
    for name in sorted(PEAK):  # the last one decides first
        out = F.when(F.contains(device, F.lit(name)), PEAK[name] / SCALE[unit]).otherwise(out)
    return out
