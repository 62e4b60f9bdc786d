"""Settings of each stage, passed explicitly; the values are the public defaults of the survey pipeline's method."""

from __future__ import annotations

import dataclasses
import json
import math
from dataclasses import dataclass, field


@dataclass(frozen=True)
class CleanConfig:
    bands: tuple[str, ...] = ("c", "o")
    require_magnitude: bool = False
    mag_range: tuple[float, float] = (-5.0, 30.0)
    dm_range: tuple[float, float] = (0.0, 5.0)
    flux_limit: float = 1e9
    hard_depth: float = 10.0
    dujy_max: float = 10_000.0
    snr_min: float = -5.0
    xy_range: tuple[float, float] = (100.0, 10460.0)
    axis_range: tuple[float, float] = (1.6, 5.0)
    apfit_range: tuple[float, float] = (-1.0, -0.1)
    depth_min: float = 17.0
    sky_min: float = 17.0
    require_err_zero: bool = True
    require_flags_zero: bool = False
    rescue: bool = False
    rescue_z: float = -5.0
    window: int = 41


@dataclass(frozen=True)
class SelectConfig:
    min_points: int = 100
    min_band_points: int = 30
    min_baseline: float = 365.0
    max_removed: float = 0.5
    max_dm: float = 0.2


@dataclass(frozen=True)
class PeriodConfig:
    min_points: int = 50
    min_baseline: float = 20.0
    min_band_points: int = 30
    min_period: float = 0.5
    max_period: float = 200.0
    min_cycles: float = 3.0
    samples_per_peak: int = 15
    n_peaks: int = 12
    peak_separation: float = 0.02
    bls_range: tuple[float, float] = (0.5, 50.0)
    bls_durations: tuple[float, ...] = (0.05, 0.10, 0.20, 0.40)
    field_deg: float = 5.0
    field_min_stars: int = 8
    field_min_fraction: float = 0.30
    cluster_tolerance: float = 0.01
    field_tolerance: float = 0.02
    universal_tolerance: float = 0.015
    harmonic_order: int = 6
    harmonic_tolerance: float = 0.02
    catalogue_tolerance: float = 0.03
    replacement_fraction: float = 0.25
    replacement_rank: int = 3
    alias_threshold: float = 0.50
    window_warning: float = 0.40
    weight_universal: float = 0.50
    weight_field: float = 0.50
    weight_window: float = 0.35
    fap_threshold: float = 0.01
    nonvar_fap: float = 0.05
    peak_snr: float = 3.0
    fold_snr: float = 3.0
    strong_ratio2: float = 1.5
    strong_ratio4: float = 1.8
    flat_ratio4: float = 1.20
    single_fold_snr: float = 3.0
    single_peak_snr: float = 4.0
    fold_bins: int = 40
    fold_min_bin: int = 3
    odd_even_bins: int = 30
    odd_even_min_bin: int = 5
    odd_even_min_bins: int = 8
    odd_even_z: float = 2.8
    odd_even_fraction: float = 0.20


@dataclass(frozen=True)
class MorphologyConfig:
    """``preset`` chooses between the two public default sets, which differ in two thresholds."""

    preset: str = "pipeline"
    phase_bins: int = 64
    sections: int = 4
    map_bins: int = 32
    min_coverage: float = 0.30
    min_observations: int = 50
    event_sigma: float = 5.0
    event_gap_days: float = 1.0
    event_min_points: int = 2
    thresholds: dict = field(default_factory=dict)

    def threshold(self, name: str) -> float:
        presets = {
            "pipeline": {"transit_max_duty_cycle": 0.25, "periodic_snr": 5.0},
            "code": {"transit_max_duty_cycle": 0.65, "periodic_snr": 6.0},
        }
        return {**THRESHOLDS, **presets[self.preset], **self.thresholds}[name]


# Classification thresholds.
THRESHOLDS = {
    "periodic_chi2": 5.0,
    "periodic_chi2_strong": 25.0,
    "alias_relative_tolerance": 0.01,
    "poor_photometry_error": 0.25,
    "poor_photometry_amplitude_ratio": 3.0,
    "transit_min_supporting_sections": 2,
    "transit_min_cycles": 3,
    "transit_exceptional_two_cycle_score": 0.88,
    "transit_min_cycle_support_fraction": 0.45,
    "transit_score_threshold": 0.52,
    "double_dip_fraction": 0.80,
    "eclipse_phase_tolerance": 0.08,
    "transit_min_dip_significance": 6.0,
    "secondary_eclipse_fraction": 0.25,
    "flare_min_events": 2,
    "flare_min_event_snr": 5.0,
    "flare_min_asymmetry": 0.75,
    "flare_max_point_fraction": 0.10,
    "flare_min_duty_fraction": 0.002,
    "flare_min_dominance": 1.6,
    "flare_max_duty_cycle": 0.35,
    "flare_max_baseline_variation": 0.40,
    "evolving_min_section_distance": 0.65,
    "evolving_max_section_correlation": 0.25,
    "irregular_min_scatter_over_error": 2.0,
    "irregular_min_temporal_coherence": 0.42,
    "wave_dimming_ambiguity_margin": 0.10,
    "noisy_min_scatter_over_error": 4.0,
    "symmetry_min_correlation": 0.97,
    "low_confidence": 0.60,
    "filter_disagreement_correlation": 0.10,
}

# Cadence aliases that any ground-based survey has, in days, in order of precedence.
UNIVERSAL_ALIASES = (
    ("third_day", 1.0 / 3.0),
    ("half_day", 0.5),
    ("two_thirds_day", 2.0 / 3.0),
    ("sidereal_day", 0.99726957),
    ("one_day", 1.0),
    ("one_and_half_day", 1.5),
    ("two_day", 2.0),
    ("half_lunar", 29.53059 / 2.0),
    ("lunar", 29.53059),
    ("half_year", 365.25 / 2.0),
    ("year", 365.25),
)
#: Warnings of a series in order of precedence; a row keeps the first two.
WARNING_ORDER = ("alias_corrected", "alias_possible", "harmonic_possible", "filter_disagreement", "single_filter_only")


def _positive(x) -> bool:
    return x > 0


def _share(x) -> bool:
    return 0 <= x <= 1


def _ascending(x) -> bool:
    return len(x) == 2 and x[0] < x[1]


#: What a setting must be, by class and name; numbers must be finite everywhere.
RULES = {
    "CleanConfig": {
        "bands": ("not empty", lambda x: len(x) > 0 and all(isinstance(b, str) and b for b in x)),
        "window": ("at least 3", lambda x: x >= 3),
        "flux_limit": ("positive", _positive),
        "dujy_max": ("positive", _positive),
        **{n: ("a pair, lower first", _ascending) for n in ("mag_range", "dm_range", "xy_range", "axis_range", "apfit_range")},
    },
    "SelectConfig": {
        "min_points": ("not negative", lambda x: x >= 0),
        "min_band_points": ("not negative", lambda x: x >= 0),
        "min_baseline": ("not negative", lambda x: x >= 0),
        "max_removed": ("from 0 to 1", _share),
        "max_dm": ("positive", _positive),
    },
    "PeriodConfig": {
        **{
            n: ("positive", _positive)
            for n in (
                "min_period",
                "max_period",
                "min_cycles",
                "samples_per_peak",
                "n_peaks",
                "field_deg",
                "harmonic_order",
                "fold_bins",
                "odd_even_bins",
                "replacement_rank",
                "field_min_stars",
            )
        },
        **{
            n: ("from 0 to 1", _share)
            for n in (
                "field_min_fraction",
                "replacement_fraction",
                "alias_threshold",
                "fap_threshold",
                "nonvar_fap",
                "odd_even_fraction",
                "peak_separation",
                "cluster_tolerance",
                "field_tolerance",
                "universal_tolerance",
                "harmonic_tolerance",
                "catalogue_tolerance",
            )
        },
        "bls_range": ("a pair, lower first", _ascending),
        "bls_durations": ("positive", lambda x: len(x) > 0 and all(d > 0 for d in x)),
    },
    "MorphologyConfig": {
        "preset": ("'pipeline' or 'code'", lambda x: x in ("pipeline", "code")),
        "phase_bins": ("at least 8", lambda x: x >= 8),
        "map_bins": ("at least 4", lambda x: x >= 4),
        "sections": ("at least 1", lambda x: x >= 1),
        "min_coverage": ("from 0 to 1", _share),
        "event_sigma": ("positive", _positive),
        "event_gap_days": ("positive", _positive),
        "event_min_points": ("at least 1", lambda x: x >= 1),
        "thresholds": ("known names", lambda x: set(x) <= {*THRESHOLDS, "transit_max_duty_cycle", "periodic_snr"}),
    },
}


def _numbers(x) -> list[float]:
    if isinstance(x, dict):
        return [n for v in x.values() for n in _numbers(v)]
    if isinstance(x, (tuple, list)):
        return [n for v in x for n in _numbers(v)]
    return [x] if isinstance(x, (int, float)) and not isinstance(x, bool) else []


def checked(cfg):
    """``cfg`` if its values are of the kinds and in the ranges that its stage can work with, else an error that names them all."""
    wrong = []
    for f in dataclasses.fields(cfg):
        value, default = getattr(cfg, f.name), f.default
        number = isinstance(default, (int, float)) and not isinstance(default, bool)
        if number and (
            not isinstance(value, (int, float)) or isinstance(value, bool)
        ) or isinstance(default, bool) and not isinstance(value, bool):
            wrong.append(f"{f.name} must be {'a number' if number else 'true or false'}, not {value!r}")
            continue
        if not all(math.isfinite(n) for n in _numbers(value)):
            wrong.append(f"{f.name} must be finite, not {value!r}")
            continue
        rule = RULES.get(type(cfg).__name__, {}).get(f.name)
        if rule and not rule[1](value):
            wrong.append(f"{f.name} must be {rule[0]}, not {value!r}")
    if isinstance(cfg, PeriodConfig) and not wrong and cfg.min_period >= cfg.max_period:
        wrong.append("min_period must be under max_period")
    if wrong:
        raise ValueError(f"{type(cfg).__name__}: " + "; ".join(wrong))
    return cfg


def configured(cls, values: dict):
    """``cls`` with ``values`` laid over its defaults and checked; unknown names are an error."""
    names = {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(values) - set(names))
    if unknown:
        raise ValueError(f"unknown {cls.__name__} settings: {', '.join(unknown)}")
    fixed = {k: tuple(v) if isinstance(v, list) else v for k, v in values.items()}
    return checked(cls(**fixed))


def overridden(values: dict, changes: list[str]) -> dict:
    """Nested settings with ``stage.name=value`` changes laid over them; a value is read as JSON, else as text."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in values.items()}
    for change in changes:
        path, found, text = change.partition("=")
        if not found or not path.strip():
            raise ValueError(f"a setting is stage.name=value, not {change!r}")
        try:
            value = json.loads(text)
        except json.JSONDecodeError:
            value = text
        *parents, last = path.strip().split(".")
        at = out
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out
