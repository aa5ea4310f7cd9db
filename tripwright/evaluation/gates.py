"""Pre-registered thresholds and the two gates that decide, from evidence alone, whether to build on."""

from __future__ import annotations

import math
import warnings
from dataclasses import dataclass, replace
from typing import Any

CONVENTIONS = ("once_via_assigned_segment", "ping_duration_weighted")


@dataclass(frozen=True)
class Registration:
    """Thresholds fixed before results are known; the fingerprint tells whether a copy was altered."""

    frozen_on: str
    primary_metric: str = "end_to_end_orientation_recovery"
    iou_thresholds: tuple[float, ...] = (0.5, 0.8)
    fragment_convention: str = CONVENTIONS[0]
    min_orientation_coverage: float = 0.7
    gate1_min_eligible_fraction: float = 0.2
    gate2_min_residual_recovery_gain: float = 0.1
    gate2_max_merge_rate: float = 0.2
    gate2_max_fragment_rate: float = 0.2
    fingerprint: str = ""

    def expected(self) -> str:
        """The fingerprint of the fields as they are."""
        return repr(tuple(v for k, v in sorted(vars(self).items()) if k != "fingerprint"))

    def check(self) -> str:
        """The fingerprint; ValueError if fields were altered since."""
        if self.fingerprint != self.expected():
            raise ValueError("the registration was altered after it was frozen")
        return self.fingerprint


def preregister(frozen_on: str | None = None, **fields: Any) -> Registration:
    """A dated registration with its fingerprint."""
    if not frozen_on:
        raise ValueError("frozen_on, a date, is required")
    r = Registration(frozen_on, **fields)
    if r.fragment_convention not in CONVENTIONS:
        raise ValueError(f"fragment_convention must be one of {CONVENTIONS}")
    return replace(r, fingerprint=r.expected())


def _number(x: Any, name: str, low: float, high: float, whole: bool = False) -> float:
    if isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) or not low <= x <= high or (whole and x != round(x)):
        raise ValueError(f"{name} must be one {'whole ' if whole else ''}number from {low} to {high}")
    return x


def _first(fraction: float | None, r: Registration) -> bool:
    return fraction is not None and _number(fraction, "eligible_fraction", 0, 1) >= r.gate1_min_eligible_fraction


def _second(gain: float, merge: float, fragment: float, coverage: float, r: Registration) -> tuple[bool, bool]:
    _number(gain, "recovery_gain", -1, 1)
    for name, x in (("merge_rate", merge), ("fragment_rate", fragment), ("orientation_coverage", coverage)):
        _number(x, name, 0, 1)
    enough = coverage >= r.min_orientation_coverage
    return enough, enough and gain >= r.gate2_min_residual_recovery_gain and merge <= r.gate2_max_merge_rate and fragment <= r.gate2_max_fragment_rate


def gate1(eligible: list[bool | None], r: Registration) -> dict[str, Any]:
    """The share of datasets that are eligible against its floor; an unknown one counts as not eligible, with a warning."""
    fingerprint = r.check()
    if any(x is not None and not isinstance(x, bool) for x in eligible):
        raise ValueError("eligible must hold True, False or None")
    unknown, yes, n = sum(x is None for x in eligible), sum(x is True for x in eligible), len(eligible)
    if unknown:
        warnings.warn(f"{unknown} datasets of unknown eligibility count as not eligible", stacklevel=2)
    fraction = yes / n if n else None
    return {"eligible_fraction": fraction, "n_datasets": n, "n_eligible": yes, "n_unknown": unknown, "pass": _first(fraction, r), "fingerprint": fingerprint}


def gate2(detector_recovery: float, baseline_recovery: float, merge_rate: float, fragment_rate: float, orientation_coverage: float, r: Registration) -> dict[str, Any]:
    """The gain over the best simple baseline against its floor, with caps on merges and fragments and a floor of coverage."""
    fingerprint = r.check()
    gain = _number(detector_recovery, "detector_recovery", 0, 1) - _number(baseline_recovery, "baseline_recovery", 0, 1)
    enough, passed = _second(gain, merge_rate, fragment_rate, orientation_coverage, r)
    return {
        "detector_recovery": detector_recovery, "baseline_recovery": baseline_recovery, "recovery_gain": gain, "merge_rate": merge_rate, "fragment_rate": fragment_rate,
        "orientation_coverage": orientation_coverage, "coverage_gate": enough, "pass": passed, "fingerprint": fingerprint,
    }


def report(first: dict[str, Any], second: dict[str, Any] | None, r: Registration) -> dict[str, Any]:
    """Both decisions anew from the evidence, never from stored verdicts; evidence that contradicts itself raises ValueError."""
    fingerprint = r.check()
    for name, g, need in (("1", first, ("n_eligible", "n_datasets")), ("2", second, ("detector_recovery", "baseline_recovery", "merge_rate", "fragment_rate", "orientation_coverage"))):
        if g is None:
            continue
        if any(k not in g for k in (*need, "fingerprint")):
            raise ValueError(f"gate {name} lacks evidence")
        if g["fingerprint"] != fingerprint:
            raise ValueError(f"gate {name} was judged under another registration")
    n, all_ = (_number(first[k], k, 0, 2**53, True) for k in ("n_eligible", "n_datasets"))
    if n > all_:
        raise ValueError("n_eligible exceeds n_datasets")
    fraction = n / all_ if all_ else None
    stored = first.get("eligible_fraction")
    if stored is not None and (fraction is None or abs(stored - fraction) > 1.5e-8):
        raise ValueError("eligible_fraction contradicts its counts")
    one = _first(fraction, r)
    two = coverage = gain = None
    if second is not None:
        gain = _number(second["detector_recovery"], "detector_recovery", 0, 1) - _number(second["baseline_recovery"], "baseline_recovery", 0, 1)
        if second.get("recovery_gain") is not None and abs(second["recovery_gain"] - gain) > 1.5e-8:
            raise ValueError("recovery_gain contradicts the recoveries")
        coverage, two = _second(gain, second["merge_rate"], second["fragment_rate"], second["orientation_coverage"], r)
    authorized = one and two is True
    note = "both gates pass" if authorized else "gate 2 was not evaluated" if second is None else "a gate fails: only the simple baseline is justified"
    return {"gate1_pass": one, "gate1_eligible_fraction": fraction, "gate2_pass": two, "gate2_coverage_gate": coverage, "gate2_recovery_gain": gain, "build_authorized": authorized, "note": note}


def shown(rep: dict[str, Any], r: Registration) -> str:
    """The report in words, with the thresholds of the registration."""
    f = rep["gate1_eligible_fraction"]
    lines = [f"registered: {r.frozen_on}", f"gate 1: eligible {'NA' if f is None else f'{f:.3f}'} of at least {r.gate1_min_eligible_fraction:.3f}: {'PASS' if rep['gate1_pass'] else 'FAIL'}"]
    lines.append("gate 2: not evaluated" if rep["gate2_pass"] is None else f"gate 2: gain {rep['gate2_recovery_gain']:.3f}, coverage {'enough' if rep['gate2_coverage_gate'] else 'too low'}: {'PASS' if rep['gate2_pass'] else 'FAIL'}")
    return "\n".join([*lines, f"build authorized: {rep['build_authorized']} ({rep['note']})"])
