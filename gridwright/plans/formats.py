"""Column formats named in plans: a profile name, or a mask given as a small object."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

from gridwright.functions.numeric import NumberMask
from gridwright.functions.temporal import BooleanMask, Profile, TextMask, mask_profile, profile

Format = Profile | NumberMask | TextMask | BooleanMask

MASK_KEYS = {"kind", "pattern", "decimal", "preserve"}


def resolve(spec: str | Mapping[str, object] | None) -> Format | None:
    """``None``, a profile name, a mask object, or ``<prefix>-format:`` followed by its JSON."""
    if spec is None or isinstance(spec, (Profile, NumberMask, TextMask, BooleanMask)):
        return spec
    if isinstance(spec, str):
        packed = re.match(r"[\w.-]+-format:(?=\{)", spec)
        if packed is None:
            return profile(spec)
        spec = json.loads(spec[packed.end() :])
    if set(spec) - MASK_KEYS or not {"kind", "pattern"} <= set(spec):
        raise ValueError("a mask has kind, pattern and optionally decimal, preserve")
    kind, pattern = str(spec["kind"]), str(spec["pattern"])
    if kind == "number":
        return NumberMask(pattern, str(spec.get("decimal", ".")), bool(spec.get("preserve", False)))
    if kind == "text":
        return TextMask(pattern)
    if kind == "boolean":
        return BooleanMask(pattern)
    return mask_profile(kind, pattern)


def is_mask(spec: str | Mapping[str, object] | None) -> bool:
    """True for custom masks, which are read before invalid numbers are resolved."""
    return spec is not None and not isinstance(spec, (str, Profile)) or (
        isinstance(spec, str) and "-format:{" in spec
    )
