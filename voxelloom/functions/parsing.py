"""Settings as text or numbers, checked: chunks, calibrations, triplets."""

from __future__ import annotations

#: World axes and the source axes that may be bound to them.
WORLD_AXES, SOURCE_AXES = ("z", "y", "x"), ("x", "y", "z", "f")


def parse_chunks(text: str | None):
    """None, one positive number or a tuple of them."""
    if text is None or not str(text).strip():
        return None
    parts = [p.strip() for p in str(text).split(",")]
    if not all(p.isdigit() and int(p) > 0 for p in parts):
        raise ValueError(f"chunks must be positive whole numbers: {text!r}")
    return int(parts[0]) if len(parts) == 1 else tuple(map(int, parts))


def int_triplet(value, name: str, default: tuple[int, int, int]) -> tuple[int, int, int]:
    """Three positive whole numbers of a number, a text or a sequence."""
    if value is None:
        return default
    if isinstance(value, str):
        value = value.split(",")
    parts = [value] * 3 if isinstance(value, int | float) else list(value)
    try:
        out = tuple(int(p) for p in parts)
    except (TypeError, ValueError):
        raise ValueError(f"{name} must hold whole numbers") from None
    if len(out) != 3 or min(out) <= 0:
        raise ValueError(f"{name} must be three positive whole numbers")
    return out


def parse_calibration(text: str) -> dict[str, str]:
    """World axis to signed source axis of ``z=+x,y=none,x=+y``.

    Every world axis occurs once, a source axis at most once; an empty text is
    the identity.
    """
    out: dict[str, str] = {}
    plain = text.replace(" ", "").lower().strip(",")
    for part in (plain or "z=+z,y=+y,x=+x").split(","):
        axis, _, bound = part.partition("=")
        if axis not in WORLD_AXES or axis in out:
            raise ValueError(f"each of z, y and x must be bound once: {text!r}")
        if bound != "none":
            bound = bound if bound[:1] in "+-" else f"+{bound}"
            if bound[1:] not in SOURCE_AXES:
                raise ValueError(f"unknown source axis in {part!r}")
        out[axis] = bound
    used = [b[1:] for b in out.values() if b != "none"]
    if len(out) != 3 or len(set(used)) != len(used):
        raise ValueError(f"each of z, y and x must be bound once, each source axis at most once: {text!r}")
    return out


def normalize_calibration(value) -> dict[str, str]:
    """A calibration from text, a mapping or nothing (z=+z, y=+y, x=+x)."""
    if value is None:
        value = ""
    if not isinstance(value, str):
        value = ",".join(f"{k}={v}" for k, v in dict(value).items())
    return parse_calibration(value)


def format_calibration(value: dict[str, str]) -> str:
    return ",".join(f"{a}={value[a]}" for a in WORLD_AXES)
