"""Settings: nested dictionaries of the driver."""

from __future__ import annotations


def merged(base: dict, over: dict) -> dict:
    """``base`` with the values of ``over``; dictionaries on both sides are merged, anything else gives way."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
