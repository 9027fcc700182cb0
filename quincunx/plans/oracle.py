"""SQL text that redraws the random numbers of table rows in a plain SQL engine."""

from __future__ import annotations

import math

from quincunx.sources.draws import BITS


def row_uniform(key: str, stream: int, seed: int, part: int = 0) -> str:
    digest = f"md5('{seed}:{stream}:' || ({key})::VARCHAR)"
    digits = f"substr({digest}, {1 + BITS // 4 * part}, {BITS // 4})"
    return f"((('0x' || {digits})::BIGINT::DOUBLE + 0.5) * {2.0**-BITS!r}::DOUBLE)"


def row_normal(key: str, stream: int, seed: int) -> str:
    radius = f"sqrt(-2 * ln({row_uniform(key, stream, seed)}))"
    return f"{radius} * cos(2 * {math.pi!r} * {row_uniform(key, stream, seed, 1)})"
