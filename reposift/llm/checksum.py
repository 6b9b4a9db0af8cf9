"""CRC-32 in DuckDB SQL, which has no function for it, and of many words at once."""

from __future__ import annotations

import zlib

import numpy as np

#: The reversed polynomial of the CRC-32 that zlib and Spark compute.
POLYNOMIAL = 0xEDB88320
#: Bytes of a span that is worked on together with others.
SHORT = 64

#: A common table expression for crc().
CRC_TABLE = f"""crc_table AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END, n) ORDER BY n) AS steps FROM range(256) AS r(n))"""


def crc(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of code points below 256 (as UTF-8); select it from CRC_TABLE too."""
    codes = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + unicode(c) // 64, 128 + unicode(c) % 64] END))"
    return f"xor(list_reduce({codes}, lambda s, b: xor(steps[(xor(s, b) & 255) + 1], s >> 8), 4294967295::BIGINT), 4294967295::BIGINT)"


def _steps() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(POLYNOMIAL), out >> np.uint32(1))
    return out


_STEPS = _steps()


def continued(state: np.ndarray, raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """zlib.crc32(raw[start:start + length], state) of many spans: one pass over all spans for each further byte of the short ones."""
    out = state.astype(np.uint32)
    for k in np.flatnonzero(length > SHORT).tolist():
        out[k] = zlib.crc32(raw[start[k] : start[k] + length[k]], int(out[k]))
    order = np.flatnonzero(length <= SHORT)
    order = order[np.argsort(-length[order], kind="stable")]
    start, falling, own = start[order], -length[order], ~out[order]
    for k in range(-int(falling[0]) if len(order) else 0):
        n = int(np.searchsorted(falling, -k, "left"))
        part = own[:n]
        own[:n] = _STEPS[(part ^ raw[start[:n] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out[order] = ~own
    return out
