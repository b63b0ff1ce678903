"""Integer arrays as byte planes, so that sorted keys compress well in shuffle files."""

from __future__ import annotations

import numpy as np


def pack(values: np.ndarray, low: int, high: int) -> bytes:
    """Bytes low..high-1 (0 is the least significant) of each number, plane by plane."""
    planes = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return planes[:, low:high].T.tobytes()


def unpack(blob: bytes, low: int, high: int) -> np.ndarray:
    planes = np.frombuffer(blob, dtype=np.uint8).reshape(high - low, -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, low:high] = planes.T
    return out.reshape(-1).view("<u8")
