"""EIP-55 checksum spelling of addresses (Keccak-256 over whole Arrow batches)."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_RATE = 136
_ROUNDS = 24


def _round_constants() -> list[int]:
    """Round constants from the degree-8 feedback register of the Keccak specification."""
    constants, state = [], 1
    for _ in range(_ROUNDS):
        constant = 0
        for j in range(7):
            if state & 1:
                constant |= 1 << ((1 << j) - 1)
            state <<= 1
            if state & 0x100:
                state ^= 0x171
        constants.append(constant)
    return constants


def _lane_walk() -> list[tuple[int, int, int]]:
    """(x, y, rotation) in the order the rho and pi steps visit the lanes."""
    walk, x, y = [], 1, 0
    for t in range(_ROUNDS):
        walk.append((x, y, (t + 1) * (t + 2) // 2 % 64))
        x, y = y, (2 * x + 3 * y) % 5
    return walk


def _rotate(lane: np.ndarray, by: int) -> np.ndarray:
    if by == 0:
        return lane
    return (lane << np.uint64(by)) | (lane >> np.uint64(64 - by))


def _permute(lanes: np.ndarray) -> np.ndarray:
    """Keccak-f[1600] on an array of shape (5, 5, rows), indexed [x, y]."""
    walk = _lane_walk()
    for constant in _round_constants():
        parity = np.bitwise_xor.reduce(lanes, axis=1)
        mixed = np.roll(parity, 1, axis=0) ^ _rotate(np.roll(parity, -1, axis=0), 1)
        lanes = lanes ^ mixed[:, None, :]
        moved = np.empty_like(lanes)
        moved[0, 0] = lanes[0, 0]
        for x, y, rotation in walk:
            moved[y, (2 * x + 3 * y) % 5] = _rotate(lanes[x, y], rotation)
        lanes = moved ^ (~np.roll(moved, -1, axis=0) & np.roll(moved, -2, axis=0))
        lanes[0, 0] ^= np.uint64(constant)
    return lanes


def keccak256_single_block(messages: np.ndarray) -> np.ndarray:
    """Digests of equal-length messages (rows of bytes, shorter than one block)."""
    rows, length = messages.shape
    block = np.zeros((rows, _RATE), dtype=np.uint8)
    block[:, :length] = messages
    block[:, length] ^= 0x01
    block[:, -1] ^= 0x80
    words = block.view("<u8").T
    lanes = np.zeros((5, 5, rows), dtype=np.uint64)
    for index in range(_RATE // 8):
        lanes[index % 5, index // 5] = words[index]
    lanes = _permute(lanes)
    digest = np.ascontiguousarray(np.stack([lanes[i, 0] for i in range(4)], axis=1))
    return digest.astype("<u8").view(np.uint8).reshape(rows, 32)


@F.pandas_udf(T.StringType())
def _checksum(keys: pd.Series) -> pd.Series:
    """Checksum form of lower-case '0x' addresses."""
    if len(keys) == 0:
        return keys
    letters = np.frombuffer("".join(k[2:] for k in keys).encode("ascii"), dtype=np.uint8).reshape(-1, 40)
    digest = keccak256_single_block(letters)
    nibbles = np.stack([digest >> 4, digest & 15], axis=2).reshape(len(keys), 64)[:, :40]
    raised = (letters >= ord("a")) & (nibbles >= 8)
    spelled = np.where(raised, letters - 32, letters).astype(np.uint8)
    text = spelled.tobytes().decode("ascii")
    return pd.Series(["0x" + text[i : i + 40] for i in range(0, len(text), 40)], index=keys.index)


def checksum_address(key: Column) -> Column:
    """Display form of a normalised address; other text is returned unchanged."""
    is_address = key.rlike("^0x[0-9a-f]{40}$")
    # The function sees a valid address in every row; the result counts only where the key is one.
    safe = F.when(is_address, key).otherwise(F.lit("0x" + "0" * 40))
    return F.when(is_address, _checksum(safe)).otherwise(key)
