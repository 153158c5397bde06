"""SHA-256 states of many messages at once, as numpy columns.

A digest in hexadecimal fills one 64-byte block, so a node over k children is
k blocks and one of padding.  Unlike the objects of hashlib, the state before
any block is a value here - eight words - that can be copied, kept in a table
and resumed in another task.  The round constants follow from their rule:
fractions of the cube and square roots of the first primes.
"""

from __future__ import annotations

import math

import numpy as np

BLOCK = 64
CHUNK = 4096                # messages advanced together, to stay in cache
U4 = np.uint32


def _primes(n: int) -> list[int]:
    found: list[int] = []
    at = 2
    while len(found) < n:
        if all(at % p for p in found):
            found.append(at)
        at += 1
    return found


def _cube_root(x: int) -> int:
    r = round(x ** (1 / 3))
    while r ** 3 > x:
        r -= 1
    while (r + 1) ** 3 <= x:
        r += 1
    return r


ROUND = np.array([_cube_root(p << 96) & 0xFFFFFFFF for p in _primes(64)], U4)
START = np.array([math.isqrt(p << 64) & 0xFFFFFFFF for p in _primes(8)], U4)
HEX = np.array([[ord(c) for c in f"{b:02x}"] for b in range(256)], np.uint8)


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> U4(n)) | (x << U4(32 - n))


def _schedule(words: np.ndarray) -> np.ndarray:
    """The 64 words of a round plan with the constants added; words: 16 x n."""
    w = np.empty((64, words.shape[1]), U4)
    w[:16] = words
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w[t] = w[t - 16] + w[t - 7] + (_turned(a, 7) ^ _turned(a, 18) ^ (a >> U4(3))) + (_turned(b, 17) ^ _turned(b, 19) ^ (b >> U4(10)))
    return w + ROUND[:, None]


def _rounds(state: np.ndarray, plan: np.ndarray) -> np.ndarray:
    """state: 8 x n; plan: 64 x n, or 64 x 1 for one block in all messages."""
    a, b, c, d, e, f, g, h = state
    for k in plan:
        one = h + (_turned(e, 6) ^ _turned(e, 11) ^ _turned(e, 25)) + (g ^ (e & (f ^ g))) + k
        two = (_turned(a, 2) ^ _turned(a, 13) ^ _turned(a, 22)) + ((a & b) | (c & (a | b)))
        h, g, f, e, d, c, b, a = g, f, e, d + one, c, b, a, one + two
    return np.stack((a, b, c, d, e, f, g, h)) + state


def begun(n: int) -> np.ndarray:
    """The state of n empty messages, one a row."""
    return np.broadcast_to(START, (n, 8)).copy()


def advanced(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """States (n x 8) after one more block each (n x 64 bytes)."""
    out = np.empty_like(state)
    for i in range(0, len(state), CHUNK):
        words = np.ascontiguousarray(blocks[i:i + CHUNK]).view(">u4").astype(U4).T
        out[i:i + CHUNK] = _rounds(np.ascontiguousarray(state[i:i + CHUNK].T), _schedule(words)).T
    return out


def _padding(blocks: np.ndarray) -> np.ndarray:
    """Last block of messages that are whole blocks long; one row a message."""
    pad = np.zeros((len(blocks), BLOCK), np.uint8)
    pad[:, 0] = 0x80
    pad[:, 56:] = (blocks.astype(np.uint64) * np.uint64(8 * BLOCK)).astype(">u8").view(np.uint8).reshape(-1, 8)
    return pad


def closed(state: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Digests (n x 32 bytes) of messages of so many blocks."""
    out = np.empty_like(state)
    for count in np.unique(blocks):
        rows = np.flatnonzero(blocks == count)
        plan = _schedule(_padding(np.array([count])).view(">u4").astype(U4).T)
        for i in range(0, len(rows), CHUNK):
            part = rows[i:i + CHUNK]
            out[part] = _rounds(np.ascontiguousarray(state[part].T), plan).T
    return np.ascontiguousarray(out.astype(">u4")).view(np.uint8).reshape(-1, 32)


def hexed(digests: np.ndarray) -> np.ndarray:
    """n x 32 bytes as n x 64 characters, each row one block."""
    return HEX[digests].reshape(-1, BLOCK)
