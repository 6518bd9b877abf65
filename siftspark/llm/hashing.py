"""Multiprobe p-stable hashing of unit vectors, in NumPy."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import combinations

import numpy as np

_MIX = np.array([pow(1_000_003, i + 1, 1 << 61) - (1 << 60) for i in range(64)], dtype=np.int64)


@dataclass(frozen=True)
class Hashing:
    """``hashes`` projections of bucket width ``width`` in each of ``tables``; ``probes`` perturbed buckets besides the own one."""

    tables: int
    hashes: int
    width: float
    probes: int
    seed: int = 7


@lru_cache(maxsize=64)
def projections(dim: int, table: int, hashes: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian (2-stable) directions, orthogonal in blocks of ``dim``, which lowers their variance; offsets in [0, width)."""
    rng = np.random.default_rng([seed, table, hashes])
    rows = [np.linalg.qr(rng.standard_normal((dim, dim)))[0].T for _ in range(-(-hashes // dim))]
    return (np.concatenate(rows)[:hashes] * np.sqrt(dim)).astype(np.float32), rng.uniform(0, width, hashes).astype(np.float32)


@lru_cache(maxsize=16)
def _sets(hashes: int, most: int) -> list[np.ndarray]:
    """Sets of up to ``most`` perturbations; i lowers hash i, hashes + i raises it; never both of one hash."""
    out = []
    for size in range(1, min(most, hashes) + 1):
        rows = [s for s in combinations(range(2 * hashes), size) if len({i % hashes for i in s}) == size]
        out.append(np.array(rows, dtype=np.int64))
    return out


def bucket_keys(x: np.ndarray, table: int, h: Hashing) -> np.ndarray:
    """A row of ``1 + probes`` bucket keys for each vector: its own, then perturbed buckets by estimated success.

    The estimate is the sum of squared distances to the bounds that the perturbations cross, least first.
    """
    p, b = projections(x.shape[1], table, h.hashes, h.width, h.seed)
    f = (x @ p.T + b) / np.float32(h.width)
    low = np.floor(f)
    mix = _MIX[: h.hashes]
    own = low.astype(np.int64) @ mix
    if not h.probes:
        return own[:, None]
    r = f - low
    cost = np.concatenate([r * r, (1 - r) * (1 - r)], axis=1)
    step = np.concatenate([-mix, mix])
    sets = _sets(h.hashes, 3 if h.probes > 2 * h.hashes else 2)
    deltas = np.concatenate([step[s].sum(axis=1) for s in sets])
    out = np.empty((len(x), 1 + h.probes), dtype=np.int64)
    out[:, 0] = own
    probes = min(h.probes, len(deltas))
    for i in range(0, len(x), 4096):
        c = cost[i : i + 4096]
        d = np.concatenate([sum(c[:, s[:, j]] for j in range(s.shape[1])) for s in sets], axis=1)
        best = np.argpartition(d, probes - 1, axis=1)[:, :probes]
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(d, best, axis=1), axis=1), axis=1)
        out[i : i + 4096, 1 : 1 + probes] = own[i : i + 4096, None] + deltas[best]
    return out[:, : 1 + probes]


def exact_cosines(x: np.ndarray, norms: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of rows a with rows b, summed in double and always in one order, rounded to 12 digits."""
    out = np.empty(len(a))
    for i in range(0, len(a), 65536):
        p, q = a[i : i + 65536], b[i : i + 65536]
        out[i : i + 65536] = np.einsum("ij,ij->i", x[p].astype(np.float64), x[q].astype(np.float64)) / (norms[p] * norms[q])
    return out.round(12)


def candidate_blocks(x: np.ndarray, h: Hashing, floor: float, queries: np.ndarray | None = None):
    """Yield (a, b): index arrays of pairs whose single-precision cosine reaches ``floor``.

    Every query visits its bucket and the perturbed ones in each table; each bucket's visitors are
    compared with its rows by one matrix product. Pairs come repeatedly and in either direction.
    """
    n = len(x)
    queries = np.arange(n) if queries is None else queries
    for t in range(h.tables):
        own = bucket_keys(x, t, replace(h, probes=0))[:, 0]
        order = np.argsort(own, kind="stable")
        held, start = np.unique(own[order], return_index=True)
        end = np.append(start[1:], n)
        visits = bucket_keys(x[queries], t, h)
        at = np.searchsorted(held, visits.ravel())
        at[at == len(held)] = 0
        hit = held[at] == visits.ravel()
        who = np.repeat(queries, visits.shape[1])[hit]
        at = at[hit]
        by = np.argsort(at, kind="stable")
        who, at = who[by], at[by]
        edge = np.flatnonzero(np.diff(at)) + 1
        for s, e in zip(np.append(0, edge), np.append(edge, len(at))):
            if s == e:
                continue
            bucket = at[s]
            rows = order[start[bucket] : end[bucket]]
            right = x[rows].T
            size = max(1, 4_000_000 // len(rows))
            for i in range(s, e, size):
                q = who[i : min(e, i + size)]
                sim = x[q] @ right
                f = np.flatnonzero(sim.ravel() >= floor)
                a, b = q[f // len(rows)], rows[f % len(rows)]
                keep = a != b
                if keep.any():
                    yield a[keep], b[keep]
