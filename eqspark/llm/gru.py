"""A gated recurrent layer in numpy: forward for training with its backward, and a lean forward for scoring."""

from __future__ import annotations

import math

import numpy as np


def forward(xg: np.ndarray, h: np.ndarray, u: np.ndarray, keep: np.ndarray | None = None):
    """States (T, B, H) for input projections ``xg`` (T, B, 3H: reset, update, candidate) from state ``h``.

    ``keep`` (T, B, 1) is 0 where a lane starts anew. Returns the states and what backward needs.
    """
    steps, lanes, width = xg.shape
    k = width // 3
    out = np.empty((steps, lanes, k), xg.dtype)
    cache = []
    for t in range(steps):
        if keep is not None:
            h = h * keep[t]
        hu = h @ u
        rz = 1 / (1 + np.exp(-(xg[t, :, : 2 * k] + hu[:, : 2 * k])))
        r, z = rz[:, :k], rz[:, k:]
        n = np.tanh(xg[t, :, 2 * k :] + r * hu[:, 2 * k :])
        cache.append((h, r, z, n, hu[:, 2 * k :]))
        h = n + z * (h - n)
        out[t] = h
    return out, cache


def backward(dout: np.ndarray, cache: list, u: np.ndarray, keep: np.ndarray | None = None):
    """Gradients of ``xg`` and ``u``; the gradient is cut at the window's start (truncated)."""
    steps, lanes, k = dout.shape
    dxg = np.empty((steps, lanes, 3 * k), dout.dtype)
    gates = np.empty_like(dxg)
    before = np.empty_like(dout)
    back = np.ascontiguousarray(u.T)
    dh = np.zeros((lanes, k), dout.dtype)
    for t in range(steps - 1, -1, -1):
        h, r, z, n, hn = cache[t]
        before[t] = h
        dh = dh + dout[t]
        new = dh * (1 - z)
        dn = new * (1 - n * n)
        g = gates[t]
        np.multiply(dn * hn, r * (1 - r), out=g[:, :k])
        np.multiply(new * z, h - n, out=g[:, k : 2 * k])
        dxg[t, :, : 2 * k] = g[:, : 2 * k]
        dxg[t, :, 2 * k :] = dn
        np.multiply(dn, r, out=g[:, 2 * k :])
        dh = dh * z + g @ back
        if keep is not None:
            dh = dh * keep[t]
    return dxg, before.reshape(-1, k).T @ gates.reshape(-1, 3 * k)


def halved(w: np.ndarray) -> np.ndarray:
    """Weights for ``step``: gates by tanh of half their input."""
    w = w.copy()
    w[..., : 2 * (w.shape[-1] // 3)] *= 0.5
    return np.ascontiguousarray(w, np.float32)


def step(xg: np.ndarray, h: np.ndarray, u: np.ndarray) -> np.ndarray:
    """One scoring step with ``halved`` weights; ``xg`` is overwritten."""
    k = h.shape[1]
    hu = h @ u
    gates, n = xg[:, : 2 * k], xg[:, 2 * k :]
    gates += hu[:, : 2 * k]
    np.tanh(gates, out=gates)
    gates += 1
    gates *= 0.5
    n += gates[:, :k] * hu[:, 2 * k :]
    np.tanh(n, out=n)
    out = h - n
    out *= gates[:, k:]
    out += n
    return out


def gatewise(w: np.ndarray) -> np.ndarray:
    """Weights (..., 3H) as (3, ..., H), gate by gate; reset and update are negated, as ``_advance`` takes their exponent."""
    parts = np.stack(np.split(np.asarray(w, np.float32), 3, axis=-1))
    np.negative(parts[:2], out=parts[:2])
    return parts


def _advance(xg: np.ndarray, before: np.ndarray, u: np.ndarray, hu: np.ndarray, gates: np.ndarray, n: np.ndarray, out: np.ndarray) -> None:
    """One step with ``gatewise`` weights: every array lies gate by gate, so that each operation runs over one stretch of memory. The last four are written."""
    np.matmul(before, u, out=hu)
    np.add(xg[:2], hu[:2], out=gates)
    np.exp(gates, out=gates)
    gates += 1
    np.reciprocal(gates, out=gates)
    np.multiply(gates[0], hu[2], out=n)
    n += xg[2]
    np.tanh(n, out=n)
    np.subtract(before, n, out=out)
    out *= gates[1]
    out += n


class Layer:
    """The layer over windows of at most ``steps`` steps of ``lanes`` lanes, whose inputs are rows of a table. Every window takes the same rooms: memory that is new in each costs as much as the arithmetic.

    Without ``learns`` only the states of a window are kept.
    """

    def __init__(self, steps: int, lanes: int, width: int, learns: bool):
        kept = steps if learns else 1
        room = lambda *shape: np.empty((*shape, lanes * width), np.float32)
        self.width, self.learns = width, learns
        self.states, self.before, self.xg, self.hu, self.gates, self.n = room(steps), room(kept), room(kept, 3), room(kept, 3), room(kept, 2), room(kept)
        if learns:
            self.d, self.back, self.some = room(4, steps), room(3), room(4)

    def forward(self, table: np.ndarray, x: np.ndarray, h: np.ndarray, u: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """States (T, B, H) for the inputs ``x`` (T, B), rows of ``table``, from state ``h``; a lane starts anew where ``begin``. Table and ``u`` are ``gatewise``. The next window overwrites the states."""
        (steps, lanes), k = x.shape, self.width
        part = lambda room: room.reshape(*room.shape[:-1], -1, k)[..., :lanes, :]
        states, before, xg, hu, gates, n = (part(r) for r in (self.states, self.before, self.xg, self.hu, self.gates, self.n))
        rows, gate, fresh = table.reshape(-1, k), (np.arange(3) * table.shape[1])[:, None], begin.any(axis=1)
        with np.errstate(over="ignore"):  # a gate whose exponent is infinite is shut
            for t in range(steps):
                i = t if self.learns else 0
                np.copyto(before[i], h)
                if fresh[t]:
                    before[i][begin[t]] = 0
                xg[i] = rows.take(x[t] + gate, axis=0, mode="clip")
                _advance(xg[i], before[i], u, hu[i], gates[i], n[i], states[t])
                h = states[t]
        return states[:steps]

    def backward(self, dout: np.ndarray, u: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the inputs (3, T, B, H: candidate, reset, update) and of ``u`` (H, 3H), whose weights ``u`` are given plain; all lanes, after ``forward``."""
        steps, lanes, k = dout.shape
        shaped = lambda room: room.reshape(*room.shape[:-1], lanes, k)
        before, hu, gates, states, n, d, back, some = (shaped(r) for r in (self.before, self.hu, self.gates, self.states, self.n, self.d, self.back, self.some))
        turned = np.stack([x.T for x in np.split(u, 3, axis=1)])
        new, rest, dh, slope = some
        dh[:] = 0
        fresh = begin.any(axis=1)
        for t in range(steps - 1, -1, -1):
            (r, z), own, hn, (dn, dr, dz, dhn) = gates[t], n[t], hu[t, 2], d[:, t]
            dh += dout[t]
            np.multiply(dh, z, out=rest)
            np.subtract(dh, rest, out=new)
            np.multiply(own, own, out=slope)
            np.subtract(1, slope, out=slope)
            np.multiply(new, slope, out=dn)
            np.multiply(dn, r, out=dhn)
            np.multiply(dhn, hn, out=dr)
            np.multiply(dr, r, out=slope)
            dr -= slope
            np.subtract(states[t], own, out=dz)  # this is z (h - n)
            dz *= new
            np.matmul(d[1:, t], turned, out=back)
            np.add(rest, back[0], out=dh)
            dh += back[1]
            dh += back[2]
            if fresh[t]:
                dh[begin[t]] = 0
        was = before[:steps].reshape(-1, k).T
        return d[:3, :steps], np.concatenate([was @ d[i, :steps].reshape(-1, k) for i in (1, 2, 3)], axis=1)


class Adam:
    """Adam with gradient clipping by global norm."""

    def __init__(self, params: dict[str, np.ndarray], rate: float, clip: float = 5.0, decay: float = 0.0):
        self.params, self.rate, self.clip, self.decay, self.t = params, rate, clip, decay, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        if not self.decay:
            return self._update(grads)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, self.clip / max(norm, 1e-12))
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8) + self.rate * self.decay * self.params[k]).astype(self.params[k].dtype)

    def _update(self, grads: dict[str, np.ndarray]) -> None:
        """Without decay: in the parameters' own precision and, as far as it goes, in their place."""
        norm = math.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        scale = min(1.0, self.clip / max(norm, 1e-12))
        rate = self.rate * math.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            m, v, room = self.m[k], self.v[k], np.multiply(g, 0.1 * scale)
            m *= 0.9
            m += room
            np.multiply(g, g, out=room)
            room *= 0.001 * scale * scale
            v *= 0.999
            v += room
            np.sqrt(v, out=room)
            room += 1e-8
            np.divide(m, room, out=room)
            room *= rate
            self.params[k] -= room
