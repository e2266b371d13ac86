"""A bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, and Adam.

Arrays of gates have the axes (direction, gate, ...) with gates update, reset, candidate; direction 1 reads the
sequence from its end. State: h' = n + z (h - n), n = tanh(x_n + r (h U_n + b_n)).
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def init_recurrent(rng: np.random.Generator, hidden: int) -> Params:
    return {"U": (rng.standard_normal((2, 3, hidden, hidden)) / np.sqrt(hidden)).astype(np.float32), "bn": np.zeros((2, 1, hidden), np.float32)}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(x: np.ndarray, p: Params) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """States (steps + 1, direction, batch, hidden) for gate inputs x (steps, direction, gate, batch, hidden), in reading order."""
    steps, _, _, batch, hidden = x.shape
    h = np.zeros((steps + 1, 2, batch, hidden), x.dtype)
    z, r, n, q = (np.empty((steps, 2, batch, hidden), x.dtype) for _ in range(4))
    for t in range(steps):
        now = h[t]
        z[t] = _sigmoid(x[t, :, 0] + now @ p["U"][:, 0])
        r[t] = _sigmoid(x[t, :, 1] + now @ p["U"][:, 1])
        q[t] = now @ p["U"][:, 2] + p["bn"]
        n[t] = np.tanh(x[t, :, 2] + r[t] * q[t])
        h[t + 1] = n[t] + z[t] * (now - n[t])
    return h, {"z": z, "r": r, "n": n, "q": q}


def backward(dh: np.ndarray, h: np.ndarray, kept: dict[str, np.ndarray], p: Params) -> tuple[np.ndarray, Params]:
    """Gradients of the gate inputs and the recurrent parameters, from those of the states after each step."""
    z, r, n, q = kept["z"], kept["r"], kept["n"], kept["q"]
    steps, _, batch, hidden = dh.shape
    dx = np.empty((steps, 2, 3, batch, hidden), h.dtype)
    dq = np.empty((steps, 2, batch, hidden), h.dtype)
    back = p["U"].transpose(0, 1, 3, 2)
    carry = np.zeros((2, batch, hidden), h.dtype)
    for t in range(steps - 1, -1, -1):
        d = dh[t] + carry
        dn = d * (1 - z[t]) * (1 - n[t] ** 2)
        dz = d * (h[t] - n[t]) * z[t] * (1 - z[t])
        dr = dn * q[t] * r[t] * (1 - r[t])
        dq[t] = dn * r[t]
        dx[t, :, 0], dx[t, :, 1], dx[t, :, 2] = dz, dr, dn
        carry = d * z[t] + dz @ back[:, 0] + dr @ back[:, 1] + dq[t] @ back[:, 2]
    before = h[:-1].transpose(1, 3, 0, 2).reshape(2, hidden, -1)
    flat = lambda a: a.transpose(1, 0, 2, 3).reshape(2, -1, hidden)
    du = np.stack([before @ flat(dx[:, :, 0]), before @ flat(dx[:, :, 1]), before @ flat(dq)], 1)
    return dx, {"U": du, "bn": dq.sum((0, 2))[:, None, :]}


def both_ways(h: np.ndarray) -> np.ndarray:
    """States of both directions at every position: (positions, batch, 2 hidden)."""
    return np.concatenate([h[1:, 0], h[:0:-1, 1]], -1)


def split_ways(d: np.ndarray) -> np.ndarray:
    """The inverse of ``both_ways`` for gradients, in reading order."""
    hidden = d.shape[-1] // 2
    return np.stack([d[..., :hidden], d[::-1, :, hidden:]], 1)


class Runner:
    """The forward pass for scoring: gate inputs are rows of tables, and buffers are used again and again."""

    def __init__(self, p: Params, steps: int, batch: int):
        hidden = p["U"].shape[-1]
        self.half = np.float32(0.5)
        self.uz, self.ur, self.un = p["U"][:, 0] * self.half, p["U"][:, 1] * self.half, np.ascontiguousarray(p["U"][:, 2])
        self.bn = p["bn"]
        self.states = np.zeros((steps + 1, 2, batch, hidden), np.float32)
        self.z, self.r, self.n, self.a = (np.empty((2, batch, hidden), np.float32) for _ in range(4))
        self.steps = steps

    def run(self, tables: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """States for ``rows`` (steps, batch), row numbers of ``tables`` (direction, gate, rows, hidden)
        whose update and reset inputs are halved."""
        z, r, n, a, half = self.z, self.r, self.n, self.a, self.half
        for t in range(self.steps):
            h, out = self.states[t], self.states[t + 1]
            for way, at in ((0, rows[t]), (1, rows[self.steps - 1 - t])):
                np.take(tables[way, 0], at, 0, z[way], "clip")
                np.take(tables[way, 1], at, 0, r[way], "clip")
                np.take(tables[way, 2], at, 0, n[way], "clip")
            z += np.matmul(h, self.uz, out=a)
            np.tanh(z, out=z)
            z *= half
            z += half
            r += np.matmul(h, self.ur, out=a)
            np.tanh(r, out=r)
            r *= half
            r += half
            np.matmul(h, self.un, out=a)
            a += self.bn
            r *= a
            n += r
            np.tanh(n, out=n)
            np.subtract(h, n, out=out)
            out *= z
            out += n
        return self.states


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.step = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def update(self, grads: Params) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            m, v = self.m[k] / (1 - 0.9**self.step), self.v[k] / (1 - 0.999**self.step)
            self.params[k] -= (self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
