"""A small bidirectional gated recurrent network over bytes, trained in numpy.

The network reads a text in patches of a few bytes, from both ends, and gives a class distribution for
every position (all bytes of a patch share the states, so they share the label). Training is by
backpropagation through time with Adam.
"""

from __future__ import annotations

import numpy as np

#: Bytes read in one step, and units per direction.
PATCH, UNITS = 4, 24


def patches(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(steps, texts, PATCH) bytes, padded with zeros, and the number of patches of each text."""
    lengths = np.fromiter((max(1, -(-len(t) // PATCH)) for t in texts), np.int64, len(texts))
    width = int(lengths.max()) * PATCH
    raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8)
    return raw.reshape(len(texts), -1, PATCH).transpose(1, 0, 2), lengths


class Network:
    """``w``: in (2, PATCH, 256, 3U) the bytes' contributions to update, reset and candidate; ``u``
    (2, U, 3U) the states'; ``b`` (2, 3U); ``v`` (2U, classes), ``c`` (classes). Direction 0 reads
    forwards, 1 backwards."""

    def __init__(self, classes: int, seed: int = 7, units: int = UNITS):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.units = units
        self.p = {
            "w": (rng.standard_normal((2, PATCH, 256, 3 * units)) * 0.25).astype(f),
            "u": np.stack(
                [np.concatenate(
                    [np.linalg.qr(rng.standard_normal((units, units)))[0] for _ in range(3)],
                    1,
                ) for _ in range(2)]
            ).astype(f),
            "b": np.zeros((2, 1, 3 * units), f),
            "v": (rng.standard_normal((2 * units, classes)) * 0.2).astype(f),
            "c": np.zeros(classes, f),
        }

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        """(2, steps, texts, 3U): what the bytes contribute in either direction's own order."""
        w = self.p["w"]
        out = np.empty((2, *x.shape[:2], 3 * self.units), np.float32)
        for d, order in ((0, x), (1, x[::-1])):
            np.take(w[d, 0], order[..., 0], axis=0, out=out[d], mode="clip")
            for k in range(1, PATCH):
                out[d] += np.take(w[d, k], order[..., k], axis=0, mode="clip")
            out[d] += self.p["b"][d]
        return out

    def states(self, x: np.ndarray, lengths: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """(steps, texts, 2U) states of every position. Padding keeps the state as it is: the texts
        end at their own lengths, and backwards begin there."""
        steps, n, units = x.shape[0], x.shape[1], self.units
        inputs, u = self._inputs(x), self.p["u"]
        h = np.zeros((2, n, units), np.float32)
        out = np.empty((steps, n, 2 * units), np.float32)
        tape = []
        whole = lengths.min() == steps
        half = np.float32(0.5)
        for t in range(steps):
            a = np.matmul(h, u)
            zr = inputs[:, t, :, : 2 * units] + a[:, :, : 2 * units]
            zr *= half
            np.tanh(zr, out=zr)  # logistic function by tanh
            zr += 1
            zr *= half
            z, r = zr[:, :, :units], zr[:, :, units:]
            hn = a[:, :, 2 * units :]
            g = np.tanh(inputs[:, t, :, 2 * units :] + r * hn)
            if not whole:
                z = z * np.stack([t < lengths, steps - 1 - t < lengths])[:, :, None]
            new = h + z * (g - h)
            if keep:
                tape.append((h, z, r, g, hn))
            h = new
            out[t, :, :units] = h[0]
            out[steps - 1 - t, :, units:] = h[1]
        return out, tape

    def _read(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The same states as ``states`` gives, without what training needs: every step works in place."""
        steps, n, units = x.shape[0], x.shape[1], self.units
        inputs, u, half = self._inputs(x), self.p["u"], np.float32(0.5)
        h, a = np.zeros((2, n, units), np.float32), np.empty((2, n, 3 * units), np.float32)
        zr, g = np.empty((2, n, 2 * units), np.float32), np.empty((2, n, units), np.float32)
        z, r, ahead, beyond = zr[:, :, :units], zr[:, :, units:], a[:, :, : 2 * units], a[:, :, 2 * units :]
        out = np.empty((steps, n, 2 * units), np.float32)
        whole = lengths.min() == steps
        for t in range(steps):
            np.matmul(h, u, out=a)
            np.add(inputs[:, t, :, : 2 * units], ahead, out=zr)
            zr *= half
            np.tanh(zr, out=zr)  # logistic function by tanh
            zr *= half
            zr += half
            np.multiply(r, beyond, out=g)
            g += inputs[:, t, :, 2 * units :]
            np.tanh(g, out=g)
            g -= h
            g *= z
            if not whole:
                g *= np.stack([t < lengths, steps - 1 - t < lengths])[:, :, None]
            h += g
            out[t, :, :units] = h[0]
            out[steps - 1 - t, :, units:] = h[1]
        return out

    def probabilities(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(steps, texts, classes): the class distribution of every position."""
        out = self._read(x, lengths) @ self.p["v"]
        out += self.p["c"]
        out -= out.max(-1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(-1, keepdims=True)
        return out

    def gradients(self, x: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients; ``target`` (texts, classes) holds for every position of its text."""
        steps, n, units = x.shape[0], x.shape[1], self.units
        out, tape = self.states(x, lengths, keep=True)
        logits = out @ self.p["v"] + self.p["c"]
        logits -= logits.max(-1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(-1, keepdims=True)
        live = (np.arange(steps)[:, None] < lengths) / lengths / n
        loss = float(-(np.log(np.maximum((p * target).sum(-1), 1e-9)) * live).sum())
        d_logits = ((p - target) * live[:, :, None]).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = d_logits.reshape(-1, d_logits.shape[-1])
        grads["v"], grads["c"] = out.reshape(-1, 2 * units).T @ flat, flat.sum(0)
        d_out = d_logits @ self.p["v"].T
        u = self.p["u"]
        dh = np.zeros((2, n, units), np.float32)
        da_all = np.empty((2, steps, n, 3 * units), np.float32)
        for t in range(steps - 1, -1, -1):
            h, z, r, g, hn = tape[t]
            dh[0] += d_out[t, :, :units]
            dh[1] += d_out[steps - 1 - t, :, units:]
            dg = dh * z * (1 - g * g)
            dz = dh * (g - h) * z * (1 - z)
            dr = dg * hn * r * (1 - r)
            da = np.concatenate([dz, dr, dg * r], 2)
            grads["u"] += np.matmul(h.transpose(0, 2, 1), da)
            dh = dh * (1 - z) + np.matmul(da, u.transpose(0, 2, 1))
            da_all[:, t, :, : 2 * units], da_all[:, t, :, 2 * units :] = da[:, :, : 2 * units], dg
        grads["b"] = da_all.sum((1, 2))[:, None, :]
        rows = da_all.reshape(2, -1, 3 * units)
        for d, order in ((0, x), (1, x[::-1])):
            for k in range(PATCH):
                # Sums by byte: sort the rows by byte, then add up runs.
                byte = order[..., k].ravel()
                at = np.argsort(byte, kind="stable")
                values, first = np.unique(byte[at], return_index=True)
                grads["w"][d, k, values] = np.add.reduceat(rows[d][at], first, axis=0)
        return loss, grads


def train(network: Network, batches, rate: float = 0.01, warm: int = 30) -> list[float]:
    """Adam over an iterable of (x, lengths, target, share of training done); gives the losses."""
    first = {k: np.zeros_like(v) for k, v in network.p.items()}
    second = {k: np.zeros_like(v) for k, v in network.p.items()}
    losses = []
    for step, (x, lengths, target, done) in enumerate(batches, 1):
        loss, grads = network.gradients(x, lengths, target)
        losses.append(loss)
        norm = float(np.sqrt(sum((g * g).sum() for g in grads.values())))
        scale = min(1.0, 1.0 / max(norm, 1e-9))
        now = rate * min(1.0, step / warm) * (1 - 0.95 * done)
        for k, g in grads.items():
            g = g * scale
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            network.p[k] -= (
                now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            ).astype(np.float32)
    return losses
