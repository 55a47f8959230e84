"""A bidirectional LSTM over sequences of vectors, with one logit for each step, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def new_model(n_in: int, embed: int, hidden: int, seed: int) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    g = lambda a, b: (r.standard_normal((a, b)) / np.sqrt(a)).astype(np.float32)
    m = {"E": g(n_in, embed), "eb": np.zeros(embed, np.float32), "O": g(2 * hidden + embed, 1), "ob": np.zeros(1, np.float32)}
    for d in "fb":
        m["W" + d], m["U" + d], m["b" + d] = g(embed, 4 * hidden), g(hidden, 4 * hidden), np.zeros(4 * hidden, np.float32)
        m["b" + d][hidden : 2 * hidden] = 1  # forget gates begin open
    return m


def _run(m: dict, d: str, z: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
    """Hidden states of one direction; z is (steps, rows, embed). A masked step leaves the state as it was."""
    steps, rows, _ = z.shape
    size = m["U" + d].shape[0]
    h, c = np.zeros((rows, size), np.float32), np.zeros((rows, size), np.float32)
    out = np.zeros((steps, rows, size), np.float32)
    x = z @ m["W" + d] + m["b" + d]
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = x[t] + h @ m["U" + d]
        i, f, o = _sigmoid(a[:, :size]), _sigmoid(a[:, size : 2 * size]), _sigmoid(a[:, 2 * size : 3 * size])
        g = np.tanh(a[:, 3 * size :])
        k = mask[t][:, None]
        c1 = f * c + i * g
        tc = np.tanh(c1)
        if keep is not None:
            keep.append((t, h, c, i, f, o, g, tc, k))
        c = np.where(k, c1, c)
        h = np.where(k, o * tc, h)
        out[t] = h * k
    return out


def forward(m: dict, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
    """Logits (steps, rows) of x (steps, rows, inputs)."""
    z = np.tanh(x @ m["E"] + m["eb"])
    kf, kb = ([], []) if keep is not None else (None, None)
    hf, hb = _run(m, "f", z, mask, kf), _run(m, "b", z, mask, kb)
    y = np.concatenate([hf, hb, z], axis=2)
    if keep is not None:
        keep |= {"z": z, "y": y, "f": kf, "b": kb}
    return (y @ m["O"] + m["ob"])[:, :, 0]


def gradients(m: dict, x: np.ndarray, mask: np.ndarray, want: np.ndarray) -> tuple[dict, float]:
    """Gradient of the mean cross entropy over unmasked steps, and its value."""
    keep: dict = {}
    s = forward(m, x, mask, keep)
    p = _sigmoid(s)
    n = max(1, mask.sum())
    loss = float(-(np.where(want, np.log(p + 1e-7), np.log(1 - p + 1e-7)) * mask).sum() / n)
    ds = ((p - want) * mask / n).astype(np.float32)[:, :, None]
    g = {"O": np.einsum("tbi,tbj->ij", keep["y"], ds), "ob": ds.sum((0, 1))}
    dy = ds @ m["O"].T
    size = m["Uf"].shape[0]
    dz = dy[:, :, 2 * size :].copy()
    for d, at in (("f", 0), ("b", size)):
        gu, gw, gb = np.zeros_like(m["U" + d]), np.zeros_like(m["W" + d]), np.zeros_like(m["b" + d])
        dh, dc = np.zeros((x.shape[1], size), np.float32), np.zeros((x.shape[1], size), np.float32)
        for t, h0, c0, i, f, o, gg, tc, k in reversed(keep[d]):
            dh = dh + dy[t, :, at : at + size] * k
            a, ac = dh * k, dc * k
            ac = ac + a * o * (1 - tc**2)
            da = np.concatenate([ac * gg * i * (1 - i), ac * c0 * f * (1 - f), a * tc * o * (1 - o), ac * i * (1 - gg**2)], axis=1)
            gu += h0.T @ da
            gw += keep["z"][t].T @ da
            gb += da.sum(0)
            dz[t] += da @ m["W" + d].T
            dh = dh * ~k + da @ m["U" + d].T
            dc = dc * ~k + ac * f
        g["U" + d], g["W" + d], g["b" + d] = gu, gw, gb
    dz *= 1 - keep["z"] ** 2
    g["E"], g["eb"] = np.einsum("tbi,tbj->ij", x, dz), dz.sum((0, 1))
    return g, loss


def train(seqs: list[np.ndarray], labels: list[np.ndarray], embed: int = 32, hidden: int = 24, epochs: int = 12, batch: int = 32, rate: float = 0.01, seed: int = 5) -> dict[str, np.ndarray]:
    """Adam over batches of sequences of about equal length."""
    m = new_model(seqs[0].shape[1], embed, hidden, seed)
    r = np.random.default_rng(seed)
    first, second = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    order = np.argsort([len(s) for s in seqs], kind="stable")
    groups = [order[i : i + batch] for i in range(0, len(order), batch)]
    turn = 0
    for epoch in range(epochs):
        for k in r.permutation(len(groups)):
            x, mask = padded([seqs[i] for i in groups[k]])
            want = padded([labels[i][:, None] for i in groups[k]])[0][:, :, 0] > 0.5
            g, _ = gradients(m, x, mask, want)
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            turn += 1
            for n, v in g.items():
                v = v * min(1.0, 5.0 / (size + 1e-9))
                first[n] = 0.9 * first[n] + 0.1 * v
                second[n] = 0.999 * second[n] + 0.001 * v**2
                m[n] = (m[n] - rate * 0.85**epoch * (first[n] / (1 - 0.9**turn)) / (np.sqrt(second[n] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    return m


def padded(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(s) for s in seqs)
    x = np.zeros((steps, len(seqs), seqs[0].shape[1]), np.float32)
    mask = np.zeros((steps, len(seqs)), bool)
    for j, s in enumerate(seqs):
        x[: len(s), j] = s
        mask[: len(s), j] = True
    return x, mask


def predict(m: dict, seqs: list[np.ndarray], cells: int = 20_000) -> list[np.ndarray]:
    """Logits of each sequence; sequences of like length run together, about `cells` padded steps at a time."""
    out: list = [np.zeros(0, np.float32)] * len(seqs)
    order = [int(i) for i in np.argsort([len(s) for s in seqs], kind="stable") if len(seqs[i])]
    while order:
        take = max(1, min(len(order), cells // len(seqs[order[-1]])))
        group, order = order[-take:], order[:-take]
        x, mask = padded([seqs[i] for i in group])
        s = forward(m, x, mask)
        for j, i in enumerate(group):
            out[i] = s[: len(seqs[i]), j]
    return out
