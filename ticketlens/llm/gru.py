"""A gated recurrent language model in numpy with a class-factored softmax.

Symbols are numbered by falling frequency and dealt into classes of ``WIDTH`` neighbours:
log p(symbol) = log p(class) + log p(symbol within class), so a step computes two short softmaxes.
Texts run side by side in streams. A stream keeps its state from window to window and starts
anew only where a text begins; gradients are cut at the window's start.
"""

from __future__ import annotations

import heapq

import numpy as np

HIDDEN, WIDTH, WINDOW = 8, 32, 32
NAMES = ("table", "inner", "inner_bias", "class_w", "class_b", "word_w", "word_b")
Model = dict[str, np.ndarray]


def new_model(counts: np.ndarray, seed: int = 3) -> Model:
    """A model whose first predictions are the symbols' frequencies. ``counts`` fall."""
    rng, n = np.random.default_rng(seed), len(counts)
    classes = -(-n // WIDTH)
    share = np.full(classes * WIDTH, 1e-30)
    share[:n] = (counts + 0.5) / (counts + 0.5).sum()
    share = share.reshape(classes, WIDTH)
    draw = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {
        "table": draw(n, 3 * HIDDEN), "inner": draw(HIDDEN, 3 * HIDDEN),
        "inner_bias": np.zeros(HIDDEN, np.float32),
        "class_w": draw(HIDDEN, classes), "class_b": np.log(share.sum(1)).astype(np.float32),
        "word_w": draw(classes, HIDDEN, WIDTH),
        "word_b": np.log(share / share.sum(1, keepdims=True)).astype(np.float32),
    }


def streams(texts: list[np.ndarray], most: int) -> list[list[int]]:
    """Text numbers of at most ``most`` streams of about equal length, longest first."""
    loads = [(0, i) for i in range(min(most, len(texts)))]
    out: list[list[int]] = [[] for _ in loads]
    for i in sorted(range(len(texts)), key=lambda i: (-len(texts[i]), i)):
        load, s = heapq.heappop(loads)
        out[s].append(i)
        heapq.heappush(loads, (load + len(texts[i]), s))
    return sorted(out, key=lambda s: -sum(len(texts[i]) for i in s))


def windows(texts: list[np.ndarray], most: int, start: int):
    """(input, target, text, fresh, live) per window: [steps, streams] arrays; ``start`` is
    the input before a text's first symbol, ``live`` the streams that have not ended."""
    if not texts:
        return
    rows = []
    for stream in streams(texts, most):
        owner = np.repeat(np.array(stream, np.int32), [len(texts[i]) for i in stream])
        rows.append((np.concatenate([texts[i] for i in stream]), owner))
    sizes = np.array([len(r[1]) for r in rows])
    last = np.full((2, len(rows)), -1)  # target and text of the step before
    for at in range(0, int(sizes.max(initial=0)), WINDOW):
        live = int((sizes > at).sum())
        steps = min(WINDOW, int(sizes[0]) - at)
        targets = np.full((steps + 1, live), -1)
        owners = np.full((steps + 1, live), -1)
        targets[0], owners[0] = last[:, :live]
        for s in range(live):
            n = min(steps, sizes[s] - at)
            targets[1 : n + 1, s] = rows[s][0][at : at + n]
            owners[1 : n + 1, s] = rows[s][1][at : at + n]
        last[:, :live] = targets[-1], owners[-1]
        fresh = owners[1:] != owners[:-1]
        inputs = np.where(fresh | (targets[:-1] < 0), start, targets[:-1])
        yield inputs, targets[1:], owners[1:], fresh, live


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def run_window(model: Model, state: np.ndarray, inputs: np.ndarray, fresh: np.ndarray, keep: bool):
    """States after each step and, with ``keep``, what the backward pass needs."""
    steps, h = len(inputs), HIDDEN
    drive = model["table"][inputs]
    states = np.empty((*inputs.shape, h), np.float32)
    saved = [] if keep else None
    for t in range(steps):
        if fresh[t].any():
            state = state * ~fresh[t][:, None]
        inner = state @ model["inner"]
        gates = _sigmoid(drive[t, :, : 2 * h] + inner[:, : 2 * h])
        q = inner[:, 2 * h :] + model["inner_bias"]
        z, r = gates[:, :h], gates[:, h:]
        new = np.tanh(drive[t, :, 2 * h :] + r * q)
        if keep:
            saved.append((state, z, r, q, new))
        state = new + z * (state - new)
        states[t] = state
    return state, states, saved


def _softmax(logits: np.ndarray):
    """Log-sums, and the probabilities as (overwritten) numerators and their sums."""
    top = logits.max()  # states stay within -1 and 1, so rows do not lie far apart
    logits -= top
    np.exp(logits, out=logits)
    total = logits @ np.ones((logits.shape[1], 1), logits.dtype)
    return (top + np.log(total))[:, 0], logits, total


def read_out(model: Model, states: np.ndarray, targets: np.ndarray, grads: Model | None = None):
    """Log-probabilities of ``targets`` and, with ``grads``, the gradient of their mean loss."""
    n = len(targets)
    classes = targets // WIDTH
    order = np.argsort(classes, kind="stable")
    states, targets, classes = states[order], targets[order], classes[order]
    here = np.arange(n)
    logits = states @ model["class_w"] + model["class_b"]
    picked = logits[here, classes]
    total, p, scale = _softmax(logits)
    logp = picked - total
    down = None
    if grads is not None:
        p /= scale
        p[here, classes] -= 1
        p /= n
        grads["class_w"] += states.T @ p
        grads["class_b"] += p.sum(0)
        down = p @ model["class_w"].T
    cuts = np.flatnonzero(np.diff(classes)) + 1
    for a, b in zip(np.append(0, cuts), np.append(cuts, n)):
        c, own = classes[a], states[a:b]
        logits = own @ model["word_w"][c] + model["word_b"][c]
        word = targets[a:b] - c * WIDTH
        at = np.arange(b - a)
        picked = logits[at, word]
        total, p, scale = _softmax(logits)
        logp[a:b] += picked - total
        if grads is not None:
            p /= scale
            p[at, word] -= 1
            p /= n
            grads["word_w"][c] += own.T @ p
            grads["word_b"][c] += p.sum(0)
            down[a:b] += p @ model["word_w"][c].T
    back = np.empty(n, np.int64)
    back[order] = here
    return logp[back], (None if down is None else down[back])


def backward(model: Model, grads: Model, saved: list, inputs: np.ndarray, fresh: np.ndarray, down: np.ndarray) -> None:
    """Gradients through the window's steps; none passes its start."""
    h = HIDDEN
    carry = np.zeros_like(down[0])
    deltas = np.empty((*inputs.shape, 3 * h), np.float32)
    inner = np.empty_like(deltas)
    for t in range(len(inputs) - 1, -1, -1):
        state, z, r, q, new = saved[t]
        d = down[t] + carry
        dz = d * (state - new) * z * (1 - z)
        dn = d * (1 - z) * (1 - new * new)
        dr = dn * q * r * (1 - r)
        deltas[t, :, :h], deltas[t, :, h : 2 * h], deltas[t, :, 2 * h :] = dz, dr, dn
        inner[t, :, : 2 * h] = deltas[t, :, : 2 * h]
        inner[t, :, 2 * h :] = dn * r
        carry = (d * z + inner[t] @ model["inner"].T) * ~fresh[t][:, None]
    states = np.concatenate([s[0] for s in saved])
    flat = inner.reshape(-1, 3 * h)
    grads["inner"] += states.T @ flat
    grads["inner_bias"] += flat[:, 2 * h :].sum(0)
    symbols = inputs.ravel()
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(symbols[order]) != 0))
    grads["table"][symbols[order][first]] += np.add.reduceat(deltas.reshape(-1, 3 * h)[order], first, 0)


def train(model: Model, texts: list[np.ndarray], start: int, most: int = 192, rate: float = 0.02) -> Model:
    """One pass of truncated backpropagation over ``texts`` with Adam."""
    model = {k: v.copy() for k, v in model.items()}
    m = {k: np.zeros_like(v) for k, v in model.items()}
    v2 = {k: np.zeros_like(v) for k, v in model.items()}
    state, step = np.zeros((0, HIDDEN), np.float32), 0
    for inputs, targets, _, fresh, live in windows(texts, most, start):
        state = state[:live] if len(state) else np.zeros((live, HIDDEN), np.float32)
        state, states, saved = run_window(model, state, inputs, fresh, True)
        mask = targets.ravel() >= 0
        grads = {k: np.zeros_like(x) for k, x in model.items()}
        _, down = read_out(model, states.reshape(-1, HIDDEN)[mask], targets.ravel()[mask], grads)
        whole = np.zeros((targets.size, HIDDEN), np.float32)
        whole[mask] = down
        backward(model, grads, saved, inputs, fresh, whole.reshape(*targets.shape, HIDDEN))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        step += 1
        for k, g in grads.items():
            if norm > 1:
                g = g / np.float32(norm)
            m[k] += np.float32(0.1) * (g - m[k])
            v2[k] += np.float32(0.01) * (g * g - v2[k])
            up = np.float32(rate / (1 - 0.9**step)) * m[k]
            model[k] -= up / (np.sqrt(v2[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return model


def log_likelihoods(model: Model, texts: list[np.ndarray], start: int, most: int = 512) -> np.ndarray:
    """Natural log-probability of each whole text."""
    out = np.zeros(len(texts))
    state = np.zeros((0, HIDDEN), np.float32)
    for inputs, targets, owner, fresh, live in windows(texts, most, start):
        state = state[:live] if len(state) else np.zeros((live, HIDDEN), np.float32)
        state, states, _ = run_window(model, state, inputs, fresh, False)
        mask = targets.ravel() >= 0
        logp, _ = read_out(model, states.reshape(-1, HIDDEN)[mask], targets.ravel()[mask])
        out += np.bincount(owner.ravel()[mask], logp, len(texts))
    return out
