"""A gated recurrent language model in numpy with a class-factored output.

The unit is the minimal gated one (minGRU): the state moves from what it was to a candidate by the share that a gate
gives, and gate and candidate depend on the input symbol.  So all but that step is computed for whole windows at once.

Symbol 0 ends a document (and, as input, starts one with a zero state), the others stand for words or kinds of
words, roughly the most frequent first.  The output is P(class | state) times P(symbol | class, state); classes are
runs of consecutive symbols whose sizes grow geometrically, so frequent symbols sit in small classes and most
tokens need few of the weights.  Output weights carry their bias as a last column.
"""

from __future__ import annotations

import numpy as np

HIDDEN = 24
VOCABULARY = 1 << 13
CLASSES = 64
#: Each class is so many times as large as the one before.
GROWTH = 1.05
BOUNDS = np.round(VOCABULARY * (GROWTH ** np.arange(CLASSES + 1) - 1) / (GROWTH**CLASSES - 1)).astype(np.int64)
CLASS_OF = np.repeat(np.arange(CLASSES, dtype=np.int16), np.diff(BOUNDS))
#: Documents side by side at most, and steps of truncated backpropagation, while training.
LANES = 1024
WINDOW = 16
#: Updates that a pass should have: shorter streams get fewer lanes, but no fewer than ``LEAST_LANES``.
UPDATES = 160
LEAST_LANES = 8
RATE = 0.02
CLIP = 1.0
#: The same while scoring.
SCORE_LANES = 1024
SCORE_WINDOW = 32

#: Logits up to this size neither overflow nor vanish in single precision.
LARGE_LOGIT = 60.0

Model = dict[str, np.ndarray]
SHAPES = {"class": (CLASSES, HIDDEN + 1), "input": (VOCABULARY, 2 * HIDDEN), "word": (VOCABULARY, HIDDEN + 1)}


def initial(log_frequency: np.ndarray, seed: int = 0) -> Model:
    """Weights that start as the unigram model of the given log frequencies."""
    rng = np.random.default_rng(seed)
    m = {k: np.zeros(s, np.float32) for k, s in SHAPES.items()}
    m["input"][:] = rng.normal(0, 0.5, SHAPES["input"])
    # gates start from short to long memory
    m["input"][:, :HIDDEN] += np.linspace(-3, 2, HIDDEN)
    mass = np.log(np.add.reduceat(np.exp(log_frequency.astype(np.float64)), BOUNDS[:-1]))
    m["class"][:, -1] = mass
    m["word"][:, -1] = log_frequency - mass[CLASS_OF]
    return m


def _gates(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gates and candidates of input rows."""
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-rows[..., :HIDDEN])), np.tanh(rows[..., HIDDEN:])


def _run(z: np.ndarray, new: np.ndarray, keep: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states before and after each step of (steps, lanes) gates and candidates; ``keep`` is 0 where a document starts."""
    before, after = np.empty_like(new), np.empty_like(new)
    for t in range(len(z)):
        np.multiply(h, keep[t], out=before[t])
        h = after[t]
        np.subtract(new[t], before[t], out=h)
        h *= z[t]
        h += before[t]
    return before, after


def _with_one(states: np.ndarray) -> np.ndarray:
    out = np.ones((len(states), HIDDEN + 1), states.dtype)
    out[:, :HIDDEN] = states
    return out


def _choice(weights: np.ndarray, states: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log probability of the wanted row of ``weights`` after each state; unnormalised probabilities and their sums.

    States lie between -1 and 1, so the weights bound the logits; only large ones need their maximum taken off.
    """
    e = states @ weights.T
    if np.abs(weights).sum(axis=1).max() > LARGE_LOGIT:
        e -= e.max(axis=1, keepdims=True)
    own = e[np.arange(len(wanted)), wanted]
    np.exp(e, out=e)
    total = e @ np.ones(len(weights), e.dtype)
    return own - np.log(total), e, total


def _by_class(targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of targets by class, and where in it each class starts and ends."""
    classes = CLASS_OF[targets]
    order = np.argsort(classes, kind="stable")
    return order, np.searchsorted(classes[order], np.arange(CLASSES + 1))


def log_probabilities(m: Model, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Natural log probability of each target symbol after each state."""
    order, at = _by_class(targets)
    states, targets = _with_one(states)[order], targets[order]
    logs = _choice(m["class"], states, CLASS_OF[targets])[0]
    for c in np.flatnonzero(np.diff(at)):
        own = slice(at[c], at[c + 1])
        logs[own] += _choice(m["word"][BOUNDS[c] : BOUNDS[c + 1]], states[own], targets[own] - BOUNDS[c])[0]
    out = np.empty_like(logs)
    out[order] = logs
    return out


def _sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` and the sum of the values of each."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(rows[order]) != 0])
    return rows[order[first]], np.add.reduceat(values[order], first, axis=0)


def gradients(m: Model, inputs: np.ndarray, targets: np.ndarray, h: np.ndarray) -> tuple[dict[str, np.ndarray | tuple[np.ndarray, np.ndarray]], np.ndarray, float]:
    """Gradients of the mean loss over a (steps, lanes) window from state ``h``, the state after it, and the loss.

    That of ``input`` is given as the rows that occur and their gradients.
    """
    z, new = _gates(m["input"][inputs])
    keep = (inputs != 0)[..., None].astype(h.dtype)
    before, states = _run(z, new, keep, h)
    order, at = _by_class(targets.reshape(-1))
    flat, wanted = _with_one(states.reshape(-1, HIDDEN))[order], targets.reshape(-1)[order]
    n = len(wanted)

    def errors(weights: np.ndarray, rows: np.ndarray, chosen: np.ndarray) -> tuple[float, np.ndarray]:
        logs, e, total = _choice(weights, rows, chosen)
        e *= (1 / (n * total))[:, None]
        e[np.arange(len(chosen)), chosen] -= 1 / n
        return -float(logs.sum()), e

    loss, e = errors(m["class"], flat, CLASS_OF[wanted])
    g = {"class": e.T @ flat, "word": np.zeros_like(m["word"])}
    back = e @ m["class"][:, :HIDDEN]
    for c in np.flatnonzero(np.diff(at)):
        own, span = slice(at[c], at[c + 1]), slice(BOUNDS[c], BOUNDS[c + 1])
        more, e = errors(m["word"][span], flat[own], wanted[own] - BOUNDS[c])
        loss += more
        g["word"][span] = e.T @ flat[own]
        back[own] += e @ m["word"][span, :HIDDEN]
    d = np.empty_like(back)
    d[order] = back
    d = d.reshape(states.shape)
    carried = (1 - z) * keep
    for t in range(len(d) - 2, -1, -1):
        d[t] += d[t + 1] * carried[t + 1]
    into = np.concatenate([d * (new - before) * z * (1 - z), d * z * (1 - new * new)], axis=2)
    g["input"] = _sums(inputs.reshape(-1), into.reshape(-1, 2 * HIDDEN))
    return g, states[-1], loss / n


def train(m: Model, stream: np.ndarray, rate: float = RATE) -> Model:
    """One pass of Adam with truncated backpropagation over documents that each end with symbol 0.

    Moments of input rows only move when the row occurs.
    """
    lanes = min(LANES, max(LEAST_LANES, len(stream) // (UPDATES * WINDOW)))
    length = (len(stream) - 1) // lanes
    if length < 1:
        return m
    x, y = (np.ascontiguousarray(stream[o : o + lanes * length].reshape(lanes, length).T) for o in (0, 1))
    m = {k: v.copy() for k, v in m.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    h = np.zeros((lanes, HIDDEN), np.float32)
    windows = range(0, length, WINDOW)
    for i, t in enumerate(windows, 1):
        g, h, _ = gradients(m, x[t : t + WINDOW], y[t : t + WINDOW], h)
        norm = np.sqrt(sum(float(np.vdot(v, v)) for v in (*(g[k] for k in g if k != "input"), g["input"][1])))
        now = rate * min(1.0, i / 10) * (1 - 0.9 * i / len(windows)) * np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        for k, v in g.items():
            rows, v = v if k == "input" else (slice(None), v)
            v *= min(1.0, CLIP / max(norm, 1e-9))
            a, b = mean[k][rows], square[k][rows]
            a += 0.1 * (v - a)
            v *= v
            b += 0.01 * (v - b)
            if k == "input":
                mean[k][rows], square[k][rows] = a, b
            m[k][rows] -= now * a / (np.sqrt(b) + 1e-7)
    return m


def score(m: Model, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of each whole document; each array ends with symbol 0.

    Documents are dealt to lanes of about equal length; a lane's state is carried across windows and starts
    anew with each document.
    """
    total = np.zeros(len(documents))
    lengths = np.array([len(d) for d in documents], np.int64)
    if not lengths.sum():
        return total
    lanes = int(min(SCORE_LANES, max(1, lengths.sum() // lengths.max()), len(documents)))
    loads, dealt = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    for i in np.argsort(-lengths, kind="stable").tolist():
        lane = int(loads.argmin())
        loads[lane] += lengths[i]
        dealt[lane].append(i)
    by_load = np.argsort(-loads, kind="stable")
    loads = loads[by_load]
    steps = int(loads[0])
    words, owner = np.zeros((lanes, steps + 1), np.int16), np.full((lanes, steps), -1, np.int32)
    for row, lane in enumerate(by_load.tolist()):
        own = dealt[lane]
        words[row, 1 : loads[row] + 1] = np.concatenate([documents[i] for i in own])
        owner[row, : loads[row]] = np.repeat(own, lengths[own])
    h = np.zeros((lanes, HIDDEN), np.float32)
    z, new = _gates(m["input"])
    for t in range(0, steps, SCORE_WINDOW):
        width = int((loads > t).sum())  # lanes that have ended are the last
        window = np.ascontiguousarray(words[:width, t : min(t + SCORE_WINDOW, steps) + 1].T)
        own = owner[:width, t : t + SCORE_WINDOW].T.reshape(-1)
        inputs = window[:-1]
        states = _run(z[inputs], new[inputs], (inputs != 0)[..., None].astype(np.float32), h[:width])[1]
        h, there = states[-1], own >= 0
        logs = log_probabilities(m, states.reshape(-1, HIDDEN)[there], window[1:].reshape(-1)[there])
        total += np.bincount(own[there], weights=logs, minlength=len(total))
    return total


def pack(m: Model) -> bytes:
    return b"".join(np.ascontiguousarray(m[k], np.float32).tobytes() for k in SHAPES)


def unpack(data: bytes) -> Model:
    flat, at, m = np.frombuffer(data, np.float32), 0, {}
    for k, shape in SHAPES.items():
        n = int(np.prod(shape))
        m[k] = flat[at : at + n].reshape(shape)
        at += n
    return m
