"""A small character tagger: bidirectional LSTM with CRF transitions, in numpy.

Windows of equal length are one batch, and both directions run side by side as two stacked
matrices. Training follows the exact gradient of the CRF likelihood back through both directions.
"""

from dataclasses import dataclass

import numpy as np

# Characters: printable ASCII each for itself, then line ends, other non-ASCII letters, the rest, padding.
N_CHARACTERS = 95 + 4
_LINE, _LETTER, _REST, PADDING = 95, 96, 97, 98


def character_ids(text: str, length: int) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    ids = np.full(length, PADDING)
    plain = codes - 32
    ids[: len(codes)] = np.where(
        (plain >= 0) & (plain < 95), plain, np.where(codes == 10, _LINE, np.where(codes >= 0xC0, _LETTER, _REST))
    )
    return ids


@dataclass
class Tagger:
    """Weights; the leading axis of 2 of the LSTM's is the direction."""

    embedding: np.ndarray  # characters x e
    inputs: np.ndarray  # 2 x e x 4h: input, forget, output gates, candidate
    states: np.ndarray  # 2 x h x 4h
    bias: np.ndarray  # 2 x 1 x 4h
    scores: np.ndarray  # 2h x labels
    scores_bias: np.ndarray  # labels
    transitions: np.ndarray  # labels x labels, from row to column

    def parameters(self):
        return [getattr(self, name) for name in self.__dataclass_fields__]


def new_tagger(n_labels: int, embedding: int = 8, hidden: int = 16, seed: int = 0) -> Tagger:
    rng = np.random.default_rng(seed)

    def draw(*shape):
        return rng.normal(0, 1 / np.sqrt(shape[-2]), shape).astype(np.float32)

    bias = np.zeros((2, 1, 4 * hidden), np.float32)
    bias[:, :, hidden : 2 * hidden] = 1
    return Tagger(
        draw(N_CHARACTERS, embedding) * 3, draw(2, embedding, 4 * hidden), draw(2, hidden, 4 * hidden), bias,
        draw(2 * hidden, n_labels), np.zeros(n_labels, np.float32), np.zeros((n_labels, n_labels), np.float32),
    )


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _forward(tagger: Tagger, ids: np.ndarray):
    """Label scores (batch, time, labels) and what the backward pass needs."""
    batch, time = ids.shape
    hidden = tagger.states.shape[1]
    x = tagger.embedding[ids]
    both = np.stack([x, x[:, ::-1]])
    projected = (both.reshape(2, batch * time, -1) @ tagger.inputs + tagger.bias).reshape(2, batch, time, 4 * hidden)
    h = np.zeros((2, batch, hidden), np.float32)
    c = np.zeros_like(h)
    gates, cells, outs = [], [c], [h]
    for t in range(time):
        z = projected[:, :, t] + h @ tagger.states
        g = np.empty_like(z)
        g[..., : 3 * hidden] = _sigmoid(z[..., : 3 * hidden])
        g[..., 3 * hidden :] = np.tanh(z[..., 3 * hidden :])
        c = g[..., hidden : 2 * hidden] * c + g[..., :hidden] * g[..., 3 * hidden :]
        h = g[..., 2 * hidden : 3 * hidden] * np.tanh(c)
        gates.append(g)
        cells.append(c)
        outs.append(h)
    out = np.stack(outs[1:], axis=2)
    features = np.concatenate([out[0], out[1, :, ::-1]], axis=-1)
    return features @ tagger.scores + tagger.scores_bias, (both, gates, cells, outs, features)


def _backward(tagger: Tagger, ids, kept, d_scores):
    both, gates, cells, outs, features = kept
    batch, time = ids.shape
    hidden = tagger.states.shape[1]
    d_features = d_scores @ tagger.scores.T
    d_out = np.stack([d_features[..., :hidden], d_features[:, ::-1, hidden:]])
    d_h = np.zeros((2, batch, hidden), np.float32)
    d_c = np.zeros_like(d_h)
    d_projected = np.empty((2, batch, time, 4 * hidden), np.float32)
    d_states = np.zeros_like(tagger.states)
    for t in reversed(range(time)):
        g = gates[t]
        i, f, o, a = (g[..., k * hidden : (k + 1) * hidden] for k in range(4))
        tanh_c = np.tanh(cells[t + 1])
        d_h = d_h + d_out[:, :, t]
        d_c = d_c + d_h * o * (1 - tanh_c**2)
        d_z = d_projected[:, :, t]
        d_z[..., :hidden] = d_c * a * i * (1 - i)
        d_z[..., hidden : 2 * hidden] = d_c * cells[t] * f * (1 - f)
        d_z[..., 2 * hidden : 3 * hidden] = d_h * tanh_c * o * (1 - o)
        d_z[..., 3 * hidden :] = d_c * i * (1 - a**2)
        d_states += outs[t].transpose(0, 2, 1) @ d_z
        d_h = d_z @ tagger.states.transpose(0, 2, 1)
        d_c = d_c * f
    flat = d_projected.reshape(2, batch * time, -1)
    d_both = (flat @ tagger.inputs.transpose(0, 2, 1)).reshape(both.shape)
    d_embedding = np.zeros_like(tagger.embedding)
    np.add.at(d_embedding, ids, d_both[0] + d_both[1, :, ::-1])
    return [
        d_embedding,
        both.reshape(2, batch * time, -1).transpose(0, 2, 1) @ flat,
        d_states,
        flat.sum(axis=1, keepdims=True),
        features.reshape(batch * time, -1).T @ d_scores.reshape(batch * time, -1),
        d_scores.sum(axis=(0, 1)),
    ]


def _log_sum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _crf(tagger: Tagger, scores, labels):
    """Negative log likelihood per window, and its gradients for scores and transitions."""
    batch, time, n = scores.shape
    trans = tagger.transitions
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[:, 0] = scores[:, 0]
    for t in range(1, time):
        alpha[:, t] = scores[:, t] + _log_sum(alpha[:, t - 1, :, None] + trans, 1)
    for t in reversed(range(time - 1)):
        beta[:, t] = _log_sum(trans + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _log_sum(alpha[:, -1], 1)
    d_scores = np.exp(alpha + beta - total[:, None, None])
    pairs = alpha[:, :-1, :, None] + trans + (scores + beta)[:, 1:, None, :] - total[:, None, None, None]
    d_trans = np.exp(pairs).sum(axis=(0, 1))
    rows, steps = np.arange(batch)[:, None], np.arange(time)[None]
    gold = scores[rows, steps, labels].sum(axis=1) + trans[labels[:, :-1], labels[:, 1:]].sum(axis=1)
    d_scores[rows, steps, labels] -= 1
    np.subtract.at(d_trans, (labels[:, :-1], labels[:, 1:]), 1)
    return float((total - gold).mean()), d_scores / batch, d_trans / batch


def loss_and_gradients(tagger: Tagger, ids, labels):
    scores, kept = _forward(tagger, ids)
    loss, d_scores, d_trans = _crf(tagger, scores, labels)
    return loss, [*_backward(tagger, ids, kept, d_scores), d_trans]


def train(tagger: Tagger, ids, labels, steps: int = 240, batch: int = 32, rate: float = 0.01, seed: int = 0) -> list[float]:
    """Adam with a falling rate, in place; returns the losses."""
    rng = np.random.default_rng(seed)
    first = [np.zeros_like(p) for p in tagger.parameters()]
    second = [np.zeros_like(p) for p in tagger.parameters()]
    losses, order = [], np.zeros(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(ids))])
        chosen, order = order[:batch], order[batch:]
        loss, gradients = loss_and_gradients(tagger, ids[chosen], labels[chosen])
        losses.append(loss)
        size = np.sqrt(sum(float((g**2).sum()) for g in gradients))
        now = rate * min(1, 5 / max(size, 1e-9)), rate * (1 - step / (steps + 1))
        for p, g, m, v in zip(tagger.parameters(), gradients, first, second):
            g = g * (now[0] / rate)
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= now[1] * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return losses


def decode(tagger: Tagger, ids: np.ndarray) -> np.ndarray:
    """The likeliest labels of each window (Viterbi)."""
    scores, _ = _forward(tagger, ids)
    batch, time, _ = scores.shape
    best, back = scores[:, 0], []
    for t in range(1, time):
        paths = best[:, :, None] + tagger.transitions
        back.append(paths.argmax(axis=1))
        best = paths.max(axis=1) + scores[:, t]
    labels = np.empty((batch, time), np.int64)
    labels[:, -1] = best.argmax(axis=1)
    for t in reversed(range(time - 1)):
        labels[:, t] = back[t][np.arange(batch), labels[:, t + 1]]
    return labels
