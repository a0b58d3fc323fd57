"""A linear-chain conditional random field over word shapes, in numpy.

A word is described by a few small numbers (which kinds of characters it has, how
many digits and marks, whether its digits pass a checksum, and the same of its
neighbours).  The score of a labelling is the sum of a weight for each number and
label and one for each pair of neighbouring labels; before the first and after
the last word stands ``OUT``.  Chains are held as arrays of words and the chains'
lengths; sums and Viterbi walk all chains of a batch together, word by word.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

KINDS = ("email", "ip", "card", "phone")
OUT = 0
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
NEVER = -1e6


class Crf(NamedTuple):
    emit: list[np.ndarray]  # for each feature: its values x labels
    step: np.ndarray  # label x next label


def allowed_steps() -> np.ndarray:
    """0, or NEVER where a kind's inside follows anything but its own begin or inside."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        out[:, inside] = NEVER
        out[[inside - 1, inside], inside] = 0
    return out


def scores(model: Crf, codes: np.ndarray) -> np.ndarray:
    """codes: words x features -> words x labels."""
    total = np.zeros((len(codes), LABELS))
    for f, w in enumerate(model.emit):
        total += w[codes[:, f]]
    return total


def _by_place(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains from the longest to the shortest, where each begins, and how many have a word at each place."""
    order = np.argsort(-sizes, kind="stable")
    first = (np.cumsum(sizes) - sizes)[order]
    reach = np.searchsorted(-sizes[order], -np.arange(1, sizes.max() + 1), "right")
    return order, first, reach


def viterbi(model: Crf, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best label of every word; ties go to the smaller label."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    emit = scores(model, codes)
    order, first, reach = _by_place(sizes)
    best = np.tile(model.step[OUT], (len(sizes), 1)) + emit[first]
    came = np.zeros((len(codes), LABELS), np.int8)
    for t in range(1, len(reach)):
        at = first[:reach[t]] + t
        ways = best[:reach[t], :, None] + model.step
        came[at] = ways.argmax(axis=1)
        best[:reach[t]] = ways.max(axis=1) + emit[at]
    label = np.zeros(len(codes), np.int64)
    now = (best + model.step[:, OUT]).argmax(axis=1)
    label[first + sizes[order] - 1] = now
    for t in range(len(reach) - 1, 0, -1):
        at = first[:reach[t]] + t
        label[at - 1] = came[at, label[at]]
    return label


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def expected(model: Crf, codes: np.ndarray, sizes: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Weighted log of the chains' sums over all labellings, with each word's label and each step's expected counts."""
    emit = scores(model, codes)
    order, first, reach = _by_place(sizes)
    w = weight[order]
    alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
    alpha[first] = model.step[OUT] + emit[first]
    for t in range(1, len(reach)):
        at = first[:reach[t]] + t
        alpha[at] = _logsum(alpha[at - 1][:, :, None] + model.step, 1) + emit[at]
    last = first + sizes[order] - 1
    beta[last] = model.step[:, OUT]
    z = _logsum(alpha[last] + beta[last], 1)
    steps = np.zeros_like(model.step)
    np.add.at(steps[OUT], np.arange(LABELS), (np.exp(alpha[first] + _back(model, emit, beta, first, reach, sizes[order]) - z[:, None]) * w[:, None]).sum(axis=0))
    for t in range(1, len(reach)):
        at = first[:reach[t]] + t
        both = alpha[at - 1][:, :, None] + model.step + (emit[at] + beta[at])[:, None, :] - z[:reach[t], None, None]
        steps += (np.exp(both) * w[:reach[t], None, None]).sum(axis=0)
    steps[:, OUT] += (np.exp(alpha[last] + beta[last] - z[:, None]) * w[:, None]).sum(axis=0)
    owner = np.empty(len(sizes), np.int64)
    owner[order] = np.arange(len(sizes))
    chain = owner[np.repeat(np.arange(len(sizes)), sizes)]
    words = np.exp(alpha + beta - z[chain][:, None]) * w[chain][:, None]
    return float((z * w).sum()), words, steps


def _back(model, emit, beta, first, reach, sizes) -> np.ndarray:
    """Fills ``beta`` from the chains' ends and returns it at their first words."""
    for t in range(len(reach) - 1, 0, -1):
        at = first[:reach[t]] + t
        beta[at - 1] = _logsum(model.step + (emit[at] + beta[at])[:, None, :], 2)
    return beta[first]


def fit(codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weight: np.ndarray, widths: list[int],
        rounds: int = 150, rate: float = 0.2, ridge: float = 0.02) -> Crf:
    """Maximum likelihood with a ridge penalty, by Adam over all chains.  ``widths``: how many values a feature has."""
    fixed = allowed_steps()
    weights = [np.zeros((n, LABELS)) for n in widths] + [np.zeros((LABELS, LABELS))]
    if not len(sizes):
        return Crf(weights[:-1], fixed)
    chain = np.repeat(np.arange(len(sizes)), sizes)
    seen_words = np.zeros((len(codes), LABELS))
    seen_words[np.arange(len(codes)), labels] = weight[chain]
    seen_steps = np.zeros((LABELS, LABELS))
    first = np.cumsum(sizes) - sizes
    before = np.r_[OUT, labels[:-1]]
    before[first] = OUT
    np.add.at(seen_steps, (before, labels), weight[chain])
    np.add.at(seen_steps, (labels[first + sizes - 1], np.full(len(sizes), OUT)), weight)
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for i in range(1, rounds + 1):
        _, words, steps = expected(Crf(weights[:-1], weights[-1] + fixed), codes, sizes, weight)
        for k, w in enumerate(weights):
            if k < len(widths):
                g = np.zeros_like(w)
                np.add.at(g, codes[:, k], seen_words - words)
            else:
                g = seen_steps - steps
            g -= ridge * w
            mean[k] = 0.9 * mean[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            w += rate * (mean[k] / (1 - 0.9 ** i)) / (np.sqrt(square[k] / (1 - 0.99 ** i)) + 1e-8) / np.sqrt(i)
    return Crf(weights[:-1], weights[-1] + fixed)
