"""A linear-chain conditional random field in numpy: trained on a small labelled table, decoded in batches.

A token has features; a label's score at a token is the sum of the weights of the token's own features, of those of the
token before and of those of the token after; labels of neighbours have transition weights.  Training climbs the
penalised log likelihood by Adam over all chains together.  Viterbi pads chains of similar length and steps through
positions for all of them at once.  Forward-backward does so for segments of SEGMENT tokens, into which all chains are
cut: a first pass gives each segment's sums of paths between the label before it and its last one, a scan over a chain's
segments gives what comes in from both sides, and a second pass the rest; this is exact and as fast for long chains.
Sums are scaled to one at each step, as only their proportions count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np

#: Score of a barred step.
BARRED = -1e4
#: Tokens of a segment.
SEGMENT = 64
#: Chains that are decoded together, and the most tokens that they have when padded to the longest, unless one alone has more.
TOGETHER = 2048
PADDED = TOGETHER * 64


@dataclass
class Crf:
    labels: list[str]
    index: dict[str, int]  # features
    own: np.ndarray  # features x labels
    prev: np.ndarray
    next: np.ndarray
    trans: np.ndarray  # label before x label
    start: np.ndarray
    end: np.ndarray

    def rows(self, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a token adds to its own scores, to those of the token after and to those of the token before."""
        at = [self.index[f] for f in features if f in self.index]
        return self.own[at].sum(0), self.prev[at].sum(0), self.next[at].sum(0)

    def emissions(self, own: np.ndarray, prev: np.ndarray, next: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores of all tokens of chains, from each token's ``rows``; the chains follow one another."""
        out = own.copy()
        ends = np.cumsum(lengths)
        inner = np.ones(len(out), bool)
        inner[ends[:-1]] = False
        inner[:1] = False
        at = np.flatnonzero(inner)  # tokens with one before them in their chain
        out[at] += prev[at - 1]
        out[at - 1] += next[at]
        return out

    def _padded(self, scores: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(lengths, kind="stable")
        low = 0
        while low < len(order):
            sizes = lengths[order[low : low + TOGETHER]]
            # sizes grow; the first TOGETHER chains whose padded block is small enough, one at least
            some = order[low : low + max(1, int(np.searchsorted(sizes * np.arange(1, len(sizes) + 1), PADDED, side="right")))]
            low += len(some)
            width = int(lengths[some[-1]])
            place = starts[some][:, None] + np.minimum(np.arange(width), lengths[some][:, None] - 1)
            live = np.arange(width) < lengths[some][:, None]
            yield scores[place], lengths[some], place, live

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The label of each token on its chain's best path."""
        out = np.zeros(len(scores), np.int64)
        for padded, sizes, place, live in self._padded(scores, lengths):
            n, width, count = padded.shape
            value = padded[:, 0] + self.start
            back = np.zeros((width, n, count), np.int8)
            for t in range(1, width):
                step = value[:, :, None] + self.trans
                back[t] = step.argmax(1)
                new = step.max(1) + padded[:, t]
                going = live[:, t]
                value = np.where(going[:, None], new, value)
            now = (value + self.end).argmax(1)
            found = np.zeros((n, width), np.int64)
            for t in range(width - 1, -1, -1):
                found[:, t] = now
                if t:
                    now = np.where(live[:, t], back[t][np.arange(n), now], now)
            out[place[live]] = found[live]
        return out

    def marginals(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The probability of each label at each token."""
        return self.expected(scores, lengths)[0]

    def expected(self, scores: np.ndarray, lengths: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The probability of each label at each token and, with ``pairs``, the expected number of each step between labels.
        Chains are not empty."""
        k = len(self.labels)
        local = np.exp(scores - scores.max(1, keepdims=True))
        trans, start, end = (np.exp(x - x.max()) for x in (self.trans, self.start, self.end))
        counts = -(-lengths // SEGMENT)
        chain = np.repeat(np.arange(len(lengths)), counts)
        rank = np.arange(len(chain)) - np.repeat(np.cumsum(counts) - counts, counts)
        begin = np.repeat(np.cumsum(lengths) - lengths, counts) + rank * SEGMENT
        size = np.minimum(SEGMENT, lengths[chain] - rank * SEGMENT)
        first = rank == 0
        order = np.argsort(size, kind="stable")  # segments of a block are about as long
        blocks = []
        for low in range(0, len(chain), TOGETHER):
            some = order[low : low + TOGETHER]
            width, sizes = int(size[some[-1]]), size[some]
            place = begin[some] + np.minimum(np.arange(width)[:, None], sizes - 1)  # steps x segments
            # segments from a place in the block on are still alive at a step
            blocks.append((some, width, place, np.searchsorted(sizes, np.arange(width), side="right")))
        # from the label before a segment to its last label; of a first segment, whatever is before
        through = np.zeros((len(chain), k, k))
        for some, width, place, dead in blocks:
            if width < SEGMENT and (counts[chain[some]] == 1).all():
                continue
            now = np.where(first[some][:, None, None], start, trans) * local[place[0]][:, None, :]
            for t in range(1, width):
                d = dead[t]
                new = (now[d:] @ trans) * local[place[t, d:]][:, None, :]
                now[d:] = new / new.sum((1, 2), keepdims=True)
            through[some] = now
        into = np.full((len(chain), k), 1.0 / k)
        after = np.tile(end, (len(chain), 1))
        by_rank = np.argsort(rank, kind="stable")
        cuts = np.searchsorted(rank[by_rank], np.arange(1, int(rank.max(initial=0)) + 2))
        for r in range(1, len(cuts)):
            at = by_rank[cuts[r - 1] : cuts[r]]  # segments that follow one in their chain
            new = (into[at - 1][:, None, :] @ through[at - 1])[:, 0]
            into[at] = new / new.sum(1, keepdims=True)
        for r in range(len(cuts) - 1, 0, -1):
            at = by_rank[cuts[r - 1] : cuts[r]]
            new = (through[at] @ after[at][:, :, None])[:, :, 0]
            after[at - 1] = new / new.sum(1, keepdims=True)
        out, steps = np.empty_like(local), np.zeros((k, k))
        for some, width, place, dead in blocks:
            here = local[place]
            alpha, beta = np.empty_like(here), np.empty_like(here)
            came = into[some] @ trans
            alpha[0] = np.where(first[some][:, None], start, came) * here[0]
            for t in range(1, width):
                new = (alpha[t - 1] @ trans) * here[t]
                alpha[t] = new / new.sum(1, keepdims=True)
            beta[-1] = last = after[some]
            for t in range(width - 2, -1, -1):
                d = dead[t + 1]
                new = (here[t + 1, d:] * beta[t + 1, d:]) @ trans.T
                beta[t, d:] = new / new.sum(1, keepdims=True)
                beta[t, :d] = last[:d]
            soft = alpha * beta
            soft /= soft.sum(2, keepdims=True)
            live = np.arange(width)[:, None] < size[some]
            out[place[live]] = soft[live]
            if pairs:
                ahead = here * beta
                for before, now, alive in [(into[some], ahead[0], ~first[some])] + [(alpha[t - 1], ahead[t], live[t]) for t in range(1, width)]:
                    both = before[alive][:, :, None] * trans * now[alive][:, None, :]
                    steps += (both / both.sum((1, 2), keepdims=True)).sum(0)
        return out, steps


def fit(chains: list[list[tuple[str, str]]], featurise: Callable[[str], list[str]], labels: list[str], steps: int = 300, ridge: float = 0.02, rate: float = 0.1, bar: bool = False) -> Crf:
    """Train on chains of (token, label), whole whatever their length; at least one chain, none of them empty.  ``bar``: steps
    between labels, and first labels, that no chain has are barred."""
    distinct = {token: featurise(token) for token in {token for chain in chains for token, _ in chain}}
    names = sorted({f for found in distinct.values() for f in found})
    index, count = {f: i for i, f in enumerate(names)}, len(labels)
    most = max(map(len, distinct.values()))
    # feature ids of different tokens, padded by one more feature without weight
    number = {token: i for i, token in enumerate(distinct)}
    padded = np.full((len(distinct), most), len(names))
    for token, found in distinct.items():
        padded[number[token], : len(found)] = [index[f] for f in found]
    kind = np.array([number[token] for chain in chains for token, _ in chain])
    lengths = np.array([len(c) for c in chains])
    n, ends = len(chains), np.cumsum(lengths)
    place = {label: i for i, label in enumerate(labels)}
    hot = np.eye(count)[[place[label] for chain in chains for _, label in chain]]
    inner = np.ones(len(kind), bool)  # tokens with one before them in their chain
    inner[0] = False
    inner[ends[:-1]] = False
    follows = np.flatnonzero(inner)
    shapes = [(len(names), count)] * 3 + [(count, count), (count,), (count,)]
    weights = [np.zeros(s) for s in shapes]
    moment, square = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
    gold = np.einsum("ta,tb->ab", hot[follows - 1], hot[follows])

    def summed(w: np.ndarray) -> np.ndarray:
        return np.concatenate([w, np.zeros((1, count))])[padded].sum(1)

    def gathered(part: np.ndarray) -> np.ndarray:
        """Sums over tokens by kind, then by feature."""
        by_kind = np.stack([np.bincount(kind, part[:, c], len(padded)) for c in range(count)], 1)
        return np.stack([np.bincount(padded.ravel(), np.repeat(by_kind[:, c], most), len(names) + 1)[:-1] for c in range(count)], 1)

    for step in range(1, steps + 1):
        own, prev, next_, trans, start, end = weights
        model = Crf(labels, index, own, prev, next_, trans, start, end)
        scores = model.emissions(summed(own)[kind], summed(prev)[kind], summed(next_)[kind], lengths)
        marginal, pair = model.expected(scores, lengths, pairs=True)
        off = hot - marginal
        before, after = np.zeros_like(off), np.zeros_like(off)
        before[follows - 1] = off[follows]
        after[follows] = off[follows - 1]
        slopes = [gathered(off), gathered(before), gathered(after), gold - pair, off[ends - lengths].sum(0), off[ends - 1].sum(0)]
        for k, slope in enumerate(slopes):
            slope = slope - ridge * n * weights[k] / 10
            moment[k] = 0.9 * moment[k] + 0.1 * slope
            square[k] = 0.99 * square[k] + 0.01 * slope**2
            weights[k] = weights[k] + rate * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    if bar:
        weights[3] = np.where(gold > 0, weights[3], BARRED)
        weights[4] = np.where(hot[ends - lengths].sum(0) > 0, weights[4], BARRED)
    return Crf(labels, index, *weights)
