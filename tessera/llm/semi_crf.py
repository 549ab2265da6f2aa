"""Semi-Markov conditional random field over candidate segments.

A text is segmented into entities, each one of the candidate segments (start, end, kind,
features), and single tokens outside, whose score is 0. A segmentation's score is the sum over
its entities of their whole-span features and of the pair (kind before, kind) where two follow
closely. Candidates farther apart than ``REACH`` do not influence each other, so a text falls
into short independent windows; within one the dynamic programme runs over its candidates and
chooses boundaries and types jointly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

#: Characters between two entities up to which their kinds count as a pair.
REACH = 30


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    features: tuple[str, ...]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]

    def score(self, s: Segment) -> float:
        get = self.weights.get
        return sum(get(f, 0.0) for f in s.features)


def _windows(segments: list[Segment]) -> list[list[Segment]]:
    out: list[list[Segment]] = []
    end = -REACH - 1
    for s in sorted(segments):
        if s.start - end > REACH or not out:
            out.append([])
        out[-1].append(s)
        end = max(end, s.end)
    return out


def _pair(a: Segment, b: Segment) -> str:
    return f"{a.kind}>{b.kind}" if b.start - a.end <= REACH else ""


def decode(model: Model, segments: list[Segment]) -> list[Segment]:
    """The entities of the best segmentation, in order."""
    out: list[Segment] = []
    get = model.weights.get
    for w in _windows(segments):
        if len(w) == 1:
            if model.score(w[0]) > 0:
                out.append(w[0])
            continue
        best: list[float] = []
        back: list[int] = []
        far, far_at = 0.0, -1  # best of the candidates too far back to be a pair with the next
        near: list[int] = []
        for j, b in enumerate(w):
            kept = []
            for i in near:
                if w[i].end + REACH >= b.start:
                    kept.append(i)
                elif best[i] > far:
                    far, far_at = best[i], i
            near = kept
            top, at = far, far_at
            for i in near:
                a = w[i]
                if a.end <= b.start and (v := best[i] + get(_pair(a, b), 0.0)) > top:
                    top, at = v, i
            best.append(top + model.score(b))
            back.append(at)
            near.append(j)
        j = max(range(len(w)), key=best.__getitem__)
        if best[j] <= 0:
            continue
        path = []
        while j >= 0:
            path.append(w[j])
            j = back[j]
        out += reversed(path)
    return out


def fit(texts: list[tuple[list[Segment], set[tuple[int, int, str]]]], decay: float = 2e-3, steps: int = 60, rate: float = 0.25) -> Model:
    """Maximise the penalised likelihood of the true entities (start, end, kind) of each text
    among all segmentations its candidates allow: forward-backward over the candidates, Adam.
    True entities that are no candidate are left out. Deterministic."""
    windows = []
    for segments, true in texts:
        for w in _windows(segments):
            n = len(w)
            allowed = [[i for i in range(j) if w[i].end <= w[j].start] for j in range(n)]
            pairs = {(i, j): p for j in range(n) for i in allowed[j] if (p := _pair(w[i], w[j]))}
            chosen = [j for j in range(n) if (w[j].start, w[j].end, w[j].kind) in true]
            gold: dict[str, float] = {}
            for j in chosen:
                for f in w[j].features:
                    gold[f] = gold.get(f, 0.0) + 1
            for i, j in zip(chosen, chosen[1:]):
                if p := pairs.get((i, j)):
                    gold[p] = gold.get(p, 0.0) + 1
            windows.append((w, allowed, pairs, gold))
    weights: dict[str, float] = {}
    first: dict[str, float] = {}
    second: dict[str, float] = {}
    for step in range(1, steps + 1):
        grad: dict[str, float] = {}
        get = weights.get
        for w, allowed, pairs, gold in windows:
            n = len(w)
            score = [sum(get(f, 0.0) for f in s.features) for s in w]
            alpha = [0.0] * n
            for j in range(n):
                alpha[j] = score[j] + math.log(1.0 + sum(math.exp(alpha[i] + get(pairs.get((i, j), ""), 0.0)) for i in allowed[j]))
            beta = [1.0] * n
            for i in range(n - 1, -1, -1):
                beta[i] = 1.0 + sum(math.exp(score[j] + get(pairs.get((i, j), ""), 0.0)) * beta[j] for j in range(i + 1, n) if w[i].end <= w[j].start)
            z = 1.0 + sum(math.exp(a) for a in alpha)
            for f, v in gold.items():
                grad[f] = grad.get(f, 0.0) + v
            for j in range(n):
                p = math.exp(alpha[j]) * beta[j] / z
                for f in w[j].features:
                    grad[f] = grad.get(f, 0.0) - p
                for i in allowed[j]:
                    if name := pairs.get((i, j)):
                        q = math.exp(alpha[i] + get(name, 0.0) + score[j]) * beta[j] / z
                        grad[name] = grad.get(name, 0.0) - q
        for f, g in grad.items():
            g = g / len(texts) * 10 - decay * get(f, 0.0)
            a = first[f] = 0.9 * first.get(f, 0.0) + 0.1 * g
            b = second[f] = 0.999 * second.get(f, 0.0) + 0.001 * g * g
            weights[f] = get(f, 0.0) + rate * (a / (1 - 0.9**step)) / (math.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return Model(weights)
