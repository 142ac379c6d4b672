"""Averaged perceptron over string features, for a handful of classes."""

from __future__ import annotations

import random
from collections import defaultdict


class Perceptron:
    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def scores(self, features: list[str]) -> dict[str, float]:
        out: dict[str, float] = defaultdict(float)
        for f in features:
            if (w := self.weights.get(f)) is not None:
                for c, v in w.items():
                    out[c] += v
        return out

    def best(self, features: list[str], default: str) -> str:
        s = self.scores(features)
        return max(sorted(s), key=lambda c: s[c]) if s else default

    def fit(self, data: list[tuple[list[str], str]], rounds: int = 5, seed: int = 5) -> Perceptron:
        """Updates on errors; the weights are the mean over all steps. The same data gives the same model."""
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[tuple[str, str], float] = defaultdict(float)
        stamp: dict[tuple[str, str], int] = defaultdict(int)
        classes = sorted({y for _, y in data})
        order, step = list(range(len(data))), 0
        shuffle = random.Random(seed)

        def add(f: str, c: str, v: float) -> None:
            k = (f, c)
            total[k] += (step - stamp[k]) * w[f][c]
            stamp[k] = step
            w[f][c] += v

        for _ in range(rounds):
            shuffle.shuffle(order)
            for i in order:
                step += 1
                fs, y = data[i]
                # only classes that some feature speaks of; the others stand at 0
                s: dict[str, float] = {}
                for f in fs:
                    if f in w:
                        for c, v in w[f].items():
                            s[c] = s.get(c, 0.0) + v
                guess = max(s, key=s.__getitem__) if s else classes[0]
                if guess != y:
                    for f in fs:
                        add(f, y, 1.0)
                        add(f, guess, -1.0)
        for (f, c), t in list(total.items()):
            mean = (t + (step - stamp[f, c]) * w[f][c]) / max(1, step)
            if mean:
                self.weights.setdefault(f, {})[c] = mean
        return self
