"""Averaged perceptron over named features."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Sequence

import numpy as np


class AveragedPerceptron:
    """Scores labels by sums of feature weights; training averages the weights over all steps."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}

    def score(self, features: Iterable[str], label: str) -> float:
        return sum(self.weights[f].get(label, 0.0) for f in features if f in self.weights)

    def sum(self, keys: Iterable[tuple[str, str]]) -> float:
        """Score of (feature, label) pairs, for actions with several labels."""
        return sum(self.weights[f].get(label, 0.0) for f, label in keys if f in self.weights)

    def best(self, features: Sequence[str], labels: Sequence[str]) -> str:
        return max(labels, key=lambda k: self.score(features, k))

    def train(self, examples: list[tuple[list[dict], int]], epochs: int = 5, seed: int = 1, margin: float = 1.0) -> None:
        """Each example: candidate actions, each {"label", "features"} or {"keys": (feature, label) pairs}, and the place of the
        right one.

        Weights change wherever the right action does not lead all others by the margin.
        """
        total: dict[tuple[str, str], float] = defaultdict(float)
        last: dict[tuple[str, str], int] = defaultdict(int)
        now: dict[tuple[str, str], float] = defaultdict(float)
        step = 0
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                actions, right = examples[k]
                candidates = [c.get("keys") or [(f, c["label"]) for f in c["features"]] for c in actions]
                step += 1
                scores = [sum(now.get(key, 0.0) for key in c) for c in candidates]
                rivals = [x if i != right else -np.inf for i, x in enumerate(scores)]
                guess = int(np.argmax(rivals))
                if len(scores) > 1 and scores[right] - rivals[guess] < margin:
                    for at, change in ((right, 1.0), (guess, -1.0)):
                        for key in candidates[at]:
                            total[key] += (step - last[key]) * now[key]
                            last[key] = step
                            now[key] += change
        weights: dict[str, dict[str, float]] = defaultdict(dict)
        for key, w in now.items():
            mean = (total[key] + (step + 1 - last[key]) * w) / (step + 1)
            if mean:
                weights[key[0]][key[1]] = mean
        self.weights = dict(weights)
