"""Growth of a small node's subtree from flat arrays within a task, by the rules of level growth (grow, split)."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field

import numpy as np

from coppice.functions.scalars import MODULUS, TINY, drawn

#: Keys of nodes are below this.
KEYS = 1 << 61


@dataclass(frozen=True)
class Rules:
    """What decides splits; attributes are numbers, discrete gives the number of values of those that are codes."""

    attributes: int
    classes: int
    criterion: str = "c45"
    depth: int | None = None
    attributes_a_node: int | None = None
    seed: int = 1
    discrete: dict[int, int] = field(default_factory=dict)
    masks: dict[int, list[int]] | None = None
    cuts: str = "best"
    fixed: int = 2
    dynamic: bool = True
    zero_gain: bool = False
    subsample: int = 0


def root_key(tree: int) -> int:
    return tree + 1


def child_key(key: int, child: int) -> int:
    """A node's key says its place below the root and nothing of the order of growth: random choices depend on it alone."""
    return (key * 6364136223846793005 + (child + 1) * 1442695040888963407) % KEYS


def least_rows(n: int, classes: int, fixed: int, dynamic: bool) -> int:
    return min(25, max(fixed, int(n * 0.1 / classes))) if dynamic else fixed


def stops(counts: tuple[int, ...], classes: int, fixed: int = 2, dynamic: bool = True) -> bool:
    """Whether a node is pure or too small to have two branches of the least size."""
    n = sum(counts)
    return max(counts) == n or n < 2 * least_rows(n, classes, fixed, dynamic)


def log2(x: np.ndarray) -> np.ndarray:
    return np.where(x < TINY, 0.0, np.log2(np.maximum(x, TINY)))


def entropy(counts: np.ndarray) -> np.ndarray:
    """Of each row of class counts."""
    n = counts.sum(axis=-1)
    return np.where(n > 0, log2(n) - (counts * log2(counts)).sum(axis=-1) / np.maximum(n, 1), 0.0)


def gains(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Information gain and split information of two branches."""
    nl, nr = left.sum(axis=-1), right.sum(axis=-1)
    n = nl + nr
    return entropy(left + right) - nl / n * entropy(left) - nr / n * entropy(right), entropy(np.stack([nl, nr], axis=-1))


def hellinger(branches: np.ndarray) -> np.ndarray:
    """Mean distance of the pairs of present classes; branches: (branch, cut, class) counts."""
    sums = branches.sum(axis=0)
    share = np.sqrt(branches / np.maximum(sums, 1))
    distance, present = np.zeros(sums.shape[:-1]), np.zeros(sums.shape[:-1])
    for a, b in itertools.combinations(range(sums.shape[-1]), 2):
        both = (sums[..., a] > 0) & (sums[..., b] > 0)
        distance += np.where(both, np.sqrt(((share[..., a] - share[..., b]) ** 2).sum(axis=0)), 0.0)
        present += both
    return np.where(present > 0, distance / np.maximum(present, 1), 0.0)


def score(gain: float, info: float, penalty: float, criterion: str) -> float | None:
    over = lambda x: x / info if info else None
    if criterion == "infogain":
        return gain
    if criterion == "gainratio":
        return over(gain)
    less = gain - penalty
    if less <= 0:
        return less
    return over(less) if criterion == "c45" else less / math.sqrt(2)


class Data:
    """Rows of a node: values (null: nan), labels, weights and keys; values of numbers are ranked once."""

    def __init__(self, values: np.ndarray, labels: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> None:
        self.values, self.labels, self.weights, self.rows = values, labels.astype(np.int64), weights.astype(float), rows
        self.levels, self.ranks = [], []
        for a in range(values.shape[1]):
            known = values[:, a][~np.isnan(values[:, a])]
            levels = np.unique(known)
            self.levels.append(levels)
            self.ranks.append(np.where(np.isnan(values[:, a]), -1, np.searchsorted(levels, values[:, a])))

    def histogram(self, at: np.ndarray, attribute: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
        """Values that the rows at have, ascending, and their class counts."""
        rank = self.ranks[attribute][at]
        known = rank >= 0
        if not known.all():
            at, rank = at[known], rank[known]
        if not len(at):
            return np.zeros(0), np.zeros((0, classes))
        low, high = int(rank.min()), int(rank.max())
        if high - low <= 2 * len(at) + 16:
            found = np.bincount((rank - low) * classes + self.labels[at], self.weights[at], (high - low + 1) * classes).reshape(-1, classes)
            there = found.sum(axis=1) > 0
            return self.levels[attribute][low : high + 1][there], found[there]
        values, place = np.unique(rank, return_inverse=True)
        return self.levels[attribute][values], np.bincount(place * classes + self.labels[at], self.weights[at], len(values) * classes).reshape(-1, classes)


def number_split(values: np.ndarray, counts: np.ndarray, rules: Rules, draws: tuple[float, float]) -> tuple[float, float | None] | None:
    """Threshold and score of an attribute's cut; None where no cut leaves enough rows on both sides."""
    if len(values) < 2:
        return None
    left = counts.cumsum(axis=0)[:-1]
    right = counts.sum(axis=0) - left
    nl, nr = left.sum(axis=1), right.sum(axis=1)
    n = nl[0] + nr[0]
    least = least_rows(n, rules.classes, rules.fixed, rules.dynamic)
    ok = (nl >= least) & (nr >= least)
    tried = int(ok.sum())
    if not tried:
        return None
    cuts, left, right = ((values[:-1] + values[1:]) / 2)[ok], left[ok], right[ok]
    penalty = math.log2(tried) / n
    if rules.cuts == "best":
        if rules.criterion == "hellinger":
            gain = hellinger(np.stack([left, right]))
            best = int(np.argmax(np.round(gain, 9)))
            info = 0.0
        else:
            gain, infos = gains(left, right)
            best = int(np.argmax(np.round(gain if rules.criterion != "gainratio" else gain / infos, 9)))
            info = float(infos[best])
        return float(cuts[best]), score(float(gain[best]), info, penalty, rules.criterion)
    threshold = float(cuts[0] + (cuts[-1] - cuts[0]) * draws[0])
    if rules.cuts == "totally_random":
        return threshold, draws[1]
    below = values < threshold
    gain, info = gains(counts[below].sum(axis=0), counts[~below].sum(axis=0))
    return threshold, float((gain - penalty) / info) if info else None


def code_split(counts: np.ndarray, rules: Rules, draws: tuple[float, float]) -> float | None:
    """Score of a discrete attribute's split; None where its largest branch leaves too few rows to the others."""
    if not len(counts):
        return None
    sizes = counts.sum(axis=1)
    n = sizes.sum()
    if sizes.max() > n - least_rows(n, rules.classes, rules.fixed, rules.dynamic):
        return None
    if rules.cuts == "totally_random":
        return draws[1]
    criterion = "gainratio" if rules.cuts == "extremely_random" else rules.criterion
    if criterion == "hellinger":
        return float(hellinger(counts[:, None, :])[0]) / math.sqrt(2)
    gain = float(entropy(counts.sum(axis=0)) - (sizes * entropy(counts)).sum() / n)
    info = float(log2(n) - (sizes * log2(sizes)).sum() / n)
    return gain if criterion == "infogain" else gain / info if info else None


def best_split(data: Data, at: np.ndarray, key: int, used: frozenset[int], tree: int, rules: Rules) -> tuple[int, float | None] | None:
    """Attribute and threshold (None: discrete) of the node of the rows at."""
    allowed = np.array([a for a in (rules.masks[tree] if rules.masks else range(rules.attributes)) if a not in used], np.int64)
    if not len(allowed):
        return None
    seeded = key + allowed * 1000003
    tried = allowed
    if rules.attributes_a_node:
        tried = allowed[np.lexsort((allowed, drawn(seeded, rules.seed)))]
    shares = {int(a): (x, y) for a, x, y in zip(allowed, drawn(seeded, rules.seed + 1) / float(MODULUS), (drawn(seeded, rules.seed + 2) + 1) / float(MODULUS), strict=True)} if rules.cuts != "best" else {}
    found: list[tuple[float, int, float | None]] = []
    for a in map(int, tried):
        values, counts = data.histogram(at, a, rules.classes)
        draws = shares.get(a, (0.0, 0.0))
        one = (None, code_split(counts, rules, draws)) if a in rules.discrete else number_split(values, counts, rules, draws)
        if one is not None and one[1] is not None:
            found.append((one[1], a, one[0]))
            if len(found) == rules.attributes_a_node:
                break
    good = [x for x in found if rules.zero_gain or x[0] > 1e-9]
    if not good:
        return None
    _, attribute, threshold = min(good, key=lambda x: (-round(x[0], 9), x[1]))
    return attribute, threshold


@dataclass
class Grown:
    """A subtree as lists; children of a node are next to each other and come after it. attribute -1: leaf."""

    attribute: list[int] = field(default_factory=list)
    threshold: list[float | None] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    children: list[int] = field(default_factory=list)
    counts: list[int] = field(default_factory=list)


def grown(data: Data, tree: int, key: int, used: frozenset[int], level: int, rules: Rules) -> Grown:
    """The subtree of a node of all rows of data."""
    out = Grown()
    todo = [(np.arange(len(data.labels)), key, used, level)]
    for at, key, used, level in todo:  # grows meanwhile
        counts = np.bincount(data.labels[at], data.weights[at], rules.classes)
        out.counts += [int(c) for c in counts]
        node = None
        if len(at) and level != rules.depth and not stops(tuple(int(c) for c in counts), rules.classes, rules.fixed, rules.dynamic):
            chosen = at
            if rules.subsample and rules.subsample < len(at):
                draws = drawn(data.rows[at], rules.seed + level)
                near = np.flatnonzero(draws <= np.partition(draws, rules.subsample - 1)[rules.subsample - 1])  # with ties of the last
                chosen = at[near[np.lexsort((data.rows[at[near]], draws[near]))[: rules.subsample]]]
            node = best_split(data, chosen, key, used, tree, rules)
        if node is None:
            out.attribute.append(-1)
            out.threshold.append(None)
            out.first.append(0)
            out.children.append(0)
            continue
        attribute, threshold = node
        x = data.values[at, attribute]
        n = 2 if threshold is not None else rules.discrete[attribute]
        branch = np.where(x < threshold, 0, 1) if threshold is not None else np.where((x >= 0) & (x < n - 1), x, n - 1).astype(np.int64)
        out.attribute.append(attribute)
        out.threshold.append(threshold)
        out.first.append(len(todo))
        out.children.append(n)
        below = used | {attribute} if threshold is None else used
        todo += [(at[branch == i], child_key(key, i), below, level + 1) for i in range(n)]
        data_done = len(out.attribute) - 1
        todo[data_done] = None  # its rows are with its children now
    return out
