"""All parameters of the procurement analytics, with the defaults that the queries use."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    abc_a: int = 80  # per cent of value that class A covers
    abc_b: int = 95  # and classes A and B together
    adi_cutoff: float = 1.32  # Syntetos-Boylan: mean interval between demands
    cv2_cutoff: float = 0.49  # and squared variation of demand sizes
    bucket: str = "quarter"  # length of a demand period: month or quarter
    alpha: float = 0.1  # TSB: smoothing of the demand probability
    beta: float = 0.2  # and of the demand size
    start_probability: float = 0.5
    glm_steps: int = 8
    trees: int = 20
    tree_depth: int = 3
    lags: int = 3
    forest: str = "item"  # a forest for each item, or one "pooled" over all
    pooled_trees: int = 50
    horizon: int = 4
    holdout: int = 4
    backtest_from: int = 8  # periods that the first origin of a backtest has seen
    clusters: int = 3
    seed: int = 42
    top_n: int = 10
