"""Analysis parameters, all in one frozen object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Parameters of one analysis run.

    ``candidates`` is ordered: every tie between candidates goes to the one that comes first.
    The grids (alphas, lambdas, thresholds) are small by nature and are used as literals.
    """

    candidates: tuple[str, ...] = ("m0", "m1", "m2", "m3")

    # Cost weights, risk penalties, failure thresholds, ratios and tolerances
    # that results depend on.
    alphas: tuple[float, ...] = (0.1, 0.3, 0.5, 0.7, 1.0)
    lambdas: tuple[float, ...] = (0.0, 0.25, 0.5, 1.0, 2.0, 3.0, 4.0)
    members: int = 10
    seed: int = 42
    train_ratio: float = 0.70
    validation_ratio: float = 0.15
    clip_percentile: float = 0.99
    failure_thresholds: tuple[float, ...] = (0.0, 0.05, 0.10)
    tail_fraction: float = 0.20
    material_regret: float = 0.05
    resamples: int = 10_000
    accuracy_tolerance: float = 1e-6
    cost_tolerance: float = 1e-10
    mechanism_alpha: float = 0.5
    # Boosted trees: rounds at most, rounds without improvement, step, depth, rows of a leaf, shares of rows and columns.
    boost_rounds: int = 1000
    boost_patience: int = 50
    boost_step: float = 0.03
    boost_depth: int = 4
    boost_leaf: int = 2
    boost_rows: float = 0.8
    boost_columns: float = 0.8

    # Queries that lack a candidate: "fail" raises an error, "drop" leaves them out of every later result.
    on_incomplete: str = "fail"

    # Sizes that decide between a plain plan and its scale-out form. Both give equal results.
    small_rows: int = 2_000_000
    broadcast_rows: int = 200_000
    order_buckets: int = 0  # ordered buckets (a power of two); 0: four per shuffle partition

    @property
    def k(self) -> int:
        return len(self.candidates)


DEFAULT = Params()
