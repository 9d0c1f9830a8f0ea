"""Streams through frozen parameters: the batch functions on streaming input."""

from __future__ import annotations

from pyspark.sql import DataFrame

from choicemill.operators import conditioning, ensemble, grading, routing
from choicemill.params import DEFAULT, Params


def scored(stream: DataFrame, medians: DataFrame, cost: conditioning.CostRange, stats: DataFrame,
           keys: dict[str, str], lambdas: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Condition costs, predict, and decide for arriving queries.

    All parameters are static tables, so the query keeps no state: it is a chain of projections
    and stream-static joins.
    """
    cleaned = conditioning.with_clean_costs(stream, medians, params)
    core = conditioning.conditioned(cleaned, cost, params)
    state = ensemble.routing_state(core, stats, keys, params)
    return routing.decisions(routing.two_routers(state, lambdas), params)


def graded_usage(stream: DataFrame, graders: dict[str, str], prices: dict[str, tuple[float, float]]) -> DataFrame:
    """Grade arriving answers and price their tokens."""
    return grading.token_cost(grading.graded(stream, graders), prices)
