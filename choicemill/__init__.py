"""choicemill: decision analytics over (query, candidate, outcome) tables, as Spark plans."""

from choicemill.params import DEFAULT, Params

__all__ = ["DEFAULT", "Params"]
