"""Text simplification, translation and its evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

from clearlines.operators.generate import HEURISTIC, IDENTITY, Generator, Rule
from clearlines.operators.ladder import THREE, TWO, UNGATED, Attempt, Ladder
from clearlines.plans.simplify import simplify, simplify_and_translate, simplify_by_rule

__all__ = ["HEURISTIC", "IDENTITY", "THREE", "TWO", "UNGATED", "Attempt", "Generator", "Ladder", "Rule",
           "simplify", "simplify_and_translate", "simplify_by_rule"]

# functions sent to workers travel with their code, so workers need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
