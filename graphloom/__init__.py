"""Graph fusion and analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors with the plan, which needn't have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
