"""cellsieve: declarative validation of large all-string tables on Spark.

A specification is compiled into Column expressions; one scan of the table
yields a long issues relation, and uniqueness, statistics, views and exports
are ordinary DataFrame plans over it.
"""

import sys

from pyspark import cloudpickle

from cellsieve.spec import ColumnSpec, DatasetSpec, Template, UniqueTogether
from cellsieve.plans.cells import cell_issues
from cellsieve.plans.validate import Validation, validate

# The few Python helpers travel with their plans, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "ColumnSpec",
    "DatasetSpec",
    "Template",
    "UniqueTogether",
    "Validation",
    "cell_issues",
    "validate",
]
