"""tablesight: tabular analysis as Spark jobs (profile, clean, diagnose, model, recommend, report).

Entry points for a table: ``diagnose``, ``analyze`` and ``run_all``; every operator
in ``tablesight.operators`` takes and returns DataFrames.
"""

from .operators.clean import CleaningPlan
from .operators.profile import overview, profile_columns
from .plans.analysis import analyze, diagnose, run_all
from .session import get_spark

__all__ = ["CleaningPlan", "analyze", "diagnose", "get_spark", "overview", "profile_columns", "run_all"]
