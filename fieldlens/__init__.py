"""Survey data-quality checks as Spark DataFrame expressions.

Public entry points::

    from fieldlens import run_checks, profile
    flagged = run_checks(survey_df, profile.batch())
"""

from . import profile
from .plans.engine import any_flag, module_flag_columns, module_view, modules_in, run_checks
from .sources.survey import coerce_types, load_survey

__all__ = [
    "any_flag", "coerce_types", "load_survey", "module_flag_columns", "module_view",
    "modules_in", "profile", "run_checks",
]
