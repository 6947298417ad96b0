"""Complex-sample household-survey analytics on Spark."""

from surveyspan.operators.design import SurveyDesign, design_summary
from surveyspan.operators.estimate import estimate_many, point_estimate

__all__ = ["SurveyDesign", "design_summary", "estimate_many", "point_estimate"]
