"""Estimators on DataFrames: fit by aggregation, predict by one projection."""

from .block import BlockClassifier, Refinement
from .classify import MultiLabelClassifier, SharedClassifier, StateClassifier
from .regress import FusedRegressor, GeneralizedRegressor, MultiOutputRegressor, ResolutionRegressor, StateRidgeRegressor
from .search import GridSearch

__all__ = ["BlockClassifier", "FusedRegressor", "GeneralizedRegressor", "GridSearch", "MultiLabelClassifier", "MultiOutputRegressor", "Refinement", "ResolutionRegressor", "SharedClassifier", "StateClassifier", "StateRidgeRegressor"]
