"""What estimators of each kind offer, as protocols that ``isinstance`` checks."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable


@runtime_checkable
class EstimatorLike(Protocol):
    def fit(self, df: Any, features: Any, *rest: Any) -> Any: ...


@runtime_checkable
class TransformerLike(EstimatorLike, Protocol):
    def transform(self, df: Any, features: Any = None) -> Any: ...


@runtime_checkable
class PredictorLike(EstimatorLike, Protocol):
    def predict(self, df: Any, features: Any = None, out: str = "prediction") -> Any: ...

    def score(self, df: Any, label: str | None = None) -> float: ...


@runtime_checkable
class ClassifierLike(PredictorLike, Protocol):
    classes_: list


@runtime_checkable
class IncrementalLike(Protocol):
    def partial_fit(self, df: Any, features: Any, *rest: Any) -> Any: ...


@runtime_checkable
class MultiOutputRegressorLike(Protocol):
    def fit_multi(self, df: Any, features: Any, labels: Any) -> Any: ...

    def predict_multi(self, df: Any, features: Any = None, out: str = "prediction") -> Any: ...


@runtime_checkable
class ParametrizedLike(Protocol):
    def get_params(self) -> dict[str, Any]: ...

    def set_param(self, name: str, value: Any) -> Any: ...
