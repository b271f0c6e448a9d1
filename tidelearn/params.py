"""Hyper-parameters of the learners; defaults as published for each method."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Base of all parameter sets.  ``override`` returns a changed copy."""

    def override(self, **changes):
        known = {f.name for f in fields(self)}
        unknown = sorted(set(changes) - known)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameter {', '.join(unknown)}")
        return replace(self, **changes)


@dataclass(frozen=True)
class RidgeParams(Params):
    dimension: int = 2
    window: int = 100
    penalty: float = 1.0
    warmup: int = 50
    sentinel: float = -9.0


@dataclass(frozen=True)
class LassoParams(Params):
    dimension: int = 2
    window: int = 100
    penalty: float = 0.1
    warmup: int = 2000
    passes: int = 100
    tolerance: float = 1e-8
    zero_below: float = 1e-6
    sentinel: float = -9.0


@dataclass(frozen=True)
class SvmParams(Params):
    dimension: int = 2
    window: int = 100
    step: float = 0.01
    step_intercept: float = 0.01
    cost: float = 1.0
    start_weight: float = 0.1
    start_intercept: float = 0.1
    merge: str = "count"
    shards: int = 4
    sentinel: float = -9.0


@dataclass(frozen=True)
class SgdParams(Params):
    dimension: int = 2
    step: float = 0.1
    window: int = 1000
    iterations: int = 50
    reg: float = 0.1
    penalty: str = "l2"
    sentinel: float = -9.0


@dataclass(frozen=True)
class MixtureParams(Params):
    dimension: int = 2
    window: int = 50
    start_components: int = 3
    max_components: int = 10
    alpha: float = 0.5
    gate: float = 5.0
    merge_below: float = 0.01
    split_above: float = 1.0
    split_share: float = 0.8
    jitter: float = 1e-6
    warmup: int = 1000
    sentinel: float = -1.0


@dataclass(frozen=True)
class TopicParams(Params):
    topics: int = 20
    alpha: float = 0.01
    eta: float = 0.01
    passes: int = 5
    tolerance: float = 0.001
    offset: float = 50.0
    decay: float = 0.7
    # Documents of the whole corpus; None: those given to ``fit``.  A stream must state it.
    documents: int | None = None
    seed: int = 0
