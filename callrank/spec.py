"""Feature specification: which columns play which role.

The engine is schema-driven; nothing is hard-wired to one input layout.
"""

from __future__ import annotations

from dataclasses import dataclass, field


class LeakageError(ValueError):
    """A leakage column was asked for as a feature."""


@dataclass(frozen=True)
class FeatureSpec:
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    target: str = "y"
    positive: object = "yes"
    leakage: tuple[str, ...] = ()
    # column -> (old sentinel, new sentinel); new None means "to null"
    sentinels: dict = field(default_factory=dict)
    null_tokens: tuple[str, ...] = ()
    key: tuple[str, ...] = ()
    seed: int = 42
    label: str = "label"

    def __post_init__(self):
        bad = set(self.features) & set(self.leakage)
        if bad:
            raise LeakageError(f"leakage columns used as features: {sorted(bad)}")
        if self.target in self.features:
            raise LeakageError(f"target {self.target!r} used as a feature")

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(self.numeric) + tuple(self.categorical)

    @property
    def columns(self) -> tuple[str, ...]:
        """Columns a preparation step needs to read (for column pruning)."""
        seen, out = set(), []
        for c in (*self.key, *self.features, self.target, *self.sentinels):
            if c not in seen:
                seen.add(c)
                out.append(c)
        return tuple(out)
