"""Strategies by which one version of a keyed table is coded against another, and the registry that picks one.

A strategy looks at both versions and either declines or gives a plan, a table; from the old version and the plan it
makes the new one. The first strategy by id that does not decline is taken; the one with id 0 never declines and comes
last. What a plan makes is checked against the digest that travels with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from tidemark.plans import versions


class Strategy(Protocol):
    """``finish`` is optional: what can be computed again from the finished table, such as a checksum column."""

    id: int
    name: str

    def analyse(self, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame | None: ...

    def materialise(self, old: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame: ...


class Changes:
    """Deletes and puts by key; takes any pair."""

    id, name = 0, "changes"

    def analyse(self, old, new, keys):
        return versions.diff(old, new, keys)

    def materialise(self, old, plan, keys):
        return versions.patch(old, plan, keys)


class Same:
    """Tables with equal rows: an empty plan."""

    id, name = 1, "same"

    def analyse(self, old, new, keys):
        return new.limit(0) if versions.verify(old, new) else None

    def materialise(self, old, plan, keys):
        return old.select(*plan.columns)


class Appended:
    """Every old row unchanged, others added: the added rows."""

    id, name = 2, "appended"

    def analyse(self, old, new, keys):
        changes = versions.changes(old, new, keys)
        return None if changes.where("_known").limit(1).count() else changes.select(*new.columns)

    def materialise(self, old, plan, keys):
        return old.select(*plan.columns).unionByName(plan)


class Registry:
    """Strategies by id; an id may be given once."""

    def __init__(self, *strategies: Strategy):
        self._by_id: dict[int, Strategy] = {}
        for s in strategies or (Changes(), Same(), Appended()):
            self.add(s)

    def add(self, strategy: Strategy) -> None:
        if strategy.id in self._by_id:
            raise ValueError(f"strategy {strategy.id} is registered twice")
        self._by_id[strategy.id] = strategy

    def get(self, id: int) -> Strategy | None:
        return self._by_id.get(id)

    def candidates(self) -> list[Strategy]:
        return [self._by_id[i] for i in sorted(self._by_id)]


@dataclass(frozen=True)
class Patch:
    """A strategy's id, its plan, the keys and the (rows, digest) of what it makes."""

    strategy: int
    plan: DataFrame
    keys: list[str]
    digest: tuple


def encode(old: DataFrame, new: DataFrame, keys: list[str], registry: Registry, allowed: set[str] | None = None) -> Patch:
    """The patch of the first strategy (among the names in ``allowed``, if given) that takes the pair, else of the one with id 0.
    Versions whose columns or types differ are an error."""
    if sorted(old.dtypes) != sorted(new.dtypes):
        raise ValueError("the versions differ in their columns")
    seal = tuple(versions.digest(new).first())
    for s in registry.candidates():
        if s.id and (allowed is None or s.name in allowed):
            plan = s.analyse(old, new, keys)
            if plan is not None:
                return Patch(s.id, plan, keys, seal)
    return Patch(0, registry.get(0).analyse(old, new, keys), keys, seal)


def apply(old: DataFrame, patch: Patch, registry: Registry) -> DataFrame:
    """The new table; an unknown strategy or another digest than the patch's is an error."""
    strategy = registry.get(patch.strategy)
    if strategy is None:
        raise ValueError(f"no strategy {patch.strategy}")
    out = strategy.materialise(old, patch.plan, patch.keys)
    if hasattr(strategy, "finish"):
        out = strategy.finish(out, patch.plan)
    if tuple(versions.digest(out).first()) != tuple(patch.digest):
        raise ValueError("the patched table does not have the wanted digest")
    return out
