"""Descriptors as objects: what a featuriser or a network has to know of one, whatever it computes."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from ..functions.scalars import typespins
from . import network, spatial


class Featuriser(Protocol):
    """What makes features of atoms."""

    @property
    def n_features(self) -> int: ...

    def features(self, atoms: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
        """(keys, aid, species, fingerprint) of atoms (keys, aid, species, x, y, z, and for periodic ones cell)."""
        ...


@dataclass(frozen=True)
class Chebyshev:
    """Radial and angular Chebyshev features of declared species, in whose order their typespins are."""

    species: tuple[str, ...]
    rad_cutoff: float
    rad_order: int
    ang_cutoff: float
    ang_order: int
    min_cutoff: float = 0.0

    def __post_init__(self):
        if len(set(self.species)) != len(self.species) or not self.species:
            raise ValueError("species are one or more different names")
        if not 0 <= self.min_cutoff < min(self.rad_cutoff, self.ang_cutoff) or min(self.rad_order, self.ang_order) < 0:
            raise ValueError("cutoffs lie above the smallest distance, and orders begin at 0")

    @property
    def spins(self) -> dict[str, int]:
        return dict(zip(self.species, typespins(len(self.species)), strict=True))

    @property
    def settings(self) -> tuple[float, int, float, int]:
        return self.rad_cutoff, self.rad_order, self.ang_cutoff, self.ang_order

    @property
    def n_features(self) -> int:
        return (self.rad_order + self.ang_order + 2) * (2 if len(self.species) > 1 else 1)

    def features(self, atoms: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
        return self.with_edges(atoms, keys)[0]

    def with_edges(self, atoms: DataFrame, keys: tuple[str, ...] = ("sid",)) -> tuple[DataFrame, DataFrame]:
        """Features, and the edges that they are made of."""
        return spatial.describe(atoms, self.spins, self.settings, self.min_cutoff, keys)

    def gradients(self, edges: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
        return network.gradients(edges, *self.settings, self.spins, self.min_cutoff, keys)

    def manifest(self) -> str:
        """Canonical JSON, equal for descriptors whose features are the same."""
        return json.dumps({"kind": "chebyshev", **asdict(self)}, sort_keys=True, separators=(",", ":"))

    @classmethod
    def restore(cls, manifest: str) -> Chebyshev:
        found = json.loads(manifest)
        if found.pop("kind", None) != "chebyshev":
            raise ValueError("the manifest is of another kind of descriptor")
        return cls(**found | {"species": tuple(found["species"])})
