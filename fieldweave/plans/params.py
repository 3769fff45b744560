"""Decomposition parameters, validated once."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

MEAN_TYPES = ("longtime", "blockwise", "zero")


@dataclass(frozen=True)
class SpodParams:
    """n_dft snapshots a block, time step dt, overlap in percent; see the fields for options and defaults."""

    n_dft: int
    time_step: float
    n_space_dims: int = 1
    n_variables: int = 1
    overlap: float = 0.0
    mean_type: str = "longtime"
    conf_level: float = 0.95
    reuse_blocks: bool = False
    savefft: bool = False
    fullspectrum: bool = False
    complex_data: bool = False
    normalize_weights: bool = False
    normalize_data: bool = False
    n_modes_save: int | None = None
    dtype: str = "double"
    savedir: str | None = None
    #: Doubles interior energies of real data even with fullspectrum (the behaviour of the original tool).
    double_fullspectrum: bool = False

    def __post_init__(self):
        if isinstance(self.n_dft, bool) or not isinstance(self.n_dft, int):
            raise TypeError("n_dft must be an integer")
        if self.n_dft < 4:
            raise ValueError("a block needs at least 4 snapshots")
        if self.mean_type not in MEAN_TYPES:
            raise ValueError(f"mean_type must be one of {MEAN_TYPES}")
        if self.n_overlap > self.n_dft - 1:
            raise ValueError("overlap leaves no step between blocks")
        if not 0 < self.conf_level < 1:
            raise ValueError("conf_level must lie between 0 and 1")
        if self.dtype not in ("double", "single", "float64", "float32"):
            raise ValueError(f"unknown dtype {self.dtype!r}")

    @property
    def n_overlap(self) -> int:
        return math.ceil(self.n_dft * self.overlap / 100)

    @property
    def step(self) -> int:
        return self.n_dft - self.n_overlap

    @property
    def one_sided(self) -> bool:
        return not self.complex_data and not self.fullspectrum

    @property
    def n_freq(self) -> int:
        return self.n_dft // 2 + 1 if self.one_sided else self.n_dft

    @property
    def window(self) -> list[float]:
        return [0.54 - 0.46 * math.cos(2 * math.pi * n / (self.n_dft - 1)) for n in range(self.n_dft)]

    @property
    def gain(self) -> float:
        return self.n_dft / sum(self.window)

    def n_blocks(self, nt: int) -> int:
        n = (nt - self.n_overlap) // self.step
        if n < 2:
            raise ValueError(f"{nt} snapshots give {n} blocks; at least 2 are needed")
        return n

    def frequencies(self) -> list[float]:
        """One-sided for real data; all bins in transform order; for complex data with the upper half negative."""
        f = [k / (self.n_dft * self.time_step) for k in range(self.n_freq)]
        if self.complex_data and not self.fullspectrum:
            f = [x - 1 / self.time_step if 2 * k >= self.n_dft else x for k, x in enumerate(f)]
        return f

    def describe(self) -> str:
        return "\n".join(f"{k:<22}{v}" for k, v in asdict(self).items())

    def to_dict(self) -> dict:
        return asdict(self)

    @classmethod
    def from_dict(cls, values: dict) -> SpodParams:
        return cls(**{k: v for k, v in values.items() if k in cls.__dataclass_fields__})

    def with_(self, **changes) -> SpodParams:
        return replace(self, **changes)
