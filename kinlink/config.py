"""Every constant of matching in one place."""

from dataclasses import dataclass


# The defaults must equal those of the system to be matched.
@dataclass(frozen=True)
class Config:
    max_block: int = 200  # records that share a key, and the numerator of its rarity
    pre_k: int = 150
    top_k: int = 50
    neutral: float = 50.0  # likeness of names of which one is empty
    train_sample: int = 250_000
    seed: int = 42
    max_trees: int = 600
    stage2_trees: int = 300
    folds: int = 5
    taus: tuple[float, ...] = (0.01, 0.02, 0.05, 0.10, 0.15, 0.20)
    tolerance: float = 0.001
    t_top: float = 0.65  # the published operating point
    t_rest: float = 0.65
    tau: float = 0.20
    threads: int = 4  # fits of folds at a time


def single_grid() -> list[float]:
    return [round(0.30 + 0.05 * i, 2) for i in range(14)]


def pair_grid() -> list[tuple[float, float]]:
    tops = [round(0.10 + 0.05 * i, 2) for i in range(12)]
    return [(t, round(r / 100, 2)) for t in tops for r in range(max(50, round(100 * t)), 96, 5)]


def stage2_grid() -> list[float]:
    return [round(0.30 + 0.05 * i, 2) for i in range(13)]
