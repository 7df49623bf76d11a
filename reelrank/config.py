"""Job parameters (pipeline_config) and request validation.

A plain dataclass: no I/O of its own. Defaults are the reference values.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class JobConfig:
    # activity thresholds before training
    min_ratings_user: int = 50
    min_ratings_movie: int = 100
    # sample sizes of the reference training run (M1); None = full data
    cv_sample_size: int | None = 100_000
    knn_sample_size: int | None = 20_000
    train_sample_size: int | None = 200_000
    predict_sample_size: int | None = 2_000_000
    predict_seed: int = 42
    cv_folds: int = 3
    # serving
    top_n: int = 5
    users_id: tuple[int, ...] = (1,)
    cold_start_genres: int = 3
    popular_min_ratings: int = 10
    damping: int = 100
    # monitoring
    drift_threshold_pct: float = 10.0
    ks_alpha: float = 0.05
    drift_sample_rows: int = 10_000
    novelty_min_ratings: int = 100
    novelty_top: int = 100
    stats_days: int = 7
    # model
    mf_rank: int = 10
    mf_max_iter: int = 10
    mf_reg: float = 0.1
    mf_blocks: int = 10
    extra: dict = field(default_factory=dict)

    def mf_params(self) -> dict:
        return {"rank": self.mf_rank, "max_iter": self.mf_max_iter, "reg": self.mf_reg, "blocks": self.mf_blocks}

    def with_overrides(self, **kw) -> "JobConfig":
        return replace(self, **kw)


def validate_top_n(top_n: int) -> int:
    """1 <= top_n <= 50, checked before any plan is built."""
    if not isinstance(top_n, int) or isinstance(top_n, bool) or not 1 <= top_n <= 50:
        raise ValueError("top_n must be an integer within 1..50")
    return top_n
