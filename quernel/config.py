"""Run settings, overridable from the environment by each field's type."""

from __future__ import annotations

import json
import os
from collections.abc import Collection, Mapping
from dataclasses import dataclass, fields, replace
from typing import Any

PREFIX = "QUERNEL_"


@dataclass(frozen=True)
class Config:
    """Sizes and parameters of corpus building, calibration and decisions."""

    max_seq_len: int = 1024
    attn_last_k: int = 4
    hidden_layer_frac: tuple = (0.25, 0.75)
    n_clean: int = 1000
    n_inj_per_cell: int = 50
    split_frac: tuple = (0.6, 0.2, 0.2)
    synthetic_clean: bool = False
    clean_passage_max_chars: int = 700
    clean_query_max_chars: int = 160
    n_base_pairs: int = 1650
    local_clean_csv: str = ""
    calib_h_samples: int = 160
    calib_per_specialist: int = 160
    probe_fit_frac: float = 0.7
    alpha_step: float = 0.05
    target_fpr: float = 0.05
    meta_mode: str = "per_spec"
    top_k_heads: int = 5
    tail_len: int = 48
    unseen_type: str = "combined"
    epsilon: float = 1e-6
    quant_compare_n: int = 50
    quant_ref_chain: str = "fp16,bf16,int8,nf4"
    n_validate: int = 12
    n_latency_runs: int = 50
    seed: int = 42
    test_mode: bool = False

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Config:
        """Each field may be set as QUERNEL_<NAME>: booleans by word, tuples as JSON, numbers and text as they are."""
        env = os.environ if env is None else env
        out: dict[str, Any] = {}
        for f in fields(cls):
            raw = env.get(PREFIX + f.name.upper())
            if raw is not None:
                out[f.name] = _coerce(raw, f.default)
        made = cls(**out)
        return made.shrunk() if made.test_mode else made

    def shrunk(self) -> Config:
        """Sizes for a quick run: few rows in every stratum, calibration within them."""
        caps = {"calib_h_samples": 24, "calib_per_specialist": 24, "quant_compare_n": 8, "n_validate": 4, "n_latency_runs": 10}
        return replace(self, n_clean=20, n_inj_per_cell=5, max_seq_len=384, **{k: min(getattr(self, k), v) for k, v in caps.items()})

    def candidate_layers(self, n_layers: int) -> list[int]:
        low, high = (int(n_layers * f) for f in self.hidden_layer_frac)
        return list(range(max(0, low), min(n_layers, high) + 1))

    def reference_precisions(self) -> list[str]:
        return [p.strip() for p in self.quant_ref_chain.split(",") if p.strip()]

    def precision(self, known: Collection[str]) -> str:
        """The first of the chain of precisions that is known."""
        for p in self.reference_precisions():
            if p in known:
                return p
        raise ValueError(f"none of {self.quant_ref_chain} is one of {', '.join(sorted(known))}")


def _coerce(raw: str, like: Any) -> Any:
    if isinstance(like, bool):
        return raw.strip().lower() in {"1", "true", "yes", "on"}
    if isinstance(like, tuple):
        return tuple(json.loads(raw))
    return type(like)(raw)
