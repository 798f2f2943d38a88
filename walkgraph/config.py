"""Settings, from the environment where it has them."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, field, fields

from walkgraph.errors import InvalidAlpha, InvalidWalksPerNode


@dataclass(frozen=True)
class WalkConfig:
    """alpha is the probability that a walk goes on."""

    alpha: float = 0.85
    walks_per_node: int = 100
    seed: int = 42

    def __post_init__(self):
        if not 0 < self.alpha < 1:
            raise InvalidAlpha(self.alpha)
        if self.walks_per_node < 1:
            raise InvalidWalksPerNode(self.walks_per_node)


@dataclass(frozen=True)
class EngineConfig:
    """Names in the environment are the fields' in capitals; lists are comma-separated."""

    state_path: str = "state"
    events_path: str = "events"
    init_pubkeys: tuple[str, ...] = ()
    query_batch_size: int = 50
    query_interval: int = 60
    node_arbiter_activation_threshold: float = 0.001
    promotion_multiplier: float = 0.1
    demotion_multiplier: float = 1.05
    promotion_wait_period: int = 3600
    max_files_per_trigger: int = 1000
    display_stats: bool = False
    walks: WalkConfig = field(default_factory=WalkConfig)

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None) -> EngineConfig:
        env = dict(os.environ if env is None else env)
        found: dict[str, object] = {}
        for f in fields(cls):
            raw = env.get(f.name.upper())
            if raw is None or f.name == "walks":
                continue
            default = f.default
            if isinstance(default, bool):
                found[f.name] = raw.strip().lower() in ("1", "true", "yes")
            elif isinstance(default, tuple):
                found[f.name] = tuple(x.strip() for x in raw.split(",") if x.strip())
            else:
                found[f.name] = type(default)(raw)
        return cls(**found)

    def __str__(self) -> str:
        return "\n".join(f"{f.name}: {getattr(self, f.name)}" for f in fields(self))


def logger(name: str = "walkgraph") -> logging.Logger:
    """Lines begin with their level."""
    log = logging.getLogger(name)
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter("%(levelname)s: %(asctime)s %(message)s"))
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
