"""Constants of the model. Values are fixed; structure is ours."""

from __future__ import annotations

from dataclasses import dataclass, field

# Sources with their attention and sentiment weights; windows, thresholds and amounts.
SOURCES = ("reddit", "hackernews", "wikipedia", "search", "github")
TEXT_SOURCES = ("reddit", "hackernews")
UNUSUAL_SOURCES = ("wikipedia", "github", "search")
ATTENTION_WEIGHTS = {"reddit": 0.30, "hackernews": 0.15, "wikipedia": 0.25, "search": 0.20, "github": 0.10}
SENTIMENT_WEIGHTS = {"reddit": 0.65, "hackernews": 0.35}
ASPECT_WEIGHTS = {"investment": 1.0, "reputation": 0.75, "product": 0.5, "general": 0.6}
COMPONENT_WEIGHTS = {"abnormal_attention": 0.25, "sentiment": 0.30, "attention_acceleration": 0.20, "sentiment_acceleration": 0.10, "confirmation": 0.10, "unusual_source": 0.05}
SHORT_WINDOW, BASELINE_WINDOW, MIN_BASELINE, MIN_SHORT, Z_CLIP, SCALE_FLOOR = 7, 30, 20, 4, 4.0, 0.08
SENTIMENT_K, ASPECT_K, MIN_MENTIONS = 4.0, 6.0, 3
SAMPLE_SCALE, STALE_AFTER, FRESH_LIMIT = 40.0, 2, 7
EXPONENTS = {"coverage": 0.35, "sample": 0.30, "freshness": 0.15, "quality": 0.20}
PENALTIES = {"tiny_sample": (15.0, 0.30), "duplicates": (0.30, 0.20), "single_source": (0.80, 0.15), "stale": (0.60, 0.15), "ambiguity": (0.30, 0.10), "bots": (0.15, 0.20), "hype": (3.0, 0.20)}
HYPE_OTHERS, PENALTY_CAP = 1.0, 0.80
EVENT_Z, REFRACTORY_DAYS, DIVERGENCE_EVENT, PRODUCT_EVENT = 3.5, 7, 85, -0.6
HISTORY_DAYS, LOOKBACK_DAYS, RETENTION_DAYS, MIN_RELEVANCE = 240, 60, 45, 0.5
WARM_UP_DAYS, MIN_DATES, MIN_SCENARIO_DATES, CONFIDENCE_FLOORS = 37, 10, 5, (0, 25, 50, 70)
MIN_CROSS_SECTION, HORIZONS, MIN_GROUP, SPLIT, FOLDS = 20, (1, 5, 10, 20), 6, (0.6, 0.2, 0.2), 4
BOOTSTRAP_ROUNDS, BOOTSTRAP_BLOCK = 1000, 3
WINDOWS = (7, 30, 90)
#: Name and version of the composite model that runs are entered with; another version for other weights or rules.
COMPOSITE_VERSION = "weighted-composite@1"


def component_weights(custom: dict[str, float] | None = None) -> dict[str, float]:
    """Defaults merged with ``custom``, negatives taken as 0, scaled to sum 1; all 0 if none is positive."""
    merged = {k: max(0.0, v) for k, v in (COMPONENT_WEIGHTS | (custom or {})).items() if k in COMPONENT_WEIGHTS}
    total = sum(merged.values())
    return {k: v / total if total else 0.0 for k, v in merged.items()}


@dataclass(frozen=True)
class ViewQuery:
    """Parameters of the view queries; ``parse`` falls back to the default of what is not valid (F1)."""

    window: int = 30
    source: str = "all"
    sector: str = "all"
    min_confidence: float = 0.0

    @staticmethod
    def parse(raw: dict[str, str]) -> ViewQuery:
        def number(key: str, default: float) -> float:
            try:
                return float(raw.get(key, default))
            except ValueError:
                return default

        window, confidence = number("window", 30), number("min_confidence", 0)
        source = raw.get("source", "all")
        return ViewQuery(int(window) if window in WINDOWS else 30, source if source in SOURCES else "all", raw.get("sector") or "all", confidence if 0 <= confidence <= 100 else 0.0)


@dataclass(frozen=True)
class LabParams:
    """Parameters of a research run (F2)."""

    features: tuple[str, ...] = ("alt_signal_score",)
    weights: dict[str, float] = field(default_factory=dict)
    component_weights: dict[str, float] = field(default_factory=dict)
    exclude_sources: tuple[str, ...] = ()
    horizon: int = 5
    start: str | None = None
    end: str | None = None
    top_rank: int | None = None
    sectors: tuple[str, ...] = ()
    min_confidence: float = 0.0

    def __post_init__(self) -> None:
        if not 1 <= len(self.features) <= 4:
            raise ValueError("one to four features")
        if self.horizon not in HORIZONS:
            raise ValueError(f"the horizon is one of {HORIZONS}")
        if any(not -5 <= w <= 5 for w in (*self.weights.values(), *self.component_weights.values())):
            raise ValueError("weights lie between -5 and 5")
        if set(self.exclude_sources) - set(SOURCES):
            raise ValueError("unknown source")
        if len(self.sectors) > 12 or self.top_rank not in (None, 25, 50, 100) or not 0 <= self.min_confidence <= 100:
            raise ValueError("sectors, universe or confidence out of range")
