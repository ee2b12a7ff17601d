"""Run configuration: closed dataclasses with checks, read from YAML."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any, get_type_hints


class ConfigError(ValueError):
    """A configuration that must not run."""


def _need(ok: bool, why: str) -> None:
    if not ok:
        raise ConfigError(why)


@dataclass(frozen=True)
class Model:
    backend: str
    name: str
    dtype: str = "bfloat16"
    max_new_tokens: int = 24
    base_url: str | None = None
    api_key_env: str = "OPENAI_API_KEY"
    request_timeout_s: float = 120.0
    max_retries: int = 4
    device: str = "auto"
    generation_batch_size: int = 1

    def __post_init__(self) -> None:
        _need(self.backend in ("local_transformers", "openai_compatible"), f"unknown backend {self.backend!r}")
        _need(self.dtype in ("float32", "bfloat16", "float16"), f"unknown dtype {self.dtype!r}")
        _need(self.device in ("auto", "cuda", "cpu"), f"unknown device {self.device!r}")
        _need(1 <= self.max_new_tokens <= 512 and self.request_timeout_s > 0 and 0 <= self.max_retries <= 10 and 1 <= self.generation_batch_size <= 256, "a model setting is out of range")
        local = self.backend == "local_transformers"
        _need(local or self.generation_batch_size == 1, "generation_batch_size is for the local backend only")
        _need(local or self.device == "auto", "device is for the local backend only")


@dataclass(frozen=True)
class Greedy:
    temperature: float = 0.0
    top_p: float = 1.0
    seed: int = 0
    top_logprobs: int = 5

    def __post_init__(self) -> None:
        _need(self.temperature == 0.0, "the greedy generation has temperature 0")
        _need(0 < self.top_p <= 1 and 1 <= self.top_logprobs <= 20, "a greedy setting is out of range")


@dataclass(frozen=True)
class Sampling:
    n_samples: int = 5
    temperature: float = 0.7
    top_p: float = 0.9
    seed_base: int = 1000
    ablation_n: tuple[int, ...] = (1, 2, 3, 5)

    def __post_init__(self) -> None:
        _need(0 < self.temperature <= 2, "samples need a temperature above 0, or all are equal")
        _need(1 <= self.n_samples <= 32 and 0 < self.top_p <= 1, "a sampling setting is out of range")
        _need(max(self.ablation_n) <= self.n_samples, "an ablation level exceeds n_samples")

    def seed_for(self, index: int) -> int:
        return self.seed_base + index


@dataclass(frozen=True)
class NLI:
    model_name: str = "MoritzLaurer/DeBERTa-v3-base-mnli"
    entailment_threshold: float = 0.5
    max_length: int = 128
    batch_size: int = 16
    entailment_label: str = "entailment"
    primary_clusterer: str = "exhaustive"
    audit_fraction: float = 0.2
    force_full_audit: bool = False

    def __post_init__(self) -> None:
        _need(self.primary_clusterer in ("exhaustive", "greedy"), f"unknown clusterer {self.primary_clusterer!r}")
        _need(0 <= self.entailment_threshold <= 1 and 0 <= self.audit_fraction <= 1, "a share is outside 0..1")
        _need(16 <= self.max_length <= 512 and 1 <= self.batch_size <= 256, "an entailment setting is out of range")


@dataclass(frozen=True)
class Signals:
    length_penalty_alpha: float = 0.6
    perplexity_clamp: float = 20.0
    verbal_confidence_max: int = 100

    def __post_init__(self) -> None:
        _need(0 <= self.length_penalty_alpha <= 2 and 0 < self.perplexity_clamp <= 100 and self.verbal_confidence_max >= 1, "a signal setting is out of range")


@dataclass(frozen=True)
class Mix:
    popqa: int = 0
    triviaqa: int = 0
    simpleqa: int = 0

    def __post_init__(self) -> None:
        _need(min(self.popqa, self.triviaqa, self.simpleqa) >= 0 and self.total > 0, "the dataset mix is empty")

    @property
    def total(self) -> int:
        return self.popqa + self.triviaqa + self.simpleqa


@dataclass(frozen=True)
class Difficulty:
    triviaqa_easy_only: bool = False
    popqa_popularity_quantile: float | None = None
    triviaqa_min_aliases: int = 12
    popqa_relations: tuple[str, ...] | None = None
    allow_inverse_relations: bool = False
    drop_gold_in_question: bool = False

    def __post_init__(self) -> None:
        q = self.popqa_popularity_quantile
        _need(q is None or 0 <= q < 1, "popqa_popularity_quantile is outside 0..1")
        _need(self.triviaqa_min_aliases >= 1, "triviaqa_min_aliases is below 1")


@dataclass(frozen=True)
class FewShot:
    enabled: bool = False
    pairs: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        _need(not self.enabled or len(self.pairs) > 0, "few-shot is on without exemplars")
        _need(all(q.strip() and a.strip() for q, a in self.pairs), "an exemplar is blank")


@dataclass(frozen=True)
class PilotGate:
    n_questions: int = 100
    error_rate_low: float = 0.25
    error_rate_high: float = 0.65
    max_iterations: int = 2

    def __post_init__(self) -> None:
        _need(0 <= self.error_rate_low < self.error_rate_high <= 1, "the band is not ordered")
        _need(self.n_questions >= 20 and 1 <= self.max_iterations <= 5, "a pilot setting is out of range")


@dataclass(frozen=True)
class Judges:
    primary: Model
    secondary: Model
    cross_validation_n: int = 100
    kappa_trust_threshold: float = 0.7
    secondary_seed: int = 4242

    def __post_init__(self) -> None:
        _need(self.cross_validation_n >= 20 and 0 <= self.kappa_trust_threshold <= 1, "a judge setting is out of range")


@dataclass(frozen=True)
class Split:
    train_fraction: float = 0.3
    seed: int = 20260101

    def __post_init__(self) -> None:
        _need(0.05 <= self.train_fraction <= 0.6, "train_fraction is outside 0.05..0.6")


@dataclass(frozen=True)
class Analysis:
    bootstrap_resamples: int = 10_000
    bootstrap_seed: int = 987654321
    ci_level: float = 0.95
    ece_bins: int = 15
    target_accuracy: float = 0.90
    logreg_cv_folds: int = 5
    logreg_seed: int = 31337
    min_meaningful_auroc_gap: float = 0.02
    holm_alpha: float = 0.05
    nondeterminism_probe_n: int = 50
    cluster_bootstrap: bool = False

    def __post_init__(self) -> None:
        _need(self.bootstrap_resamples >= 100 and 2 <= self.ece_bins <= 100 and 2 <= self.logreg_cv_folds <= 20, "an analysis setting is out of range")
        _need(0 < self.ci_level < 1 and 0 <= self.target_accuracy <= 1 and 0 <= self.holm_alpha <= 1, "an analysis share is outside 0..1")


@dataclass(frozen=True)
class Paths:
    raw_dir: str = "data/raw"
    cache_dir: str = "data/cache"
    artifacts_dir: str = "data/artifacts"
    figures_dir: str = "figures"
    results_json: str = "results_default.json"
    human_validation_csv: str = "data/human_validation_sample.csv"
    fuzzy_decided_csv: str | None = None
    labels_checkpoint: str = "labels.parquet"


@dataclass(frozen=True)
class Prompts:
    system: str
    user_template: str
    verify_template: str
    verify_with_samples_template: str
    verbal_confidence_template: str
    abstain_token: str = "UNKNOWN"

    def __post_init__(self) -> None:
        for text, slots in ((self.user_template, ["question"]), (self.verify_template, ["question", "answer"]), (self.verify_with_samples_template, ["question", "answer", "samples"])):
            for s in slots:
                _need(f"{{{s}}}" in text, f"a template lacks {{{s}}}")


@dataclass(frozen=True)
class Config:
    run_name: str
    model_under_test: Model
    greedy: Greedy
    sampling: Sampling
    nli: NLI
    dataset_mix: Mix
    pilot_gate: PilotGate
    judges: Judges
    split: Split
    analysis: Analysis
    prompts: Prompts
    signals: Signals = field(default_factory=Signals)
    difficulty: Difficulty = field(default_factory=Difficulty)
    few_shot: FewShot = field(default_factory=FewShot)
    paths: Paths = field(default_factory=Paths)
    dataset_seed: int = 12345
    baseline_config: str | None = None
    comparability_note: str | None = None
    is_pilot: bool = False

    def __post_init__(self) -> None:
        for judge in (self.judges.primary, self.judges.secondary):
            _need(judge.name != self.model_under_test.name, "a judge differs from the model under test")
        if self.baseline_config is not None:
            before = load(self.baseline_config).difficulty.popqa_popularity_quantile
            moved = before != self.difficulty.popqa_popularity_quantile
            _need(not moved or bool((self.comparability_note or "").strip()), "the popularity quantile moved against the baseline without a comparability_note")


def _made(kind: type, raw: Any, where: str) -> Any:
    _need(isinstance(raw, dict), f"{where} is not a mapping")
    hints, known = get_type_hints(kind), {f.name for f in fields(kind)}
    _need(not (odd := sorted(set(raw) - known)), f"{where} has unknown keys {odd}")
    values = {}
    for k, v in raw.items():
        if is_dataclass(hints[k]):
            values[k] = _made(hints[k], v, f"{where}.{k}")
        else:
            values[k] = tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v
    try:
        return kind(**values)
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from None


def load(path: str | Path) -> Config:
    """Read and check a YAML file; unknown keys and missing sections raise."""
    import yaml

    return _made(Config, yaml.safe_load(Path(path).read_text(encoding="utf-8")), "config")
