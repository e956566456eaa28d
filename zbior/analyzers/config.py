"""Which analyzers run, with what parameters; read from and written to YAML or TOML."""

from __future__ import annotations

import tomllib
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Any


@dataclass
class AnalyzerConfig:
    name: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass
class AnalysisConfig:
    enabled: bool = True
    analyzers: list[AnalyzerConfig] = field(default_factory=list)


def from_dict(data: dict[str, Any]) -> AnalysisConfig:
    """Parameters may stand under ``params`` or ``config``; unknown keys are ignored, those of a crawler and its output among them (Spark has its own)."""
    analysis = data.get("analysis", data)
    own = [AnalyzerConfig(a["name"], dict(a.get("params") or a.get("config") or {})) for a in analysis.get("analyzers", [])]
    return AnalysisConfig(bool(analysis.get("enabled", True)), own)


def load_config(path: str) -> AnalysisConfig:
    """FileNotFoundError if it is missing, ValueError for another extension."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    if p.suffix in (".yaml", ".yml"):
        import yaml

        return from_dict(yaml.safe_load(p.read_text()) or {})
    if p.suffix == ".toml":
        return from_dict(tomllib.loads(p.read_text()))
    raise ValueError(f"neither YAML nor TOML: {path}")


def save_config(config: AnalysisConfig, path: str) -> None:
    import yaml

    data = asdict(config)
    Path(path).write_text(yaml.safe_dump({"analysis": {k: data[k] for k in ("enabled", "analyzers")}}, allow_unicode=True, sort_keys=False))


def select(kinds: list[str], least: int = 2, sentiment: bool = True) -> AnalysisConfig:
    """The configuration for the names that the command line knows: none, basic_tokens, tokens, spacy, urls, domains, all."""
    if "none" in kinds:
        return AnalysisConfig(enabled=False)
    every = "all" in kinds
    own = []
    if every or "tokens" in kinds:
        own.append(AnalyzerConfig("token_count"))
    if "basic_tokens" in kinds and not every and "spacy" not in kinds:
        own.append(AnalyzerConfig("basic_tokenizer", {"min_token_length": least}))
    if every or "spacy" in kinds:
        own.append(AnalyzerConfig("spacy_analyzer", {"include_sentiment": sentiment}))
    if every or "urls" in kinds:
        own.append(AnalyzerConfig("url_analyzer"))
    if every or "domains" in kinds:
        own.append(AnalyzerConfig("domain_stats"))
    return AnalysisConfig(analyzers=own)
