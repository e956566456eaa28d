"""Per-document analyzers behind one interface: a name, and the columns it adds."""

from zbior.analyzers.builtin import BUILTIN
from zbior.analyzers.config import AnalysisConfig, AnalyzerConfig, load_config, save_config
from zbior.analyzers.registry import Analyzer, create, list_analyzers, register, run

__all__ = ["BUILTIN", "AnalysisConfig", "Analyzer", "AnalyzerConfig", "create", "list_analyzers", "load_config", "register", "run", "save_config"]
