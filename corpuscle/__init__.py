"""Comparative corpus analytics on Spark DataFrames."""

from __future__ import annotations

__version__ = "0.1.0"

_HOME = {
    "Corpus": "operators.corpus", "CorpusSlice": "operators.corpus", "TemporalCorpus": "operators.corpus",
    "RegexTokenizer": "functions.text", "NgramTokenizer": "functions.text",
    "compare": "plans.compare", "before_after": "plans.compare", "against_baseline": "plans.compare", "network": "plans.compare",
    "track": "operators.temporal", "keyness_multi": "operators.keyness", "match": "operators.matching",
    "lexical_diversity": "operators.lexical", "hill_numbers": "operators.lexical", "rarefaction": "operators.lexical",
    "kwic": "operators.collocation", "kwic_compare": "operators.collocation", "representative_docs": "operators.collocation",
    "semantic_trajectory": "operators.semantic", "neighborhood_drift": "operators.semantic", "HashEmbedder": "operators.semantic",
    "induce_senses": "operators.senses", "sense_drift": "operators.senses", "knn_density_drift": "operators.senses",
    "read_csv": "sources.readers", "read_parquet": "sources.readers", "read_txt": "sources.readers", "from_dataframe": "sources.readers",
    "from_sql": "sources.readers", "baseline_from_corpus": "sources.baselines", "load_baseline": "sources.baselines",
}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    """Names are found when first used, so that workers load only what a function of theirs needs."""
    if name not in _HOME:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"corpuscle.{_HOME[name]}"), name)
