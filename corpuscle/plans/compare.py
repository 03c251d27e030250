"""The verbs: compare two corpora, or what came before an event with what came after."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from corpuscle.operators import collocation, keyness, resampling, semantic
from corpuscle.operators.corpus import Corpus
from corpuscle.operators.corpus import before_after as _before_after
from corpuscle.plans.results import CollocationShiftResult, KeynessResult, NetworkResult, SemanticShiftResult
from corpuscle.plans.storage import written


@dataclass(frozen=True)
class Comparison:
    a: Corpus
    b: Corpus

    def keyness(
        self,
        method: str = "log_likelihood",
        formula: str = "rayson",
        effect_size: bool = True,
        dispersion: bool = False,
        min_count: int = 5,
        multiple_comparisons: str = "bh",
        stop_words: Iterable[str] | None = None,
        permutation_n: int = 0,
        permutation_seed: int = 0,
        ci: str = "none",
        n_boot: int = 999,
        ci_level: float = 0.95,
        simultaneous_ci: bool = False,
        cluster_col: str | None = None,
        bootstrap_seed: int = 0,
        denominator: str = "kept",
    ) -> KeynessResult:
        """The keyness table; resampled columns are joined to it by term."""
        if ci not in ("none", "bootstrap"):
            raise ValueError("ci is 'none' or 'bootstrap'")
        table = keyness.keyness(self.a, self.b, method, formula, effect_size, min_count, multiple_comparisons, stop_words, dispersion)
        score = keyness.SCORE.get(method, method)
        if permutation_n or ci == "bootstrap":
            table = written(table)
            terms = table.select("term")
            if permutation_n:
                table = table.join(resampling.permutation_pvalues(self.a, self.b, terms, permutation_n, permutation_seed, denominator), "term", "left")
            if ci == "bootstrap":
                found = resampling.bootstrap_g2_ci(self.a, self.b, terms, formula, n_boot, ci_level, simultaneous_ci, cluster_col, bootstrap_seed, denominator)
                table = table.join(found, "term", "left")
            table = keyness.by_strength(table, method)
        return KeynessResult(table, {"method": method, "formula": formula, "min_count": min_count, "score": score}, (self.a, self.b))

    def collocation_shift(self, target: str, window: int = 5, measure: str = "logDice", min_count: int = 5, smoothing: float = 0.5) -> CollocationShiftResult:
        table = collocation.collocation_shift(self.a, self.b, target, window, measure, min_count, smoothing)
        return CollocationShiftResult(table, {"target": target, "window": window, "measure": measure}, (self.a, self.b))

    def semantic_shift(self, target: str | Sequence[str], embedder=None, window: int = 5, align: str = "none") -> SemanticShiftResult:
        table = semantic.semantic_shift(self.a, self.b, target, embedder, window, align)
        return SemanticShiftResult(table, {"embedder": embedder, "window": window, "align": align}, (self.a, self.b))

    def concordance(self, target: str, n: int = 20, window: int = 5) -> DataFrame:
        return collocation.kwic_compare(self.a, self.b, target, window, n)


def compare(a: Corpus, b: Corpus) -> Comparison:
    return Comparison(a, b)


def before_after(corpus: Corpus, event: str, time_col: str = "date") -> Comparison:
    return Comparison(*_before_after(corpus, event, time_col))


compare.before_after = before_after  # type: ignore[attr-defined]


def against_baseline(corpus: Corpus, baseline, **options) -> KeynessResult:
    return KeynessResult(keyness.against_baseline(corpus, baseline, **options), {"baseline": baseline.name}, (corpus,))


def network(corpus: Corpus, **options) -> NetworkResult:
    return NetworkResult(*collocation.cooccurrence_network(corpus, **options), options)
