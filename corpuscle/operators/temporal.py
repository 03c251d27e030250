"""Trajectories of terms over time, and what is computed from each of their series."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpuscle.functions import stats
from corpuscle.functions.text import positions
from corpuscle.operators import semantic, series
from corpuscle.operators.corpus import Corpus, period_label, unit_of


def track(corpus: Corpus, target: str | Sequence[str]) -> Tracker:
    targets = [target] if isinstance(target, str) else list(target or [])
    if not targets or any(not isinstance(t, str) or not t for t in targets):
        raise ValueError("give a term or several")
    return Tracker(corpus, tuple(dict.fromkeys(targets)))


class Tracker:
    def __init__(self, corpus: Corpus, targets: tuple[str, ...]):
        self.corpus, self.targets = corpus, targets

    def over_time(self, freq: str = "Y", time_col: str = "date", confidence: float = 0.95) -> Trajectory:
        """(period, period_label, term, count, total, relfreq, ci_lower, ci_upper): all targets in one job."""
        dated = self.corpus.by_time(time_col, freq).docs.filter("period is not null")
        timed = Corpus(dated, self.corpus.text_col, tokenizer=self.corpus.tokenizer)
        hits = [F.sum(F.size(positions(F.col("tokens"), t)).cast("long")).alias(f"h{i}") for i, t in enumerate(self.targets)]
        sums = timed.token_lists("period").groupBy("period").agg(F.sum(F.size("tokens").cast("long")).alias("total"), *hits)
        pairs = F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"h{i}").alias("count")) for i, t in enumerate(self.targets)])
        long = sums.select("period", "total", F.explode(pairs).alias("p")).select("period", "p.term", "p.count", "total")
        low, high = stats.wilson(F.col("count"), F.col("total"), confidence)
        rate = F.when(F.col("total") == 0, stats.NAN).otherwise(F.col("count") / F.nullif("total", F.lit(0)))
        table = long.select(
            "period", period_label(F.col("period"), unit_of(freq)).alias("period_label"), "term", "count", "total", rate.alias("relfreq"), low.alias("ci_lower"), high.alias("ci_upper")
        )
        return Trajectory(table.orderBy("term", "period"), freq)

    trajectory = over_time

    def semantic_over_time(self, embedder=None, freq: str = "Y", time_col: str = "date", **options) -> DataFrame:
        """How far each target's contexts are from those of its baseline, by period."""
        return semantic.semantic_trajectory(self.corpus, self.targets, time_col, freq, embedder, **options)


def event_trajectory(events: DataFrame, time_col: str, term_col: str, freq: str = "D", confidence: float = 0.95) -> DataFrame:
    """The same table where each row is one token already."""
    unit = unit_of(freq)
    counts = events.groupBy(F.date_trunc(unit, F.col(time_col)).cast("date").alias("period"), F.col(term_col).alias("term")).agg(F.count("*").alias("count"))
    table = counts.withColumn("total", F.sum("count").over(Window.partitionBy("period")))
    low, high = stats.wilson(F.col("count"), F.col("total"), confidence)
    return table.select("period", period_label(F.col("period"), unit).alias("period_label"), "term", "count", "total", (F.col("count") / F.col("total")).alias("relfreq"), low.alias("ci_lower"), high.alias("ci_upper"))


class Trajectory:
    """A trajectory table, and one job for each analysis of all its terms."""

    def __init__(self, table: DataFrame, freq: str = "Y"):
        self.table, self.freq = table, freq

    def to_df(self) -> DataFrame:
        return self.table

    def of(self, target: str | None) -> DataFrame:
        if target is None:
            if self.table.select("term").distinct().limit(2).count() > 1:
                raise ValueError("the trajectory has several terms; name one, or use each()")
            return self.table
        found = self.table.filter(F.col("term") == target)
        if found.limit(1).count() == 0:
            raise ValueError(f"no trajectory of {target!r}")
        return found

    def each(self, kernel, schema: str, table: DataFrame | None = None) -> DataFrame:
        """kernel(pdf of one term, by period) -> pdf; the term is put before its columns."""

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("period").reset_index(drop=True)
            out = kernel(pdf)
            out.insert(0, "term", pdf["term"].iloc[0])
            return out

        return (self.table if table is None else table).groupBy("term").applyInPandas(run, f"term string, {schema}")

    def changepoints(self, target: str | None = None, method: str = "pelt", penalty: float | None = None, model: str = "rbf") -> DataFrame:
        """(term, period, index, method)."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            at = series.detect_changepoints(pdf["relfreq"].to_numpy(float), method, penalty, model)
            return pd.DataFrame({"period": pdf["period"].iloc[at].to_numpy(), "index": np.asarray(at, np.int64), "method": method})

        return self.each(kernel, "period date, index long, method string", self.of(target) if target else None)

    def changepoints_online(self, target: str | None = None, **options) -> DataFrame:
        """(term, period, value, map_run_length, cp_probability, cp_recent)."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            r = series.bocpd(pdf["relfreq"].to_numpy(float), **options)
            return pd.DataFrame({
                "period": pdf["period"], "value": pdf["relfreq"], "map_run_length": r.map_run_length, "cp_probability": r.cp_probability, "cp_recent": r.cp_probability_recent(),
            })

        return self.each(kernel, "period date, value double, map_run_length long, cp_probability double, cp_recent double", self.of(target) if target else None)

    def burstiness(self, target: str | None = None, s: float = 2.0, gamma: float = 1.0, n_states: int = 5) -> DataFrame:
        """(term, period, count, total, state)."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            state = series.kleinberg_bursts(pdf["count"].to_numpy(float), pdf["total"].to_numpy(float), s, gamma, n_states)
            return pd.DataFrame({"period": pdf["period"], "count": pdf["count"], "total": pdf["total"], "state": state})

        return self.each(kernel, "period date, count long, total long, state long", self.of(target) if target else None)

    def bursts(self, target: str | None = None, **options) -> DataFrame:
        """(term, start, end, n_periods, max_state, total_count, mean_relfreq) of the runs above state 0."""
        states = self.burstiness(target, **options)
        by, order = Window.partitionBy("term").orderBy("period"), Window.partitionBy("term", "up").orderBy("period")
        runs = states.withColumn("up", F.col("state") > 0).withColumn("run", F.row_number().over(by) - F.row_number().over(order)).filter("up")
        return runs.groupBy("term", "run").agg(
            F.min("period").alias("start"), F.max("period").alias("end"), F.count("*").alias("n_periods"), F.max("state").alias("max_state"),
            F.sum("count").alias("total_count"), F.avg(F.col("count") / F.col("total")).alias("mean_relfreq"),
        ).drop("run").orderBy("term", "start")

    def interrupted_time_series(self, event: str, target: str | None = None) -> DataFrame:
        """(term, coefficient, coef, std_err, t, p_value, ci_lower, ci_upper): four rows a term."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int((pd.to_datetime(pdf["period"]) < pd.Timestamp(event)).sum())
            return series.interrupted(pdf["relfreq"].to_numpy(float), at)

        return self.each(kernel, "coefficient string, coef double, std_err double, t double, p_value double, ci_lower double, ci_upper double", self.of(target) if target else None)

    def causal_impact(self, event: str, target: str | None = None, **options) -> DataFrame:
        """A row for each period: observed, counterfactual and effects with their bounds."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int((pd.to_datetime(pdf["period"]) < pd.Timestamp(event)).sum())
            table, _ = series.causal_impact(pdf["relfreq"].to_numpy(float), at, **options)
            table.insert(0, "period", pdf["period"])
            return table

        return self.each(kernel, "period date, " + ", ".join(f"{c} double" for c in series.IMPACT_COLUMNS), self.of(target) if target else None)

    def causal_metrics(self, event: str, target: str | None = None, **options) -> DataFrame:
        """(term, metric, value)."""

        def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
            at = int((pd.to_datetime(pdf["period"]) < pd.Timestamp(event)).sum())
            _, m = series.causal_impact(pdf["relfreq"].to_numpy(float), at, **options)
            return pd.DataFrame({"metric": list(m), "value": [float(v) for v in m.values()]})

        return self.each(kernel, "metric string, value double", self.of(target) if target else None)

    def forecast(self, targets: Sequence[str] | None = None, horizon: int = 4, level: float = 0.95, method: str = "auto", logit_transform: bool = True) -> DataFrame:
        """(term, period, point, ci_lower, ci_upper) of the next periods."""
        table = self.table if targets is None else self.table.filter(F.col("term").isin(list(targets)))
        return forecast_table(table, "relfreq", self.freq, horizon, level, method, logit_transform, upper=1.0)

    def to_combined(self, **options) -> DataFrame:
        """(period, term, value, ci_lower, ci_upper, kind): what was observed, then the forecast."""
        seen = self.table.select("period", "term", F.col("relfreq").alias("value"), "ci_lower", "ci_upper", F.lit("observed").alias("kind"))
        new = self.forecast(**options).select("period", "term", F.col("point").alias("value"), "ci_lower", "ci_upper", F.lit("forecast").alias("kind"))
        return seen.unionByName(new).orderBy("term", "period")


OFFSETS = {"year": pd.DateOffset(years=1), "quarter": pd.DateOffset(months=3), "month": pd.DateOffset(months=1), "week": pd.DateOffset(weeks=1), "day": pd.DateOffset(days=1)}


def forecast_table(table: DataFrame, value: str, freq: str, horizon: int, level: float, method: str, logit: bool, upper: float | None, key: str = "term") -> DataFrame:
    if horizon < 1:
        raise ValueError("the horizon is at least one period")
    if not 0 < level < 1:
        raise ValueError("a level lies between 0 and 1")
    if method not in ("auto", "ets", "holt"):
        raise ValueError(f"unknown method {method!r}")
    step = OFFSETS[unit_of(freq)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        point, low, high = series.forecast(pdf[value].to_numpy(float), horizon, level, method, logit)
        if not logit:  # distances are not negative
            point, low = np.maximum(point, 0), np.maximum(low, 0)
        last, dates = pd.Timestamp(pdf["period"].iloc[-1]), []
        for _ in range(horizon):
            last = last + step
            dates.append(last.date())
        return pd.DataFrame({key: pdf[key].iloc[0], "period": dates, "point": point, "ci_lower": low, "ci_upper": high})

    return table.groupBy(key).applyInPandas(run, f"{key} string, period date, point double, ci_lower double, ci_upper double").orderBy(key, "period")


def forecast_semantic_drift(trajectory: DataFrame, freq: str = "Y", horizon: int = 4, level: float = 0.95, method: str = "auto") -> DataFrame:
    """(target, period, point, ci_lower, ci_upper) of the distance from the baseline; bounds are not below 0."""
    real = trajectory.filter(~F.isnan("distance_from_baseline"))
    return forecast_table(real, "distance_from_baseline", freq, horizon, level, method, False, None, key="target")
