"""Pipelines of named frames: features, alignment, primary and metalabel models, positions.

A feature step is ``df -> df`` over one named frame; a model is ``df -> df`` that adds ``side_pred`` and, if it has any,
probabilities in an array column ``probability`` in the order of its classes.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.align import align_on
from barloom.operators.bet_sizing import bet_sizes
from barloom.operators.labels import daily_volatility
from barloom.schema import must, require_columns, unique_keys

Step = Callable[[DataFrame], DataFrame]
KEYS = ["series_id", "ts"]


def feature_union(*steps: Step) -> Step:
    """All steps' new columns side by side on the input's rows."""

    def run(df: DataFrame) -> DataFrame:
        out = df
        for step in steps:
            out = step(out)
        new = [c for c in out.columns if c not in df.columns]
        return out.select(*KEYS, *new)

    return run


@dataclass
class StrategySignalPipeline:
    """features: a step per named frame; align_on: the frame whose keys lead; align_methods: mean, max or min per frame."""

    features: dict[str, Step]
    primary: Step
    align_on: str | None = None
    align_methods: dict[str, str] = field(default_factory=dict)
    metalabel_features: dict[str, Step] = field(default_factory=dict)
    metalabel: Step | None = None
    use_predictions: bool = True
    use_probabilities: bool = False
    num_classes: int = 3
    classes: tuple[float, ...] = (-1.0, 0.0, 1.0)
    bet_sizer: dict[str, Any] | None = None

    def transform(self, frames: dict[str, DataFrame], features: dict[str, Step] | None = None) -> dict[str, DataFrame]:
        steps = self.features if features is None else features
        if set(frames) != set(steps):
            raise AssertionError(f"frames {sorted(frames)} and features {sorted(steps)} must have the same names")
        return {k: steps[k](frames[k]) for k in steps}

    def aligned(self, frames: dict[str, DataFrame], features: dict[str, Step] | None = None) -> DataFrame:
        """All features on the leading frame's keys, rows with nulls dropped."""
        ready = self.transform(frames, features)
        lead = self.align_on or next(iter(ready))
        out = ready[lead]
        for name, df in ready.items():
            if name != lead:
                df = align_on(out.select(*KEYS), df, self.align_methods.get(name, "mean")) if self.align_on else df
                out = out.join(df, KEYS, "full")
        return out.na.drop(how="any")

    def _meta_rows(self, frames: dict[str, DataFrame], predicted: DataFrame) -> DataFrame:
        rows = self.aligned({k: frames[k] for k in self.metalabel_features}, self.metalabel_features) if self.metalabel_features else predicted.select(*KEYS)
        extra = [F.col("side_pred").alias("primary_side_pred")] * self.use_predictions
        if self.use_probabilities:
            extra += [F.get("probability", F.lit(i)).alias(f"primary_side_pred_proba_{i}") for i in range(self.num_classes)]
        out = rows.join(predicted.select(*KEYS, *extra), KEYS)
        for c in (c for c in out.columns if c not in KEYS):
            out = must(out, F.col(c).isNotNull(), f"the metalabel model's column {c} has a NULL")
        return out

    def _check_ranges(self, frames: dict[str, DataFrame]) -> None:
        """An action where frames are aligned: an error if a series' frame ends before the leading one starts, a warning if it
        starts earlier or later by more than a tenth of the leading frame's time."""
        for name in (n for n in frames if self.align_on and n != self.align_on):
            lead = frames[self.align_on].groupBy("series_id").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
            own = frames[name].groupBy("series_id").agg(F.min("ts").alias("b"), F.max("ts").alias("y"))
            seconds = lambda c: F.col(c).cast("timestamp").cast("double")
            off = F.abs(seconds("b") - seconds("a")) > (seconds("z") - seconds("a")) / 10
            apart, late = lead.join(own, "series_id").agg(F.count_if(F.col("a") > F.col("y")), F.count_if(off)).first()
            if apart:
                raise ValueError(f"no time of {name} meets {self.align_on} in {apart} series")
            if late:
                warnings.warn(f"{name} starts much earlier or later than {self.align_on} in {late} series", stacklevel=3)

    def dataset_primary(self, frames: dict[str, DataFrame], y: DataFrame, label: str = "label") -> DataFrame:
        return self.aligned(frames).join(y.where(F.col(label).isNotNull()).select(*KEYS, label), KEYS)

    def dataset_metalabeling(self, frames: dict[str, DataFrame], y: DataFrame, label: str = "label") -> DataFrame:
        """Metalabel features with y_meta: whether the primary model is right."""
        predicted = self.primary(self.aligned({k: frames[k] for k in self.features}))
        rows = self._meta_rows(frames, predicted)
        truth = y.where(F.col(label).isNotNull()).select(*KEYS, F.col(label).alias("__y"))
        right = predicted.select(*KEYS, F.col("side_pred").alias("__p")).join(truth, KEYS)
        return rows.join(right.select(*KEYS, (F.col("__p") == F.col("__y")).cast("double").alias("y_meta")), KEYS)

    def predict(self, frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """primary: rows with side_pred; metalabeling, if there is such a model: rows with meta_proba."""
        self._check_ranges(frames)
        predicted = self.primary(self.aligned({k: frames[k] for k in self.features}))
        out = {"primary": predicted}
        if self.metalabel:
            out["metalabeling"] = self.metalabel(self._meta_rows(frames, predicted))
        return out

    def get_side_and_size(self, frames: dict[str, DataFrame]) -> DataFrame:
        """(series_id, ts, side, size): the primary side; the size by bet sizing, the metalabel's chance, or the primary's."""
        done = self.predict(frames)
        rows = done["primary"].select(*KEYS, F.col("side_pred").cast("double").alias("side"), *(["probability"] if "probability" in done["primary"].columns else []))
        if self.metalabel:
            rows = rows.join(done["metalabeling"].select(*KEYS, F.col("meta_proba").cast("double")), KEYS)
        if self.bet_sizer is not None:
            prob = F.greatest(F.col("meta_proba"), 1 - F.col("meta_proba")) if self.metalabel else F.array_max("probability")
            pred = F.when(F.col("meta_proba") >= 0.5, 1.0).otherwise(0.0) if self.metalabel else F.element_at(F.array(*[F.lit(c) for c in self.classes]), F.array_position("probability", F.array_max("probability")).cast("int"))
            work = rows.withColumn("__prob", prob).withColumn("__pred", pred)
            sized = bet_sizes(work, **({"num_classes": 2 if self.metalabel else self.num_classes, "meta_labeling": bool(self.metalabel), "probability": "__prob", "prediction": "__pred", "out": "size"} | self.bet_sizer))
            rows = sized if "side" in sized.columns else rows.join(sized.select(*KEYS, "size"), KEYS)
        else:
            rows = rows.withColumn("size", F.col("meta_proba") if self.metalabel else F.array_max("probability"))
        return rows.select(*KEYS, "side", "size").na.drop()


@dataclass
class StrategyTrader:
    """Signals with stop and profit distances. Options without effect on results are kept as they are given."""

    pipeline: StrategySignalPipeline
    volatility_frame: str = "bars"
    volatility_window: int = 100
    volatility_adjusted: bool = True
    profit_taking_factor: float | None = None
    stop_loss_factor: float | None = None
    num_expiration_bars: int | None = None
    closing_positions_model: Callable[[dict[str, DataFrame]], str | None] | None = None
    options: dict[str, Any] = field(default_factory=dict)

    def determine_positions_to_close(self, frames: dict[str, DataFrame]) -> str | None:
        """None, all, long or short, as the closing model says."""
        said = self.closing_positions_model(frames) if self.closing_positions_model else None
        if said not in (None, "all", "long", "short"):
            raise ValueError("a closing model gives None, all, long or short")
        return said

    def create_signal(self, frames: dict[str, DataFrame]) -> DataFrame:
        """(series_id, ts, side, size, strategy_valid): sides within [-1, 1] and sizes within [0, 1]; repeated keys in a frame are an error."""
        rows = self.pipeline.get_side_and_size({k: unique_keys(df, f"the frame {k}") for k, df in frames.items()})
        valid = F.col("side").between(-1, 1) & F.col("size").between(0, 1)
        return rows.withColumn("strategy_valid", valid)

    def create_strategy_bars(self, bars: DataFrame, close: str = "close") -> DataFrame:
        """(series_id, ts, stop_loss, profit_taking, num_expiration_bars): factors times daily volatility, or as they are."""
        require_columns(bars, *KEYS, close)
        work = daily_volatility(bars, self.volatility_window, close) if self.volatility_adjusted else bars.withColumn("daily_vol", F.lit(1.0))
        by = lambda f: F.col("daily_vol") * F.lit(f).cast("double")
        return work.select(*KEYS, by(self.stop_loss_factor).alias("stop_loss"), by(self.profit_taking_factor).alias("profit_taking"), F.lit(self.num_expiration_bars).cast("int").alias("num_expiration_bars"))

    def create_position(self, frames: dict[str, DataFrame]) -> DataFrame:
        signal, bars = self.create_signal(frames), self.create_strategy_bars(frames[self.volatility_frame])
        both = signal.join(bars, KEYS, "full").select(*KEYS, "side", "size", "stop_loss", "profit_taking", "num_expiration_bars")
        return unique_keys(both, "the position")
