"""The operators as ``pyspark.ml`` transformers: parameters at construction, ``transform(df)``, usable in a Pipeline.

    Pipeline(stages=[RollMeasure(window=10), VPIN(window=10)]).fit(bars).transform(bars)

All are stateless, so there is nothing to fit.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any, ClassVar

from pyspark.ml import Transformer
from pyspark.sql import DataFrame

from barloom.functions import indicators
from barloom.operators import bet_sizing, breaks, labels, microstructure, rolling, sampling, technical
from barloom.schema import identity


class OperatorTransformer(Transformer):
    """Calls an operator with parameters that are checked when it is made."""

    op: ClassVar[Callable[..., DataFrame]]

    def __init__(self, **params: Any):
        super().__init__()
        known = set(list(inspect.signature(type(self).op).parameters)[1:])
        if unknown := set(params) - known:
            raise TypeError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.params_given = params

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return type(self).op(dataset, **self.params_given)


def transformer(name: str, op: Callable[..., DataFrame]) -> type[OperatorTransformer]:
    """A transformer class for any ``op(df, **params)``."""
    return type(name, (OperatorTransformer,), {"op": staticmethod(op), "__doc__": op.__doc__, "__module__": __name__})


Identity = transformer("Identity", identity)
RollingZScore = transformer("RollingZScore", rolling.rolling_z_score)
LocalMaxToCloseRatio = transformer("LocalMaxToCloseRatio", rolling.local_max_to_close)
RollMeasure = transformer("RollMeasure", microstructure.roll_measure)
RollImpact = transformer("RollImpact", microstructure.roll_impact)
ParkinsonVolatility = transformer("ParkinsonVolatility", microstructure.parkinson_volatility)
CorwinSchultzSpread = transformer("CorwinSchultzSpread", microstructure.corwin_schultz_spread)
BeckersParkinsonVolatility = transformer("BeckersParkinsonVolatility", microstructure.beckers_parkinson_volatility)
KyleLambda = transformer("KyleLambda", microstructure.kyle_lambda)
AmihudLambda = transformer("AmihudLambda", microstructure.amihud_lambda)
HasbrouckLambda = transformer("HasbrouckLambda", microstructure.hasbrouck_lambda)
VPIN = transformer("VPIN", microstructure.vpin)
MovingAverageCrossOver = transformer("MovingAverageCrossOver", technical.moving_average_crossover)
ExponentialWeightedDifference = transformer("ExponentialWeightedDifference", technical.ewm_difference)
MACDHistogramCrossOver = transformer("MACDHistogramCrossOver", technical.macd_histogram_crossover)
BuySellImbalance = transformer("BuySellImbalance", technical.buy_sell_imbalance)
MeanReversion = transformer("MeanReversion", technical.mean_reversion)
BarArrivalRSI = transformer("BarArrivalRSI", technical.bar_arrival_rsi)
RSIConfirmation = transformer("RSIConfirmation", technical.rsi_confirmation)
DailyVolatility = transformer("DailyVolatility", labels.daily_volatility)
TripleBarrierLabels = transformer("TripleBarrierLabels", labels.triple_barrier)
TrendScannerLabels = transformer("TrendScannerLabels", labels.trend_scanning)
CUSUMFilter = transformer("CUSUMFilter", sampling.cusum_filter)
BetSizing = transformer("BetSizing", bet_sizing.bet_sizes)
ChuStinchcombeWhite = transformer("ChuStinchcombeWhite", breaks.chu_stinchcombe_white)
DickeyFullerChow = transformer("DickeyFullerChow", breaks.dickey_fuller_chow)
SupremumADF = transformer("SupremumADF", breaks.sup_adf)
EMA, RSI, MACD, SMA = (transformer(n.upper(), getattr(indicators, n)) for n in ("ema", "rsi", "macd", "sma"))
