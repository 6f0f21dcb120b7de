"""Fixed table schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(**cols: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in cols.items()])


_S, _D, _DT, _L = T.StringType(), T.DoubleType(), T.DateType(), T.LongType()

BARS = _schema(symbol=_S, date=_DT, open=_D, high=_D, low=_D, close=_D, volume=_D)
SERIES = _schema(series_id=_S, date=_DT, value=_D)
HEADLINES = _schema(doc_id=_L, date=_DT, source=_S, text=_S, base_score=_D)
OPTIONS = _schema(
    date=_DT, underlying=_S, expiry=_DT, strike=_D, opt_type=_S, oi=_D, vol=_D,
    close_px=_D, last_px=_D, spot=_D,
)
POSITIONS = _schema(contract=_S, date=_DT, long=_D, short=_D, oi=_D)
FLOWS = _schema(date=_DT, category=_S, buy=_D, sell=_D, net=_D)
CALENDAR = _schema(event=_S, date=_DT, country=_S, impact=_S, source=_S)
SIGNALS = _schema(symbol=_S, date=_DT, score=_D, signal=_S, confidence=_S, stable=_S, hit_rate=_D)
