"""The trial counters on streams: lines arrive while listeners answer."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gatelab.operators.confusion import confusion_counts
from gatelab.operators.trials import parse_trials


def stream_confusion_counts(raw_lines: DataFrame) -> DataFrame:
    """raw_lines as a stream gives running counts; write with output mode update or complete.  State is bounded: at most
    38 * 38 cells per listener, gate and position."""
    return confusion_counts(parse_trials(raw_lines))
