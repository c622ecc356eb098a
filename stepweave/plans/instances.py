"""Instance timing from end to end, each stage computed once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame

from stepweave.operators import phases, rollup
from stepweave.operators.nesting import main_thread_tree
from stepweave.plans.tables import TraceTables
from stepweave.session import materialize


class InstanceTiming:
    """Stacks -> instance weights per kernel -> self time -> inclusive time -> panels."""

    def __init__(self, t: TraceTables, sources: DataFrame, spans: DataFrame):
        self.t, self.sources, self.spans = t, sources, spans

    @cached_property
    def _step_phases(self) -> tuple[DataFrame, DataFrame]:
        steps, parts = phases.step_phases(self.t.events, main_thread_tree(self.t.events))
        return materialize(steps), materialize(parts)

    @property
    def steps(self) -> DataFrame:
        return self._step_phases[0]

    @property
    def phases(self) -> DataFrame:
        return self._step_phases[1]

    @cached_property
    def attribution(self) -> DataFrame:
        return materialize(rollup.kernel_attribution(self.t, self.sources, self.spans))

    @cached_property
    def counters(self) -> DataFrame:
        return materialize(rollup.attribution_counters(self.t, self.attribution))

    @cached_property
    def self_times(self) -> DataFrame:
        return materialize(rollup.self_times(self.attribution, self.steps, self.phases))

    def _times(self, roots: Sequence[str] = (), mode: str = "transitive") -> DataFrame:
        return rollup.instance_times(self.self_times, self.spans, roots, mode)

    def _panel(self, roots: Sequence[str] = ()) -> DataFrame:
        return rollup.timing_panel(self._times(roots))

    def times(self, roots: Sequence[str] = (), mode: str = "transitive") -> DataFrame:
        return rollup.in_ns(self._times(roots, mode))

    def panel(self, roots: Sequence[str] = ()) -> DataFrame:
        return rollup.in_ns(self._panel(roots))

    def class_times(self, roots: Sequence[str] = ()) -> DataFrame:
        return rollup.in_ns(rollup.class_times(self._panel(roots)))

    def summary(self) -> DataFrame:
        return rollup.in_ns(rollup.instance_summary(self.counters, self.steps, self.self_times))  # the roll-up adds no self time
