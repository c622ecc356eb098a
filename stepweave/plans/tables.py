"""The tables every trace analysis starts from, computed once and shared."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from stepweave.operators import nesting, trace_dims
from stepweave.session import materialize


class TraceTables:
    """An event table and its threads, steps and parents.

    ``threads``, ``steps``, ``summary``, ``parents`` and so on are written to the shared folder on
    first use: the analyses join them again and again, and none should rescan the events
    to rebuild them.
    """

    def __init__(self, events: DataFrame, runner_prefix: str = trace_dims.RUNNER_PREFIX):
        self.events = events
        self.runner_prefix = runner_prefix

    @cached_property
    def threads(self) -> DataFrame:
        return materialize(trace_dims.threads(self.events, self.runner_prefix))

    @cached_property
    def steps(self) -> DataFrame:
        return materialize(trace_dims.steps(self.events))

    @cached_property
    def summary(self) -> DataFrame:
        return materialize(trace_dims.step_summary(self.events))

    @cached_property
    def device_steps(self) -> DataFrame:
        return materialize(trace_dims.device_steps(self.events, self.threads))

    @cached_property
    def parents(self) -> DataFrame:
        return materialize(nesting.event_parents(self.events))

    @cached_property
    def id_modules(self) -> DataFrame:
        """Module per external id."""
        return materialize(nesting.external_id_modules(self.events))

    @cached_property
    def flow_pairs(self) -> DataFrame:
        from stepweave.operators.flows import flow_pairs

        return materialize(flow_pairs(self.events))

    @cached_property
    def frames(self) -> DataFrame:
        """Frames of each distinct stack text."""
        from stepweave.operators import stacks

        return materialize(stacks.stack_frames(stacks.distinct_stacks(self.events)))
