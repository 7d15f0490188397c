"""User-made map and reduce over batches of variants."""

from __future__ import annotations

import copy
import pickle
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import VariantFrame
from ..scratch import discard, materialise
from ..shipping import ship_package

#: States that a task merges in a step of the tree.
FAN_IN = 16
STATE = "part long, state binary"


class Pipeline:
    """Functions from pandas batch to pandas batch, and what to make of the batches at the end.

    map_functs run one after another on each batch of a partition, in one stage. There are two
    kinds of reduction:

    * with a schema, reduce_funct is given the mapped DataFrame and returns the aggregated one, so
      that Spark does partial and final aggregation;
    * without one, or with a reduce_initializer, reduce_funct is a binary function on Python values
      of any kind, as of functools.reduce: each task folds its own mapped batches, beginning with a
      copy of the initializer, and states are merged as a tree of FAN_IN, in the order of the
      rows, by merge_funct (reduce_funct, if none is given). Grouping is Spark's, so merging must
      be associative and the initializer neutral; order is kept, so it needn't be commutative.
      The result is the last state, a value on the driver; it must stay small, the number of states doesn't matter.
    """

    def __init__(
        self, map_functs: Sequence[Callable], schema: str | None = None, reduce_funct: Callable | None = None, after_reduce_funct: Callable | None = None,
        reduce_initializer=None, merge_funct: Callable | None = None,
    ) -> None:
        self.map_functs, self.schema = list(map_functs), schema
        self.reduce_funct, self.after_reduce_funct = reduce_funct, after_reduce_funct
        self.reduce_initializer, self.merge_funct = reduce_initializer, merge_funct

    def append_map_funct(self, funct: Callable) -> None:
        self.map_functs.append(funct)

    def set_reduce_funct(self, funct: Callable, reduce_initializer=None, merge_funct: Callable | None = None) -> None:
        self.reduce_funct, self.reduce_initializer, self.merge_funct = funct, reduce_initializer, merge_funct

    def _mapped(self, variants: VariantFrame) -> DataFrame:
        if self.schema is None:
            raise ValueError("batches become rows by a schema, and this pipeline has none")
        ship_package(variants.df.sparkSession)
        functs = tuple(self.map_functs)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield reduce(lambda held, f: f(held), functs, batch)

        return variants.df.mapInPandas(run, self.schema)

    def map_chunks(self, variants: VariantFrame) -> DataFrame:
        if self.reduce_funct is not None or self.reduce_initializer is not None:
            raise ValueError("this pipeline reduces; use map_and_reduce")
        return self._mapped(variants)

    def map_and_reduce(self, variants: VariantFrame):
        """A DataFrame, or of a pipeline that folds Python values the last one."""
        if self.reduce_funct is None:
            raise ValueError("this pipeline has no reduce function; use map_chunks")
        folds = self.schema is None or self.reduce_initializer is not None
        reduced = self._folded(variants) if folds else self.reduce_funct(self._mapped(variants))
        return self.after_reduce_funct(reduced) if self.after_reduce_funct else reduced

    def _folded(self, variants: VariantFrame):
        ship_package(variants.df.sparkSession)
        functs, step, initializer = tuple(self.map_functs), self.reduce_funct, self.reduce_initializer
        merge = self.merge_funct or step

        def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            state, empty = copy.deepcopy(initializer), initializer is None
            for batch in batches:
                made = reduce(lambda held, f: f(held), functs, batch)
                state, empty = (made if empty else step(state, made)), False
            if not empty:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "state": [pickle.dumps(state)]})

        def join(group: pd.DataFrame) -> pd.DataFrame:
            held = group.sort_values("part")
            return pd.DataFrame({"part": [int(held["part"].iloc[0]) // FAN_IN], "state": [pickle.dumps(reduce(merge, map(pickle.loads, held["state"])))]})

        states = materialise(variants.df.mapInPandas(fold, STATE), "fold")
        while states.count() > 1:
            after = materialise(states.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(join, STATE), "fold")
            discard(states)
            states = after
        last = states.first()
        discard(states)
        return copy.deepcopy(initializer) if last is None else pickle.loads(bytes(last.state))
