"""From a table hierarchy to one imputed, encoded row per entity."""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from hierfeat.operators.assemble import (
    add_joined_flag,
    attach_children,
    fill_joined_flags,
    join_to_base,
    restrict,
)
from hierfeat.operators.impute import Imputer, ImputerModel
from hierfeat.operators.rollup import WIDE_COLUMNS, rollup_children, rollup_history
from hierfeat.operators.sampling import stratified_sample
from hierfeat.operators.skew import HotKeys, find_hot_keys
from hierfeat.session import stored
from hierfeat.sources.export import export_chunk_files, export_profile, export_table
from hierfeat.sources.shards import scan_table
from hierfeat.spec import CASE, BuildConfig, HierarchySpec, TableSpec

logger = logging.getLogger(__name__)

Reader = Callable[[str], DataFrame]


def assemble_matrix(
    read: Reader, spec: HierarchySpec, ids: DataFrame | None = None, iqr: str | None = "nearest"
) -> DataFrame:
    """Base rows with every table of the hierarchy rolled up and joined on, flags filled.

    ``ids`` restricts every table before it is rolled up; without it nothing is dropped.
    """

    def rows(table: TableSpec) -> tuple[DataFrame, HotKeys | None]:
        """Flagged rows of a table, and its hot keys as far as anything depends on them."""
        stored = read(table.name)
        hot = None
        if table.depth and (ids is not None or (iqr and table.depth == 1)):
            # Counted on the stored table: one column, no joins.
            hot = find_hot_keys(stored.select(CASE), [CASE], WIDE_COLUMNS)
        kept = stored if ids is None else restrict(stored, ids, hot=hot)
        return add_joined_flag(kept, table.name), hot

    base = read(spec.base)
    base = base if ids is None else restrict(base, ids)
    children = defaultdict(list)
    for table in spec.at_depth(2):
        children[table.parent].append(rollup_children(rows(table)[0], order=table.order_columns))
    joined = []
    for table in spec.at_depth(1):
        history, hot = rows(table)
        if children[table.name]:
            # Joined once; numbers and categories then each read their own columns of it.
            history = stored(attach_children(history, children[table.name]), "history")
        joined.append(rollup_history(history, order=table.order_columns, iqr=iqr, hot=hot, null_keys=False))
    joined += [rows(table)[0] for table in spec.at_depth(0)]
    return fill_joined_flags(join_to_base(base, joined))


@dataclass
class FeatureBuild:
    """One run over a data folder: training learns and stores the state, inference replays it."""

    spec: HierarchySpec
    config: BuildConfig

    def run(self, spark: SparkSession, export: bool = True) -> DataFrame:
        config = self.config
        spec = self.spec.for_mode(config.is_inference)

        def read(table: str) -> DataFrame:
            return scan_table(spark, table, config.data_dir)

        ids = None
        if not config.is_inference and 0.0 < config.sample_ratio < 1.0:
            # Every table is restricted by them; drawn once.
            ids = stored(
                stratified_sample(
                    read(spec.base), config.sample_ratio, random_state=config.seed, exact=config.exact_sample
                ),
                "sample",
            )
        state = f"{config.artifact_dir}/imputer_state"
        if config.is_inference:
            # Load first: a missing state must fail before any work is done.
            model = ImputerModel.load(spark, state)
            features = model.transform(assemble_matrix(read, spec, ids))
        else:
            # Fitting reads the matrix several times; it is stored once instead.
            matrix = stored(assemble_matrix(read, spec, ids), "matrix")
            model = Imputer().fit(matrix)
            model.save(state)
            features = model.transform_training(matrix)
        if export:
            self.export(features)
        return features

    def export(self, features: DataFrame) -> None:
        config = self.config
        mode = "test" if config.is_inference else "train"
        if not config.is_inference:
            export_profile(features, f"{config.output_dir}/feature_statistics")
        if config.chunked_export and not config.is_inference:
            chunks = export_chunk_files(
                features, f"{config.output_dir}/chunks", config.chunk_size, prefix=f"{mode}_chunk"
            )
            logger.info("%d chunks written", len(chunks))
        else:
            export_table(features, f"{config.output_dir}/{mode}_features_unscaled")

