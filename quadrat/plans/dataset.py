"""The dataset build from end to end: read, map, roll up, filter, subsample, check features, split."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions.keys import class_key
from quadrat.operators import features, prepare, split
from quadrat.operators.allocate import SubsampleOptions
from quadrat.operators.staging import pin, stage
from quadrat.operators.subsample import audit, subsample
from quadrat.operators.weights import WeightOptions, audit_table, class_weights, weight_summary, weights_table
from quadrat.sources import sinks, specs, tables


@dataclass(frozen=True)
class DatasetOptions:
    """What goes into a dataset. Paths are anything that Spark reads.

    ``ref_val_ratios`` are given as text so that they are exact decimals. At least one of the two
    inputs is needed; of the two label lists at most one may be given.
    """

    manifest_path: str | None = None
    native_path: str | None = None
    provider_site: str = "provider"
    native_site: str = "native"
    provider_bucket: str = "features"
    native_bucket: str = "native-features"
    native_prefix: str = "native"
    drop_forms: bool = False
    rollup_csv: str | None = None
    included_csv: str | None = None
    excluded_csv: str | None = None
    ref_val_ratios: tuple[str, str] = ("0.1", "0.1")
    subsample: SubsampleOptions | None = None
    weighting: WeightOptions | None = None
    percent_missing_allowed: float = 0.0
    columns: Mapping[str, str] = field(default_factory=dict)
    annotations_to_log: str | None = None

    def __post_init__(self) -> None:
        if self.included_csv and self.excluded_csv:
            raise ValueError("included_csv and excluded_csv exclude each other.")
        if not self.manifest_path and not self.native_path:
            raise ValueError("A dataset needs manifest_path or native_path.")

    @classmethod
    def from_dict(cls, values: Mapping[str, object]) -> "DatasetOptions":
        """From parsed configuration; unknown keys are refused."""
        known = set(cls.__dataclass_fields__)
        unknown = sorted(set(values) - known)
        if unknown:
            raise ValueError(f"A dataset has no options called {unknown}.")
        made = dict(values)
        for key, kind in (("subsample", SubsampleOptions), ("weighting", WeightOptions)):
            if isinstance(made.get(key), Mapping):
                made[key] = kind(**made[key])
        return cls(**made)


@dataclass
class Dataset:
    """The annotation table with ``training_set``, and the report tables made on the way."""

    annotations: DataFrame
    tables: dict[str, DataFrame]


def build_dataset(
    spark: SparkSession,
    options: DatasetOptions,
    mapping: DataFrame | None,
    listing: DataFrame | None,
    names: DataFrame,
    form_names: DataFrame,
) -> Dataset:
    """Run all stages in their fixed order.

    ``mapping`` is needed with a manifest, ``listing(feature_full)`` names the feature files that
    exist (None skips the check). What several later stages read is written out where making it moves rows: the provider's points with their
    class, the rows kept by the subsample or with features, and the final table. Native points, rollup and filter are
    worked out where they are read, as the lists are of class size; ``retention`` and ``unmapped_labels`` are made when they are wanted.
    """
    out: dict[str, DataFrame] = {}
    parts, stats = [], []
    if options.manifest_path:
        raw = tables.read_manifest(
            spark, options.manifest_path, options.provider_site, options.provider_bucket, options.columns
        )
        stats.append(pin(prepare.project_stats(raw)))
        out["included_sources"] = prepare.source_id_list(stats[0])
        out["label_mapping"] = mapping
        coded = prepare.look_up_labels(raw, mapping)
        out["unmapped_labels"] = prepare.unmapped_labels(coded.where(F.col("label_id").isNotNull()))
        parts.append(stage(prepare.drop_unmapped(coded), "points"))
    if options.native_path:
        native = tables.read_native(
            spark,
            options.native_path,
            options.native_site,
            options.native_bucket,
            options.native_prefix,
            options.columns,
        )
        stats.insert(0, pin(prepare.project_stats(native)))
        parts.append(native)
    points = prepare.append_native(*parts) if len(parts) == 2 else parts[0]
    if options.native_path:
        points = prepare.normal_forms(points)
    out["project_stats_raw"] = reduce(DataFrame.unionByName, stats)
    if options.drop_forms:
        points = prepare.clear_forms(points)
    rollup = specs.load_rollup(spark, options.rollup_csv) if options.rollup_csv else None
    include = specs.load_filter(spark, options.included_csv) if options.included_csv else None
    exclude = specs.load_filter(spark, options.excluded_csv) if options.excluded_csv else None
    for name, spec in (("rollup_spec", rollup), ("labels_included", include), ("labels_excluded", exclude)):
        if spec is not None:
            out[name] = spec
    rolled = prepare.roll_up(points, rollup)
    out["retention"] = prepare.retention_of_marked(prepare.mark_kept(rolled, include, exclude))
    kept = prepare.filter_classes(rolled, include, exclude)
    if options.subsample is not None:
        kept, targets = subsample(kept, options.subsample)
        kept = stage(kept, "annotations")
        out["subsample_audit"] = audit_table(audit(targets, kept), names, form_names)
    if listing is not None:
        kept = features.require_features(
            features.with_full_path(kept), listing, options.percent_missing_allowed
        ).drop("feature_full")
        kept = stage(kept, "annotations")
    final = stage(split.stratified_split(kept, options.ref_val_ratios), "annotations")
    out["project_stats_train_data"] = prepare.project_stats(final, with_splits=True)
    out["attribute_counts"] = split.attribute_counts(final, names)
    out["class_counts"] = split.class_split_counts(final, names, form_names)
    out["train_summary"] = split.train_summary(final)
    out["annotations_val"] = split.validation_rows(final)
    if options.weighting is not None:
        trained = prepare.class_counts(final.where(F.col("training_set") == "train"))
        keyed = pin(class_weights(trained, options.weighting)).select(
            class_key("attribute_id", "form_id").alias("class_key"), "n", "weight"
        )
        out["class_weights"] = weights_table(keyed, names, form_names)
        out["class_weight_summary"] = weight_summary(keyed)
    if options.annotations_to_log:
        spec = options.annotations_to_log.lower()
        out[f"annotations_{spec}"] = split.select_annotations(final, spec, options.provider_site)
    return Dataset(final, out)


def publish(tables_by_name: Mapping[str, DataFrame], path: str) -> None:
    """Write each report table as CSV below ``path``."""
    for name, df in tables_by_name.items():
        sinks.write_csv(df, f"{path}/{name}")
