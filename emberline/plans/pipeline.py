"""The batch pipeline: detections to scored, labelled rows, with one materialised middle table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from emberline.operators import labels, optical, recurrence, reports, spatial
from emberline.session import checkpoint_root
from emberline.sources import firms, sinks


@dataclass(frozen=True)
class PipelineConfig:
    join: spatial.JoinConfig = field(default_factory=spatial.JoinConfig)
    recurrence: recurrence.RecurrenceConfig = field(
        default_factory=recurrence.RecurrenceConfig)
    cut_after_join: bool = True


def run(detections: DataFrame, polygons: DataFrame, forests: DataFrame | None = None,
        scars: DataFrame | None = None, cfg: PipelineConfig = PipelineConfig()) -> DataFrame:
    """Site join, forest flag, recurrence, alert state and, where given, burn scars.

    The joined table feeds several branches of the recurrence step (key counts, windows, area
    activity), so it is checkpointed once to the shared folder instead of being joined again.
    """
    usable, _ = recurrence.quarantine(detections)
    joined = spatial.join_industrial(usable, polygons, cfg.join)
    joined = recurrence.with_keys(spatial.forest_flag(joined, forests))
    if cfg.cut_after_join:
        checkpoint_root(joined.sparkSession)
        joined = joined.checkpoint()
    out = recurrence.evaluate(joined, cfg.recurrence)
    return out if scars is None else optical.attach_scars(out, scars)


def label(scored: DataFrame) -> DataFrame:
    """Thresholds from the corpus itself, then the labelling rule."""
    return labels.training_corpus(scored)


def ingest(feeds: list[DataFrame]) -> DataFrame:
    """Typed feeds in priority order as one deduplicated corpus."""
    return firms.dedupe(firms.union_feeds([firms.typed(f) for f in feeds]))


def publish(scored: DataFrame, path: str) -> DataFrame:
    """Write the corpus behind the shrink guard and report its span."""
    sinks.write_corpus(scored, path)
    return reports.corpus_span(scored.sparkSession.read.parquet(path))
