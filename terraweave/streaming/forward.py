"""The forward direction over a stream: it keeps no state, so each micro-batch is the same plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from terraweave.operators import filters
from terraweave.operators.triples import TripleBuilder
from terraweave.plans.config import Config
from terraweave.plans.mapping import Mapping
from terraweave.sinks.rdf import ntriples


def triples(features: DataFrame, config: Config, mapping: Mapping | None) -> DataFrame:
    """A stream of triples from a stream of features with ``wkt``."""
    kept = filters.with_geometry(filters.thematic(features, config.condition))
    return TripleBuilder(config, mapping).triples(filters.spatial(kept, config.extent), config.target_srid)


def start(features: DataFrame, config: Config, mapping: Mapping | None, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends N-Triples files below the output folder, each record once."""
    lines = ntriples(triples(features, config, mapping))
    return lines.writeStream.format("text").option("path", config.output).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
