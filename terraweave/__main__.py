"""``python -m terraweave COMMAND ...``

forward CONF          features to triples, by a settings file
reverse CONF          triples to features, by a settings file and its query
scheme FILE           tiers, categories and the listing of a classification file
sanity PATH [QUERY]   counts of the triples below a path, or the rows of a query file
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from terraweave.operators import classification
from terraweave.plans import config, pipeline
from terraweave.sinks import rdf as rdf_sinks
from terraweave.sources import rdf


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in ("forward", "reverse", "scheme", "sanity"):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("terraweave").getOrCreate()
    command, path = args[:2]
    if command in ("forward", "reverse"):
        settings = config.load(pipeline.text_of(spark, path))
        if command == "reverse":
            pipeline.write_reverse(spark, settings)
        elif settings.mode.upper() == "XSLT":
            rdf_sinks.write(pipeline.xml_triples(spark, settings), f"{settings.output.rstrip('/')}/triples", "RDF/XML")
        else:
            pipeline.Forward(spark, settings).write()
    elif command == "scheme":
        parse = classification.parse_csv if path.lower().endswith(".csv") else classification.parse_indented
        found = classification.frame(spark, parse(pipeline.text_of(spark, path)))
        print(classification.statistics(found).first().asDict())
        for row in classification.listing(found).orderBy("path").toLocalIterator():
            print(row["line"])
    else:
        query = pipeline.text_of(spark, args[2]) if len(args) > 2 else None
        pipeline.sanity(rdf.read(spark, path), query).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
