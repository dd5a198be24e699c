"""grainmill: crawl, extraction, record, entity and event analytics over web corpora, as Spark plans."""
