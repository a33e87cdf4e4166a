"""triagelake: dependency-triage analytics expressed as Spark DataFrame plans."""
