"""Study pipelines composed from the operators."""
