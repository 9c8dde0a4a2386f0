"""grainmill: a PySpark engine for knowledge retrieval, memory scoring and corpus preparation."""
