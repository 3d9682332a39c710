"""orthoweave: Spark operators for feature matching, match graphs, camera geometry and rasters."""
