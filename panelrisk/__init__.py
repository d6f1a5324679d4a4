"""Rare-event analytics on an entity x day panel, expressed as Spark jobs."""
