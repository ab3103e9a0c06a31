"""Query registry, SQL twins and lineage control."""
