"""What Spark plans to do: scan footprints, and the registered queries."""
