"""quantloom: panel analytics for equity-style data on PySpark."""
