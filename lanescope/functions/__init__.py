"""Column-expression builders. Everything here returns ``pyspark.sql.Column`` objects that
stay inside whole-stage codegen; no Python runs per row."""
