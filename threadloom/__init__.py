"""Link analysis and entity resolution over case documents, as Spark DataFrame operators."""

__version__ = "0.1.0"
