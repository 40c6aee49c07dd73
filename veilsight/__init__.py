"""veilsight: discovery of indirectly identifying attributes and re-identification risk, as Spark plans."""

__version__ = "0.1.0"
