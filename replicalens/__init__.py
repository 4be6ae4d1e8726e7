"""DataFrame and Structured Streaming operators over the metadata of partitioned log-broker clusters."""

__version__ = "0.1.0"
