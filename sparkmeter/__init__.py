"""Agent-usage and prompt-context analytics on Spark."""
