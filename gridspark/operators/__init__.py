"""DataFrame -> DataFrame operators. Key columns are arguments; nothing collects."""
