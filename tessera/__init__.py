"""Entity alignment of large knowledge graphs as DataFrame operators."""
