"""Structured Streaming: micro-batch detection with carried state, and
single-operator stateful twins."""
