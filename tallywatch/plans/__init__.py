"""End-to-end flows put together from the operators."""
