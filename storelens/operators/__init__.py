"""storelens operators."""
