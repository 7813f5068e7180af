"""storelens functions."""
