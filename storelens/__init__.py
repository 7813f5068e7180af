"""storelens: PySpark operators for web-shop search analytics (tables in, tables out)."""
